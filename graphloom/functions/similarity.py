"""Similarities of names and vectors as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import fixed
from .text import acronym, canonical_key, token_set, years_conflict


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, in lower case; 1 if both are empty."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / F.when(longest == 0, 1).otherwise(longest))


@F.pandas_udf(DoubleType())
def gestalt_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which Spark has no function for."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union == 0, 1).otherwise(union))


def pair_features(a: Column, b: Column, label: Column, file_a: Column, file_b: Column, gestalt: bool = False) -> dict[str, Column]:
    """The five features of a pair of mentions; ``gestalt`` takes the slower ratio for char_sim."""
    x, y = canonical_key(a, label), canonical_key(b, label)
    char = gestalt_similarity(x, y) if gestalt else levenshtein_similarity(x, y)
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    return {
        "char_sim": char,
        "token_jaccard": jaccard(token_set(a), token_set(b)),
        "acronym_match": F.when((acronym(a) != "") & (acronym(a) == acronym(b)), 1.0).otherwise(0.0),
        "same_file": F.when(file_a.eqNullSafe(file_b), 1.0).otherwise(0.0),
        "len_ratio": F.least(F.length(x), F.length(y)) / longest,
    }


def hard_conflict(a: Column, b: Column, label_a: Column, label_b: Column) -> Column:
    """Labels differ, years differ, or a party's key is too short to match another."""
    x, y = canonical_key(a, F.lit("PARTY")), canonical_key(b, F.lit("PARTY"))
    short = (label_a == "PARTY") & ((F.length(x) <= 3) | (F.length(y) <= 3)) & (x != y)
    return ~label_a.eqNullSafe(label_b) | years_conflict(a, b) | short


def er_probability(features: dict[str, Column]) -> Column:
    raw = sum((F.lit(w) * features[k] for k, w in fixed.ER_WEIGHTS.items()), F.lit(fixed.ER_BIAS))
    return 1 / (1 + F.exp(-raw))


def dot(a: Column, b: Column) -> Column:
    """Dot product, which is the cosine of unit vectors."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
