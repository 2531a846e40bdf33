"""Coreference: pronouns and the noun phrases before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaccard
from .extract import tokens

# Fixed values.
SINGULAR, PLURAL = ["it", "its", "he", "she", "him", "her", "his"], ["they", "them", "their", "these", "those"]
# End of the fixed values.


def marked_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words with is_pronoun, is_phrase (a longer word with a capital that is no pronoun) and plural."""
    t = tokens(docs, id_col, text_col)
    bare = F.regexp_replace(F.lower("w"), "[^a-z]", "")
    t = t.withColumn("bare", bare)
    pronoun = F.col("bare").isin(SINGULAR + PLURAL)
    phrase = ~pronoun & F.col("w").rlike("^[A-Z]") & (F.length("bare") > 3)
    plural = F.when(pronoun, F.col("bare").isin(PLURAL)).otherwise(F.col("bare").endswith("s") | F.col("bare").contains("parties"))
    return t.select(id_col, "pos", "w", pronoun.alias("is_pronoun"), phrase.alias("is_phrase"), plural.alias("plural"))


def with_antecedent(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pronouns and phrases of ``marked`` with antecedent, the nearest phrase before of the same number, else the nearest one.

    An as-of lookup by windows: the last phrase of either number up to here. Other words move nowhere.
    """
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(c, F.col("w")), ignorenulls=True).over(w)
    phrase = F.col("is_phrase")
    m = marked.filter("is_pronoun or is_phrase").select("*", last(phrase & F.col("plural")).alias("many"), last(phrase & ~F.col("plural")).alias("one"), last(phrase).alias("any"))
    return m.withColumn("antecedent", F.coalesce(F.when(F.col("plural"), F.col("many")).otherwise(F.col("one")), F.col("any"))).drop("many", "one", "any")


def nearest_antecedent(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc, pos, pronoun, antecedent) of all pronouns, by ``with_antecedent``."""
    return with_antecedent(marked, id_col).filter("is_pronoun").select(id_col, "pos", F.col("w").alias("pronoun"), "antecedent")


def candidates(marked: DataFrame, most: int = 10, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, pos, pronoun, p_plural, candidate, at, c_plural) of the last ``most`` phrases before each pronoun.

    ``keep`` names columns of pronouns that are kept. Phrases hold the last ones up to
    themselves, which pronouns look up, all in one grouping by document.
    """
    few = Window.partitionBy(id_col, "is_phrase").orderBy("pos").rowsBetween(1 - most, 0)
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("is_phrase"), F.collect_list(F.struct(F.col("w").alias("candidate"), F.col("pos").alias("at"), F.col("plural").alias("c_plural"))).over(few))
    m = marked.filter((F.col("is_pronoun") | F.col("is_phrase")) & F.col(id_col).isNotNull()).withColumn("few", own)
    p = m.withColumn("few", F.last("few", ignorenulls=True).over(before)).filter("is_pronoun")
    p = p.select(id_col, "pos", F.col("w").alias("pronoun"), F.col("plural").alias("p_plural"), *keep, F.explode("few").alias("c"))
    return p.select(id_col, "pos", "pronoun", "p_plural", *keep, "c.candidate", "c.at", "c.c_plural")


def pair_features(a: Column, b: Column, distance: Column, a_pronoun: Column, b_pronoun: Column) -> dict[str, Column]:
    """Nine features of two mentions ``distance`` words apart."""
    x, y = F.lower(a), F.lower(b)
    return {
        "distance": F.least(distance / 100, F.lit(1.0)),
        "jaccard": jaccard(F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))),
        "a_pronoun": a_pronoun.cast("double"),
        "b_pronoun": b_pronoun.cast("double"),
        "near": (distance < 20).cast("double"),
        "same": (x == y).cast("double"),
        "capitals": (a.rlike("^[A-Z]") & b.rlike("^[A-Z]")).cast("double"),
        "inside": (F.contains(x, y) | F.contains(y, x)).cast("double"),
        "length_gap": F.abs(F.length(a) - F.length(b)).cast("double"),
    }


def without_overlap(phrases: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Phrases (doc, start, end, ...) that no span (doc, start, end) of dates, numbers or money overlaps."""
    s = spans.select(F.col(id_col).alias("_d"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    return phrases.join(s, (F.col(id_col) == F.col("_d")) & (F.col("start") < F.col("_b")) & (F.col("end") > F.col("_a")), "left_anti")


def compare(by_rule: DataFrame, learnt: DataFrame, most: int = 20, id_col: str = "doc_id") -> DataFrame:
    """(algorithm, doc, pos, pronoun, antecedent, found): the first ``most`` of each document and how many there are."""
    both = by_rule.select(F.lit("rule").alias("algorithm"), id_col, "pos", "pronoun", "antecedent").union(learnt.select(F.lit("learnt"), id_col, "pos", "pronoun", "antecedent"))
    both = both.filter("antecedent is not null")
    of = Window.partitionBy("algorithm", id_col)
    return both.withColumn("found", F.count("*").over(of)).withColumn("k", F.row_number().over(of.orderBy("pos"))).filter(F.col("k") <= most).drop("k")
