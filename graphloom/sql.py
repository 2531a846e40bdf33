"""The library in Spark SQL: functions of texts, and table functions of their parts.

    register(spark)
    spark.sql("SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text, 10, 2) c")

Scalar functions are expressions of Spark and stay in its plans; table
functions are Python, a row at a time in Arrow batches, for what SQL has no
table function for. ``analyze`` checks the arguments when the query is planned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions import fixed

#: (name, arguments, result, body) of the scalar functions.
SCALARS = [
    ("text_words", "t STRING", "ARRAY<STRING>", r"filter(split(t, '\\s+'), w -> w <> '')"),
    ("search_tokens", "t STRING", "ARRAY<STRING>", "regexp_extract_all(lower(t), '[a-z0-9]+', 0)"),
    ("normalize_entity", "t STRING", "STRING", "btrim(btrim(t), ',.;:\\'\"')"),
    ("is_valid_entity", "t STRING", "BOOLEAN", "length(btrim(t)) BETWEEN 3 AND 80 AND NOT array_contains(array({}), lower(btrim(t)))".format(", ".join(f"'{w}'" for w in fixed.QUERY_STOP_WORDS + fixed.GENERIC_ROLES))),
    ("is_junk_predicate", "p STRING", "BOOLEAN", r"length(replace(p, ' ', '')) = 0 OR length(regexp_replace(replace(p, ' ', ''), '[^\\p{L}]', '')) * 10 < length(replace(p, ' ', '')) * 6"),
]


def _is(argument: AnalyzeArgument, kind: type, what: str) -> None:
    if not isinstance(argument.dataType, kind):
        raise ValueError(f"{what} must be {kind.__name__}")


def _split(text: str | None) -> list[str]:
    parts = (s.strip(" \t\r") for s in re.split(r"[.\n]+", text or ""))
    return [s for s in parts if s]


class TextSentences:
    """(sid, sentence) of a text, counted from 1; a null or empty one has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _is(text, StringType, "the text")
        return AnalyzeResult(StructType().add("sid", IntegerType()).add("sentence", StringType()))

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(_split(text), 1)


class TextChunks:
    """(chunk, text) of a text: windows of ``size`` sentences that share ``overlap`` with the next."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _is(text, StringType, "the text")
        for a, what in ((size, "size"), (overlap, "overlap")):
            _is(a, IntegerType, what)
            if not a.isConstantExpression or a.value is None:
                raise ValueError(f"{what} must be a number that is known when the query is planned")
        if not 0 <= overlap.value < size.value:
            raise ValueError("overlap must be less than size, and neither below 0")
        return AnalyzeResult(StructType().add("chunk", IntegerType()).add("text", StringType()))

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        s = _split(text)
        for k, at in enumerate(range(0, len(s), size - overlap)):
            yield k, " ".join(s[at : at + size])


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session, in place of any of the same names; their names."""
    for name, arguments, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, own in (("text_sentences", TextSentences), ("text_chunks", TextChunks)):
        spark.udtf.register(name, udtf(own, useArrow=True))
    return [*(s[0] for s in SCALARS), "text_sentences", "text_chunks"]


def inspection_views(resolved: DataFrame, rules: DataFrame, mentions: DataFrame, sample: int = 30, seed: int = 42) -> list[str]:
    """Views to look through a run with: reject_reasons, object_leaks, domain_rules, mention_sample; their names.

    object_leaks counts accepted triples by relation and object type, with leak
    where the relation takes no such object (``fixed.OBJECT_TYPES``). mention_sample
    has ``sample`` mentions (label, text, words) by hash, the same in each run. ``resolved`` is
    what ``triples.validate_with_repairs`` gives. Empty tables give empty views.
    """
    from .operators import triples

    accepted = resolved.filter("validation_status <> 'rejected'")
    allowed = F.create_map(*[x for k, v in fixed.OBJECT_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("relation")]
    leak = F.coalesce(~F.array_contains(allowed, F.col("object_type")), F.lit(False))
    views = {
        "reject_reasons": triples.reasons(resolved).filter("validation_status = 'rejected'").select("reason", "n"),
        "object_leaks": accepted.groupBy("relation", "object_type", leak.alias("leak")).agg(F.count("*").alias("n")),
        "domain_rules": rules.select("subject", "relation", "object", "frequency"),
        "mention_sample": mentions.orderBy(F.xxhash64(F.lit(seed), "label", "text"), "label", "text").limit(sample).select("label", "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words")),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
