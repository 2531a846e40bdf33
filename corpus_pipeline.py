"""A corpus pipeline over ``documents``: rules, near copies, passages, benchmark, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. ``run`` writes each stage's result to the shared folder and rereads it.
All but the last return the columns of ``documents``; other columns that come
along stay as they are, whatever their names. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, near_copies, quality_rules, sentencepiece_codec, suffix_dedup
from graphloom.session import materialise


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside all other columns in one, so that no name can clash."""
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).select(F.struct(*names[:at], *names[at + 1 :]).alias("_row"), F.col(f"c{at}").alias("text"))


def _unpacked(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of before, with ``text`` from the column of that name and its length in n_chars."""
    at = columns.index("text")
    out = [F.col(text) if i == at else F.col("_row")[f"c{i}"] for i in range(len(columns))]
    if "n_chars" in columns:
        out[columns.index("n_chars")] = F.length(text).cast("long")
    return rows.select(*[c.alias(f"c{i}") for i, c in enumerate(out)]).toDF(*columns)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    judged = quality_rules.quality_rules(_packed(docs), "_row", keep_text=True)
    return _unpacked(judged.filter("kept"), docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more on five-word shingles), that of the least id.

    A document without id can't be named as a copy and stays. Rows of equal id
    and text count as one document.
    """
    groups = near_copies.near_copies(docs).filter("doc_id is not null")
    named = groups.groupBy("doc_id").agg(F.max("component_id").alias("c"), F.count("*").alias("n"))
    # written, so that Spark knows its size before it plans to move the texts
    named = materialise(named.filter("c <> doc_id or n > 1"), "copies")
    kept = docs.join(named.filter("c <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = named.filter("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(once)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that come more than once; a text may end up empty."""
    return _unpacked(suffix_dedup.suffix_dedup(_packed(docs)), docs.columns, "kept")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts stay, repeated rows each stay or go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_benchmark(_packed(docs), benchmark)
    return _unpacked(found.filter("_hit = 0"), docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the pieces of each text, which decode to it again; a null text has no pieces, repeated rows each get a row."""
    rows = sentencepiece_codec.encode_texts(_packed(docs))
    kept = [(c, i) for i, c in enumerate(docs.columns) if c in ("doc_id", "lang", "source")]
    own = ("n_bytes", "n_pieces", "n_fallback", "ids_crc32", "decoded_crc32", "round_trip", "pieces")
    return rows.select(*[F.col("_row")[f"c{i}"].alias(c) for c, i in kept], *own)


#: The stages in their order.
STAGES = [
    ("quality_rules", rules_stage),
    ("simhash_near_dedup", near_copies_stage),
    ("suffix_array_dedup", passages_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL can express neither fingerprints nor pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
