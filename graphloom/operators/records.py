"""Training records of several sources: labelled sentences as they come, and spans of documents.

Labelled sentences hold a list of words with labels. Now and then an item has
the word itself as its only key; it is recovered. An item of any other shape
makes its sentence unusable. What became of the records is counted in the pass
that writes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .extract import words_to_spans

#: What ``read_labelled`` takes: items of a list as JSON texts.
RAW = "sentence string, labels array<string>, source_file string"


def _item(raw: Column) -> Column:
    """(word, label, recovered) of an item; null if it is of neither shape."""
    m = F.from_json(raw, "map<string,string>")
    only = F.map_entries(m)[0]
    return (
        F.when(F.map_contains_key(m, F.lit("word")) & F.map_contains_key(m, F.lit("label")), F.struct(m["word"].alias("word"), m["label"].alias("label"), F.lit(False).alias("recovered")))
        .when(F.size(m) == 1, F.struct(only["key"].alias("word"), only["value"].alias("label"), F.lit(True).alias("recovered")))
        .otherwise(F.lit(None).cast("struct<word:string,label:string,recovered:boolean>"))
    )


def read_labelled(raw: DataFrame) -> DataFrame:
    """(source_file, sentence, labels array<struct<word,label>>, status, recovered) of rows of ``RAW``.

    status is kept, unlabelled (all labels O) or skipped: no labels, or an item
    that is no object, has a null word or label, or several keys other than word and label. ``recovered``
    counts the items whose only key was the word. No rows give none.
    """
    items = F.transform(F.coalesce("labels", F.array()), _item)
    d = raw.select("source_file", "sentence", items.alias("i"))
    broken = (F.size("i") == 0) | F.exists("i", lambda x: x.isNull() | x["word"].isNull() | x["label"].isNull())
    status = F.when(broken, "skipped").when(F.exists("i", lambda x: x["label"] != "O"), "kept").otherwise("unlabelled")
    labels = F.transform("i", lambda x: F.struct(x["word"].alias("word"), x["label"].alias("label")))
    recovered = F.size(F.filter("i", lambda x: F.coalesce(x["recovered"], F.lit(False))))
    return d.select("source_file", "sentence", F.when(status != "skipped", labels).alias("labels"), status.alias("status"), F.when(status == "skipped", 0).otherwise(recovered).alias("recovered"))


def as_spans(labelled: DataFrame) -> DataFrame:
    """(source_file, text, entities array<struct<start,end,label,text>>) of the kept sentences of ``read_labelled``."""
    kept = labelled.filter("status = 'kept'")
    numbered = kept.select(F.xxhash64("source_file", "sentence", F.to_json("labels")).alias("sid"), "source_file", "sentence", "labels").dropDuplicates(["sid"])
    spans = words_to_spans(numbered.select("sid", "sentence", "labels"))
    own = spans.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "text"))).alias("entities"))
    return numbered.join(own, "sid").select("source_file", F.col("sentence").alias("text"), "entities")


def combine(spans: DataFrame, labelled: DataFrame) -> DataFrame:
    """(origin, source_file, text, entities): the rows of ``spans`` (text, entities) that have entities, and those of labelled sentences.

    A labelled sentence that repeats one with the same file and labels counts once.
    """
    a = spans.filter(F.size("entities") > 0).select(F.lit("spans").alias("origin"), F.lit(None).cast("string").alias("source_file"), "text", "entities")
    return a.unionByName(as_spans(labelled).withColumn("origin", F.lit("labelled")))


COUNTS = ("sentences", "kept", "unlabelled", "skipped", "with_recovery", "recovered_items")


def observed(labelled: DataFrame) -> tuple[DataFrame, Observation]:
    """``labelled`` and what counts its records while an action runs over it."""
    seen = Observation(f"records-{uuid.uuid4().hex}")
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = (F.count(F.lit(1)), is_("kept"), is_("unlabelled"), is_("skipped"), F.count_if(F.col("recovered") > 0), F.coalesce(F.sum("recovered"), F.lit(0)))
    return labelled.observe(seen, *[c.cast("long").alias(n) for c, n in zip(counts, COUNTS, strict=True)]), seen


def write_training(labelled: DataFrame, path: str) -> dict[str, int]:
    """Writes the kept sentences as JSON, and gives the counts of all records from the same pass."""
    rows, seen = observed(labelled)
    rows.filter("status = 'kept'").select("source_file", "sentence", "labels").write.mode("overwrite").json(path)
    return {n: seen.get[n] for n in COUNTS}
