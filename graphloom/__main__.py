"""``python -m graphloom run``: from a folder of texts to checked triples; ``ask`` answers from them; ``samples`` takes sentences for labelling."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extract, graph, resolve, retrieve, triples
from .session import materialise
from .sources import io, resume

TRIPLE = "subject string, predicate string, object string"


def run(spark: SparkSession, data_dir: str, out_dir: str, limit: int | None = 25, incremental: bool = False, er_threshold: float = 0.72, min_triple_confidence: float = 0.75, gold: str | None = None) -> dict:
    """Mentions, entities, triples and metrics as JSON folders of ``out_dir``, and the manifest of all documents.

    An incremental run extracts from new and changed documents only and replaces
    their rows; those of other documents stay. Entities are resolved over the
    mentions of all documents, old and new, since a new mention may join an old
    entity.
    """
    docs = io.text_folder(spark, data_dir, limit)
    known = io.optional(spark, lambda: spark.read.parquet(f"{out_dir}/manifest"), "path string, sha256 string")
    todo = io.changed(docs, known) if incremental else docs
    todo = materialise(todo.select("doc_id", "path", "text"), "documents")
    m = materialise(extract.mentions(todo), "mentions")
    kept = materialise(_with_kept(spark, m, f"{out_dir}/mentions", todo.select("doc_id")), "all-mentions") if incremental else m
    e = materialise(resolve.resolve(kept.select(F.col("mention_id").alias("id"), "text", "label", F.col("doc_id").alias("filename")), threshold=er_threshold), "entities")
    t = materialise(triples.two_tier(triples.rule_relations(m, e.select("entity_id", "canonical", F.explode("mention_ids").alias("mention_id"))), min_triple_confidence), "triples")
    accepted = t.filter("reason is null")
    metrics = {"documents": todo.count(), "mentions": m.count(), "entities": e.count(), "triples": t.count(), "accepted": accepted.count()}
    if gold:
        key = ["subject", "predicate", "object"]
        metrics |= triples.prf(accepted, io.json_rows(spark, gold, TRIPLE), key).first().asDict()
    done = todo.select("doc_id")
    for name, df in (("mentions", m), ("validated_triples", accepted.drop("reason")), ("rejected_triples", t.filter("reason is not null"))):
        _put(spark, df, f"{out_dir}/{name}", done, incremental)
    e.write.mode("overwrite").json(f"{out_dir}/entities")
    materialise(io.manifest(docs), "manifest").write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return metrics


def _with_kept(spark: SparkSession, new: DataFrame, path: str, done: DataFrame) -> DataFrame:
    """``new`` and the rows at ``path`` of documents that are not ``done`` again."""
    old = io.optional(spark, lambda: spark.read.schema(new.schema).json(path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema))
    return new.unionByName(old.join(done, "doc_id", "left_anti").select(*new.columns))


def _put(spark: SparkSession, new: DataFrame, path: str, done: DataFrame, keep: bool) -> None:
    if keep:
        new = materialise(_with_kept(spark, new, path, done), "merged")
    new.write.mode("overwrite").json(path)


def ask(spark: SparkSession, out_dir: str, question: str, k: int = 5) -> str:
    """Names, passages, paths and facts for a question from what ``run`` has written, as text; an empty question is an error.

    Names without an accepted triple show their rejected ones, marked as unverified.
    """
    if not question.strip():
        raise ValueError("an empty question")
    m = spark.read.json(f"{out_dir}/mentions")
    said = m.groupBy("doc_id", "sentence").agg(F.array_sort(F.collect_set(F.struct("text", "label"))).alias("entities"))
    said = said.select(F.xxhash64("doc_id", "sentence").alias("sid"), F.col("sentence").alias("text"), "entities")

    def edges_of(name: str) -> tuple[DataFrame, DataFrame]:
        t = io.optional(spark, lambda: spark.read.schema(_TRIPLES).json(f"{out_dir}/{name}"), _TRIPLES)
        return graph.build(t.withColumn("seq", F.monotonically_increasing_id()).withColumnRenamed("predicate", "relation"))

    vertices, edges = edges_of("validated_triples")
    _, rejected = edges_of("rejected_triples")
    e = retrieve.Engine(materialise(said, "sentences"), vertices, materialise(edges, "edges"), materialise(rejected, "candidates"))
    return retrieve.report(e.evidence(question, k))


_TRIPLES = "subject string, subject_type string, predicate string, object string, object_type string, confidence double"


def samples(spark: SparkSession, data_dir: str, out_dir: str, limit: int | None = None, batches: int = 8) -> dict:
    """Sentences for labelling from each text of a folder, in batches; a run that was stopped goes on where it was."""
    log = resume.Log(spark, f"{out_dir}/samples")
    removed = log.clean()
    done = log.run(io.text_folder(spark, data_dir, limit).select("doc_id", "text"), "doc_id", extract.label_samples_with_text, batches)
    rows = log.rows()
    return {"batches": done, "removed": removed, "sentences": rows.count() if rows is not None else 0}


def main() -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=["run", "ask", "samples"])
    p.add_argument("question", nargs="?", help="for ask; without one, questions are read line by line")
    p.add_argument("--data-dir")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--limit", type=int, default=25)
    p.add_argument("--incremental", action="store_true")
    p.add_argument("--er-threshold", type=float, default=0.72)
    p.add_argument("--min-triple-confidence", type=float, default=0.75)
    p.add_argument("--gold")
    a = vars(p.parse_args())
    command, question = a.pop("command"), a.pop("question")
    if command != "ask" and not a["data_dir"]:
        p.error(f"{command} needs --data-dir")
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if command == "run":
        print(json.dumps(run(spark, **a)))
        return
    if command == "samples":
        print(json.dumps(samples(spark, a["data_dir"], a["out_dir"], a["limit"])))
        return
    for line in [question] if question else sys.stdin:
        if line.strip():
            print(ask(spark, a["out_dir"], line))


if __name__ == "__main__":
    main()
