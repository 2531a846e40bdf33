"""Scans and sinks: text folders, nested JSON, graphs, manifests, SQL tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QA_SCHEMA = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"

#: The label of the first phrase that a question holds, in this order.
QUESTION_LABELS = [
    ("parties", "PARTY"), ("party", "PARTY"), ("agreement date", "DATE"), ("effective date", "EFFECTIVE_DATE"), ("expiration date", "DATE"), ("governing law", "JURISDICTION"),
    ("payment", "PAYMENT"), ("notice", "NOTICE"), ("agreement", "AGREEMENT"), ("contract", "CONTRACT"), ("license", "LICENSE"), ("term", "TERM"),
]


def text_folder(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, path, text, sha256) of the ``.txt`` files of a folder, by name; ``limit`` keeps the first."""
    d = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    d = d.select(F.col("_metadata.file_name").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    d = d.withColumn("sha256", F.sha2("text", 256))
    return d.orderBy("path").limit(limit) if limit is not None else d


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold a list, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def optional(spark: SparkSession, read, schema: str) -> DataFrame:
    """What ``read()`` gives, or an empty table of the schema where its path is missing."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def qa_label(question: Column) -> Column:
    q, out = F.lower(question), None
    for phrase, label in QUESTION_LABELS:
        out = F.when(q.contains(phrase), label) if out is None else out.when(q.contains(phrase), label)
    return out


def flatten_qa(raw: DataFrame) -> DataFrame:
    """(text, entities) per paragraph of question-and-answer data that has an answer of a known label."""
    p = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    a = p.select(F.col("p.context").alias("text"), F.explode("p.qas").alias("q")).select("text", F.col("q.question").alias("question"), F.explode("q.answers").alias("a"))
    a = a.withColumn("label", qa_label(F.col("question"))).withColumn("said", F.btrim("a.text")).filter("label is not null and said <> ''")
    e = F.struct(F.col("a.answer_start").alias("start"), (F.col("a.answer_start") + F.length("said")).alias("end"), F.col("label"), F.col("said").alias("text"))
    return a.groupBy("text").agg(F.array_sort(F.collect_set(e)).alias("entities"))


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a node-link file, whose edges are called ``links`` or ``edges``."""
    link = "array<struct<source:string,target:string,relation:string,confidence:double,inferred:boolean>>"
    g = json_rows(spark, path, f"nodes array<struct<id:string,type:string>>, links {link}, edges {link}")
    v = g.select(F.explode("nodes").alias("n")).select("n.id", "n.type")
    e = g.select(F.explode(F.coalesce("links", "edges")).alias("e"))
    return v, e.select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation", "e.confidence", F.coalesce("e.inferred", F.lit(False)).alias("inferred"))


def write_node_link(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON line per vertex or edge, in files of their own folders, and a line of metadata; ``read_node_link`` reads them back."""
    vertices.write.mode("overwrite").json(f"{path}/nodes")
    edges.withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").json(f"{path}/links")
    counts = vertices.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("links")))
    counts.select(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", "links").write.mode("overwrite").json(f"{path}/metadata")


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges that ``write_node_link`` has written."""
    e = spark.read.schema("source string, target string, relation string, confidence double, inferred boolean").json(f"{path}/links")
    e = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation", "confidence", F.coalesce("inferred", F.lit(False)).alias("inferred"))
    return spark.read.schema("id string, type string").json(f"{path}/nodes"), e


def triples_of(spark: SparkSession, path: str, fallback: str | None = None, validated_only: bool = False) -> DataFrame:
    """Triples of a JSON file that is a list, or holds one under ``triples``, ``validated`` or ``relations``.

    Where ``path`` is missing, ``fallback`` is read; keys may have any of the
    usual names and incomplete rows go. ``validated_only`` keeps rows whose
    ``validated`` is true or whose ``validation_status`` is not "rejected".
    """
    from ..operators.retrieve import key_variants

    names = ("source", "subject", "head", "canonical1", "entity1", "relation", "predicate", "label", "rel_type", "target", "object", "tail", "canonical2", "entity2", "validation_status")
    row = ", ".join(f"{n}: string" for n in names) + ", validated: boolean"
    flat = row.replace(": ", " ")
    schema = f"{flat}, " + ", ".join(f"{k} array<struct<{row}>>" for k in ("triples", "validated_triples", "relations"))
    raw = optional(spark, lambda: json_rows(spark, path, schema), schema)
    if fallback and raw.isEmpty():
        raw = optional(spark, lambda: json_rows(spark, fallback, schema), schema)
    own = F.struct(*names, "validated")
    wrapped = F.coalesce("triples", "validated_triples", "relations")
    rows = raw.select(F.explode(F.when(wrapped.isNotNull(), wrapped).otherwise(F.array(own))).alias("t")).select("t.*")
    if validated_only:
        rows = rows.filter(F.coalesce("validated", F.col("validation_status") != "rejected", F.lit(False)))
    return key_variants(rows)


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): node and edge elements; the number of an edge among its parallels is its id."""
    v = vertices.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), escape_xml(F.col("id")), F.lit('"><data key="type">'), escape_xml(F.coalesce("type", F.lit(""))), F.lit("</data></node>")).alias("line"))
    e = edges.withColumn("k", F.row_number().over(Window.partitionBy("src", "dst").orderBy("relation", "confidence")) - 1)
    e = e.select(
        F.lit(2).alias("part"),
        F.concat(
            F.lit('<edge source="'), escape_xml(F.col("src")), F.lit('" target="'), escape_xml(F.col("dst")), F.lit('" id="'), F.col("k").cast("string"), F.lit('"><data key="relation">'), escape_xml(F.col("relation")), F.lit("</data></edge>")
        ).alias("line"),
    )
    return v.union(e)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML as text parts: head and foot are rows too, and parts follow in order."""
    spark = vertices.sparkSession
    head = '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="node" attr.name="type" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    graphml_lines(vertices, edges).union(ends).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)


def sql_tables(vertices: DataFrame, edges: DataFrame, metrics: dict) -> dict[str, DataFrame]:
    """Views entities, relations and metrics (last value wins) for Spark SQL.

    An entity has its first type by ``seq`` where vertices have that column,
    else the least of its types.
    """
    spark = vertices.sparkSession
    kind = F.min_by("type", F.struct("seq", "type")) if "seq" in vertices.columns else F.min("type")
    first = vertices.groupBy(F.col("id").alias("name")).agg(kind.alias("type"))
    e = edges.select(F.col("src").alias("subject"), "relation", F.col("dst").alias("object"), "confidence", (F.col("inferred") if "inferred" in edges.columns else F.lit(False)).cast("int").alias("inferred"))
    m = spark.createDataFrame([(k, json.dumps(v)) for k, v in flatten(metrics).items()], "name string, value string")
    out = {"entities": first, "relations": e, "metrics": m}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def flatten(value: dict, prefix: str = "") -> dict:
    """Nested keys joined by dots."""
    out: dict = {}
    for k, v in value.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        out |= flatten(v, name) if isinstance(v, dict) else {name: v}
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """(path, sha256) of documents (path, text)."""
    return docs.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def changed(docs: DataFrame, old: DataFrame) -> DataFrame:
    """Documents (path, text) that the manifest ``old`` lacks or has with another hash."""
    now = docs.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    o = old.select(F.col("path").alias("_p"), F.col("sha256").alias("_s"))
    return now.join(o, (F.col("path") == F.col("_p")) & (F.col("sha256") == F.col("_s")), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` and those rows of ``old`` whose key it does not have."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def write_by_document(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """JSON in a folder per document; Spark's commit makes it whole or not at all."""
    rows.write.mode("overwrite").partitionBy(key).json(path)


def write_outcomes(resolved: DataFrame, path: str) -> None:
    """Validated, original, repaired and rejected triples in folders of their own, from one written table."""
    from ..session import materialise

    r = materialise(resolved, "outcomes")
    status = F.col("validation_status")
    parts = {"validated": status != "rejected", "original": status == "validated", "after_repair": status == "repaired", "rejected": status == "rejected"}
    for name, cond in parts.items():
        r.filter(cond).write.mode("overwrite").json(f"{path}/{name}")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def pending(rows: DataFrame, done: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows whose key the finished ones do not have, to go on with after a stop."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def fresh_table(spark: SparkSession, path: str, inputs: list[str], build) -> DataFrame:
    """The table at ``path`` if it is newer than all inputs, else what ``build()`` gives, written there."""

    def newest(p: str):
        d = optional(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select("modificationTime"), "modificationTime timestamp")
        return d.agg(F.max("modificationTime")).first()[0]

    own = newest(path)
    if own is None or any((t := newest(p)) is not None and t >= own for p in inputs):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
