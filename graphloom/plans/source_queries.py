"""Tables written by the sinks and read back by the scans, against the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import scratch
from ..sources import io, resume
from .graph_queries import EDGES, customer_graph
from .registry import query, table
from .triple_queries import RAW, raw_triples


@query(f"WITH {EDGES} SELECT 'vertices' AS part, type AS kind, count(*)::BIGINT AS n, NULL::DOUBLE AS confidence FROM v GROUP BY type UNION ALL SELECT 'edges', relation, count(*)::BIGINT, round(avg(confidence), 6) FROM e GROUP BY relation")
def node_link_files(spark, sf_dir):
    """SNK6 and SRC5: the customers' graph written as node-link files and read back."""
    path = scratch(spark, "node-link")
    io.write_node_link(*customer_graph(spark, sf_dir), path)
    v, e = io.read_node_link(spark, path)
    n = v.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("vertices").alias("part"), "kind", "n", F.lit(None).cast("double").alias("confidence"))
    return n.union(e.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")).select(F.lit("edges"), "relation", "n", "confidence"))


@query("SELECT c_name AS subject, 'LOCATED_IN' AS predicate, n_name AS object FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 1 AND c_custkey % 4 <> 3")
def triple_files(spark, sf_dir):
    """SRC8 and SRC3: triples in a JSON file under several names of their keys, rejected and incomplete ones among them."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    k, path = F.col("c_custkey"), scratch(spark, "triples")
    name = lambda i: F.when(k % 2 == i, F.col("c_name"))
    row = F.struct(
        name(0).alias("subject"), name(1).alias("head"), F.when(k % 4 != 3, "LOCATED_IN").alias("relation"), F.col("n_name").alias("target"), F.when(k % 3 == 1, "rejected").otherwise("validated").alias("validation_status")
    )
    lists = c.groupBy("n_nationkey").agg(F.to_json(F.struct(F.collect_list(row).alias("triples"))).alias("value"))
    lists.write.partitionBy("n_nationkey").text(path)  # a file for each nation
    found = io.triples_of(spark, path, validated_only=True)
    other = io.triples_of(spark, f"{path}-missing", fallback=path, validated_only=True)
    return found.intersectAll(other)


@query(f"WITH {RAW}, t AS (SELECT subject AS name, subject_type AS type, seq * 2 AS pos FROM raw UNION ALL SELECT object, object_type, seq * 2 + 1 FROM raw) SELECT name, arg_min(type, struct_pack(pos := pos, type := type)) AS type FROM t GROUP BY name")
def first_types(spark, sf_dir):
    """SNK7: the exported entities, each with the type that it was first seen with."""
    t = raw_triples(spark, sf_dir).withColumn("confidence", F.lit(1.0))
    _, e = graph.build(t)
    return io.sql_tables(graph.occurrences(t), e, {})["entities"]


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n, min(o_orderkey) AS first, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_files(spark, sf_dir):
    """SNK9: orders written as CSV with a head, and read back by their names."""
    path = scratch(spark, "csv")
    io.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    d = spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, o_totalprice double").csv(path)
    return d.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT lang, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def document_folders(spark, sf_dir):
    """SNK1: documents as JSON in a folder for each language, read back with the folder's name as a column."""
    path = scratch(spark, "folders")
    io.write_by_document(table(spark, sf_dir, "documents").filter("lang is not null").select("lang", "doc_id", "text"), path, "lang")
    d = spark.read.schema("doc_id long, text string, lang string").json(path)
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'rejected' WHEN c_custkey % 5 = 1 THEN 'after_repair' ELSE 'original' END AS part, count(*)::BIGINT AS n FROM customer GROUP BY 1 UNION ALL SELECT 'validated', count(*)::BIGINT FROM customer WHERE c_custkey % 5 <> 0")
def outcome_folders(spark, sf_dir):
    """SNK4: rows with a status in a folder for each outcome."""
    path, k = scratch(spark, "outcomes"), F.col("c_custkey") % 5
    status = F.when(k == 0, "rejected").when(k == 1, "repaired").otherwise("validated")
    io.write_outcomes(table(spark, sf_dir, "customer").select("c_custkey", status.alias("validation_status")), path)
    out = None
    for part in ("validated", "original", "after_repair", "rejected"):
        n = spark.read.schema("c_custkey long").json(f"{path}/{part}").agg(F.lit(part).alias("part"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query("SELECT c_mktsegment AS segment, count(*)::BIGINT AS customers, count(DISTINCT c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def resumed_batches(spark, sf_dir):
    """SNK12: customers written in batches; the first run stops half-way, the second goes on."""
    log, c = resume.Log(spark, scratch(spark, "batches")), table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    log.run(c.filter("c_custkey % 2 = 0"), "key", lambda d: d, 2)
    log.run(c, "key", lambda d: d, 3)
    return log.rows().groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), F.countDistinct("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def fresh_tables(spark, sf_dir):
    """SRC10: a table that is made once and then found newer than its inputs."""
    path, made = scratch(spark, "fresh"), []
    inputs = [f"{sf_dir}/customer.parquet", f"{sf_dir}/nation.parquet"]

    def build():
        made.append(1)
        c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
        return c.groupBy("n_name").agg(F.count("*").alias("customers"))

    io.fresh_table(spark, path, inputs, build)
    return io.fresh_table(spark, path, inputs, build).filter(F.lit(len(made)) == 1)
