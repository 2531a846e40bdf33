"""Streams over events, and scans, sinks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..streaming import stream
from .graph_queries import EDGES, customer_graph
from .registry import query, table


def _stamp(df, *columns):
    """Times as text, the same in every session time zone."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows with a watermark."""
    return _stamp(stream.run_once(stream.tumbling(stream.read_events(spark, sf_dir)), ["start", "event_type"], "windows"), "start")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def event_sliding(spark, sf_dir):
    """Sliding windows."""
    return _stamp(stream.run_once(stream.sliding(stream.read_events(spark, sf_dir)), ["start"], "sliding"), "start")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    """Session windows."""
    return _stamp(stream.run_once(stream.sessions(stream.read_events(spark, sf_dir)), ["user_id", "start"], "sessions", "complete"), "start")


@query("SELECT DISTINCT user_id, event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute FROM events")
def event_dedup(spark, sf_dir):
    """Deduplication within a watermark."""
    return _stamp(stream.run_once(stream.deduplicated(stream.read_events(spark, sf_dir)), None, "dedup"), "minute")


@query("SELECT 'doc ' || doc_id AS path, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE source IN ('src0', 'src1')")
def changed_docs(spark, sf_dir):
    """FIL3 and SNK10: against a manifest that lacks one source and has other hashes of another."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("path"), "text", "source")
    old = io.manifest(d.withColumn("text", F.when(F.col("source") == "src1", F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text"))).filter("source <> 'src0'"))
    return io.changed(d, old).select("path", "sha256")


@query("SELECT doc_id, CASE WHEN source = 'src2' THEN 'new' ELSE lang END AS lang FROM documents")
def incremental_upsert(spark, sf_dir):
    """Incremental runs replace what changed and keep the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = d.filter("source = 'src2'").select("doc_id", F.lit("new").alias("lang"))
    return io.upsert(d.select("doc_id", "lang"), new, ["doc_id"])


@query(
    f"""WITH {EDGES}, k AS (SELECT src, dst, relation, row_number() OVER (PARTITION BY src, dst ORDER BY relation, confidence) - 1 AS k FROM e)
SELECT 1 AS part, '<node id="' || id || '"><data key="type">' || type || '</data></node>' AS line FROM v UNION ALL SELECT 2, '<edge source="' || src || '" target="' || dst || '" id="' || k || '"><data key="relation">' || relation || '</data></edge>' FROM k"""
)
def graphml(spark, sf_dir):
    """SNK5."""
    return io.graphml_lines(*customer_graph(spark, sf_dir))


@query(f"WITH {EDGES} SELECT type, relation, count(*)::BIGINT AS n, round(avg(confidence), 6) AS confidence FROM e JOIN v ON v.id = e.src GROUP BY ALL")
def sql_surface(spark, sf_dir):
    """SNK7: SQL over the exported tables."""
    io.sql_tables(*customer_graph(spark, sf_dir), {"run": {"ok": True}})
    return spark.sql("SELECT type, relation, count(*) AS n, round(avg(confidence), 6) AS confidence FROM relations JOIN entities ON entities.name = relations.subject GROUP BY type, relation")


@query("SELECT 'tables.customer' AS name, (SELECT count(*) FROM customer)::VARCHAR AS value UNION ALL SELECT 'tables.orders.all', (SELECT count(*) FROM orders)::VARCHAR UNION ALL SELECT 'tables.orders.status.' || o_orderstatus, count(*)::VARCHAR FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'first', '\"' || min(c_name) || '\"' FROM customer UNION ALL SELECT 'ok', 'true'")
def metrics_flatten(spark, sf_dir):
    """SNK8: nested counts of the tables as rows of names and values."""
    v, e = customer_graph(spark, sf_dir)
    c, o = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"), F.min("c_name").alias("first")).first(), table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().collect()
    counts = {"customer": c["n"], "orders": {"all": sum(r["count"] for r in o), "status": {r["o_orderstatus"]: r["count"] for r in o}}}
    return io.sql_tables(v, e, {"tables": counts, "first": c["first"], "ok": True})["metrics"]


@query(
    """WITH t AS (SELECT c_name || ' of ' || n_name || '.' AS text, c_name, n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT text, 0 AS start, length(c_name)::INT AS "end", 'PARTY' AS label, c_name AS entity FROM t WHERE c_custkey % 5 <> 4 UNION ALL SELECT text, (length(c_name) + 4)::INT, (length(c_name) + 4 + length(n_name))::INT, 'JURISDICTION', n_name FROM t WHERE c_custkey % 5 <> 4"""
)
def qa_flatten(spark, sf_dir):
    """SRC4: questions and answers about customers, a JSON text for each nation."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    answer = lambda text, at: F.array(F.struct(text.alias("text"), at.cast("int").alias("answer_start")))
    ask = lambda q, a: F.struct(F.lit(q).alias("question"), a.alias("answers"))
    name, nation = F.col("c_name"), F.col("n_name")
    qas = F.array(ask("Which Parties sign?", answer(name, F.lit(0))), ask("Governing Law?", answer(nation, F.length(name) + 4)), ask("Why?", answer(F.lit("of"), F.length(name) + 1)))
    none = F.filter(qas, lambda x: F.lit(False))
    paragraph = F.struct(F.concat(name, F.lit(" of "), nation, F.lit(".")).alias("context"), F.when(F.col("c_custkey") % 5 == 4, none).otherwise(qas).alias("qas"))
    texts = c.groupBy("n_name").agg(F.collect_list(paragraph).alias("paragraphs"))
    texts = texts.select(F.to_json(F.struct(F.array(F.struct(F.col("n_name").alias("title"), "paragraphs")).alias("data"))).alias("j"))
    raw = texts.select(F.from_json("j", io.QA_SCHEMA).alias("r")).select("r.*")
    return io.flatten_qa(raw).select("text", F.explode("entities").alias("e")).select("text", "e.start", "e.end", "e.label", F.col("e.text").alias("entity"))


@query(
    """SELECT 'both' AS part, count(*)::BIGINT AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'any', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)"""
)
def exact_set_ops(spark, sf_dir):
    """SET1, SET3 and SET4."""
    c, s = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    parts = {"both": c.intersect(s), "only": c.subtract(s), "any": c.union(s).distinct(), "all": c.union(s)}
    out = None
    for k, d in parts.items():
        row = d.agg(F.lit(k).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out
