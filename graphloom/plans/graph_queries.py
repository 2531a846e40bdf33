"""Graph queries over customers, orders, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import materialise, parts_for
from .registry import query, table
from .triple_queries import CAPPED, RAW, capped, raw_triples


def customer_graph(spark, sf_dir):
    """Customers, their orders and their nations; a multi-edge for open orders."""
    t = lambda n: table(spark, sf_dir, n)
    o, c, n = t("orders"), t("customer"), t("nation")
    order = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    base = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_name", order.alias("ord"), "o_orderstatus")
    e = base.select(F.col("c_name").alias("src"), F.col("ord").alias("dst"), F.lit("PARTY_OF").alias("relation"), F.lit(0.88).alias("confidence"))
    e = e.union(base.filter("o_orderstatus = 'O'").select("ord", "c_name", F.lit("ENTERED_INTO"), F.lit(0.5)))
    e = e.union(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", "n_name", F.lit("LOCATED_IN"), F.lit(0.78)))
    v = c.select(F.col("c_name").alias("id"), F.lit("PARTY").alias("type")).union(o.select(order, F.lit("CONTRACT"))).union(n.select("n_name", F.lit("JURISDICTION")))
    return v, e


EDGES = """e AS (SELECT c_name AS src, 'order ' || o_orderkey AS dst, 'PARTY_OF' AS relation, 0.88::DOUBLE AS confidence FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'order ' || o_orderkey, c_name, 'ENTERED_INTO', 0.5 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
UNION ALL SELECT c_name, n_name, 'LOCATED_IN', 0.78 FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT c_name AS id, 'PARTY' AS type FROM customer UNION ALL SELECT 'order ' || o_orderkey, 'CONTRACT' FROM orders UNION ALL SELECT n_name, 'JURISDICTION' FROM nation),
s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), adj AS (SELECT a AS node, b AS other FROM s UNION ALL SELECT b, a FROM s),
comp AS (SELECT id, min(id) OVER (PARTITION BY coalesce(nation, id)) AS component FROM (SELECT id, CASE type WHEN 'JURISDICTION' THEN id WHEN 'PARTY' THEN cn.n_name ELSE orn.n_name END AS nation FROM v
  LEFT JOIN (SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) cn ON cn.c_name = v.id
  LEFT JOIN (SELECT 'order ' || o_orderkey AS ord, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) orn ON orn.ord = v.id))"""


@query(
    f"""WITH {EDGES}, n AS (SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM s) AS m, (SELECT count(DISTINCT node) FROM adj) AS touched, (SELECT count(DISTINCT component) FROM comp) AS c)
SELECT nodes::BIGINT AS nodes, edges::BIGINT AS edges, m::BIGINT AS simple_edges, c::BIGINT AS components, round(2 * m / (nodes * (nodes - 1)), 9) AS density, round(2 * m / nodes, 6) AS mean_degree, round(touched / nodes, 6) AS coverage FROM n"""
)
def graph_stats(spark, sf_dir):
    """AGG18, GRA2 and GRA3."""
    return graph.stats(*customer_graph(spark, sf_dir))


@query(f"WITH {EDGES} SELECT component, count(*)::BIGINT AS size FROM comp GROUP BY 1")
def components(spark, sf_dir):
    """GRA3 over the whole graph."""
    return graph.components(*customer_graph(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"))


@query(f"WITH {EDGES} SELECT id, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY degree DESC, id LIMIT 400")
def degree_topn(spark, sf_dir):
    """AGG23 and WIN10."""
    return graph.top_nodes(customer_graph(spark, sf_dir)[1])


@query(
    f"""WITH {EDGES}, k AS (SELECT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 400)
SELECT src, dst, relation FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""
)
def induced_subgraph(spark, sf_dir):
    """FIL8: edges among the nodes of highest degree."""
    e = customer_graph(spark, sf_dir)[1]
    return graph.induced(e, graph.top_nodes(e)).select("src", "dst", "relation")


ANCHOR = "Customer#000000001"


@query(
    f"""WITH {EDGES}, h0 AS (SELECT '{ANCHOR}' AS node), h1 AS (SELECT DISTINCT other AS node FROM adj JOIN h0 USING (node) WHERE other NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT other AS node FROM adj JOIN h1 USING (node) WHERE other NOT IN (SELECT node FROM h0) AND other NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2"""
)
def bfs_hops(spark, sf_dir):
    """GRA6."""
    return graph.bfs(customer_graph(spark, sf_dir)[1], spark.createDataFrame([(ANCHOR,)], "node string"))


PAIRS = [("Customer#000000001", "Customer#000000002"), ("Customer#000000001", "NATION_19"), ("Customer#000000001", "Customer#000000015"), ("order 11", "order 40"), ("order 58", "NATION_19"), ("Customer#000000013", "order 11")]


def _paths_sql() -> str:
    out = [f"p0 AS (SELECT DISTINCT s AS source, s AS node, [s] AS path FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in sorted({a for a, _ in PAIRS}))}) t(s))", "seen0 AS (SELECT *, 0 AS hops FROM p0)"]
    for h in range(1, 5):
        out.append(f"p{h} AS (SELECT source, other AS node, min(list_append(path, other)) AS path FROM p{h - 1} JOIN adj USING (node) WHERE NOT EXISTS (SELECT 1 FROM seen{h - 1} x WHERE x.source = p{h - 1}.source AND x.node = other) GROUP BY ALL)")
        out.append(f"seen{h} AS (SELECT * FROM seen{h - 1} UNION ALL SELECT *, {h} FROM p{h})")
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    return ", ".join(out) + f" SELECT q.source, q.target, hops::INT AS hops, array_to_string(path, ' > ') AS path FROM (VALUES {pairs}) q(source, target) JOIN seen4 ON seen4.source = q.source AND seen4.node = q.target"


@query(f"WITH {EDGES}, {_paths_sql()}")
def shortest_paths(spark, sf_dir):
    """GRA7, GRA8 and WIN13: the six pairs that a query of several entities asks for."""
    return graph.shortest_paths(customer_graph(spark, sf_dir)[1], spark.createDataFrame(PAIRS, "source string, target string"))


def _best_sql() -> str:
    both = "SELECT src AS node, dst AS other, relation, confidence, 1 AS fwd FROM e WHERE src <> dst UNION ALL SELECT dst, src, relation, confidence, 0 FROM e WHERE src <> dst"
    out = [
        f"one AS (SELECT node, other, confidence AS c, CASE fwd WHEN 1 THEN ' -' || relation || '-> ' ELSE ' <-' || relation || '- ' END AS step FROM (SELECT *, row_number() OVER (PARTITION BY node, other ORDER BY confidence DESC, relation, fwd DESC) AS k FROM ({both})) WHERE k = 1)",
        f"b0 AS (SELECT DISTINCT s AS source, s AS node, 0::DOUBLE AS total, [s] AS nodes, s AS path FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in sorted({a for a, _ in PAIRS}))}) t(s))", "s0 AS (SELECT *, 0 AS hops FROM b0)",
    ]
    for h in range(1, 5):
        grown = f"SELECT source, one.other AS node, total + c AS total, list_append(nodes, one.other) AS nodes, path || step || one.other AS path FROM b{h - 1} JOIN one USING (node) WHERE NOT EXISTS (SELECT 1 FROM s{h - 1} x WHERE x.source = b{h - 1}.source AND x.node = one.other)"
        out.append(f"b{h} AS (SELECT source, node, total, nodes, path FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY round(total, 9) DESC, nodes, path) AS k FROM ({grown})) WHERE k = 1)")
        out.append(f"s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT *, {h} FROM b{h})")
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    return ", ".join(out) + (
        f", f AS (SELECT q.source, q.target, hops, round(total / hops, 6) AS confidence, path FROM (VALUES {pairs}) q(source, target) JOIN s4 ON s4.source = q.source AND s4.node = q.target WHERE hops > 0)"
        " SELECT source, target, hops::INT AS hops, confidence, path, row_number() OVER (ORDER BY hops, confidence DESC, source, target)::INT AS rank FROM f"
    )


@query(f"WITH {EDGES}, {_best_sql()}")
def best_paths(spark, sf_dir):
    """WIN13 with GRA7: of the shortest paths the most confident over parallel edges, ranked by hops and mean confidence."""
    return graph.best_paths(customer_graph(spark, sf_dir)[1], spark.createDataFrame(PAIRS, "source string, target string"))


@query(f"WITH {EDGES} SELECT DISTINCT id FROM (SELECT node AS id FROM adj WHERE node LIKE '%ation_7%' OR lower(node) LIKE '%nation_7%' UNION ALL SELECT other FROM adj WHERE lower(node) LIKE '%nation_7%')")
def neighbour_expansion(spark, sf_dir):
    """GRA9 and GRA11."""
    return graph.expand(customer_graph(spark, sf_dir)[1], "nation_7")


def supplier_graph(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("dst")).distinct()
    v = li.select(F.col("src").alias("id")).distinct().withColumn("type", F.lit("PARTY")).union(li.select("dst").distinct().withColumn("type", F.lit("CONTRACT")))
    return v, li.withColumn("relation", F.lit("ENTERED_INTO")).withColumn("confidence", F.lit(0.5))


SUPPLIERS = """s AS (SELECT DISTINCT 'supplier ' || l_suppkey AS u, 'order ' || l_orderkey AS o FROM lineitem), deg_o AS (SELECT o, count(*) AS d FROM s GROUP BY 1), deg_u AS (SELECT u, count(*) AS d FROM s GROUP BY 1),
c AS (SELECT x.u, y.u AS v, count(*) AS common, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS aa, sum(1 / d) AS ra FROM s x JOIN s y ON x.o = y.o AND x.u < y.u JOIN deg_o ON deg_o.o = x.o GROUP BY x.u, y.u)"""


@query(
    f"""WITH {SUPPLIERS} SELECT c.u, c.v, FALSE AS has_edge, common::BIGINT AS common, round(common / (a.d + b.d - common), 6) AS jaccard, (a.d * b.d)::BIGINT AS preferential, abs(a.d - b.d)::BIGINT AS degree_gap, TRUE AS same_type,
round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation FROM c JOIN deg_u a ON a.u = c.u JOIN deg_u b ON b.u = c.v"""
)
def pair_features(spark, sf_dir):
    """GRA4, FIL7 and JOI14 for pairs of suppliers, by their common orders."""
    v, e = supplier_graph(spark, sf_dir)
    p = graph.pair_features(e, v, "PARTY")
    return p.select("u", "v", "has_edge", "common", F.round("jaccard", 6).alias("jaccard"), "preferential", "degree_gap", "same_type", F.round("adamic_adar", 6).alias("adamic_adar"), F.round("resource_allocation", 6).alias("resource_allocation"))


@query(f"WITH {RAW}, t AS (SELECT subject AS id, subject_type AS type, seq * 2 AS pos FROM raw UNION ALL SELECT object, object_type, seq * 2 + 1 FROM raw), w AS (SELECT id, max_by(type, struct_pack(pos := pos, type := type)) AS type FROM t GROUP BY id) SELECT type, count(*)::BIGINT AS vertices FROM w GROUP BY 1")
def vertex_types(spark, sf_dir):
    """GRA1 and AGG22: the last type seen of each vertex."""
    v, _ = graph.build(materialise(raw_triples(spark, sf_dir), "raw-triples").withColumn("confidence", F.lit(1.0)))
    return v.groupBy("type").agg(F.count("*").alias("vertices"))


@query(f"WITH {CAPPED} SELECT relation, count(DISTINCT (subject, object))::BIGINT AS edges, count(DISTINCT subject)::BIGINT AS sources FROM capped GROUP BY 1")
def relation_histogram(spark, sf_dir):
    """AGG22 after the fan-out cap."""
    # by steps, in parts by size, so that no task holds a relation's edges and sources side by side
    e = capped(spark, sf_dir).select("relation", "subject", "object")
    parts = parts_for(e)
    e = e.repartition(parts, "relation", "subject", "object").groupBy("relation", "subject", "object").agg(F.lit(1))
    e = e.repartition(parts, "relation", "subject").groupBy("relation", "subject").agg(F.count("object").alias("n"))
    known = F.col("subject").isNotNull()
    return e.groupBy("relation").agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("edges"), F.count("subject").alias("sources"))


@query(
    f"""WITH {EDGES}, b AS (SELECT src AS node, dst AS other, relation, confidence FROM e UNION ALL SELECT dst, src, relation, confidence FROM e)
SELECT node, other, relation, confidence, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN relation LIKE '%LOCATED%' THEN 0 ELSE 1 END, confidence DESC, relation, other) AS rank FROM b WHERE node IN (SELECT c_name FROM customer)) WHERE rank <= 5"""
)
def facts_topk(spark, sf_dir):
    """WIN9 and JOI12: five facts of every customer, seats first."""
    who = table(spark, sf_dir, "customer").select(F.col("c_name").alias("node"))
    return graph.facts(customer_graph(spark, sf_dir)[1], who, ["located"]).select("node", "other", "relation", "confidence", "rank")


@query(f"WITH {EDGES} SELECT s_name AS name FROM supplier WHERE s_name NOT IN (SELECT id FROM v) UNION ALL SELECT c_name FROM customer WHERE c_name NOT IN (SELECT node FROM adj)")
def missing_from_kg(spark, sf_dir):
    """FIL4: names that have no edge."""
    e = customer_graph(spark, sf_dir)[1]
    known = graph.both_ways(e).select(F.col("node").alias("name")).distinct()
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).union(table(spark, sf_dir, "customer").select("c_name"))
    return names.join(known, "name", "left_anti")


@query(f"WITH {EDGES} SELECT name FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation) WHERE name IN (SELECT id FROM v) AND name IN (SELECT node FROM adj)")
def names_in_graph(spark, sf_dir):
    """FIL6: of all names those that are vertices with an edge."""
    v, e = customer_graph(spark, sf_dir)
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("name"))
    names = t("supplier", "s_name").union(t("customer", "c_name")).union(t("nation", "n_name"))
    names = names.join(v.select(F.col("id").alias("name")), "name", "left_semi")
    return names.join(graph.both_ways(e).select(F.col("node").alias("name")), "name", "left_semi")


@query(
    f"""WITH {EDGES}, miss AS (SELECT s_name AS name, s_nationkey FROM supplier WHERE s_name NOT IN (SELECT node FROM adj)),
cand AS (SELECT s_name AS name, 'ENTERED_INTO' AS relation, 'order ' || l_orderkey AS other, round(l_discount, 2) AS confidence FROM lineitem JOIN miss ON l_suppkey = CAST(right(name, 9) AS BIGINT) JOIN supplier ON s_name = name)
SELECT name, relation, other, confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, relation, other) AS k FROM (SELECT DISTINCT * FROM cand)) WHERE k <= 5"""
)
def backfill(spark, sf_dir):
    """FIL5: unverified facts only for names without verified ones."""
    missing = missing_from_kg(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cand = li.select(F.col("s_name").alias("src"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("dst"), F.lit("ENTERED_INTO").alias("relation"), F.round("l_discount", 2).alias("confidence")).distinct()
    f = graph.facts(cand, missing.select(F.col("name").alias("node")))
    return f.select(F.col("node").alias("name"), "relation", "other", "confidence")
