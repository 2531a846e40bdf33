"""Graphs as two tables: vertices (id, type) and edges (src, dst, relation, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, parts_for
from .components import connected_components


def build(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and directed multi-edges of triples; a vertex has the type of its last row by seq."""
    ends = triples.select(F.col("subject").alias("id"), F.col("subject_type").alias("type"), (F.col("seq") * 2).alias("at")).union(
        triples.select("object", "object_type", F.col("seq") * 2 + 1)
    )
    vertices = ends.groupBy("id").agg(F.max_by("type", F.struct("at", "type")).alias("type"))
    return vertices, triples.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "relation", "confidence")


def occurrences(triples: DataFrame) -> DataFrame:
    """(id, type, seq) of each end of each triple in their order, for what takes the first type that is seen."""
    return triples.select(F.col("subject").alias("id"), F.col("subject_type").alias("type"), (F.col("seq") * 2).alias("seq")).union(triples.select("object", "object_type", F.col("seq") * 2 + 1))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (a < b) without loops."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: (node, other, ...); a loop comes once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
    return there.union(edges.filter("src <> dst").select(F.col("dst"), F.col("src"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over all multi-edges; a loop counts twice."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex; one without edges is its own."""
    c = connected_components(edges)
    return vertices.select("id").join(c, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, distinct edges, density, components, mean degree and share of nodes with an edge."""
    s = simple(edges)
    touched = s.select("a").union(s.select("b")).distinct().agg(F.count("*").alias("touched"))
    c = components(vertices, edges).select("component").distinct().agg(F.count("*").alias("components"))
    v, e, u = vertices.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")), s.agg(F.count("*").alias("simple_edges"))
    d = v.join(e).join(u).join(touched).join(c)
    n, m = F.col("nodes"), F.col("simple_edges")
    return d.select(
        "nodes", "edges", "simple_edges", "components",
        F.round(F.coalesce(F.try_divide(2 * m, n * (n - 1)), F.lit(0.0)), 9).alias("density"),
        F.round(F.coalesce(F.try_divide(2 * m, n), F.lit(0.0)), 6).alias("mean_degree"),
        F.round(F.coalesce(F.try_divide(F.col("touched"), n), F.lit(0.0)), 6).alias("coverage"),
    )


def bfs(edges: DataFrame, anchors: DataFrame, max_hops: int = 2) -> DataFrame:
    """(node, hop) of all nodes within ``max_hops`` of the anchors (node); each round is written once."""
    adjacent = simple(edges)
    adjacent = adjacent.select(F.col("a").alias("node"), F.col("b").alias("other")).union(adjacent.select("b", "a"))
    seen = anchors.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        new = frontier.select("node").join(adjacent, "node").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialise(new.withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.union(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """(source, target, hops, path) for pairs (source, target); of equal length the least path by its nodes.

    Frontiers grow from all sources together and keep one path per source and
    node, so rows stay within sources times nodes.
    """
    adjacent = simple(edges)
    adjacent = adjacent.select(F.col("a").alias("node"), F.col("b").alias("other")).union(adjacent.select("b", "a"))
    seen = pairs.select("source", F.col("source").alias("node"), F.array("source").alias("path"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(adjacent, "node").select("source", F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"))
        best = step.groupBy("source", "node").agg(F.min("path").alias("path")).join(seen.select("source", "node"), ["source", "node"], "left_anti")
        frontier = materialise(best.withColumn("hops", F.lit(hop)), "paths")
        seen = seen.unionByName(frontier)
    found = pairs.join(seen.withColumnRenamed("node", "target"), ["source", "target"])
    return found.filter("source <> target").select("source", "target", "hops", F.array_join("path", " > ").alias("path"))


def best_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """(source, target, hops, confidence, path, rank) for pairs (source, target): fewest hops, then the highest mean confidence.

    Of parallel edges the most confident one counts, then the first relation; it
    may be walked against its direction, which the path shows (``<-R-``). Of
    equal paths the first by its nodes. All paths are ranked by (hops, mean
    confidence). A null confidence counts as 0; loops, null ends, pairs of one
    node and pairs out of reach give no row. Frontiers keep one path per source
    and node, since at equal length the best path to a node goes over the best
    paths to its neighbours.
    """
    ok = edges.filter("src is not null and dst is not null and src <> dst").withColumn("c", F.coalesce("confidence", F.lit(0.0)))
    both = ok.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation", F.col("c").alias("confidence"), F.lit(1).alias("out"))
    both = both.union(ok.select("dst", "src", "relation", "c", F.lit(0)))
    best = both.groupBy("node", "other").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "relation", (-F.col("out")).alias("back"))).alias("e"))
    step = F.when(F.col("e.back") < 0, F.concat(F.lit(" -"), F.coalesce("e.relation", F.lit("")), F.lit("-> "))).otherwise(F.concat(F.lit(" <-"), F.coalesce("e.relation", F.lit("")), F.lit("- ")))
    adjacent = materialise(best.select("node", "other", (-F.col("e.less")).alias("c"), step.alias("step")), "best-edges")
    seen = pairs.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.lit(0.0).alias("sum"), F.array("source").alias("nodes"), F.col("source").alias("path"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        grown = frontier.join(adjacent, "node").join(seen.select("source", F.col("node").alias("other")), ["source", "other"], "left_anti")
        grown = grown.select("source", F.col("other").alias("node"), (F.col("sum") + F.col("c")).alias("sum"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("path", "step", "other").alias("path"))
        top = grown.groupBy("source", "node").agg(F.min(F.struct((-F.round("sum", 9)).alias("less"), "nodes", "path", "sum")).alias("b"))
        frontier = materialise(top.select("source", "node", F.lit(hop).alias("hops"), F.col("b.sum").alias("sum"), F.col("b.nodes").alias("nodes"), F.col("b.path").alias("path")), "best-paths")
        seen = seen.unionByName(frontier)
    found = pairs.select("source", "target").distinct().join(seen.withColumnRenamed("node", "target"), ["source", "target"]).filter("hops > 0")
    found = found.select("source", "target", "hops", F.round(F.col("sum") / F.col("hops"), 6).alias("confidence"), "path")
    return found.withColumn("rank", F.row_number().over(Window.orderBy("hops", F.desc("confidence"), "source", "target")))


#: Neighbours of a hub that one task pairs with as many others.
SIDE = 2000


def pair_features(edges: DataFrame, vertices: DataFrame, of_type: str | None = None) -> DataFrame:
    """Topology of each pair that shares a neighbour or has an edge, as if its own edge were not there.

    Only such pairs are made (others have all features zero). Degrees and types
    go along with the edges, so pairs are moved once, to be added up. The pairs
    around a hub of more than ``SIDE`` neighbours are dealt out in squares of as
    many, so no task holds them all; the pairs themselves still grow with the
    square of a hub's degree (``links.graph_without_hubs`` bounds it,
    ``links.features`` makes the features of given pairs alone). Edges with a
    null end and empty tables give no pairs. An own edge takes one off both
    degrees and each end off the other's neighbours, in closed form.
    ``of_type`` keeps pairs of one vertex type.
    """
    s = materialise(simple(edges), "edges")
    adjacent = s.select(F.col("a").alias("node"), F.col("b").alias("nbr")).union(s.select("b", "a"))
    deg = materialise(adjacent.groupBy("node").agg(F.count("*").alias("deg")), "degrees")
    via = deg.select(F.col("node").alias("nbr"), F.col("deg").alias("via"))
    hubs = materialise(via.filter(F.col("via") > SIDE), "hubs")
    kept = vertices.select(F.col("id").alias("node"), "type")
    known = deg.join(kept.filter(F.col("type") == of_type).select("node"), "node") if of_type else deg.join(kept, "node", "left")
    known = materialise(known, "known")
    ends = adjacent.join(known, "node")
    types = [] if of_type else ["type"]
    there = lambda d: d.select("nbr", F.col("node").alias("u"), F.col("deg").alias("du"), *[F.col(c).alias("tu") for c in types])
    back = lambda d: d.select("nbr", F.col("node").alias("v"), F.col("deg").alias("dv"), *[F.col(c).alias("tv") for c in types])
    pair = ["u", "v", "du", "dv", (F.lit(True) if of_type else F.coalesce(F.col("tu") == F.col("tv"), F.lit(False))).alias("same_type")]
    # parts of bounded size, so that the pairs that a task adds up stay in memory
    few = ends.join(hubs, "nbr", "left_anti").repartition(parts_for(s), "nbr")
    few = there(few).join(via, "nbr").join(back(few), "nbr").filter("u < v").select(*pair, "via", F.lit(0).alias("edge"))
    parts = F.ceil(F.col("via") / SIDE).cast("long")
    many = ends.join(hubs, "nbr").withColumn("own", F.pmod(F.xxhash64("node"), parts)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    left = there(many.withColumn("nbr", F.struct("nbr", F.col("own").alias("i"), F.col("with").alias("j"), "via")))
    right = back(many.withColumn("nbr", F.struct("nbr", F.col("with").alias("i"), F.col("own").alias("j"), "via")))
    many = left.join(right, "nbr").filter("u < v").select(*pair, "nbr.via", F.lit(0).alias("edge"))
    own = there(s.select(F.col("a").alias("node"), F.col("b").alias("nbr")).join(known, "node"))
    own = own.join(back(known.withColumn("nbr", F.col("node"))), "nbr").select(*pair, F.lit(None).cast("long").alias("via"), F.lit(1).alias("edge"))
    p = few.union(many).union(own).groupBy("u", "v", "du", "dv", "same_type").agg(
        F.count("via").alias("common"), F.sum(F.when(F.col("via") > 1, 1 / F.log("via")).otherwise(0.0)).alias("adamic_adar"), F.coalesce(F.sum(1 / F.col("via")), F.lit(0.0)).alias("resource_allocation"), F.max("edge").alias("edge")
    )
    du, dv = F.col("du") - F.col("edge"), F.col("dv") - F.col("edge")
    union = du + dv - F.col("common")
    return p.select(
        "u", "v", (F.col("edge") == 1).alias("has_edge"), "common", F.coalesce(F.try_divide("common", union), F.lit(0.0)).alias("jaccard"), (du * dv).alias("preferential"), F.abs(du - dv).alias("degree_gap"),
        "same_type", "adamic_adar", "resource_allocation",
    )


def top_nodes(edges: DataFrame, n: int = 400) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among ``kept`` (id)."""
    k = kept.select("id").distinct()
    return edges.join(k.select(F.col("id").alias("src")), "src", "left_semi").join(k.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def expand(edges: DataFrame, text: str) -> DataFrame:
    """Nodes whose name holds ``text``, and their neighbours."""
    both = both_ways(edges).select("node", "other")
    hit = both.filter(F.lower("node").contains(text.lower()))
    return hit.select(F.col("node").alias("id")).union(hit.select("other")).distinct()


def add_inferred(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with inferred links (u, v, probability) after them."""
    own = edges.withColumn("inferred", F.lit(False))
    new = links.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit("INFERRED_LINK").alias("relation"), F.round("probability", 5).alias("confidence"), F.lit(True).alias("inferred"))
    return own.unionByName(new)


def facts(edges: DataFrame, entities: DataFrame, preferred: list[str] | None = None, most: int = 5) -> DataFrame:
    """The first facts of each entity (node): those of preferred relations, then by confidence.

    Spark keeps the first ``most`` of a node in each map task before it
    shuffles (window group limit), so a hub's edges do not meet in one task.
    """
    liked = F.lower("relation").rlike("|".join(preferred)) if preferred else F.lit(False)
    f = both_ways(edges).join(entities.select("node").distinct(), "node").withColumn("preferred", liked)
    order = Window.partitionBy("node").orderBy(F.desc("preferred"), F.desc(F.coalesce("confidence", F.lit(0.0))), "relation", "other")
    return f.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
