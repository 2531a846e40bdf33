"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def _large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node it knows."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Each round writes its edges to the shared folder and removes those of the
    round before, so lineage stays short and a lost executor costs a round at
    most. The number of rounds grows with
    the logarithm of a component's size. Minima are pre-aggregated, so a hub
    meets in no single task. Self-loops make a component of one; edges with a
    null end are ignored; no edges give no rows.
    """
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    loops = named.filter("u = v").select(F.col("u").alias("node")).distinct()
    e, before = materialise(named.filter("u <> v").distinct(), "components"), None
    for _ in range(max_rounds):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        last, e = e, materialise(_small_star(_large_star(e)), "components")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = found.union(roots)
    return known.union(loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
