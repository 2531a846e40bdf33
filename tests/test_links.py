"""Link prediction and the kernel machine, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from graphloom.operators import kernel, links


def graph_of(spark, edges, types=None):
    e = spark.createDataFrame([(a, b, "R", 0.5) for a, b in edges], "src string, dst string, relation string, confidence double")
    ids = sorted({x for p in edges for x in p if x is not None})
    v = spark.createDataFrame([(i, (types or {}).get(i, "T")) for i in ids], "id string, type string")
    return v, e


def neighbours(edges):
    out = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def plain_path(adj, u, v, most):
    """Breadth first without the edge u-v."""
    seen, front = {u}, {u}
    for hop in range(1, most + 1):
        front = {y for x in front for y in adj.get(x, ()) if {x, y} != {u, v}} - seen
        if v in front:
            return hop
        seen |= front
    return 0


def plain_features(adj, types, u, v, most):
    adj = {k: set(x) for k, x in adj.items()}
    adj.get(u, set()).discard(v)
    adj.get(v, set()).discard(u)
    a, b = adj.get(u, set()), adj.get(v, set())
    both = a & b
    return (
        len(both), len(both) / len(a | b) if a | b else 0.0, len(a) * len(b), sum(1 / math.log(len(adj[w])) for w in both if len(adj[w]) > 1), sum(1 / len(adj[w]) for w in both),
        abs(len(a) - len(b)), int(u in types and v in types and types[u] == types[v]), plain_path(adj, u, v, most),
    )


def random_edges(n, m, seed):
    r = np.random.default_rng(seed)
    return [(f"n{a}", f"n{b}") for a, b in r.integers(0, n, (m, 2))]


@pytest.mark.parametrize(("n", "m", "hops"), [(12, 14, 5), (30, 60, 3)])
def test_features_and_paths_equal_plain_ones(spark, n, m, hops):
    edges = [*random_edges(n, m, n), ("n1", "n1"), (None, "n2"), ("n3", None), ("hub", "n1"), *[("hub", f"n{i}") for i in range(0, n, 3)]]
    types = {f"n{i}": "AB"[i % 2] for i in range(n)}
    v, e = graph_of(spark, edges, types)
    nodes = sorted(neighbours(edges)) + ["nowhere"]
    r = np.random.default_rng(1)
    pairs = {tuple(sorted((nodes[a], nodes[b]))) for a, b in r.integers(0, len(nodes), (80, 2)) if a != b} | {tuple(sorted(p)) for p in edges if None not in p and p[0] != p[1]}
    got = links.features(e, v, spark.createDataFrame(sorted(pairs), "u string, v string"), hops).collect()
    adj = neighbours(edges)
    types["hub"] = "T"
    assert len(got) == len(pairs)
    for x in got:
        assert tuple(x[c] for c in links.FEATURES) == pytest.approx(plain_features(adj, types, x.u, x.v, hops)), (x.u, x.v)


def test_non_edges_are_none_and_spread_over_all_nodes(spark):
    edges = random_edges(300, 900, 7)
    _, e = graph_of(spark, edges)
    got = [(x.u, x.v) for x in links.non_edges(e, 1500).collect()]
    adj = neighbours(edges)
    assert 1300 <= len(got) <= 1700 and len(set(got)) == len(got)
    assert all(u < v and v not in adj[u] for u, v in got)
    each = {}
    for p in got:
        for x in p:
            each[x] = each.get(x, 0) + 1
    assert len(each) > 290 and max(each.values()) < 40
    assert links.non_edges(e.limit(0), 10).collect() == []
    assert links.non_edges(graph_of(spark, [("a", "b")])[1], 10).collect() == []  # all pairs are edges


def test_parts_hold_the_shares_of_each_label(spark):
    d = spark.range(1000).select(F.col("id").cast("string").alias("u"), F.lit("x").alias("v"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    n = {(r.label, r.part): r["count"] for r in links.stratified_parts(d, "label", ["u", "v"]).groupBy("label", "part").count().collect()}
    assert n == {(0, 0): 540, (0, 1): 180, (0, 2): 180, (1, 0): 60, (1, 1): 20, (1, 2): 20}


def communities(seed=3, groups=12, size=14, inside=0.55, between=60):
    r = np.random.default_rng(seed)
    name = lambda g, i: f"g{g}_{i}"
    edges = [(name(g, i), name(g, j)) for g in range(groups) for i in range(size) for j in range(i) if r.random() < inside]
    edges += [(name(*a), name(*b)) for a, b in zip(zip(r.integers(0, groups, between), r.integers(0, size, between)), zip(r.integers(0, groups, between), r.integers(0, size, between)))]
    return edges


def test_predicts_edges_of_communities_and_not_of_chance(spark):
    v, e = graph_of(spark, communities())
    model, rows = links.fit_predictor(e, v, trees=40)
    best = [x for x in rows.collect() if x.chosen]
    assert {x.model for x in rows.collect()} == {"random_forest", "svm"} and len(best) == 1
    assert best[0].f1 > 0.8 > best[0].f1_of_all
    added = links.predicted(e, v, model, top=10).collect()
    assert len(added) == 10 and all(x.u.split("_")[0] == x.v.split("_")[0] and x.probability >= 0.6 for x in added)
    adj = neighbours(communities())
    assert all(x.v not in adj[x.u] for x in added)
    assert links.predicted(e, v, model, top=10, hub=3).count() <= 10

    v, e = graph_of(spark, random_edges(200, 900, 11))  # no pair is likelier than another
    _, rows = links.fit_predictor(e, v, trees=40)
    best = next(x for x in rows.collect() if x.chosen)
    assert best.f1 < best.f1_of_all + 0.15


def test_too_small_graphs_have_no_predictor(spark):
    for edges in [[("a", "b")], [("a", "b"), ("b", "c"), (None, "c"), ("c", "c")]]:
        v, e = graph_of(spark, edges)
        model, rows = links.fit_predictor(e, v)
        assert model is None and rows.collect() == [] and "f1" in rows.columns
    v, e = graph_of(spark, [("a", "b")])
    assert links.fit_predictor(e.limit(0), v.limit(0))[0] is None


@pytest.fixture(scope="module")
def xor(spark):
    r = np.random.default_rng(5)
    x = r.uniform(-1, 1, (3000, 2))
    rows = [(i, float(a), float(b) if i % 50 else None, int((a > 0) != (b > 0))) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, label int")


def right(df):
    return df.agg(F.avg(((F.col("probability") > 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]


def test_kernel_beats_a_linear_machine_on_xor(xor):
    known = xor.filter("id < 2000 and b is not null")
    new = xor.filter("id >= 2000 and b is not null")
    k = kernel.fit(known, ["a", "b"], "label", "id", gamma=1.0)
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    line = LinearSVC(maxIter=50, labelCol="label").fit(v.transform(known)).transform(v.transform(new)).withColumn("probability", F.col("prediction"))
    assert right(new.withColumn("probability", k.probability())) > 0.9 > 0.75 > right(line)


def test_probabilities_are_calibrated(xor):
    noisy = xor.withColumn("label", F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, 1 - F.col("label")).otherwise(F.col("label")))
    k = kernel.fit(noisy.filter("id < 2000"), ["a", "b"], "label", "id", gamma=1.0)
    scored = noisy.filter("id >= 2000").withColumn("probability", k.probability())
    sure = scored.filter("probability > 0.7").agg(F.avg("label").alias("y"), F.avg("probability").alias("p")).first()
    assert abs(sure.y - sure.p) < 0.1


def test_kernel_takes_nulls_and_needs_both_labels(xor):
    k = kernel.fit(xor, ["a", "b"], "label", "id")
    assert xor.withColumn("p", k.probability()).filter("p is null or isnan(p)").count() == 0
    assert kernel.fit(xor.filter("label = 1"), ["a", "b"], "label", "id") is None
    assert kernel.fit(xor.limit(0), ["a", "b"], "label", "id") is None


def test_random_features_give_the_gaussian_kernel(xor):
    k = kernel.kernel_of(xor.dropna(), ["a", "b"], dim=20_000, gamma=0.7)
    x = np.array([[0.1, 0.2], [0.5, -0.4], [-0.9, 0.3]])
    z = k.map(x)
    s = (x - k.mean) / k.spread
    exact = np.exp(-0.7 * ((s[:, None] - s[None]) ** 2).sum(2))
    np.testing.assert_allclose(z @ z.T, exact, atol=0.03)


class Plain:
    """A model that goes by the common neighbours and the types alone."""

    def __init__(self, best):
        self.best = best

    def alike(self):
        if self.best == "svm":
            return lambda x: (None, 1 - 1 / (1 + x[:, 0] + x[:, 6] / 2))
        return lambda x: ((2 * x[:, 0] + x[:, 6]).astype(np.int64), None)

    def score(self, df):
        return df.withColumn("probability", 1 - 1 / (1 + F.col("common") + F.col("same") / 2))


def test_likeliest_pairs_of_blocks_are_those_of_all(spark, monkeypatch):
    """Blocks of few nodes, without joining or scoring each pair, give the likeliest of all pairs, hubs, null types and own edges included."""
    from graphloom.operators import graph

    edges = [*communities(groups=3, size=10), *[("hub", f"g{g}_{i}") for g in range(3) for i in range(7)], ("g0_1", "g0_1"), (None, "hub")]
    types = {f"g{g}_{i}": "AB"[i % 2] for g in range(3) for i in range(10)}
    v, e = graph_of(spark, edges, types)
    v = v.withColumn("type", F.when(~F.col("id").isin("g1_1", "hub"), F.col("type")))
    del types["g1_1"]
    adj = neighbours(edges)
    every = {(a, b): plain_features(adj, types, a, b, 2) for a in adj for b in adj if a < b and b not in adj[a] and adj[a] & adj[b]}
    monkeypatch.setattr(links, "BLOCK", 11)
    monkeypatch.setattr(links, "features", lambda *a: 1 / 0)
    monkeypatch.setattr(graph, "pair_features", lambda *a: 1 / 0)
    for best, of_type in (("random_forest", None), ("svm", "A")):
        want = [(-round(1 - 1 / (1 + x[0] + x[6] / 2), 9), *k, *(round(float(y), 9) for y in x)) for k, x in every.items() if not of_type or types.get(k[0]) == types.get(k[1]) == of_type]
        got = links.predicted(e, v, Plain(best), 40, 0.3, of_type).collect()
        assert [(-round(r.probability, 9), r.u, r.v, *(round(float(r[c]), 9) for c in links.FEATURES)) for r in got] == sorted(want)[:40]
        assert len(got) == 40
    assert links.predicted(e.limit(0), v, Plain("svm")).collect() == []
