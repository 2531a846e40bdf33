"""Ward clustering against the plain algorithm."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from graphloom.operators import learn, ward


def plain(points):
    """In each round the two clusters whose merge adds least to the squares, by their members."""
    clusters, out = [[i] for i in range(len(points))], []
    cost = lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum()
    while len(clusters) > 1:
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))), key=lambda p: cost(clusters[p[0]], clusters[p[1]]))
        out.append((min(clusters[i] + clusters[j]), float(np.sqrt(cost(clusters[i], clusters[j])))))
        clusters[i] = clusters[i] + clusters.pop(j)
    return out


@pytest.mark.parametrize(("n", "dim", "seed"), [(2, 1, 0), (9, 2, 1), (40, 3, 2), (60, 8, 3)])
def test_merges_equal_the_plain_algorithm(n, dim, seed):
    points = np.random.default_rng(seed).standard_normal((n, dim))
    got = ward.merges(points)
    expected = plain(points)
    assert len(got) == n - 1
    np.testing.assert_allclose([h for *_, h in got], [h for _, h in expected], rtol=1e-7)
    members = {i: {i} for i in range(n)}
    for (a, b, _), (least, _) in zip(got, expected, strict=True):
        both = next(x for x in members.values() if a in x) | next(x for x in members.values() if b in x)
        members |= dict.fromkeys(both, both)
        assert min(both) == least


def test_equal_points_and_few():
    assert ward.labels(np.zeros((5, 2)), 2).max() == 1 and ward.labels(np.zeros((1, 2)), 3).tolist() == [0]
    line = np.array([[0.0], [1.0], [2.0], [3.0], [10.0]])
    assert len(set(ward.labels(line, 2)[:4])) == 1 and ward.labels(line, 2)[4] == 1


def test_all_rows_go_to_the_nearest_centre(spark):
    r = np.random.default_rng(4)
    middle = np.array([[0, 0], [8, 0], [0, 8]])
    rows = [(i, [float(x) for x in middle[i % 3] + r.standard_normal(2) * 0.5]) for i in range(600)] + [(999, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>").withColumn("features", F.when(F.col("v").isNotNull(), array_to_vector("v")))
    got = ward.ward(d, "id", 3, sample=60).collect()
    by = {}
    for x in got:
        by.setdefault(x.id % 3 if x.id < 999 else None, set()).add(x.cluster)
    assert by[None] == {None} and all(len(by[g]) == 1 for g in range(3)) and len(set().union(*(by[g] for g in range(3)))) == 3
    assert ward.ward(d.limit(0), "id").collect() == []
    assert {x.cluster for x in ward.ward(d.filter("id < 2"), "id", 8).collect()} == {0, 1}


def test_profiles_count_labels(spark):
    d = spark.createDataFrame([(0, "a", "x"), (0, "a", "y"), (0, "b", "z"), (1, None, "w")], "cluster int, label string, t string")
    got = {r.cluster: r for r in learn.profile(d, "label", "t").collect()}
    assert got[0].labels == {"a": 2, "b": 1} and got[0].dominant == "a" and got[0].purity == pytest.approx(2 / 3) and got[1].labels == {"": 1}
    assert learn.purity(d, "label").first()[0] == pytest.approx(3 / 4)


def test_short_names_are_taken_first(spark):
    rows = [(i, "a", "one two" if i < 60 else "word " * 12) for i in range(100)] + [(i, "b", "word " * 12 if i < 190 else "x") for i in range(100, 200)]
    d = spark.createDataFrame(rows, "id long, label string, t string")
    got = learn.short_first(d, "label", "t", most=50).groupBy("label").agg(F.count("*").alias("n"), F.max(F.size(F.split("t", " "))).alias("longest")).collect()
    assert {(r.label, r.n, r.longest) for r in got} == {("a", 60, 2), ("b", 100, 13)}
