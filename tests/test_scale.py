"""What steps move and write is bounded, with the same results."""

from pyspark.sql import functions as F

from graphloom.operators import learn


def test_classifiers_are_fitted_on_weighted_rows(spark, monkeypatch):
    """Rows of equal features are one with a weight; all pairs are counted."""
    written = {}
    kept = learn.materialise

    def spy(df, what, *a):
        written[what] = kept(df, what, *a)
        return written[what]

    monkeypatch.setattr(learn, "materialise", spy)
    i = F.col("id")
    p = spark.range(20_000).select(
        i.alias("pair_id"), F.when(i % 3 == 0, "A").otherwise("B").alias("label1"), F.when(i % 3 == 1, "A").otherwise("B").alias("label2"), (i % 2 + 5).cast("int").alias("length1"), F.lit(7).alias("length2"), (i % 2).cast("int").alias("has_preposition"),
        F.when(i == 0, "RARE").otherwise(F.concat(F.lit("R"), (i % 3).cast("string"))).alias("relation"),
    )
    got = {r["model"]: r for r in learn.relation_classifiers(p).collect()}
    rows = written["relation-features"]
    assert rows.count() <= 6 * learn.SHARES * 2 and rows.agg(F.sum("_weight")).first()[0] == 19_999
    assert set(got) == {"linear_svm", "random_forest", "naive_bayes"} and {r["rows"] for r in got.values()} == {learn.split(p.filter("pair_id > 0"), "pair_id", (0.7, 0.3))[1].count()}
    assert got["random_forest"]["accuracy"] == 1.0


def test_paths_of_three_do_not_grow_hubs(spark, monkeypatch):
    """Two hubs of 400 neighbours each and 400 pairs at them: what is written stays near the edges."""
    from graphloom.operators import links

    edges = [(f"a{i}", "A") for i in range(400)] + [(f"b{i}", "B") for i in range(400)] + [("A", "B")] + [(f"a{i}", f"b{i}") for i in range(0, 400, 2)]
    e = spark.createDataFrame([(x, y) for x, y in edges], "src string, dst string")
    written = []
    kept = links.materialise

    def spy(df, what, *a):
        out = kept(df, what, *a)
        written.append(out.count())
        return out

    adjacent = links.adjacency(e).cache()
    monkeypatch.setattr(links, "materialise", spy)
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(400)] + [("A", "B"), ("a1", "A")], "u string, v string")
    got = {(r.u, r.v): r.path for r in links.path_lengths(adjacent, pairs).collect()}
    assert got == {**{(f"a{i}", f"b{i}"): 3 for i in range(400)}, ("A", "B"): 3, ("a1", "A"): 0}
    assert max(written) < 10 * len(edges)


def test_scores_deal_triples_by_their_size(spark, sf_dir, monkeypatch):
    """No copy of the triples is written for the scores, and tables of type pairs are broadcast, so their few keys get no rows of triples."""
    from graphloom.operators import triples
    from graphloom.session import parts_for

    raw = spark.createDataFrame([(f"s{i % 5}", "PARTY", "PARTY_OF", None if i == 7 else f"order {i % 20}", "CONTRACT", "Is" if i % 2 else "is", f"line {i % 3}", "f", 40 - i if i % 20 else None) for i in range(40)], ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in triples.RAW))
    monkeypatch.setattr(triples, "materialise", lambda *a: 1 / 0)
    got = triples.score(raw, triples.induce_rules(raw)).cache()
    rows = {(r.subject, r.object): (r.mentions, r.sentence_support, r.predicates, r.seq) for r in got.collect()}
    assert len(rows) == 21 and rows[("s2", None)] == (1, 1, 1, 33) and rows[("s1", "order 1")] == (2, 2, 1, 19) and rows[("s0", "order 0")] == (2, 2, 1, None)
    assert parts_for(raw) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # no known size
    known = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert parts_for(known, 100) > parts_for(known) >= 2


def test_caps_deal_triples_once_and_by_their_size(spark, sf_dir, monkeypatch):
    """The rows of capped relations move once, in parts by the size of the tables that are joined; rows without object or file go."""
    from graphloom import session
    from graphloom.operators import triples
    from graphloom.plans import triple_queries

    raw = triple_queries.raw_triples(spark, sf_dir)
    monkeypatch.setattr(session.parts_for, "__defaults__", (1 << 12,))
    assert (n := session.parts_for(raw)) > 2 * spark.sparkContext.defaultParallelism
    plan = triples.cap_fanout(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n})") + plan.count(f", {n}),") >= 1 and "LeftSemi" not in plan
    rows = [("a", "R", x, f, i) for i, (x, f) in enumerate([("x", "f"), ("y", "f"), ("y", "f"), (None, "f"), ("z", None)])] + [(None, "R", "x", "f", 9), ("a", "FREE", None, None, 10)]
    some = spark.createDataFrame(rows, "subject string, relation string, object string, filename string, seq long")
    assert sorted(r.seq for r in triples.cap_fanout(some, {"R": 1}).collect()) == [1, 2, 10]


def test_pairs_are_moved_once_with_degrees_and_types(spark, monkeypatch):
    """Nothing is joined to the pairs once they are added up; with hubs, own edges, a missing vertex and null ends they equal brute force."""
    from itertools import combinations
    from math import log

    from graphloom.operators import graph

    edges = [(f"s{i}", o) for i in range(12) for o in ("hub", f"o{i % 3}", f"o{i % 4}")] + [("s1", "s2"), ("s2", "s1"), ("s3", "hub2"), ("s4", "hub2"), ("lone", "s1"), ("x", "y"), ("s5", None), (None, "s6"), ("s7", "s7")]
    e = spark.createDataFrame(edges, "src string, dst string")
    near = {}
    for a, b in edges:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    kind = {n: n[0] for n in near if n != "lone"}
    v = spark.createDataFrame(list(kind.items()), "id string, type string")
    monkeypatch.setattr(graph, "SIDE", 5)
    for of_type in (None, "s"):
        want = {}
        for x, y in combinations(sorted(n for n in near if not of_type or kind.get(n) == of_type), 2):
            both, own = near[x] & near[y], y in near[x]
            if both or own:
                dx, dy = len(near[x]) - own, len(near[y]) - own
                want[x, y] = (own, len(both), len(both) / (dx + dy - len(both)) if dx + dy > len(both) else 0.0, dx * dy, abs(dx - dy), x in kind and y in kind and kind[x] == kind[y], sum(1 / log(len(near[z])) for z in both), sum(1 / len(near[z]) for z in both))
        p = graph.pair_features(e, v, of_type)
        assert "Join" not in p._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[0]
        got = {tuple(r)[:2]: tuple(r)[2:] for r in p.collect()}
        assert got.keys() == want.keys()
        for k, row in want.items():
            assert got[k][:2] == row[:2] and got[k][3:6] == row[3:6] and all(abs(got[k][i] - row[i]) < 1e-9 for i in (2, 6, 7)), (k, got[k], row)
    assert graph.pair_features(e.limit(0), v).collect() == []


def test_scores_move_triples_once(spark, sf_dir):
    """What is known of a subject is made where its triples lie, not joined to them; rows without relation count among its mentions."""
    from graphloom.operators import triples

    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    raw = spark.createDataFrame([("s", "PARTY", r, "order 1", "CONTRACT", "is", "line", "f", i) for i, r in enumerate(("PARTY_OF", None))], ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in triples.RAW))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = triples.score(raw, triples.induce_rules(raw))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    one, both = (triples.score(d, triples.induce_rules(raw)).collect() for d in (raw.filter("relation is not null"), raw))
    assert len(both) == 1 and abs(one[0].confidence - both[0].confidence - 0.09) < 1e-9
