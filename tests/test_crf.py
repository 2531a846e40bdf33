"""The conditional random field against enumeration, finite differences and made sentences."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import crf, extract


def field(k=3, buckets=11, seed=0):
    r = np.random.default_rng(seed)
    return crf.Field([f"t{i}" for i in range(k)], r.standard_normal((buckets, k)), r.standard_normal((k, k)))


def sample(lengths, k=3, buckets=11, seed=1):
    r = np.random.default_rng(seed)
    n = sum(lengths)
    per = r.integers(1, 4, n)
    return r.integers(0, buckets, per.sum()), per, r.integers(0, k, n), np.array(lengths)


def score(f, emission, y):
    return sum(emission[i, t] for i, t in enumerate(y)) + sum(f.jumps[a, b] for a, b in zip(y, y[1:]))


@pytest.mark.parametrize("length", [1, 2, 4])
def test_sums_and_best_equal_enumeration(length):
    f = field()
    x, per, _, _ = sample([length])
    e = f.emission(x, per)
    every = {y: score(f, e, y) for y in itertools.product(range(3), repeat=length)}
    total, share, expected = crf.chains(e[None], f.jumps, np.array([length]))
    z = np.log(sum(np.exp(s) for s in every.values()))
    assert total[0] == pytest.approx(z)
    for t in range(length):
        for k in range(3):
            assert share[0, t, k] == pytest.approx(sum(np.exp(s - z) for y, s in every.items() if y[t] == k))
    for a, b in itertools.product(range(3), repeat=2):
        assert expected[a, b] == pytest.approx(sum(np.exp(s - z) * sum(p == (a, b) for p in zip(y, y[1:])) for y, s in every.items()))
    assert tuple(f.best(x, per)) == max(every, key=every.get)


def test_padding_changes_nothing():
    f = field()
    x, per, y, length = sample([2, 5, 1, 5])
    loss, g = f.gradient(x, per, y, length)
    one, parts, at, ax = 0.0, 0.0, 0, 0
    for n in length:
        k = per[at : at + n]
        own, own_g = f.gradient(x[ax : ax + k.sum()], k, y[at : at + n], np.array([n]))
        one, parts, at, ax = one + own, parts + own_g, at + n, ax + k.sum()
    assert loss == pytest.approx(one)
    np.testing.assert_allclose(g, parts, atol=1e-9)


def test_gradient_equals_finite_differences():
    x, per, y, length = sample([3, 1, 6])
    f = field()
    flat = np.concatenate([f.weights.ravel(), f.jumps.ravel()])
    loss = lambda w: crf.Field.of(w, f.tags, 11).gradient(x, per, y, length)[0]
    _, g = f.gradient(x, per, y, length)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(g[i], abs=1e-5)


def test_minimise_finds_the_least_value():
    a = np.diag([1.0, 10.0, 100.0])
    f = lambda x: (0.5 * x @ a @ x - x @ np.array([1.0, 2.0, 3.0]), a @ x - np.array([1.0, 2.0, 3.0]))
    np.testing.assert_allclose(crf.minimise(f, np.zeros(3), iterations=100, tolerance=1e-8), [1.0, 0.2, 0.03], atol=1e-3)
    # with an absolute penalty the solution is known for each coordinate: (b - l1) / a, or zero
    sparse = crf.minimise(f, np.zeros(3), l1=2.5, iterations=200, tolerance=1e-8)
    np.testing.assert_allclose(sparse, [0.0, 0.0, 0.005], atol=1e-3)
    assert sparse[0] == 0.0


SHAPES = ["red", "blue", "tall", "Ada", "Bo", "Cy"]


def made(spark, n, seed=2):
    """A name is a person only behind "by", and then goes on over further names: neither words nor neighbours alone tell."""
    r = np.random.default_rng(seed)
    rows = []
    for sid in range(n):
        pos, live = 0, False
        for _ in range(int(r.integers(4, 14))):
            w = str(r.choice(["by", "by", "by", *SHAPES]))
            if w == "by":
                tag, live = "O", True
            elif w in SHAPES[3:]:
                before = rows[-1][3] if pos else "O"
                tag = ("I-PER" if before != "O" else "B-PER") if live else "O"
            else:
                tag, live = "O", False
            pos += 1
            rows.append((f"s{sid}", pos, w, tag))
    return spark.createDataFrame(rows, "sid string, pos int, word string, tag string").repartition(4)


def test_learns_what_a_word_alone_does_not_tell(spark):
    words = extract.word_features(made(spark, 500))
    got = crf.tagger(words, ["lower", "is_title", "p1"], ["O", "B-PER", "I-PER"], iterations=60, buckets=512).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == words.count() and 60 < len({r.sid for r in held}) < 150
    tp = sum(r.tag == r.predicted != "O" for r in held)
    f1 = 2 * tp / (sum(r.tag != "O" for r in held) + sum(r.predicted != "O" for r in held))
    # by words alone a third name in a row can't be told
    assert f1 > 0.95
    again = crf.tagger(words, ["lower", "is_title", "p1"], ["O", "B-PER", "I-PER"], iterations=60, buckets=512).collect()
    assert sorted(again) == sorted(got)


def test_gradient_over_tasks_equals_that_of_one(spark):
    tags = ["O", "B-PER", "I-PER"]
    rows = crf.sentences(crf.hashed(extract.word_features(made(spark, 60)), ["lower", "p1", "bos"], 64), tags).cache()
    w = np.random.default_rng(4).standard_normal(64 * 3 + 9)
    loss, g = crf.loss_and_gradient(rows.repartition(7), w, tags, 64)
    f, own, total = crf.Field.of(w, tags, 64), 0.0, 0.0
    for r in rows.collect():
        a, b = f.gradient(np.array(r.x), np.array(r.k), np.array(r.y), np.array([len(r.y)]))
        own, total = own + a, total + b
    assert loss == pytest.approx(own)
    np.testing.assert_allclose(g, total, atol=1e-8)


def test_messy_rows(spark):
    rows = [("a", 1, None, "B-X"), ("a", 2, "", "O"), ("b", 1, "é" * 5000, "unknown"), ("c", 1, "x", None)]
    words = extract.word_features(spark.createDataFrame(rows, "sid string, pos int, word string, tag string"))
    got = {(r.sid, r.pos): r.predicted for r in crf.tagger(words, ["lower", "length", "bos"], ["O", "B-X"], held_out=1000, iterations=5, buckets=16).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("c", 1)} and set(got.values()) <= {"O", "B-X"}
    assert crf.tagger(words.limit(0), ["lower"], ["O", "B-X"], iterations=3, buckets=16).collect() == []


def test_neighbours_and_ends(spark):
    rows = [("a", i, w) for i, w in enumerate("Dated May 3 by ACME Inc of Ohio-Land McDonald $5".split(), 1)] + [("b", 1, "Exhibit")]
    f = {(r.sid, r.pos): r for r in extract.word_features(spark.createDataFrame(rows, "sid string, pos int, word string")).collect()}
    a = lambda i: f["a", i]
    assert a(1).bos and not a(1).eos and a(10).eos and f["b", 1].bos and f["b", 1].eos and f["b", 1].is_section
    assert a(2).p1 == "dated" and a(2).p1_is_date_indicator and a(2).is_month and a(3).p1_is_month and a(3).p2_is_title and not a(3).p2_is_company_suffix
    assert a(5).is_all_caps and a(5).n1_is_company_suffix and a(4).n2 == "inc" and a(6).is_company_suffix and a(8).is_title and not a(9).is_title
    assert a(10).has_currency and a(10).n1 is None and a(10).n1_is_title is None and a(3).is_digit


def test_features_with_nulls_are_left_out(spark):
    d = crf.hashed(spark.createDataFrame([("x", True, None), ("x", False, 3)], "a string, b boolean, c int"), ["a", "b", "c"], 1 << 20)
    one, two = (set(r.x) for r in d.select("x").collect())
    assert len(one) == 3 and len(two) == 3 and len(one & two) == 2
    assert d.select(F.size("x")).distinct().count() == 1


def test_words_of_all_lines_are_tagged(spark, sf_dir):
    """Lines without personal data are tagged and reported on too; alone or among all, held-out sentences get the same tags."""
    from graphloom.plans import learn_queries

    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((f"{i}:{at}", pos, w) for i, t in texts for at, line in enumerate(t.split("\n")) if line for pos, w in enumerate(line.split(" "), 1))
    rows = learn_queries.tagged_words(spark, sf_dir).collect()
    assert sorted((r.sid, r.pos, r.word) for r in rows) == want and {r.tag for r in rows} > {"O", "B-CARD"}
    words = extract.word_features(made(spark, 60)).cache()
    run = lambda **k: crf.tagger(words, ["lower", "p1"], ["O", "B-PER", "I-PER"], iterations=4, buckets=64, **k).collect()
    assert sorted(run(held_out_only=True, tagged=words)) == sorted(r for r in run() if r.held_out)
