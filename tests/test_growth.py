"""Steps that must not grow with the largest group or with equal rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.operators import coref, crf, extract, learn, punkt
from graphloom.plans import QUERIES, learn_queries
from graphloom.session import parts_for


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coref_pairs_group_documents_once(spark):
    docs = spark.createDataFrame([(1, "Alpha Betas they Gamma it and Delta Parties said their it"), (2, "it came"), (None, "Alpha it")], "doc_id long, text string")
    pairs, _ = learn.coref_pairs(coref.marked_tokens(docs))
    assert plan(pairs).count("Exchange hashpartitioning") == 1
    got = sorted((r.pos, r.candidate, r.at, r.label) for r in pairs.collect())
    first = [(3, "Alpha", 1, 0), (3, "Betas", 2, 1), (5, "Alpha", 1, 0), (5, "Betas", 2, 0), (5, "Gamma", 4, 1)]
    later = [(p, w, at, int(w == right)) for p, right in ((10, "Parties"), (11, "Delta")) for w, at in (("Alpha", 1), ("Betas", 2), ("Delta", 7), ("Gamma", 4), ("Parties", 8))]
    assert got == sorted(first + later)


def test_equal_pairs_count_by_their_number(spark):
    d = spark.createDataFrame([(1, 1)] * 5 + [(1, 0)] * 3 + [(0, 1)] * 2 + [(0, 0)], "p int, a int")
    few = d.groupBy("p", "a").agg(F.count("*").alias("n"))
    assert learn.metrics(d, "p", "a").collect() == learn.metrics(few, "p", "a", "n").collect()


def test_histogram_holds_no_two_sets(spark, sf_dir):
    assert "Expand" not in plan(QUERIES["relation_histogram"](spark, sf_dir))


def test_rows_are_dealt_before_they_grow(spark):
    d = spark.range(200).select("id", F.concat(F.lit("some word "), F.col("id") % 7).alias("t")).coalesce(1)
    assert learn.char_tfidf(d, "t").rdd.getNumPartitions() == parts_for(d) > 1


def test_spans_are_made_a_sentence_at_a_time(spark):
    row = lambda i, s, *x: (i, s, [dict(zip(("word", "label"), w, strict=True)) if w else None for w in x])
    rows = [row(1, "a bb a", ("a", "B-X"), ("bb", "I-X"), None, ("a", "B-Y")), row(2, None, ("a", "B-X")), (3, "a", None), row(4, "a", ("z", "B-X"), ("a", None))]
    got = extract.words_to_spans(spark.createDataFrame(rows, "sid long, sentence string, labels array<struct<word:string,label:string>>"))
    assert "MapInArrow" in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 4, "X", "a bb"), (1, 5, 6, "Y", "a")]


def test_a_field_works_on_many_sentences_at_once(spark, monkeypatch):
    """Sums are products but for weights far apart; the best tags of all sentences are those of each; parts hold every row once."""
    r = np.random.default_rng(5)
    length = np.array([1, 3, 3, 8])
    per = r.integers(1, 5, length.sum())
    x = r.integers(0, 40, per.sum())
    f = crf.Field(list("abc"), r.standard_normal((40, 3)), r.standard_normal((3, 3)))
    whole, at, ax = f.best(x, per, length), 0, 0
    for n in length:
        k = per[at : at + n]
        assert whole[at : at + n] == f.best(x[ax : ax + k.sum()], k)
        at, ax = at + n, ax + k.sum()
    padded = f._padded(x, per, length)[1]
    logs = crf._chains_in_logs(padded, f.jumps, length)
    far = crf._chains_in_logs(padded * 1e4, f.jumps * 1e4, length)
    kept = crf._chains_in_logs
    monkeypatch.setattr(crf, "_chains_in_logs", lambda *a: 1 / 0)
    for a, b in zip(crf.chains(padded, f.jumps, length), logs):
        np.testing.assert_allclose(a, b, atol=1e-12)
    monkeypatch.setattr(crf, "_chains_in_logs", kept)
    for a, b in zip(crf.chains(padded * 1e4, f.jumps * 1e4, length), far):
        np.testing.assert_allclose(a, b)
    y = [[0] * int(n) for n in (3, 0, 1, 3)]
    batch = pa.RecordBatch.from_pydict({"x": [[i] * len(v) for i, v in enumerate(y)], "k": [[1] * len(v) for v in y], "y": y})
    monkeypatch.setattr(crf, "WORDS", 4)
    got = [(rows.tolist(), x.tolist(), n.tolist()) for rows, (x, _, _, n) in crf._parts(batch)]
    assert got == [([2], [2], [1]), ([0], [0] * 3, [3]), ([3], [3] * 3, [3])]


def test_signs_leave_out_no_line_of_personal_data(spark):
    rows = ["", None, "plain", "a@b", "a@bc d", "+1 (234) 567-8901", "1 (234) 567-8901", "1234567890123456", "12345678901234567", "1.2.3.4", "x@", "+", "@ 10.0.0.1"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    held = lambda c: [r.i for r in d.filter(c).orderBy("i").collect()]
    assert held(learn_queries.holds_personal(F.col("t"))) == held(F.col("t").rlike("|".join(learn_queries.PERSONAL.values())))
