import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import importance
from graphloom.llm.importance import Tournament


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_features(text, longest):
    w = brute_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("step", [5, 64, 1 << 20])
def test_features_go_over_the_ends_of_parts(monkeypatch, longest, step):
    monkeypatch.setattr(importance, "STEP", step)
    texts = ["", "  ", "One", "Éa_b-c D9 ñandú 日本語 x", "word " * 50 + "END", "a" * 700 + " b", "UPPER lower ÀB"]
    for text in texts:
        parts = list(importance.features(text.encode(), longest, 977))
        got = sorted(np.concatenate([b for _, b in parts]).tolist()) if parts else []
        assert got == sorted(zlib.crc32(f.encode()) % 977 for f in brute_features(text, longest))
        assert sum(n for n, _ in parts) == len(brute_words(text))


def test_tournament_merges_any_number_of_sources():
    r = np.random.default_rng(3)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted(r.integers(0, 20, r.integers(0, 30)).tolist()) for _ in range(k)]
        got = list(Tournament([iter([(x, x) for x in run]) for run in runs]))
        assert got == sorted(x for run in runs for x in run)


def by_hand(rows, min_words, per_cent):
    """Rows in their order of draw, by one sort."""
    e = sorted((x for x in rows if x.n_words >= min_words), key=lambda x: (-x.score, x.id is None, x.id or 0))
    return {(k + 1, x.score, x.id) for k, x in enumerate(e[: per_cent * len(e) // 100])}


@pytest.mark.parametrize("limits", [{}, {"run_rows": 50, "range_rows": 90, "fan": 2, "block": 7}, {"run_rows": 33, "range_rows": 10_000, "fan": 3, "block": 4}, {"run_rows": 1000, "range_rows": 40, "fan": 2, "block": 16}])
@pytest.mark.parametrize("per_cent", [0, 55])
def test_draw_equals_one_sort(spark, limits, per_cent):
    n = F.col("id")
    rows = spark.range(0, 900, numPartitions=5).select(
        F.when(n % 97 == 0, None).otherwise(n % 700).alias("id"), (n % 40).alias("n_words"), n.alias("n_features"), n.alias("weight"), F.when(n % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(50))).alias("score")
    )
    got = importance.draw(rows, 5, per_cent, **limits).collect()
    assert len(got) == 900
    assert {(x.rank, x.score, x.id) for x in got if x.rank} == by_hand(got, 5, per_cent)
    assert sorted(x.weight for x in got) == list(range(900))


def test_ids_that_are_texts(spark):
    rows = spark.range(200).select(F.concat(F.lit("d"), "id").alias("id"), F.lit(30).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 7).alias("score"))
    got = importance.draw(rows, 20, 50, run_rows=30, range_rows=20, fan=2, block=8).collect()
    best = sorted(((-x.score, x.id) for x in got))[:100]
    assert [(-x.score, x.id) for x in sorted((x for x in got if x.rank), key=lambda x: x.rank)] == best


def test_messy_rows(spark, messy, empty):
    target = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (3, "")], "item long, text string")
    out = importance.resample(messy, target, per_cent=60).collect()
    assert len(out) == 10
    rows = {x.doc_id: x for x in out}
    assert rows[3].n_features == rows[3].weight == rows[4].n_features == rows[5].n_features == 0
    assert rows[6].n_words == 30_001 and rows[1].weight == rows[2].weight > rows[6].weight
    # ids 1, 2, 2 and 6 have 20 words or more: two of four are drawn
    best = sorted((-x.score, x.doc_id) for x in out if x.n_words >= 20)[:2]
    assert sorted((-x.score, x.doc_id) for x in out if x.rank) == best
    assert importance.resample(empty, target).collect() == []
    alone = importance.resample(messy.filter("doc_id = 8"), target.filter("false")).collect()
    assert [(x.n_features, x.rank) for x in alone] == [(1, None)]


def test_gains_and_scores():
    g = importance.gains(np.array([0, 3]), np.array([2, 0]))
    assert g.tolist() == [int(np.floor(1000 * np.log(3 * 5 / (1 * 4)))), int(np.floor(1000 * np.log(1 * 5 / (4 * 4))))]
    assert importance.gumbel(5) != importance.gumbel(6) and importance.gumbel(5) == importance.gumbel(5)
