import random

import numpy as np
import pytest

from graphloom.llm import suffix_dedup as S


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def compare(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df, with_text=False, **how).collect()}
    assert [got[i] for i in range(len(texts))] == S.brute_force([(t or "").encode() for t in texts])
    return got


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, (3000, 5)).astype(np.uint64)
    order = S.multikey_quicksort(w)
    assert sorted(order.tolist()) == list(range(3000))
    assert [tuple(r) for r in w[order].tolist()] == sorted(tuple(r) for r in w.tolist())


def test_each_string_has_one_anchor_and_equal_strings_equal_ones():
    rng = random.Random(2)
    text = (words(rng, 80) + "aaaa" * 100).encode()
    a, p, q, h = S.anchors([b"xy" * 150, text, text])
    starts = [(int(s), int(x) - int(s), int(g)) for x, f, e, g in zip(a, p, q, h, strict=True) for s in range(f, e + 1)]
    sizes, at = (300, len(text), len(text)), 0
    expected = []
    for n in sizes:
        expected += range(at, at + n - S.LENGTH + 1)
        at += n
    assert sorted(s for s, *_ in starts) == expected
    by = {s: (d, g) for s, d, g in starts}
    assert all(by[300 + i] == by[300 + len(text) + i] for i in range(len(text) - S.LENGTH + 1))


def test_long_text_in_pieces_finds_the_same_strings():
    rng = random.Random(3)
    t = bytes(rng.choice(b"abcd ") for _ in range(5000))
    whole = S.anchors([t])
    old, S.CHUNK = S.CHUNK, 1024
    S._POWERS.clear()
    try:
        parts = S.anchors([t])
    finally:
        S.CHUNK = old
        S._POWERS.clear()
    spread = lambda r: sorted((s, int(a) - s) for a, p, q, _ in zip(*r, strict=True) for s in range(p, q + 1))
    assert [s for s, _ in spread(whole)] == [s for s, _ in spread(parts)] == list(range(5000 - 199))


def test_hot_passage_over_many_blocks_and_buckets(spark):
    rng = random.Random(5)
    hot = words(rng, 60)
    texts = [words(rng, 20) + " " + (hot if i % 3 else hot[rng.randint(0, 80) : rng.randint(200, 330)]) + " " + words(rng, 15) for i in range(250)]
    texts += ["a" * 700, "ab" * 400, "xyz" * 300 + "q", hot, hot, None, "", "short", hot[:199], hot[:200], hot[:201], "é" * 150, "ß" + "é" * 150]
    compare(spark, texts, block_bytes=4000)


def test_removed_joins_what_touches_but_no_texts():
    runs = np.array([(0, 3, 5), (0, 4, 9), (1, 0, 0), (2, 0, 0)], S._RUN)
    start, end = S.removed(runs, np.array([100, 500, 700, 1000]), np.array([0, 1, 2, 3]), np.array([700, 1300]))
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [(91, 297), (500, 700), (700, 900)]


def test_near_copies_over_many_buckets_send_a_row_each(spark, monkeypatch):
    """Contexts near a boundary go out once each, however many of their strings may repeat beyond it."""
    rng = random.Random(8)
    base = words(rng, 120).split()
    texts = []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(len(w)), 3):
            w[k] = words(rng, 1)
        texts.append(" ".join(w))
    written, put = {}, S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, what: written.setdefault(what, put(df, what)))
    monkeypatch.setattr(S, "SUFFIX_BUCKET", 40)
    compare(spark, texts, block_bytes=3000)
    assert 0 < written["suffix-verdicts"].filter("key is not null").count() <= written["suffixes"].filter("ctx >= 0").count()


def test_a_block_that_differs_on_a_retry_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="not the block"):
        S.put(f"file://{tmp_path}/b", b"other")
        S._load(f"file://{tmp_path}/b", check=1)


def test_against_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = compare(spark, [r.text for r in docs])
    assert sum(x[1] for x in got.values()) > 0


def test_messy_rows(messy, empty):
    rows = S.suffix_dedup(messy).collect()
    assert len(rows) == messy.count()
    narrow = {r.doc_id: r for r in S.passages(messy).collect()}
    assert narrow[1].n_removed == narrow[1].n_bytes and narrow[1].n_spans == 1
    assert narrow[3].n_bytes == narrow[4].n_bytes == 0 and narrow[8].n_removed == 0
    assert S.passages(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201])
def test_short_texts_stay(spark, n):
    got = compare(spark, ["q" * n if n < 200 else "".join(chr(97 + i % 26) for i in range(n // 2)) + "-" * (n - n // 2)])
    assert len(got) == 1
