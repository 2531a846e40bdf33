import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import spelling


def brute_words(docs, damage=199, min_length=6, min_count=5):
    low = str.maketrans(spelling.CAPITALS, spelling.SMALL)
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % damage == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = [n[w], len(others), best if best and n[best] >= 5 * n[w] else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [n[row[2]] if row[2] else None, root]
    return out


def result(df):
    rows = df.collect()
    out = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in rows}
    assert len(out) == len(rows)
    return out


def made(spark, n):
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(n.items())]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_equals_brute_force(spark):
    r = np.random.default_rng(5)
    base = ["".join(r.choice(list("abé"), r.integers(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "straßen", "strassen", "ÀÉÎÕÜß"]
    n = {}
    for w in base:
        n.setdefault(w, int(r.choice([5, 6, 30, 200, 1000])))
        for _ in range(3):  # a few changed letters
            at = int(r.integers(0, len(w)))
            v = [w[:at] + w[at + 1 :], w[:at] + "ö" + w[at:], w[:at] + "z" + w[at + 1 :]][int(r.integers(0, 3))]
            n.setdefault(v, int(r.choice([5, 25, 150])))
    docs = made(spark, n)
    expected = brute(brute_words([(x.doc_id, x.text) for x in docs.collect()]))
    assert result(spelling.spelling_variants(docs)) == expected
    assert sum(row[2] is not None for row in expected.values()) > 20 and max(row[1] for row in expected.values()) > 3


def test_damage_follows_the_hash(spark):
    docs = [(i, "Wörterbuch dictionary " * 7 + "Aéroport") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.word: x.n for x in spelling.word_counts(df, damage=3, min_count=1).collect()}
    assert got == brute_words(docs, damage=3, min_count=1) and len(got) > 6


def test_chains_are_followed_to_the_last(spark):
    chain = {"abcdefg": 40_000, "abcdefgh": 8000, "abcdefghi": 1600, "abcdefghij": 320, "abcdefghijk": 64, "abcdefghijkl": 12}
    got = result(spelling.spelling_variants(made(spark, chain), damage=10**12))
    assert {row[4] for row in got.values()} == {"abcdefg"}
    assert got["abcdefghijkl"][2:4] == ["abcdefghijk", 64]


def test_no_pairs_of_a_large_group(spark):
    """300 words of one pattern give one row each, not a row a pair."""
    letters = [chr(c) for c in [*range(0xC0, 0x100), *range(97, 123)] if c not in (0xD7, 0xF7)]
    n = {f"{c}attern": 5 + i for i, c in enumerate(letters)}
    words = spark.createDataFrame([(i, w, k) for i, (w, k) in enumerate(n.items())], "id long, word string, n long")
    near_rows = spelling.near_words(words).collect()
    assert len(near_rows) == len(letters) and {x.n_near for x in near_rows} == {len(letters) - 1}


def test_meetings_find_every_replacement_although_keys_collide():
    """With all keys equal, rows still meet by place; strings then decide."""
    r = np.random.default_rng(1)
    words = sorted({"".join(r.choice(list("ab"), 6)).encode() for _ in range(30)})
    w, p, k, h = spelling.deletion_keys(words)
    order = np.lexsort((w, p))
    batch = pa.RecordBatch.from_pydict({"key": k * 0, "place": p[order].astype(np.int32), "id": w[order], "head": h[order]})
    met = pa.Table.from_batches(list(spelling._meetings(iter([batch.slice(0, 40), batch.slice(40)])))).to_pylist()
    found = set()
    for m in met:
        if m["link"] == m["place"]:
            found |= {(m["id"], o["id"]) for o in met if o["link"] == m["link"] and near(words[m["id"]].decode(), words[o["id"]].decode())}
    every = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a.decode(), b.decode())}
    assert found == every


def test_keys_equal_those_of_the_strings():
    words = ["aab", "b", "éaß", "zzzz", "abcabc", "q" * 500]
    w, place, key, head = spelling.deletion_keys([x.encode() for x in words])
    shorter = sorted({x if p < 0 else x[:p] + x[p + 1 :] for x, p in ((words[i], p) for i, p in zip(w, place))} - {""})
    own = dict(zip(shorter, spelling.deletion_keys([x.encode() for x in shorter])[2][: len(shorter)].tolist()))
    for i, p, k, h in zip(w.tolist(), place.tolist(), key.tolist(), head.tolist()):
        s = words[i] if p < 0 else words[i][:p] + words[i][p + 1 :]
        assert not s or own[s] == k
        assert h == (p == 0 or (p > 0 and words[i][p] != words[i][p - 1]))


def test_messy_rows(spark, messy, empty):
    rows = [(x.doc_id, x.text) for x in messy.collect()]
    expected = brute(brute_words(rows, min_count=3, min_length=4))
    assert result(spelling.spelling_variants(messy, min_count=3, min_length=4)) == expected and expected
    assert spelling.spelling_variants(empty).collect() == []
    letters = "é" * 40_000
    long = spark.createDataFrame([(1, f"{letters} {letters}a"), (2, f"{letters} {letters}a {letters}a"), (None, None)], "doc_id long, text string")
    got = result(spelling.spelling_variants(long, min_count=2, ratio=1, damage=10**12))
    assert got[letters] == [2, 1, letters + "a", 3, letters + "a"] and got[letters + "a"][:3] == [3, 1, None]


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_keys_that_go_over_batches(cut):
    key = np.sort(np.random.default_rng(2).integers(0, 6, 40))
    batch = pa.RecordBatch.from_pydict({"key": key, "x": np.arange(40)})
    parts = list(spelling._whole_keys(iter([batch.slice(a, cut) for a in range(0, 40, cut)])))
    assert [x for p in parts for x in p.column("x").to_pylist()] == list(range(40))
    seen = [set(p.column("key").to_pylist()) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen))
