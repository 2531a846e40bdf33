import random

import numpy as np
import pytest

from graphloom.llm import near_copies as N

from .test_simhash import roots


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def altered(rng, w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    """Copies of texts with words changed, from near 1 down to below 0.8, short ones and a large group among them."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for size in [30, 60, 120, 400] * 15:
        w = rng.choices(vocabulary, k=size)
        out += [altered(rng, w, 0), altered(rng, w, max(1, size // 60)), altered(rng, w, max(1, size // 40)), altered(rng, w, size // 15)]
    group = rng.choices(vocabulary, k=200)
    return out + [altered(rng, group, rng.randrange(1, 5)) for _ in range(150)] + ["a b", "A  b", "a c", "one"]


def test_components_against_brute_force(spark, texts):
    s = [plain_shingles(t) for t in texts]
    links = []
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both >= 0.8 * (len(s[i]) + len(s[j]) - both):
                links.append((i, j))
    assert len(links) > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, N.near_copies(docs).collect()))
    assert got == list(enumerate(roots(len(s), links)))


@pytest.mark.parametrize("side", [4000, 20])
def test_dense_group_sends_few_pairs(spark, monkeypatch, side):
    """Of a group whose texts are about 0.6 alike, pairs are told apart inside the task, and large keys in squares."""
    rng = random.Random(9)
    base = [f"w{i}" for i in rng.choices(range(3000), k=300)]
    out = [altered(rng, base, rng.randrange(9, 14)) for _ in range(160)] + [altered(rng, base, 2) for _ in range(3)]
    s = [plain_shingles(t) for t in out]
    links = [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    written, put = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, what: written.append((what, put(df, what))) or written[-1][1])
    monkeypatch.setattr(N, "SIDE", side)
    got = sorted(map(tuple, N.near_copies(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")).collect()))
    assert got == list(enumerate(roots(len(s), links)))
    met = sum(df.count() for what, df in written if what == "near-pairs")
    assert met < 0.2 * len(out) * (len(out) - 1) / 2


@pytest.mark.parametrize(("changed", "similarity"), [((7, 9), 0.6), ((4, 6), 0.73), ((3, 5), 0.78)])
def test_rows_that_go_out_grow_with_the_members(spark, monkeypatch, changed, similarity):
    """Groups that are about 0.6, 0.73 and 0.78 alike: what leaves the tasks is linear in the members, and no link is lost."""
    rng = random.Random(17)
    base = [f"w{i}" for i in rng.choices(range(3000), k=300)]
    out = [altered(rng, base, rng.randrange(*changed)) for _ in range(140)]
    s = [plain_shingles(t) for t in out]
    alike = [len(s[i] & s[j]) / len(s[i] | s[j]) for i in range(len(s)) for j in range(i)]
    assert abs(sum(alike) / len(alike) - similarity) < 0.04
    links = [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    written, put = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, what: written.append((what, put(df, what))) or written[-1][1])
    monkeypatch.setattr(N, "discard", lambda *_: None)
    got = sorted(map(tuple, N.near_copies(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")).collect()))
    assert got == list(enumerate(roots(len(s), links)))
    sent = sum(df.count() for what, df in written if what in ("near-pairs", "near-links", "near-joined"))
    assert sent <= (N.KEYS + 1) * len(out)


def test_joining_links_are_fewer_than_members():
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**48, 200, np.uint64)
    sets = [np.unique(np.concatenate([common[rng.random(200) < 0.93], rng.integers(0, 2**48, int(rng.integers(0, 12)), np.uint64)])) for _ in range(80)] + [np.empty(0, np.uint64)]
    x, side, a = np.arange(81), np.full(81, 2), rng.integers(0, 2**40, (81, 20))
    for labels in (x, x // 9, np.zeros(81, np.int64)):
        got = list(N.joining_links(sets, x, labels, side, a, 3, 0.8))
        every = [(int(labels[i]), int(labels[j])) for i in range(81) for j in range(i) if labels[i] != labels[j] and N.jaccard(sets[i], sets[j]) >= 0.8]
        assert roots(81, got) == roots(81, every) and len(got) < len(set(labels.tolist()))
    halves = list(N.joining_links(sets, x, x, np.arange(81) % 2, a, 0, 0.8))
    across = [(i, j) for i in range(81) for j in range(i) if (i - j) % 2 and N.jaccard(sets[i], sets[j]) >= 0.8]
    assert halves and roots(81, halves) == roots(81, across)
    assert not list(N.joining_links(sets, x, x, side, np.zeros((81, 20), np.int64), 3, 0.8))  # they met at an earlier key


def test_sets_are_read_as_they_were_written(tmp_path):
    rng = np.random.default_rng(4)
    sets = [N.stored(np.unique(rng.integers(0, 2**64, n, np.uint64))) for n in (0, 1, 7, 5000)]
    places, at = [], 0
    with open(tmp_path / "a.sets", "wb") as f:
        for s in sets:
            f.write(N.Sets.packed(s))
            places.append((at, len(s)))
            at += 6 * len(s)
    reader = N.Sets(f"file://{tmp_path}")
    for s, (a, n) in list(zip(sets, places, strict=True)) * 2:
        assert (reader.read("a.sets", a, n) == s).all()
    reader.close()


def test_stage_drops_pairs_that_three_bits_miss(spark, texts):
    import corpus_pipeline as P
    from graphloom.llm import simhash as S

    far = next((a, b) for a, b in zip(texts[::4], texts[1::4], strict=False) if N.jaccard(N.shingles(N.words(a)), N.shingles(N.words(b))) >= 0.8 and bin(S.fingerprint(a.encode()) ^ S.fingerprint(b.encode())).count("1") > 3)
    docs = spark.createDataFrame(list(enumerate(far)), "doc_id long, text string")
    assert [r.doc_id for r in P.near_copies_stage(spark, docs, "").collect()] == [0]
