import numpy as np
import xxhash

from graphloom.llm import simhash as S


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_anchors_bring_all_near_pairs_together():
    rng = np.random.default_rng(1)
    x = []
    for v in rng.integers(0, 2**64, 200, dtype=np.uint64).tolist():
        for _ in range(7):
            y = v
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                y ^= 1 << int(b)
            x.append(y)
    x = np.unique(np.array(x, np.uint64))
    key, place, home = S.anchors(x)
    u, v = S.link_groups(key, x[place], home)
    at = {int(q): i for i, q in enumerate(x)}
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1)).tolist()
    assert len(near) > 300
    assert roots(len(x), near) == roots(len(x), [(at[int(i)], at[int(j)]) for i, j in zip(u, v, strict=True)])
    assert len(u) < len(x)


def test_every_word_is_within_one_of_its_nearest_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    key, place, home = S.anchors(x)
    for half in (0, 1):
        part = x >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        own = (key >> np.uint64(32)) == half
        d = np.bitwise_count((key[own] & np.uint64(0xFFFFFFFF)) ^ part[place[own]])
        assert d.max() <= 2 and d[home[own]].max() <= 1


def test_dense_group_is_connected_by_pivots():
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    f = np.unique(np.array([base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (1500, 2))], np.uint64))
    key, place, home = S.anchors(f)
    u, v = S.link_groups(key, f[place], home)
    at = {int(q): i for i, q in enumerate(f)}
    near = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1)).tolist()
    assert roots(len(f), near) == roots(len(f), [(at[int(i)], at[int(j)]) for i, j in zip(u, v, strict=True)])


def test_components_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    f = [plain_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 3]
    root = roots(len(f), links)
    expected = sorted((r.doc_id, f"{f[i]:016x}", rows[root[i]].doc_id) for i, r in enumerate(rows))
    assert sorted(map(tuple, S.simhash_components(docs).collect())) == expected


def test_messy_rows(messy, empty):
    rows = S.simhash_components(messy).collect()
    assert len(rows) == messy.count()
    got = {r.doc_id: r for r in rows}
    assert got[1].component_id == got[2].component_id == 1
    assert got[3].fingerprint == got[4].fingerprint == "0" * 16 and got[5].component_id == 3
    assert got[None].component_id is None
    assert S.simhash_components(empty).count() == 0
