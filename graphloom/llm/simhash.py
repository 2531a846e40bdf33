"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at ``DISTANCE`` (3) or fewer differing bits, so
one of their two halves differs in at most one bit. The anchors of a half are
a covering code: the perfect [31, 26] Hamming code with a free bit beside it,
which leaves no word further than 1 from an anchor. With the covering radius 1
and the threshold 1 of a half, a fingerprint is replicated to every anchor
within 2 (17 at most, 2 for an anchor itself), and each meets, at its own
nearest anchor, every other within 1 of it. Only there are whole fingerprints
compared. A covering code over all 64 bits would ask for thousands of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ._common import as_bytes, freed, materialise, narrow, shuffle_partitions

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Replicated rows that one task of the comparison holds, about.
ROWS_A_TASK = 2_000_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, unsigned; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(b" ".join(w), SEED)
    h = np.array([digest(b" ".join(s), SEED) for s in zip(*(w[k:] for k in range(shingle)), strict=False)], "<u8")
    v = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 64:
        ones = np.unpackbits(v, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(v[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["d", "f"])

    return run


#: Bits 0 to 30 of a half are the positions 1 to 31 of the Hamming code; bit 31 is free.
_PARITY = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)], np.uint64)
_FREE = 1 << 31


def _flips(s: int) -> list[int]:
    """What to flip in a word of syndrome s to get each anchor within 2, the nearest first."""
    if not s:
        return [0, _FREE]
    bit = lambda p: 1 << (p - 1)
    return [bit(s), bit(s) | _FREE, *(bit(p) | bit(p ^ s) for p in range(1, 32) if p < p ^ s and p ^ s < 32 and p != s)]


_WIDTH = 17
_FLIPS = np.array([(f := _flips(s)) + [0] * (_WIDTH - len(f)) for s in range(32)], np.uint64)
_COUNT = np.array([len(_flips(s)) for s in range(32)])


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place of the fingerprint, whether it is the nearest) over both halves."""
    keys, place, home = [], [], []
    for half in (0, 1):
        x = fingerprints >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        s = sum((np.bitwise_count(x & m).astype(np.int64) & 1) << k for k, m in enumerate(_PARITY))
        used = np.arange(_WIDTH) < _COUNT[s][:, None]
        keys.append(((x[:, None] ^ _FLIPS[s]) | np.uint64(half << 32))[used])
        place.append(np.broadcast_to(np.arange(len(x))[:, None], used.shape)[used])
        home.append(np.broadcast_to(np.arange(_WIDTH) == 0, used.shape)[used])
    return np.concatenate(keys), np.concatenate(place), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(k, 20_000) for k in range(0, batch.num_rows, 20_000)):
            f = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, place, home = anchors(f)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f[place].view(np.int64)), pa.array(home)], names=["a", "f", "home"])


class _Links:
    """Labels of the fingerprints of a task; only links that join two labels go out."""

    def __init__(self, f: np.ndarray):
        self.f, self.label = f, np.arange(len(f))
        self.out: list[tuple[int, int]] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.label[x], self.label[y]
        apart = a != b
        if not apart.any():
            return
        pair, at = np.unique(np.stack([a[apart], b[apart]], 1), axis=0, return_index=True)
        x, y, root = x[apart][at], y[apart][at], {}

        def find(i: int) -> int:
            while (j := root.get(i, i)) != i:
                root[i] = root.get(j, j)
                i = j
            return i

        for (a, b), i, j in zip(pair.tolist(), x.tolist(), y.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                self.out.append((i, j))
        old = np.array(sorted(root))
        new = np.array([find(i) for i in old.tolist()])
        k = np.searchsorted(old, self.label)
        k[k == len(old)] = 0
        self.label = np.where(old[k] == self.label, new[k], self.label)

    def compare(self, homes: np.ndarray, others: np.ndarray, cells: int = 4_000_000) -> None:
        """Links each of ``homes`` with those of ``others`` within the distance."""
        step = max(1, cells // max(1, len(others)))
        for k in range(0, len(homes), step):
            h = homes[k : k + step]
            i, j = np.nonzero(np.bitwise_count(self.f[h][:, None] ^ self.f[others][None, :]) <= DISTANCE)
            self.add(h[i], others[j])

    def group(self, homes: np.ndarray, others: np.ndarray, pivots: int = 16) -> None:
        """All links of an anchor; pairs that have come together already are passed over."""
        if len(homes) * len(others) > 1_000_000:
            for p in homes[:: max(1, len(homes) // pivots)]:
                self.compare(np.array([p]), others)
            names, sizes = np.unique(self.label[others], return_counts=True)
            most = names[np.argmax(sizes)]
            inside = self.label[homes] == most
            apart = others[self.label[others] != most]
            self.compare(homes[~inside], others)
            if len(apart):
                self.compare(homes[inside], apart)
        else:
            self.compare(homes, others)


def link_groups(key: np.ndarray, f: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of fingerprints) that connect what the anchors of a task bring together."""
    distinct, place = np.unique(f, return_inverse=True)
    links = _Links(distinct)
    order = np.lexsort((~home, key))
    key, place, home = key[order], place[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(first[1:], len(key))
    n_home = np.add.reduceat(home.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    # anchors with two fingerprints, one of them at home, are compared at once
    two = (end - first == 2) & (n_home > 0)
    x, y = place[first[two]], place[first[two] + 1]
    near = np.bitwise_count(distinct[x] ^ distinct[y]) <= DISTANCE
    links.add(x[near], y[near])
    for a, b, n in zip(*(v[(end - first > 2) & (n_home > 0)].tolist() for v in (first, end, n_home)), strict=True):
        links.group(place[a : a + n], place[a:b])
    out = np.array(links.out, np.int64).reshape(-1, 2)
    return distinct[out[:, 0]], distinct[out[:, 1]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches if b.num_rows]
    if parts:
        key, f, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, v = link_groups(key, f.view(np.uint64), home)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def near_links(fingerprints: DataFrame, column: str = "f") -> DataFrame:
    """(u, v) links between distinct fingerprints that connect all within the distance.

    Within an anchor a spanning part of the links goes out, never all pairs.
    """
    spark = fingerprints.sparkSession
    f = fingerprints.select(F.col(column).alias("f")).dropna().distinct()
    tasks = max(shuffle_partitions(spark), f.count() * 2 * _WIDTH // ROWS_A_TASK)
    rows = f.mapInArrow(_replicate, "a long, f long, home boolean")
    return rows.repartition(tasks, "a").mapInArrow(freed(_compare), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row per document: fingerprint, component_id (the least id reachable).

    Equal fingerprints are one node, whatever number of documents has them. A
    null or empty text, or one without words, has fingerprint zero and links
    like any other. Repeated rows each get a row; ids that are null stay null
    and do not name a component unless it has no other; an empty table gives
    no rows; other columns are not read.
    """
    d = narrow(docs, id_col, text_col).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    id_type = d.schema["d"].dataType.simpleString()
    prints = materialise(d.mapInArrow(freed(_fingerprints(shingle)), f"d {id_type}, f long"), "fingerprints")
    nodes = materialise(prints.groupBy("f").agg(F.min("d").alias("least")), "fingerprint-nodes")
    found = connected_components(near_links(nodes), "u", "v")
    placed = nodes.join(found.select(F.col("node").alias("f"), "component"), "f", "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    names = placed.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = placed.join(names, "c").select("f", "component_id")
    return prints.join(labels, "f").select(
        F.col("d").alias(id_col), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id"
    )
