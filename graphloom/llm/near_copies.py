"""Near copies by Jaccard similarity: SimHash anchors and min-wise keys find candidates, whole shingle sets confirm them.

Fingerprints of 64 bits meet by anchor-point covering as in ``simhash``, which
finds the nearest copies. At a similarity of 0.8 two fingerprints differ in
about ten bits, which no covering code reaches at a bearable number of copies.
So texts also meet at keys of ``ROWS`` least shingles each; one of ``KEYS`` is
shared with a probability of 1 - (1 - 0.8^5)^20 = 0.9996. A link is what the
exact Jaccard similarity confirms.

The sets are written once, as files of the shared folder, and read by range
where two are compared; neither texts nor sets go through a shuffle. First all
members of a key are compared with the one that has the most company, which
joins large groups at a linear cost. Where a key still holds different groups,
one task compares their members by an index of its shingles and sends only
links that join two groups, of which there are fewer than members.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import discard, remove
from ._common import as_texts, freed, groups, materialise, narrow, open_fs, scratch, shuffle_partitions
from .simhash import _BITS, SEED, near_links

SHINGLE = 5
SIMILARITY = 0.8
KEYS, ROWS = 20, 5
#: Members of a key that one task compares with as many others, and shingles that both sides hold about.
SIDE, SIDE_SHINGLES = 4000, 2_000_000
#: Bits of a hash that are stored, and bytes of sets that a task keeps at hand.
STORED_BITS, AT_HAND = 48, 32 << 20

_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 1 << 32, (KEYS * ROWS, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, (KEYS * ROWS, 1), dtype=np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def words(text: str) -> list[str]:
    return text.lower().split()


def shingles(w: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; fewer words than a shingle make one, no words none."""
    if not w:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, SEED) for x in w], np.uint64)
    k = min(shingle, len(h))
    out = h[: len(h) - k + 1]
    for j in range(1, k):
        out = _mixed(out * _P + h[j : len(h) - k + 1 + j])
    return np.unique(_mixed(out + np.uint64(k)))


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of shingles."""
    if not len(s):
        return 0
    v = s.view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(v, axis=1, bitorder="little").sum(axis=0) if len(s) < 64 else np.concatenate([np.bincount(v[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def keys(s: np.ndarray) -> np.ndarray:
    """The keys at which a set of shingles meets others; none for an empty set."""
    if not len(s):
        return np.empty(0, np.int64)
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(KEYS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(least, ((low[k : k + 2048] ^ _XOR) * _MUL).min(axis=1), out=least)
    out = np.arange(KEYS, dtype=np.uint64)
    for column in least.reshape(KEYS, ROWS).T.astype(np.uint64):
        out = _mixed(out * _P + column)
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of distinct hashes; 0 where both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def stored(s: np.ndarray) -> np.ndarray:
    """The leading ``STORED_BITS`` of ascending hashes, distinct."""
    return np.unique(s >> np.uint64(64 - STORED_BITS))


class Sets:
    """Sets in files of a folder, read by range; the last ones read stay at hand up to ``AT_HAND`` bytes."""

    def __init__(self, folder: str):
        self.folder, self.size = folder, 0
        self.files: OrderedDict = OrderedDict()
        self.held: OrderedDict = OrderedDict()

    @staticmethod
    def packed(s: np.ndarray) -> bytes:
        return s.astype("<u4").tobytes() + (s >> np.uint64(32)).astype("<u2").tobytes()

    def read(self, file: str, at: int, n: int) -> np.ndarray:
        """The n hashes at a place of a file."""
        if not n:
            return np.empty(0, np.uint64)
        if (file, at) in self.held:
            self.held.move_to_end((file, at))
            return self.held[file, at]
        if file not in self.files:
            fs, path = open_fs(f"{self.folder}/{file}")
            self.files[file] = fs.open_input_file(path)
            if len(self.files) > 32:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(file)
        data = self.files[file].read_at(6 * n, at)
        out = np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)
        self.held[file, at] = out
        self.size += out.nbytes
        while self.size > AT_HAND and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return out

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def node(w: list[str]) -> int:
    """Texts of the same words are one node."""
    return xxhash.xxh3_64_intdigest(" ".join(w), SEED)


def _described(folder: str, shingle: int):
    """(d, x, n, f, a, file, at) of documents; the set of each distinct text of a task is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, end, written = f"{uuid.uuid4().hex}.sets", 0, {}
        fs, path = open_fs(f"{folder}/{file}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for batch in batches:
                x, n, f, a, at = [], [], [], [], []
                for t in as_texts(batch.column(1)):
                    w = words(t)
                    s = shingles(w, shingle)
                    x.append(node(w))
                    f.append(fingerprint(s))
                    a.append(keys(s))
                    if x[-1] not in written:
                        own = stored(s)
                        written[x[-1]] = end, len(own)
                        out.write(Sets.packed(own))
                        end += 6 * len(own)
                    at.append(written[x[-1]][0])
                    n.append(written[x[-1]][1])
                arrays = [batch.column(0), pa.array(np.array(x, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(f, pa.int64()), pa.array(a, pa.list_(pa.int64())), pa.array([file] * len(x), pa.string()), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["d", "x", "n", "f", "a", "file", "at"])

    return run


def _confirmed(folder: str, similarity: float):
    """The pairs whose sets are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        for batch in batches:
            place = [list(zip(*[batch.column(f"{c}{e}").to_pylist() for c in ("file", "at", "n")], strict=True)) for e in ("u", "v")]
            ok = [jaccard(sets.read(*u), sets.read(*v)) >= similarity for u, v in zip(*place, strict=True)]
            kept = batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
            yield kept
        sets.close()

    return run


def joining_links(sets: list[np.ndarray], x: np.ndarray, c: np.ndarray, side: np.ndarray, a: np.ndarray, own: int, similarity: float) -> Iterator[tuple[int, int]]:
    """(label, label) of links between members of a key that join two groups.

    Members of side 0 meet side 1, those of side 2 each other. ``a`` has the keys
    of each and ``own`` is the place of this one; a pair counts only at the
    first key that it shares. Common shingles of a member with all others come
    from an index of the shingles; a link within a group found so far is
    passed over, so fewer links than members go out.
    """
    n = np.array([len(s) for s in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(shingle, kind="stable")
    by_shingle, first = member[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    start = np.cumsum(n) - n
    names, label = np.unique(c, return_inverse=True)  # groups as found so far
    most = np.argmax(np.bincount(label))
    few = label != most  # members of the largest group meet only those outside
    for i in np.flatnonzero(few):
        j = np.flatnonzero((label != label[i]) & np.where(few, x > x[i], True) & ((side == 2) | (side != side[i])) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]) - 1e-9))
        j = j[~(a[j, :own] == a[i, :own]).any(axis=1)]
        if not len(j):
            continue
        mine = shingle[start[i] : start[i] + n[i]]
        size = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(by_shingle[at], minlength=len(sets))[j]
        for k in j[common >= similarity * (n[i] + n[j] - common)]:
            old, new = label[k], label[i]
            if old != new:
                yield int(names[old]), int(names[new])
                label[label == old] = new


def _joined(folder: str, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Sets(folder)
        for rows in groups(batches, "cell"):
            x, n, c, side = (rows[name].to_numpy() for name in ("x", "n", "c", "side"))
            sets = [reader.read(*p) for p in zip(*[rows[name].to_pylist() for name in ("file", "at", "n")], strict=True)]
            links = list(joining_links(sets, x, c, side, np.array(rows["keys"].to_pylist(), np.int64), rows["place"][0].as_py(), similarity))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in zip(*links, strict=True)], names=["cu", "cv"])
        reader.close()

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: component_id, the least id reachable over pairs of that Jaccard similarity or more.

    Words are lower-cased and split at white space; texts of the same words
    are one node, whatever their length. A null or empty text has no words, and
    all such are copies of each other. Repeated rows each get a row; null ids
    stay null and name a component only if it has no other; an empty table
    gives no rows; other columns are not read. A key of many members is dealt
    out to tasks in squares of ``SIDE`` members and ``SIDE_SHINGLES`` shingles.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    id_type = d.schema["d"].dataType.simpleString()
    folder = scratch(spark, "near-sets")
    rows = materialise(d.mapInArrow(freed(_described(folder, shingle)), f"d {id_type}, x long, n int, f long, a array<long>, file string, at long"), "near-copies")
    nodes = rows.groupBy("x").agg(F.min("d").alias("least"), F.first("f").alias("f"), F.first("a").alias("a"), F.min(F.struct("file", "at", "n")).alias("set"))
    nodes = materialise(nodes.select("x", "least", "f", "a", "set.*"), "near-nodes")

    def ordered(u, v):
        return F.least(u, v).alias("u"), F.greatest(u, v).alias("v")

    # what anchors bring together, and texts of an equal fingerprint with the first of them
    prints = materialise(nodes.groupBy("f").agg(F.min("x").alias("x")), "near-fingerprints")
    by_print = {e: prints.select(F.col("f").alias(e), F.col("x").alias(f"x{e}")) for e in ("u", "v")}
    near = near_links(prints).join(by_print["u"], "u").join(by_print["v"], "v").select(*ordered("xu", "xv"))
    equal = nodes.select("f", "x").join(prints.withColumnRenamed("x", "first"), "f").filter("x <> first").select(*ordered("x", "first"))
    # of each key the member with the most company, and all others
    members = nodes.select(F.posexplode("a").alias("place", "a"), "x")
    shared = members.groupBy("a").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialise(members.join(shared, "a"), "near-members")
    company = members.groupBy("x").agg(F.sum("size").alias("company"))
    centre = members.join(company, "x").groupBy("a").agg(F.max_by("x", F.struct("company", "x")).alias("centre"))
    star = members.join(centre, "a").filter("x <> centre").select(*ordered("x", "centre"))
    tried = materialise(near.union(equal).union(star).distinct(), "near-pairs")
    place = {e: nodes.select(F.col("x").alias(e), *[F.col(c).alias(f"{c}{e}") for c in ("file", "at", "n")]) for e in ("u", "v")}
    sized = F.least("nu", "nv") >= F.lit(similarity) * F.greatest("nu", "nv") - 1e-9
    pairs = tried.join(place["u"], "u").join(place["v"], "v").filter(sized)
    links = materialise(pairs.mapInArrow(freed(_confirmed(folder, similarity)), "u long, v long"), "near-links")
    found = connected_components(links, "u", "v").select(F.col("node").alias("x"), "component")
    labels = materialise(nodes.select("x").join(found, "x", "left").select("x", F.coalesce("component", "x").alias("c")), "near-labels")
    # keys that still hold different groups
    labelled = members.join(labels, "x")
    mixed = labelled.groupBy("a").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("a")
    mixed = labelled.join(mixed, "a", "left_semi").join(nodes.select("x", "n", "file", "at", F.col("a").alias("keys")), "x")
    weight = mixed.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("n") / SIDE_SHINGLES)).cast("long").alias("parts"))
    mixed = materialise(mixed.join(weight, "a"), "near-mixed")
    parts = F.col("parts")
    own = F.pmod(F.xxhash64("x"), parts)
    cells = mixed.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    cells = cells.select(F.xxhash64("a", F.least("own", "with"), F.greatest("own", "with")).alias("cell"), "x", "n", "file", "at", "c", "keys", "place", side.alias("side"))
    tasks = max(shuffle_partitions(spark), mixed.agg(F.sum("parts")).first()[0] // (2 * SIDE) if not mixed.isEmpty() else 0)
    joined = materialise(cells.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(freed(_joined(folder, similarity)), "cu long, cv long"), "near-joined")
    if not joined.isEmpty():  # components of the first round are the nodes of the second
        outer = connected_components(joined, "cu", "cv").select(F.col("node").alias("c"), "component")
        labels = labels.join(outer, "c", "left").select("x", F.coalesce("component", "c").alias("c"))
    placed = materialise(nodes.select("x", "least").join(labels, "x"), "near-placed")
    names = placed.groupBy("c").agg(F.min("least").alias("component_id"))
    out = rows.select("d", "x").join(placed.select("x", "c").join(names, "c"), "x").select(F.col("d").alias(id_col), "component_id")
    out = materialise(out, "near-components")
    discard(rows, nodes, prints, members, links, mixed, placed)  # the pairs stay to be looked at
    remove(spark, folder)
    return out
