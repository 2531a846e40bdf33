"""Suffix-array removal of repeated passages: sampled splitters, multikey quicksort, boundaries.

A byte goes if a string of ``LENGTH`` (200) bytes over it starts anywhere else
too. Sorting every suffix would move each byte 200 times, so suffixes start at
anchors: of the grams of 64 bytes in a string, the one of least hash (the first
on ties). Equal strings have equal anchors at equal offsets, so

1. anchors' grams are dealt out by hash and counted; only anchors whose gram
   comes twice go on, each with the bytes of all strings it stands for;
2. these contexts, equal ones of a block as one, are suffixes from the anchor
   (and what lies before it, backwards). Sampled splitters range-partition
   them by their leading bytes, at any point, so no key is too frequent;
3. each bucket sorts its suffixes by multikey quicksort over words of 8 bytes.
   With the common prefixes of neighbours, strings that reach ``a`` bytes
   before the anchor repeat if 200 - a bytes behind it and a bytes before it
   are equal. A suffix that shares 200 - a bytes with a splitter may repeat
   beyond the boundary: such contexts, one row each, are ordered once more by
   what lies before the anchor, where those of equal strings are neighbours;
4. what repeats goes back to the block of texts, which marks and cuts it.

Texts lie in files of whole blocks in the shared folder and are not shuffled.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, freed, get, groups, materialise, narrow, partition_id, put, scratch, shuffle_partitions, slices_of_bytes

LENGTH, GRAM = 200, 64
#: Grams in a string, and so the most bytes of a string before its anchor, plus one.
REACH = LENGTH - GRAM + 1
#: Bytes of text in a block at most, but for one text that has more by itself.
BLOCK_BYTES = 8_000_000
CHUNK = 1 << 18
#: Bytes of all texts for each bucket of gram hashes, and contexts for each bucket of suffixes, about.
GRAM_BUCKET_BYTES, SUFFIX_BUCKET = 64_000_000, 40_000
#: Samples for each bucket of the range partitioning.
OVERSAMPLE = 16

_R = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in (int(_R), pow(int(_R), -1, 1 << 64)):
            p = np.full(CHUNK + 1, np.uint64(base))
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    up, down = _powers()
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=s[1:])
    h = (s[GRAM:] - s[:-GRAM]) * down[: len(b) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width``: of a tail and a head of blocks that long."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    m = padded.reshape(-1, width)
    head = np.minimum.accumulate(m, axis=1).ravel()
    tail = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def _chunk_anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first and last string start, gram hash) over texts that end at ``ends``."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if len(b) < LENGTH:
        return none
    h = _gram_hashes(b)
    place = np.uint64(CHUNK - 1)
    least = _sliding_least(h & ~place | np.arange(len(h), dtype=np.uint64), REACH)
    end = np.repeat(ends, np.diff(ends, prepend=0))
    p = np.flatnonzero(end[: len(least)] - np.arange(len(least)) >= LENGTH)
    if not len(p):
        return none
    a = (least[p] & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.append(first[1:], len(p)) - 1
    return a[first], p[first], p[last], h[a[first]]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The same over all texts of a block, at places in their concatenation."""
    out, at, held, ends, size = [], 0, [], [], 0

    def flush() -> None:
        nonlocal at, held, ends, size
        if held:
            a, p, q, h = _chunk_anchors(np.frombuffer(b"".join(held), np.uint8), np.array(ends))
            out.append((a + at, p + at, q + at, h))
        at, held, ends, size = at + size, [], [], 0

    for t in texts:
        if size and size + len(t) > CHUNK:
            flush()
        if len(t) > CHUNK:  # pieces overlap by a string less one byte, so each start is in one
            for k in range(0, len(t) - LENGTH + 1, CHUNK - LENGTH + 1):
                piece = t[k : k + CHUNK]
                a, p, q, h = _chunk_anchors(np.frombuffer(piece, np.uint8), np.array([len(piece)]))
                out.append((a + at + k, p + at + k, q + at + k, h))
            at += len(t)
            continue
        held.append(t)
        size += len(t)
        ends.append(size)
    flush()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _chunk_anchors(np.empty(0, np.uint8), np.empty(0, np.int64))


# ---------------------------------------------------------------- blocks


def _save(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def _load(name: str, check: int | None = None) -> pa.Table:
    raw = get(name)
    if check is not None and _checksum(raw) != check:
        raise ValueError(f"{name} is not the block that its rows came from; give the documents as a table or checkpoint")
    return pa.ipc.open_stream(pa.BufferReader(raw)).read_all()


def _checksum(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) >> 1


def _texts(rows: pa.Table, text_col: str) -> list[bytes]:
    return as_bytes(rows[text_col].combine_chunks()) if rows.num_rows else []


_GRAMS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("check", pa.int64()), ("grams", pa.binary()), ("twice", pa.binary())])


def _blocks(folder: str, text_col: str, buckets: int, block_bytes: int):
    """Stage 1: writes blocks; a row for each block and bucket of gram hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = k = 0

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            number = partition_id() << 24 | k
            raw = _save(rows)
            put(f"{folder}/{number}", raw)
            g, n = np.unique(anchors(_texts(rows, text_col))[3], return_counts=True)
            of = (g >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(of, kind="stable")
            g, n, of = g[order], n[order], of[order]
            some = np.unique(np.append(of, np.uint64(0)))  # bucket 0 of each block goes out, with or without grams
            first, end = np.searchsorted(of, some), np.searchsorted(of, some, "right")
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": some.astype(np.int32),
                    "block": [number] * len(some),
                    "check": [_checksum(raw)] * len(some),
                    "grams": [g[a:b].tobytes() for a, b in zip(first, end, strict=True)],
                    "twice": [np.packbits(n[a:b] > 1).tobytes() for a, b in zip(first, end, strict=True)],
                },
                schema=_GRAMS,
            )

        for batch in batches:
            for part, n in slices_of_bytes(batch, text_col, block_bytes):
                if held and size + n > block_bytes:
                    yield close()
                    held, size, k = [], 0, k + 1
                held.append(part)
                size += n
        if held:
            yield close()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the gram hashes of a bucket, for each block those that come twice or more anywhere; rows come by bucket."""
    for rows in groups(batches, "bucket"):
        blocks, checks, raw, bits = (rows[n].to_pylist() for n in ("block", "check", "grams", "twice"))
        g = [np.frombuffer(r, np.uint64) for r in raw]
        twice = [np.unpackbits(np.frombuffer(r, np.uint8), count=len(x)) if len(x) else np.empty(0, np.uint8) for r, x in zip(bits, g, strict=True)]
        seen, inverse, n = np.unique(np.concatenate(g), return_inverse=True, return_counts=True)
        many = n > 1
        many[inverse[np.concatenate(twice) > 0]] = True
        at = 0
        for block, check, x in zip(blocks, checks, g, strict=True):
            keep = x[many[inverse[at : at + len(x)]]]
            at += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([check], pa.int64()), pa.array([keep.tobytes()], pa.binary())], names=["block", "check", "grams"])


_CONTEXT = pa.schema([("block", pa.int64()), ("ctx", pa.int32()), ("check", pa.int64()), ("hi", pa.int32()), ("lo", pa.int32()), ("many", pa.bool_()), ("bytes", pa.binary())])


def _contexts(folder: str, text_col: str, step: int = 20_000):
    """Stage 2: distinct contexts of a block; where they lie is kept beside the block. Rows come by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "block"):
            block, checks = rows["block"][0].as_py(), rows["check"].unique().to_pylist()
            if len(checks) > 1:
                raise ValueError("a repeated task made another block; give the documents as a table or checkpoint")
            wanted = np.unique(np.concatenate([np.frombuffer(g, np.uint64) for g in rows["grams"].to_pylist()]))
            texts = _texts(_load(f"{folder}/{block}", checks[0]), text_col)
            a, p, q, h = anchors(texts)
            at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            keep = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
            a, p, q = a[keep], p[keep], q[keep]
            joined, number, count, ctx = b"".join(texts), {}, [], np.empty(len(a), np.int32)
            del texts, h, at, keep
            for i, (x, j, k) in enumerate(zip(a.tolist(), p.tolist(), q.tolist(), strict=True)):
                c = number.setdefault((x - j, x - k, joined[j : k + LENGTH]), len(number))
                ctx[i] = c
                if c == len(count):
                    count.append(0)
                count[c] += 1
            put(f"{folder}/{block}.ctx", _save(pa.table({"anchor": a, "ctx": ctx})))
            yield pa.RecordBatch.from_pydict({"block": [block], "ctx": [-1], "check": checks, "hi": [0], "lo": [0], "many": [False], "bytes": [b""]}, schema=_CONTEXT)
            found = list(number)
            del number, joined
            for k in range(0, len(found), step):
                part = found[k : k + step]
                n = len(part)
                hi, lo, raw = zip(*part, strict=True)
                yield pa.RecordBatch.from_pydict({"block": [block] * n, "ctx": range(k, k + n), "check": checks * n, "hi": hi, "lo": lo, "many": [c > 1 for c in count[k : k + n]], "bytes": raw}, schema=_CONTEXT)

    return run


# ---------------------------------------------------------------- suffixes


def _key(raw: bytes, hi: int) -> bytes:
    """A suffix: what follows the anchor, filled up to a string's length, then what precedes it, backwards."""
    return raw[hi:].ljust(LENGTH, b"\0") + raw[:hi][::-1]


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of big-endian 8-byte words, by three-way partitions on a word at a time."""
    out: list[np.ndarray] = []
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            out.append(rows)
            continue
        w = words[rows, depth]
        if len(rows) <= 24:
            rest = words[rows, depth:].tolist()
            out.append(rows[sorted(range(len(rows)), key=rest.__getitem__)])
            continue
        pivot = np.sort(w[[0, len(w) // 2, -1]])[1]
        less, more = w < pivot, w > pivot
        stack.append((rows[more], depth))
        stack.append((rows[~(less | more)], depth + 1))
        stack.append((rows[less], depth))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows of a and b have in common at their start."""
    apart = a != b
    first = apart.argmax(axis=1)
    return np.where(apart.any(axis=1), first, a.shape[1])


def repeats(raw: list[bytes], hi: np.ndarray, lo: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context which offsets repeat within these (n x REACH), and the suffixes' bytes."""
    n = len(raw)
    right = np.frombuffer(b"".join(r[k:].ljust(LENGTH, b"\0") for r, k in zip(raw, hi.tolist(), strict=True)), np.uint8).reshape(n, LENGTH)
    order = multikey_quicksort(right.view(">u8").astype(np.uint64))
    lcp = np.concatenate([[0], _common(right[order[1:]], right[order[:-1]])]) if n else np.empty(0, np.int64)
    offsets = np.arange(REACH)
    flags = many[:, None] & (lo[:, None] <= offsets) & (offsets <= hi[:, None])
    run = np.cumsum(lcp < GRAM)  # of suffixes that share their gram
    size = np.bincount(run)
    s = np.flatnonzero(size[run] > 1)  # places in the sorted order that are still to be told apart
    cls = run[s]
    left = np.zeros((n, REACH), np.uint8)
    for i in order[s].tolist():
        k = hi[i]
        left[i, :k] = np.frombuffer(raw[i], np.uint8)[:k][::-1]
    for a in range(REACH):
        if a:
            _, cls, count = np.unique(cls * 256 + left[order[s], a - 1], return_inverse=True, return_counts=True)
            keep = (count[cls] > 1) & (hi[order[s]] >= a)
            s, cls = s[keep], cls[keep]
        if len(s) < 2:
            break
        active = lo[order[s]] <= a
        same = np.cumsum(lcp < LENGTH - a)[s[active]] * (int(cls.max()) + 1) + cls[active]
        _, inverse, count = np.unique(same, return_inverse=True, return_counts=True)
        flags[order[s[active][count[inverse] > 1]], a] = True
    return flags, right


#: A run of offsets of a context at which strings repeat.
_RUN = np.dtype([("ctx", "<i4"), ("first", "u1"), ("last", "u1")])


def offset_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each run of offsets that are set in a row."""
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=np.int8(0), append=np.int8(0))
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


#: Either all runs of a bucket in a block, or a context near a boundary.
_VERDICT = pa.schema([("block", pa.int64()), ("runs", pa.binary()), ("key", pa.binary()), ("ctx", pa.int32()), ("bucket", pa.int32()), ("hi", pa.int32()), ("lo", pa.int32()), ("below", pa.int32()), ("above", pa.int32()), ("flags", pa.binary()), ("bytes", pa.binary())])
#: Either all runs of a part in a block, or a string near a part's end: its hash, part, context and offset.
_CROSSING = pa.schema([("block", pa.int64()), ("runs", pa.binary()), ("h", pa.binary()), ("part", pa.int32()), ("ctx", pa.int32()), ("a", pa.int16()), ("open", pa.bool_())])


def _packed_runs(block: np.ndarray, ctx: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Blocks and the runs of offsets of their contexts."""
    row, first, last = offset_runs(flags)
    runs = np.empty(len(row), _RUN)
    runs["ctx"], runs["first"], runs["last"] = ctx[row], first, last
    order = np.argsort(block[row], kind="stable")
    names, at = np.unique(block[row][order], return_index=True)
    return names, [x.tobytes() for x in np.split(runs[order], at[1:])] if len(names) else []


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """Rows with null in the columns that are not given."""
    return pa.RecordBatch.from_pydict({name: columns.get(name, [None] * n) for name in schema.names}, schema=schema)


def _with_splitter(right: np.ndarray, splitter: bytes) -> np.ndarray:
    return _common(right, np.broadcast_to(np.frombuffer(splitter, np.uint8)[:LENGTH], right.shape)).astype(np.int32)


def _sort(splitters: list[bytes]):
    """Stage 3: repeats within a bucket, and contexts that may repeat beyond its boundaries. Rows come by bucket."""

    def verdicts(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, ctx, hi, lo, many = (rows[n].to_numpy() for n in ("block", "ctx", "hi", "lo", "many"))
        raw = rows["bytes"].to_pylist()
        flags, right = repeats(raw, hi, lo, many)
        names, runs = _packed_runs(block, ctx, flags)
        yield _rows(_VERDICT, len(names), block=names, runs=runs)
        none = np.zeros(len(raw), np.int32)
        below = _with_splitter(right, splitters[bucket - 1]) if bucket else none
        above = _with_splitter(right, splitters[bucket]) if bucket < len(splitters) else none
        del right
        known: set[tuple[bytes, int]] = set()
        send = []
        for i in np.flatnonzero(np.maximum(below, above) >= LENGTH - hi).tolist():
            if (own := (raw[i], int(hi[i]))) not in known:  # an equal context repeats here already, and one stands for all
                known.add(own)
                send.append(i)
        for k in range(0, len(send), 10_000):
            i = send[k : k + 10_000]
            part = [(raw[j], int(hi[j])) for j in i]
            yield _rows(
                _VERDICT, len(i), block=block[i], ctx=ctx[i], bucket=np.full(len(i), bucket, np.int32), hi=hi[i], lo=lo[i], below=below[i], above=above[i],
                key=[xxhash.xxh3_128_digest(r[h : h + GRAM]) + r[:h][::-1] for r, h in part], flags=[x.tobytes() for x in np.packbits(flags[i], axis=1)], bytes=[r for r, _ in part],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "to"):
            yield from verdicts(rows["to"][0].as_py(), rows)

    return run


def _across(splitters: list[bytes]):
    """Contexts near boundaries, by gram and the bytes before the anchor, backwards: what repeats across buckets.

    Such a context begins like a splitter, so its string that reaches ``a``
    bytes before the anchor is told by those bytes and that splitter's first
    200 - a. Those of equal bytes lie side by side. At either end of a part one
    string of a kind goes out, to be found by the parts beside it.
    """
    common = [len(os.path.commonprefix((x[:LENGTH], y[:LENGTH]))) for x, y in zip(splitters, splitters[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        block, ctx, bucket, hi, lo, below, above = (rows[n].to_numpy() for n in ("block", "ctx", "bucket", "hi", "lo", "below", "above"))
        keys, raw, n = rows["key"].to_pylist(), rows["bytes"].to_pylist(), rows.num_rows
        flags = np.unpackbits(np.frombuffer(b"".join(rows["flags"].to_pylist()), np.uint8).reshape(n, -1), axis=1, count=REACH).astype(bool)
        left = np.frombuffer(b"".join(k[16:].ljust(REACH - 1, b"\0") for k in keys), np.uint8).reshape(n, REACH - 1)
        gram = np.array([k[:16] for k in keys], "V16")
        lcp = np.full(n, -1)
        lcp[1:] = np.where(gram[1:] == gram[:-1], _common(left[1:], left[:-1]), -1)
        apart, new, ends = np.array([0, *common]), np.zeros_like(flags), []
        for a in range(REACH):
            need = LENGTH - a
            i = np.flatnonzero((lo <= a) & (a <= hi) & (np.maximum(below, above) >= need))
            if not len(i):
                continue
            place = np.cumsum(lcp < a)
            start = np.cumsum(apart < need)[np.where(above[i] >= need, bucket[i], bucket[i] - 1)]  # splitters that begin alike
            kind, first, inverse, count = np.unique(place[i] * (len(apart) + 1) + start, return_index=True, return_inverse=True, return_counts=True)
            new[i[count[inverse] > 1], a] = True
            at_end = (place[i[first]] == 1) | (place[i[first]] == place[-1])
            ends += [(j, a, c < 2 and not flags[j, a]) for j, c in zip(i[first[at_end]].tolist(), count[at_end].tolist(), strict=True)]
        names, runs = _packed_runs(block, ctx, new & ~flags)
        yield _rows(_CROSSING, len(names), block=names, runs=runs)
        part = partition_id()
        for k in range(0, len(ends), 10_000):
            some = ends[k : k + 10_000]
            i = [j for j, *_ in some]
            h = [xxhash.xxh3_128_digest(raw[j][hi[j] - a : hi[j] - a + LENGTH] + bytes((a,))) for j, a, _ in some]
            yield _rows(_CROSSING, len(some), block=block[i], ctx=ctx[i], h=h, part=[part] * len(some), a=[a for _, a, _ in some], open=[o for *_, o in some])

    return run


def _bucket_of(splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = (_key(r, h) for r, h in zip(b.column("bytes").to_pylist(), b.column("hi").to_pylist(), strict=True))
            bucket = pa.array([bisect_right(splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, bucket], names=[*b.schema.names, "to"])

    return run


def removed(runs: np.ndarray, anchor: np.ndarray, ctx: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans (start, end) of removed bytes of a block, in order; none goes beyond a text (``ends``)."""
    runs = np.sort(runs, order=["ctx", "first"])
    a = runs["ctx"].astype(np.int64) << 8
    a, b = a + runs["first"], a + runs["last"]
    if len(a):  # one run for what overlaps, so that each anchor has few
        upto = np.maximum.accumulate(b)
        new = np.concatenate([[True], a[1:] > upto[:-1] + 1])
        a, b = a[new], np.maximum.reduceat(b, np.flatnonzero(new))
    low, high = np.searchsorted(a >> 8, ctx), np.searchsorted(a >> 8, ctx, "right")
    n = high - low
    i = np.repeat(np.arange(len(ctx)), n)
    k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
    start, end = anchor[i] - (b[k] & 255), anchor[i] - (a[k] & 255) + LENGTH
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    if not len(start):
        return start, end
    text = np.searchsorted(ends, start, "right")
    upto = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], (start[1:] > upto[:-1]) | (text[1:] != text[:-1])]))
    return start[new], np.maximum.reduceat(end, new)


def _cut(folder: str, text_col: str, with_text: bool):
    """Stage 4: cuts the texts of a block. Rows come by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in groups(batches, "block"):
            block = found["block"][0].as_py()
            rows, place = _load(f"{folder}/{block}", pa.compute.max(found["check"]).as_py()), _load(f"{folder}/{block}.ctx")
            single = found.filter(pa.compute.is_valid(found["a"]))
            runs = np.empty(single.num_rows, _RUN)
            runs["ctx"], runs["first"], runs["last"] = single["ctx"].to_numpy(), single["a"].to_numpy(), single["a"].to_numpy()
            runs = np.concatenate([runs, np.frombuffer(b"".join(found["runs"].drop_null().to_pylist()), _RUN)])
            texts = _texts(rows, text_col)
            ends = np.cumsum([len(t) for t in texts])
            start, end = removed(runs, place["anchor"].to_numpy(), place["ctx"].to_numpy(), ends)
            upto = np.searchsorted(start, ends).tolist()
            start, end = start.tolist(), end.tolist()
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            at = i = 0
            for t, j in zip(texts, upto, strict=True):
                kept = t
                if j > i:
                    cuts = [0, *(x - at for k in range(i, j) for x in (start[k], end[k])), len(t)]
                    kept = b"".join([t[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2)])
                out["n_bytes"].append(len(t))
                out["n_removed"].append(len(t) - len(kept))
                out["n_spans"].append(j - i)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "ignore") if with_text else None)
                at, i = at + len(t), j
            del texts
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            own = {n: pa.array(v, kind) for (n, v), kind in zip(out.items(), kinds, strict=True)}
            if with_text:  # a null stays null
                own["kept"] = pa.compute.if_else(rows[text_col].combine_chunks().is_null(), pa.scalar(None, pa.string()), own["kept"])
            names = [*rows.schema.names, *own]
            whole = pa.Table.from_arrays([*rows.columns, *own.values()], names=names)
            yield from whole.to_batches(max_chunksize=2000)

    return run


def suffix_dedup(docs: DataFrame, text_col: str = "text", with_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept (the text that is left).

    Every whole text counts as UTF-8 bytes, a null as empty (its kept text
    stays null); matches never cross documents, and all strings are judged on
    the input. ``kept`` leaves out characters that a cut has broken. Texts
    under 200 bytes are left whole; repeated rows are copies of each other and
    go as such; an empty table gives no rows; input columns of the new names
    are replaced. A very long text is a block of its own, sorted in pieces like
    any other. ``docs`` must come from a table (or a checkpoint), so that a
    repeated task makes equal blocks; rows carry their block's checksum, and
    one that differs raises an error. Gram buckets follow the bytes of all
    texts and suffix buckets the number of contexts; the driver sees
    ``OVERSAMPLE`` sampled suffixes of each bucket.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    spark = docs.sparkSession
    folder = scratch(spark, "suffix-blocks")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-size // GRAM_BUCKET_BYTES))
    grams = docs.mapInArrow(freed(_blocks(folder, text_col, n, block_bytes)), "bucket int, block long, check long, grams binary, twice binary")
    repeated = grams.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(freed(_repeated), "block long, check long, grams binary")
    by_block = repeated.repartition(n, "block").sortWithinPartitions("block")
    kinds = "block long, ctx int, check long, hi int, lo int, many boolean, bytes binary"
    contexts = materialise(by_block.mapInArrow(freed(_contexts(folder, text_col)), kinds), "suffixes")
    suffixes = contexts.filter("ctx >= 0")
    count = suffixes.count()
    buckets = max(2 * shuffle_partitions(spark), -(-count // SUFFIX_BUCKET))
    every = max(1, count // (buckets * OVERSAMPLE))
    sample = sorted(_key(r.bytes, r.hi) for r in suffixes.filter(F.pmod(F.xxhash64("block", "ctx"), F.lit(every)) == 0).select("bytes", "hi").toLocalIterator())
    splitters = sorted({sample[len(sample) * k // buckets] for k in range(1, buckets)}) if sample else []
    dealt = suffixes.mapInArrow(_bucket_of(splitters), kinds + ", to int").repartition(buckets, "to").sortWithinPartitions("to")
    kinds = "block long, runs binary, key binary, ctx int, bucket int, hi int, lo int, below int, above int, flags binary, bytes binary"
    verdicts = materialise(dealt.mapInArrow(freed(_sort(splitters)), kinds), "suffix-verdicts")
    edge = verdicts.filter("key is not null")
    parts = max(shuffle_partitions(spark), -(-edge.count() // SUFFIX_BUCKET))
    edge = edge.repartitionByRange(parts, "key", "block").sortWithinPartitions("key", "block")
    crossing = materialise(edge.mapInArrow(freed(_across(splitters)), "block long, runs binary, h binary, part int, ctx int, a short, open boolean"), "suffix-crossing")
    ends = crossing.filter("h is not null")
    across = ends.groupBy("h").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).filter("p1 < p2").select("h")
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("check", "long"), ("runs", "binary"), ("ctx", "int"), ("a", "short"))}
    found = (
        verdicts.filter("key is null").select("block", none["check"], "runs", none["ctx"], none["a"])
        .union(crossing.filter("h is null").select("block", none["check"], "runs", none["ctx"], none["a"]))
        .union(ends.filter("open").join(across, "h", "left_semi").select("block", none["check"], none["runs"], "ctx", "a"))
        .union(contexts.filter("ctx < 0").select("block", "check", none["runs"], none["ctx"], none["a"]))
    )
    found = found.repartition(n, "block").sortWithinPartitions("block")
    extra = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField(c, T.StringType()) for c in ("kept_sha256", "kept")]
    out = found.mapInArrow(freed(_cut(folder, text_col, with_text)), T.StructType([*docs.schema.fields, *extra]))
    return out if with_text else out.drop("kept")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(narrow(docs, id_col, text_col), text_col, with_text=False).drop(text_col)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by comparing all strings, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


#: The same in DuckDB SQL over ``documents``: strings as hexadecimal digits, told apart by MD5.
SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT r, p, md5(substring(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
g AS (SELECT r, p, sum(CASE WHEN p - prev <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS prev FROM hit)),
span AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, run),
part AS (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM span UNION ALL SELECT d.r, coalesce(max(b), 0), max(n) FROM d LEFT JOIN span ON span.r = d.r GROUP BY d.r),
kept AS (SELECT r, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM part JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)"""
