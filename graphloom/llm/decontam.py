"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, materialise, narrow

#: Lower-cases A-Z and turns every other ASCII byte that is not a digit into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW = 10
#: Bytes of benchmark text that one pass holds; more items take more passes. Tables take about 80 bytes for each, so 160 MB in a worker.
BLOCK_BYTES = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Shift and hash tables over words, for patterns of one length each.

    A block is two words. ``shift[block]`` is how far a block may move until it
    can end a pattern; blocks that no pattern has move the whole length less
    one. At shift 0 the bucket of the block lists the patterns that end in it,
    and each is compared with the text directly.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.owners: list[list[int]] = []
        self.items = [i for i, _ in items]
        known: dict[tuple[bytes, ...], int] = {}
        for k, (_, text) in enumerate(items):
            w = words_of(text)
            size = min(window, len(w))
            for at in range(len(w) - size + 1 if w else 0):
                p = tuple(w[at : at + size])
                if p not in known:
                    known[p] = len(known)
                    self.owners.append([])
                if k not in self.owners[known[p]][-1:]:
                    self.owners[known[p]].append(k)
        self.single = {p[0]: k for p, k in known.items() if len(p) == 1}
        self.tables: dict[int, tuple[dict, dict]] = {}
        for p, k in known.items():
            if (n := len(p)) > 1:
                shift, bucket = self.tables.setdefault(n, ({}, {}))
                for end in range(1, n):
                    block = (p[end - 1], p[end])
                    shift[block] = min(shift.get(block, n - 1), n - 1 - end)
                bucket.setdefault((p[-2], p[-1]), []).append((p, k))

    def find(self, w: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(first word, word behind the last, pattern) of each occurrence."""
        if self.single:
            for i, x in enumerate(w):
                if (k := self.single.get(x)) is not None:
                    yield i, i + 1, k
        for n, (shift, bucket) in self.tables.items():
            i, far, end = n - 1, n - 1, len(w)
            while i < end:
                block = (w[i - 1], w[i])
                step = shift.get(block, far)
                if step:
                    i += step
                    continue
                at = i - n + 1
                for p, k in bucket[block]:
                    if p[0] == w[at] and p == tuple(w[at : i + 1]):
                        yield at, i + 1, k
                i += 1


_BUILT: dict = {}


def _tables(key: str, shared) -> WuManber:
    """One set of tables for each block and Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WuManber(shared.value)
    return _BUILT[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.int32())


def _scan(shared, text_col: str):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, shared)
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            counts, hit, spans, items = [], [], [], []
            for text, before, had in zip(as_bytes(col[text_col]), col["_spans"].to_pylist(), col["_items"].to_pylist(), strict=True):
                w = words_of(text)
                found = list(tables.find(w))
                own = merged([(a, b) for a, b, _ in found] + list(zip(before[::2], before[1::2], strict=True))) if found else None
                counts.append(len(w))
                spans.append([x for s in own for x in s] if own else before)
                hit.append(sum(spans[-1][1::2]) - sum(spans[-1][::2]))
                ids = {tables.items[i] for k in {k for *_, k in found} for i in tables.owners[k]} - {None}
                items.append(sorted(ids | set(had)) if ids else had)
            new = {"_n": pa.array(counts, pa.int64()), "_hit": pa.array(hit, pa.int64()), "_spans": pa.array(spans, SPANS), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(n, col.get(n)) for n in batch.schema.names], names=batch.schema.names)

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _n (words), _hit (words hit), _spans (flat word intervals hit) and _items (ids of items found).

    The benchmark is the query set: its size is counted first, and it is taken
    in blocks of about ``block_bytes``, one broadcast and one scan of the
    documents each without a shuffle. Passes are written one after another, so
    that one block's tables are held at a time. Null and empty texts have no
    words, long ones are searched whole, repeated rows each get a row and an
    empty table gives none; items without words match nothing; an item without id marks words
    but is not listed; equal ids are listed once. Input columns of
    the new names are replaced.
    """
    docs = docs.drop("_n", "_hit", "_spans", "_items")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.select("*", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_hit"), F.expr("cast(array() as array<int>)").alias("_spans"), F.expr("cast(array() as array<string>)").alias("_items"))
    for b in range(blocks):
        if b:
            out = materialise(out, "benchmark-pass")
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r.i, r.t.encode()) for r in sorted(rows, key=lambda r: (r.i or "", r.t))])
        out = out.mapInArrow(_scan(shared, text_col), out.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row per document: n_words, n_hit, items, n_items, items_sha256, contaminated."""
    d = find_benchmark(narrow(docs, id_col, text_col), benchmark, text_col, **how)
    return d.select(
        id_col,
        F.col("_n").alias("n_words"),
        F.col("_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
        F.col("_items").alias("items"),
    )


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) by comparing every position, for tests."""
    w, hit, found = words_of((text or "").encode()), set(), set()
    for item, t in items:
        v = words_of((t or "").encode())
        size = min(window, len(v))
        for a in range(len(v) - size + 1 if v else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[a : a + size]:
                    hit.update(range(i, i + size))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
hit AS (SELECT r, win.n, i, item FROM win JOIN p ON win.n = p.n AND win.s = p.s),
words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)"""
