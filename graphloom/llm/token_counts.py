"""Token counts: pieces of each distinct pre-token, joined to per-document frequencies.

Documents are taken in blocks of text. A block keeps, in a file, which of its
distinct pre-tokens each document has and how often; the distinct pre-tokens
themselves are dealt out by hash, counted once where they meet, and only the
counts go back to the block. So rows grow with the distinct pre-tokens of
blocks, a frequent pre-token comes once a block, and ids are never made.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_texts, get, narrow, partition_id, put, scratch, shuffle_partitions
from ._pretokens import WORD_BPE, load, safe, special_strings

#: Bytes of text in a block.
BLOCK_BYTES = 12_000_000
#: Remembered pre-tokens of a worker that counts; beyond it the memory starts anew (speed only).
MEMO = 300_000

_LOADED: dict = {}


class _Splitter:
    """Pre-tokens of a text as the tokenizer's normaliser and splitter give them."""

    def __init__(self, tokenizer: str):
        self.tokenizer = load(tokenizer)
        self.special = special_strings(self.tokenizer)

    def __call__(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special strings in the text, a token each)."""
        if safe(text, self.special):
            return WORD_BPE.findall(text.lower()), 0
        out: list[str] = []
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            n = self.tokenizer.normalizer.normalize_str(part)
            out += [n[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(n)]
        return out, len(parts) - 1


def _loaded(kind, tokenizer: str):
    if (kind, tokenizer) not in _LOADED:
        _LOADED[kind, tokenizer] = kind(tokenizer)
    return _LOADED[kind, tokenizer]


def _pack(block: list[tuple]) -> bytes:
    """A block's documents: ids, bytes, extra tokens, pre-token numbers and frequencies."""
    ids, sizes, extra, index, freq, ends = zip(*block, strict=True)
    table = pa.record_batch({"id": pa.array(ids, pa.int64()), "bytes": pa.array(sizes, pa.int64()), "extra": pa.array(extra, pa.int64()), "n": pa.array(ends, pa.int64())})
    flat = pa.record_batch({"index": pa.array(np.concatenate(index)), "freq": pa.array(np.concatenate(freq))})
    sink = pa.BufferOutputStream()
    for t in (table, flat):
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(t)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> tuple[pa.Table, pa.Table]:
    source = pa.BufferReader(raw)
    return tuple(pa.ipc.open_stream(source).read_all() for _ in range(2))


def _rows(batch: pa.RecordBatch, step: int = 500) -> Iterator[tuple]:
    for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
        yield from zip(part.column(0).to_pylist(), as_texts(part.column(1)), strict=True)


def _blocks(folder: str, tokenizer: str, buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _loaded(_Splitter, tokenizer)
        number: dict[str, int] = {}
        block: list[tuple] = []
        size = k = 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/{partition_id():06d}-{k:06d}"
            put(name, _pack(block))
            raw = [w.encode() for w in number]
            of = np.array([zlib.crc32(r) % buckets for r in raw], np.int64)
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(buckets + 1))
            rows: dict[str, list] = {"bucket": [], "block": [], "pos": [], "words": []}
            for b in range(buckets):
                pos = order[cut[b] : cut[b + 1]]
                if len(pos) or not b:  # the first also stands for a block without words
                    rows["bucket"].append(b)
                    rows["block"].append(name)
                    rows["pos"].append(pos.astype("<u4").tobytes())
                    rows["words"].append(zstandard.compress(b"\n".join([raw[p] for p in pos]), 1))
            return pa.RecordBatch.from_pydict(rows, schema=_WORDS)

        for batch in batches:
            for d, text in _rows(batch):
                found, extra = split(text)
                c = Counter(found)
                index = np.fromiter((number.setdefault(w, len(number)) for w in c), np.uint32, len(c))
                n = len(text) if text.isascii() else len(text.encode())
                block.append((d, n, extra, index, np.fromiter(c.values(), np.uint32, len(c)), len(c)))
                size += n
                if size >= block_bytes:
                    yield close()
                    number, block, size, k = {}, [], 0, k + 1
        if block:
            yield close()

    return run


_WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("pos", pa.binary()), ("words", pa.binary())])


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(load, tokenizer)
        memo: dict[str, int] = {}
        for batch in batches:
            counts = []
            for packed in batch.column(3):
                joined = zstandard.decompress(packed.as_py()).decode()
                words = joined.split("\n") if joined else []
                new = [w for w in words if w not in memo]
                if len(memo) + len(new) > MEMO:
                    memo, new = {}, words
                for at in range(0, len(new), 50_000):
                    part = new[at : at + 50_000]
                    memo.update(zip(part, map(len, t.encode_batch_fast(part, add_special_tokens=False)), strict=True))
                counts.append(np.fromiter(map(memo.__getitem__, words), "<u4", len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(counts, pa.binary())], names=["block", "pos", "pieces"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs, flat = _unpack(get(name))
            pos = np.concatenate([np.frombuffer(p["pos"], "<u4") for p in parts])
            pieces = np.zeros(len(pos), np.int64)
            pieces[pos] = np.concatenate([np.frombuffer(p["pieces"], "<u4") for p in parts])
            each = pieces[flat["index"].to_numpy()] * flat["freq"].to_numpy()
            ends = np.cumsum(docs["n"].to_numpy())
            upto = np.concatenate([[0], np.cumsum(each)])
            total = upto[ends] - upto[ends - docs["n"].to_numpy()] + docs["extra"].to_numpy()
            yield pa.RecordBatch.from_arrays([docs["id"].combine_chunks(), docs["bytes"].combine_chunks(), pa.array(total)], names=["d", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: n_bytes, n_tokens, over_limit.

    A null or empty text has 0 bytes and tokens; repeated rows each get a row;
    an empty table gives none; other columns are not read. ``docs`` should come
    from a table (or a checkpoint), so that a repeated task makes equal blocks.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    folder, n = scratch(spark, "token-counts"), shuffle_partitions(spark)
    words = d.mapInArrow(_blocks(folder, tokenizer, n, block_bytes), "bucket int, block string, pos binary, words binary")
    pieces = words.repartition(n, "bucket").mapInArrow(_count(tokenizer), "block string, pos binary, pieces binary")
    back = pieces.groupBy("block").agg(F.collect_list(F.struct("pos", "pieces")).alias("parts"))
    out = back.mapInArrow(_sums, "d long, n_bytes long, n_tokens long")
    return out.select(F.col("d").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
