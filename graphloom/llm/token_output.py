"""Binary token files: frequency ranks in byte-aligned codes with separate control bytes.

A shard file is a run of blocks. Each block holds whole documents and ranks
its own token ids by how often they come, so that frequent ids take one byte:

    "GLT1", then as little-endian uint32: documents, ids, distinct ids, data bytes
    int64 document id of each document, one byte each that is 1 for a null id
    uint32 ids of each document
    uint32 token id of each rank
    control bytes: two bits an id, its rank's bytes less one, first id lowest
    data bytes: each rank, little-endian, in as many bytes
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_texts, materialise, narrow, open_fs, partition_id, scratch
from ._pretokens import BYTE_BPE, load, safe, special_strings

MAGIC = b"GLT1"
BLOCK_IDS = 1 << 20
#: Remembered words of a worker; beyond it new ones are forgotten after their batch (speed only).
MEMO = 700_000
#: Lengths of the four ids of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    count = np.bincount(flat)
    distinct = np.flatnonzero(count)
    order = np.lexsort((distinct, -count[distinct]))
    rank_of = np.zeros(len(count), "<u4")
    rank_of[distinct[order]] = np.arange(len(distinct), dtype=np.uint32)
    ranks = rank_of[flat]
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    padded[: len(size)] = size - 1
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return b"".join(
        (
            MAGIC,
            struct.pack("<4I", len(ids), len(flat), len(distinct), len(data)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.array([len(x) for x in ids], "<u4").tobytes(),
            distinct[order].astype("<u4").tobytes(),
            control.tobytes(),
            data.tobytes(),
        )
    )


def _read(f, n: int) -> bytes:
    out = f.read(n)
    if len(out) != n:
        raise EOFError(f"token file ends {n - len(out)} bytes early")
    return out


def decode_blocks(f) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """(document ids, token ids of each) of each block of an open file."""
    while head := f.read(20):
        if head[:4] != MAGIC or len(head) < 20:
            raise ValueError("not a token block")
        docs, n, distinct, size = struct.unpack("<4I", head[4:])
        own = np.frombuffer(_read(f, 8 * docs), "<i8").tolist()
        null = _read(f, docs)
        lengths = np.frombuffer(_read(f, 4 * docs), "<u4")
        token = np.frombuffer(_read(f, 4 * distinct), "<u4")
        control = np.frombuffer(_read(f, -(-n // 4)), np.uint8)
        data = np.frombuffer(_read(f, size) + b"\0\0\0", np.uint8).astype(np.uint32)
        length = LENGTHS[control].ravel()[:n]
        start = np.cumsum(length, dtype=np.int64) - length
        rank = data[start]
        for k in (1, 2, 3):
            more = length > k
            rank[more] |= data[start[more] + k] << np.uint32(8 * k)
        ids = token[rank].astype("<u4") if n else np.empty(0, "<u4")
        yield [None if z else i for i, z in zip(own, null, strict=True)], np.split(ids, np.cumsum(lengths)[:-1]) if docs else []


#: A space between white space: there words do not part at each space.
_RUN = re.compile(r"\s \s")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x85\xa0]")


def _byte_letters() -> str:
    """The letter of each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class Encoder:
    """Token ids of texts.

    A text is parted at its spaces and what stands between two into pre-tokens,
    of which each is encoded by the library's model once and remembered. New
    ones go to the model many at a time: where no piece of the vocabulary has a
    letter and a space behind it, or a zero byte beside anything, words joined
    by spaces and others joined by zero bytes stay apart. Texts where that is not exact (code points beyond the compared ones,
    special strings) go to the library whole.
    """

    def __init__(self, tokenizer: str):
        self.tokenizer = load(tokenizer)
        #: Ids of words behind a space, with or without marks at their end, and of other pre-tokens.
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.model, self.special = self.tokenizer.model, special_strings(self.tokenizer)
        self.model._resize_cache(0)  # pre-tokens come here once; the memory above serves the rest
        self.letters = _byte_letters()
        zero, space = self.letters[0], self.letters[32]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t[0] == space]] = True
        self.zero = vocabulary.get(zero)
        inner = [t for t in vocabulary if space in t.lstrip(space) or (zero in t and t != zero)]
        apart = not any(self._joins_letters(t) for t in inner)
        self.together = 512 if apart and self.zero is not None else 1

    def _joins_letters(self, piece: str) -> bool:
        """Whether a piece of the vocabulary can hold the end of a word and a space or zero byte behind it."""
        try:
            text = bytes(map(self.letters.index, piece)).decode()
        except ValueError:
            return True
        return "\0" in text or any(c.isalpha() for c, following in zip(text, text[1:], strict=False) if following == " ")

    def _ids(self, text: str) -> np.ndarray:
        """Ids of one pre-token, or of joined ones."""
        return np.array([t.id for t in self.model.tokenize(charmap_decode(text.encode(), "strict", self.letters)[0])], "<u4")

    def _learn(self, words: list[str], pieces: list[str]) -> None:
        """Remembers words that stand behind a space and other pre-tokens."""
        for k in range(0, len(words), self.together):
            part = words[k : k + self.together]
            ids = self._ids(" " + " ".join(part))
            at = 4 * np.flatnonzero(self.spaced[ids]) if len(part) > 1 else np.zeros(1, int)
            self._keep(self.memo, part, ids.tobytes(), at.tolist(), [*at[1:].tolist(), 4 * len(ids)])
        odd = [p for p in pieces if "\0" in p]
        plain = [p for p in pieces if "\0" not in p] if odd else pieces
        for p in odd:
            self.pieces[p] = self._ids(p).tobytes()
        for k in range(0, len(plain), self.together):
            part = plain[k : k + self.together]
            ids = self._ids("\0".join(part))
            at = 4 * np.flatnonzero(ids == self.zero) if len(part) > 1 else np.empty(0, int)
            self._keep(self.pieces, part, ids.tobytes(), [0, *(at + 4).tolist()], [*at.tolist(), 4 * len(ids)])

    @staticmethod
    def _keep(memo: dict[str, bytes], keys: list[str], ids: bytes, starts: list[int], ends: list[int]) -> None:
        if len(keys) != len(starts):
            raise ValueError("pre-tokens did not stay apart")
        memo.update(zip(keys, [ids[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))

    def _cut(self, text: str) -> bytes:
        """Ids of a text whose pre-tokens are known."""
        return b"".join([self.memo[p[1:]] if p[0] == " " and p[1:].isalpha() else self.pieces[p] for p in BYTE_BPE.findall(text)])

    def _known(self, words: list[str], texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each word behind a space, and of each text."""
        memo, pieces = self.memo, self.pieces
        new: dict[str, None] = {}
        other: dict[str, None] = {}

        def look(text: str) -> None:
            for p in BYTE_BPE.findall(text):
                if p[0] == " " and p[1:].isalpha():
                    if p[1:] not in memo:
                        new[p[1:]] = None
                elif p not in pieces:
                    other[p] = None

        out = list(map(memo.get, words))
        tails, rest = [], []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            if w.isalpha():
                new[w] = None
                rest.append(i)
                continue
            core = w.rstrip(string.punctuation)
            if core.isalpha():
                if core not in memo:
                    new[core] = None
                if (tail := w[len(core) :]) not in pieces:  # marks alone, so one pre-token
                    other[tail] = None
                tails.append((i, w, core, tail))
            else:
                look(" " + w)
                rest.append(i)
        for t in texts:
            look(t)
        self._learn(list(new), list(other))
        for i in rest:
            out[i] = memo[words[i]] if words[i] in new else self._cut(" " + words[i])
        cut = [self._cut(t) for t in texts]
        for i, w, core, tail in tails:
            memo[w] = out[i] = memo[core] + pieces[tail]
            new[w] = None
        for known, fresh, most in ((memo, new, MEMO), (pieces, other, MEMO // 4)):
            if len(known) > most:
                for w in fresh:
                    del known[w]
        return out, cut

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column; words are looked up once a column."""
        texts = as_texts(column)
        out: list = [None] * len(texts)
        plain, whole = [], []
        for i, t in enumerate(texts):
            if not safe(t, self.special):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            elif ("  " in t or "\n \n" in t or _OTHER_SPACE.search(t)) and _RUN.search(t):
                whole.append(i)
            else:
                plain.append(i)
        for i, ids in zip(whole, self._known([], [texts[i] for i in whole])[1], strict=True):
            out[i] = np.frombuffer(ids, "<u4")
        if not plain:
            return out
        column = column if len(plain) == len(texts) else column.take(pa.array(plain))
        parts = pc.split_pattern(pc.fill_null(column, ""), " ")
        offsets = parts.offsets.to_numpy()
        words = parts.values.dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False).copy()
        first = offsets[:-1]
        ids, begun = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.values.take(pa.array(first)).to_pylist())
        index[first] = len(ids) + np.arange(len(plain), dtype=np.int32)  # the first word has no space before it
        ids += begun
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        start, each = np.cumsum(size, dtype=np.int32) - size, size[index]
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)])  # a column holds under 2**31 ids
        place = np.arange(upto[-1], dtype=np.int32) + np.repeat(start[index] - upto[:-1], each)
        flat = np.frombuffer(b"".join(ids), "<u4")[place]
        for i, x in zip(plain, np.split(flat, upto[offsets[1:-1]]), strict=True):
            out[i] = x
        return out


_ENCODERS: dict[str, Encoder] = {}


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, None) or Encoder(tokenizer)
        _ENCODERS[tokenizer] = encoder
        end = np.array([end_id], "<u4")
        shard, path = partition_id(), f"{folder}/{partition_id():06d}-{uuid.uuid4().hex}.tok"
        fs, at = open_fs(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        total = docs = held = 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        out = None
        for batch in batches:
            for part in (batch.slice(k, 4000) for k in range(0, batch.num_rows, 4000)):
                for d, own in zip(part.column(0).to_pylist(), encoder(part.column(1)), strict=True):
                    doc_ids.append(d)
                    ids.append(np.append(own, end))
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        out = out or fs.open_output_stream(at)
                        out.write(encode_block(doc_ids, ids))
                        total, docs, held, doc_ids, ids = total + held, docs + len(ids), 0, [], []
        if ids:
            out = out or fs.open_output_stream(at)
            out.write(encode_block(doc_ids, ids))
            total, docs = total + held, docs + len(ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "docs": [docs], "ids": [total]}, schema=_MANIFEST)

    return run


_MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text into shard files; returns their manifest (shard, path, docs, ids).

    Documents are range-partitioned by id, so shards follow in ascending id
    order (null ids first; equal ids by text). Each attempt of a task writes a
    file of its own and the manifest, written at the end, names those of the
    attempts that counted. A null or empty text has only the end id; an empty
    table gives an empty manifest. ``folder`` must be shared by all machines.
    """
    d = narrow(docs, id_col, text_col)
    d = d.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).repartitionByRange("d").sortWithinPartitions("d", "t")
    m = d.mapInArrow(_writer(folder, tokenizer, end_id), "shard long, path string, docs long, ids long")
    return materialise(m, "token-manifest")


def _reader(with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_stream(at) as f:
                    for doc_ids, ids in decode_blocks(f):
                        n = np.array([len(x) for x in ids], np.int64)
                        own = {
                            "doc_id": pa.array(doc_ids, pa.int64()),
                            "start": pa.array(start + np.cumsum(n) - n),
                            "n_tokens": pa.array(n),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        }
                        start += int(n.sum())
                        if with_ids:
                            own["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(own)

    return run


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the files of a manifest.

    Only shard totals are summed up in one place; files are read a task each.
    """
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    shards = shards.repartition(max(1, manifest.count()))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.mapInArrow(_reader(with_ids), schema)


def token_output(docs: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes the token files and reads them back."""
    return read_tokens(write_tokens(docs, folder or scratch(docs.sparkSession, "tokens"), **how))
