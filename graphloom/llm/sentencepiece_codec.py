"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces of a model file are laid into a double-array trie by their UTF-8
bytes. A text gets the pieces of the greatest total log score; a code point
that no piece covers costs the least score less ``UNKNOWN`` and becomes its
bytes' pieces. Spaces are written as the marker, one more stands in front, and
decoding reverses both. Scores are those of the file; a file of merge ranks
has none, so a rank's log probability is taken by the Zipf-Mandelbrot law.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_texts, freed, narrow, slices_of_bytes

MARK = "▁"
UNKNOWN = 10.0
#: Log scores are multiples of this, so that sums are exact in any order and precision.
GRID = 1 / 256
ZIPF_SHIFT = 2.7
#: Remembered words of a task, some 200 bytes each; beyond it new ones are forgotten after their part (speed only).
MEMO = 200_000
#: Bytes of texts that are encoded at once, but for single texts; some ten times as much in memory.
STEP = 1 << 20

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def load_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, log score, kind) by id; kind is normal, byte or other."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    kind = ["byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal" for i in range(n)]
    score = [p.get_score(i) for i in range(n)]
    if all(s == int(s) and s <= 0 for s in score):  # merge ranks
        mass = math.log(sum(1 / (ZIPF_SHIFT - s) for s, k in zip(score, kind, strict=True) if k == "normal"))
        score = [-math.log(ZIPF_SHIFT - s) - mass for s in score]
    return [(p.id_to_piece(i), round(s / GRID) * GRID, k) for i, (s, k) in enumerate(zip(score, kind, strict=True))]


class DoubleArray:
    """Trie of byte strings: from state s byte c leads to base[s] + c + 1 if check of that is s.

    A string that ends at s has its number at base[s], whose check is s too.
    """

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check = [0] * 512, [-1] * 512
        self.check[0] = 0
        free = 1
        items = sorted(keys.items())
        stack = [(0, 0, len(items), 0)]  # state, range of keys below it, depth
        while stack:
            state, a, b, depth = stack.pop()
            groups: list[tuple[int, int, int]] = []  # label, range; label 0 ends a key
            if len(items[a][0]) == depth:
                groups.append((0, a, a + 1))
                a += 1
            while a < b:
                c = items[a][0][depth]
                e = a + 1
                while e < b and items[e][0][depth] == c:
                    e += 1
                groups.append((c + 1, a, e))
                a = e
            labels = [g[0] for g in groups]
            while free < len(self.check) and self.check[free] != -1:
                free += 1
            at = max(1, free - labels[0])
            while True:
                self._grow(at + 258)
                if all(self.check[at + x] == -1 for x in labels):
                    break
                at += 1
            self.base[state] = at
            for label in labels:
                self.check[at + label] = state
            for label, p, q in groups:
                if label:
                    stack.append((at + label, p, q, depth + 1))
                else:
                    self.base[at] = -keys[items[p][0]] - 1

    def _grow(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base += [0] * more
            self.check += [-1] * more

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, number) of each key that starts at ``start``, the shortest first."""
        base, check, state = self.base, self.check, 0
        for i in range(start, len(text)):
            at = base[state] + text[i] + 1
            if check[at] != state:
                return
            state = at
            end = base[state]
            if check[end] == state and base[end] < 0:
                yield i + 1, -base[end] - 1


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.score = [s for _, s, _ in pieces]
        self.trie = DoubleArray({p.encode(): i for i, (p, _, k) in enumerate(pieces) if k == "normal"})
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = min(s for _, s, k in pieces if k == "normal") - UNKNOWN
        self.raw = [bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, _, k in pieces]
        self.is_byte = np.array([k == "byte" for *_, k in pieces])
        self.across = any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == "normal")
        self.memo: dict[str, bytes] = {}

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best pieces; of equal sums the one whose last piece starts first."""
        text = chunk.encode()
        n, trie, score = len(text), self.trie, self.score
        base, check = trie.base, trie.check
        best, came, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        start = 0
        while start < n:
            here, c = best[start], text[start]
            width = 1 if c < 128 else 2 if c < 224 else 3 if c < 240 else 4
            single, state, i = False, 0, start
            while i < n:
                at = base[state] + text[i] + 1
                if check[at] != state:
                    break
                state, i = at, i + 1
                end = base[state]
                if check[end] == state and base[end] < 0:
                    k = -base[end] - 1
                    if i - start == width:
                        single = True
                    if (s := here + score[k]) > best[i]:
                        best[i], came[i], by[i] = s, start, k
            if not single and (s := here + self.unknown) > best[start + width]:
                best[start + width], came[start + width], by[start + width] = s, start, -1
            start += width
        out, end = [], n
        while end:
            start = came[end]
            if by[end] < 0:
                out += [self.bytes.get(c, 0) for c in reversed(text[start:end])]
            else:
                out.append(by[end])
            end = start
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> bytes:
        return np.array(self.viterbi(chunk), "<i4").tobytes()

    def _text(self, text: str) -> bytes:
        marked = MARK + text.replace(" ", MARK) if text else ""
        return self._chunk(marked) if self.across else b"".join(map(self._chunk, _CHUNK.findall(marked)))

    def _known(self, words: list[str]) -> list[bytes]:
        get, out, new = self.memo.get, [], []
        for w in words:
            if (ids := get(w)) is None:
                self.memo[w] = ids = self._text(w)
                new.append(w)
            out.append(ids)
        if len(self.memo) > MEMO:
            for w in new:
                del self.memo[w]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Pieces don't reach over a single space, so words are looked up once."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t or self.across or "  " in t or t[0] == " " or t[-1] == " " or MARK in t:
                out[i] = np.frombuffer(self._text(t), "<i4")
            else:
                plain.append(i)
        if plain:
            parts = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            words = parts.values.dictionary_encode()
            index = words.indices.to_numpy(zero_copy_only=False)
            ids = self._known(words.dictionary.to_pylist())
            size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
            start, each = np.cumsum(size, dtype=np.int32) - size, size[index]
            upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)])  # a part holds under 2**31 ids
            place = np.arange(upto[-1], dtype=np.int32) + np.repeat(start[index] - upto[:-1], each)
            flat = np.frombuffer(b"".join(ids), "<i4")[place]
            for i, x in zip(plain, np.split(flat, upto[parts.offsets.to_numpy()[1:-1]]), strict=True):
                out[i] = x
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8: markers are spaces again and the one in front goes."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


_CODECS: dict = {}


def _codec(path: str) -> Codec:
    """The codec of a model file, built once in each worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(load_pieces(path))
    return _CODECS[path]


def _forget() -> None:
    """Drops the words of a task, which would lie idle in the worker."""
    for codec in _CODECS.values():
        codec.memo = {}


def model_path(model: str) -> str:
    return model if "/" in model else public_tokenizers.path(model)


_OWN = (("n_bytes", T.LongType(), pa.int64()), ("n_pieces", T.LongType(), pa.int64()), ("n_fallback", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()), ("decoded_crc32", T.LongType(), pa.int64()), ("round_trip", T.BooleanType(), pa.bool_()), ("pieces", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))


def _coder(model: str, text_col: str, with_pieces: bool):
    own = _OWN if with_pieces else _OWN[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path(model))
        for batch in batches:
            for part, _ in slices_of_bytes(batch, text_col, STEP):
                texts = as_texts(part.column(part.schema.names.index(text_col)))
                out: dict[str, list] = {n: [] for n, *_ in _OWN}
                for t, ids in zip(texts, codec.encode(texts), strict=True):
                    raw, back = t.encode(), codec.decode(ids)
                    values = (len(raw), len(ids), int(codec.is_byte[ids].sum()), zlib.crc32(ids.tobytes()), zlib.crc32(back), back == raw, ids)
                    for n, v in zip(out, values, strict=True):
                        out[n].append(v)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[n], k) for n, _, k in own)], names=[*part.schema.names, *(n for n, *_ in own)])

    return run


def encode_texts(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text", with_pieces: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_pieces, n_fallback (byte pieces), ids_crc32, decoded_crc32, round_trip and pieces.

    Each whole text is encoded, decoded again and compared (``round_trip``: a
    text that holds the marker itself comes back with a space). A null or empty
    text has no pieces; input columns of the new names are replaced. No row meets another, so nothing is shuffled.
    """
    own = _OWN if with_pieces else _OWN[:-1]
    docs = docs.drop(*[n for n, *_ in own])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t, _ in own)])
    return docs.mapInArrow(freed(_coder(model, text_col, with_pieces), _forget), schema)


def decode_pieces(pieces: DataFrame, model: str = "piece_bpe_32k.model", pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """``pieces`` with the decoded text; a null list gives a null text, broken bytes the replacement mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path(model))
        for batch in batches:
            ids = batch.column(batch.schema.names.index(pieces_col)).to_pylist()
            texts = [None if x is None else codec.decode(np.array(x, np.int32)).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    pieces = pieces.drop(text_col)
    return pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField(text_col, T.StringType())]))


def codec_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document the counts and checksums, without texts and pieces."""
    return encode_texts(narrow(docs, id_col, text_col), text_col=text_col, with_pieces=False, **how).select(F.col(id_col), *[n for n, *_ in _OWN[:-1]])
