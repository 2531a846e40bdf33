import io
import struct
import zlib

import numpy as np
import pytest

from graphloom.llm import _pretokens as P
from graphloom.llm import token_counts as C
from graphloom.llm import token_output as O

TRICKY = ["", " ", "  a", "a  b   c", " \n x", "x\n \nbar", "foo ", "\n\n a", "'s't d'll I'M", "<|endoftext|> a<|startoftext|>", "x²y", "日本 語 a", "\ta \t b", "İstanbul ǅ", "a.b,c!!! ###x", "é́é", "1234 5", "_a_ -b-"]


@pytest.mark.parametrize("name, pattern, lower", [("byte_bpe_50k.json", P.BYTE_BPE, False), ("word_bpe_49k.json", P.WORD_BPE, True)])
def test_safe_code_points_split_as_in_the_library(name, pattern, lower):
    t = P.load(name)
    for c in map(chr, range(0x2100)):
        if P.UNSAFE.search(c):
            continue
        for text in (f"a{c}b1{c}2 {c}{c}.{c} x", f" {c}  {c}'s{c}"):
            n = t.normalizer.normalize_str(text) if t.normalizer else text
            expected = [n[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(n)]
            assert pattern.findall(text.lower() if lower else text) == expected, repr(c)


def test_block_round_trip():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 2**17, n).astype("<u4") for n in (0, 1, 5, 4000)] + [np.zeros(7, "<u4")]
    raw = O.encode_block([1, None, 3, 4, 5], ids)
    (docs, back), = O.decode_blocks(io.BytesIO(raw + b""))
    assert docs == [1, None, 3, 4, 5] and all((a == b).all() and len(a) == len(b) for a, b in zip(ids, back, strict=True))
    assert len(list(O.decode_blocks(io.BytesIO(raw + raw)))) == 2
    with pytest.raises(EOFError):
        list(O.decode_blocks(io.BytesIO(raw[:-3])))


def expected_output(rows):
    t, out, start = P.load("byte_bpe_50k.json"), [], 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_output_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, O.token_output(docs).collect())) == expected_output(sorted(map(tuple, docs.select("doc_id", "text").collect())))


def test_output_of_tricky_texts(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    assert sorted(map(tuple, O.token_output(df).collect())) == expected_output(list(enumerate(TRICKY)))


def test_messy_output(messy, empty):
    rows = O.token_output(messy).collect()
    assert len(rows) == messy.count() and min(r.start for r in rows) == 0
    first = min(rows, key=lambda r: r.start)
    assert first.doc_id is None
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert O.token_output(empty).count() == 0


def test_counts_against_the_library(spark, sf_dir, messy, empty):
    t = P.load("word_bpe_49k.json")
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), tricky, messy):
        rows = df.select("doc_id", "text").collect()
        expected = sorted(((d is None, d or 0), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for d, x in rows)
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(df, block_bytes=20_000).collect())
        assert got == expected
    assert C.token_counts(empty).count() == 0
