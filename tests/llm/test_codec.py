import random

import public_tokenizers
import pytest
import sentencepiece

from graphloom.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def library(codec):
    """The library's own unigram encoder over the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for piece, (_, score, _) in zip(m.pieces, S.load_pieces(path), strict=True):
        piece.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_trie_finds_what_it_holds():
    keys = {k.encode(): i for i, k in enumerate(["a", "ab", "abc", "b", "日本", "日", "zz", "\x00"])}
    t = S.DoubleArray(keys)
    found = lambda x: [n for _, n in t.prefixes(x.encode(), 0)]
    assert found("abcd") == [0, 1, 2] and found("日本語") == [5, 4] and found("z") == [] and found("\x00b") == [7] and found("") == []


def test_against_the_library(codec, library, spark, sf_dir):
    rng = random.Random(3)
    texts = ["", "  a", "a  b   c", " \n x", "日本 語 a", "😀😀 x", "a▁b", "x ", "\t", "é́é"]
    texts += ["".join(rng.choice(" \n\t a'sé.,1_-日▁😀the") for _ in range(30)) for _ in range(500)]
    texts += [r.text[:1500] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t), repr(t[:60])
        assert S.MARK in t or codec.decode(ids).decode() == t


def test_messy_codec(messy, empty):
    rows = {r.doc_id: r for r in S.codec_report(messy).collect()}
    assert all(r.round_trip == (d != 7) for d, r in rows.items())
    assert rows[7].n_fallback > 0 and rows[3].n_pieces == rows[4].n_pieces == 0
    assert S.codec_report(empty).count() == 0
    back = S.decode_pieces(S.encode_texts(messy.select("doc_id", "text")).select("doc_id", "pieces"))
    assert {r.doc_id: r.text for r in back.collect()}[1] == messy.filter("doc_id = 1").first().text


def test_parts_and_words_of_a_task_are_bounded_by_bytes(codec, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "STEP", 5000, raising=False)
    monkeypatch.setattr(S, "MEMO", 300)
    monkeypatch.setattr(codec, "memo", {})
    monkeypatch.setitem(S._CODECS, S.model_path("piece_bpe_32k.model"), codec)
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(100)] + ["y" * 9000, None, ""]
    out = list(S._coder("piece_bpe_32k.model", "text", True)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert max(sum(len(t or "") for t in b["text"].to_pylist()) for b in out if b.num_rows > 1) <= 5000
    assert len(codec.memo) <= 300
    assert [t for b in out for t in b["text"].to_pylist()] == texts
    assert [x for b in out for x in b["pieces"].to_pylist()] == [x.tolist() for x in codec.encode([t or "" for t in texts])]
