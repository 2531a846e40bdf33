import corpus_pipeline as P
import public_tokenizers
from graphloom.llm import decontam, quality_rules, sentencepiece_codec, suffix_dedup
from graphloom.session import materialise

from .test_near_copies import plain_shingles
from .test_simhash import roots


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    s = [plain_shingles(t) for _, t in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if alike(s[i], s[j])])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    cut = [x[1] for x in suffix_dedup.brute_force([t.encode() for _, t in rows])]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in P.run(spark, sf_dir).collect()}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    clean = [(d, t) for (d, t), n in zip(rows, cut, strict=True) if n == 0 and not decontam.brute_force(t, items)[1]]
    assert len(clean) > 50
    for d, t in clean:
        assert got[d].pieces == codec.encode([t])[0].tolist() and got[d].round_trip
    assert set(got) <= {d for d, _ in rows}
    assert {d for (d, _), n in zip(rows, cut, strict=True) if n == 0} - set(got) == {d for (d, t), n in zip(rows, cut, strict=True) if n == 0 and decontam.brute_force(t, items)[1]}


def test_stages_keep_columns_and_take_messy_rows(spark, sf_dir, messy, empty):
    for docs in (messy, empty):
        d = docs
        for name, stage in P.STAGES[:-1]:
            d = materialise(stage(spark, d, sf_dir), name)
            assert d.columns == docs.columns
        assert P.STAGES[-1][1](spark, d, sf_dir).count() == d.count()


def test_copies_leave_one_and_rows_without_id_stay(spark, messy):
    ids = [r.doc_id for r in P.near_copies_stage(spark, messy, "").collect()]
    assert ids.count(1) == 1 and 2 not in ids and None in ids and ids.count(3) == 1 and 4 not in ids
