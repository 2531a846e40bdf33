"""Verb phrases, records, resumable appends, best paths and the SQL surface."""

import itertools
import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from graphloom import __main__ as cli
from graphloom import sql
from graphloom.operators import extract, graph, phrases, records, triples
from graphloom.sources import resume


@pytest.mark.parametrize(
    ("text", "phrase"),
    [
        ("shall not be governed by the laws of", "shall not be governed by"), (", Inc. enters into an agreement with", "enters into"), ("(the \"Buyer\") of Ohio", "the Buyer of Ohio"), ("is", "is"),
        ("a b c d e f", None), ("", None), (None, None), ("  ...  ", None), ("Limited and United", "Limited and United"), ("has been duly", "has been duly"), ("was quickly sold to", "was quickly sold to"),
        ("the seller delivered on time, paid", "delivered on"), ("may from time to time", "may from"), ("x " * 40_000 + "signed with y", "signed with"), ("licensing of", "licensing of"), ("bed red", "bed red"),
    ],
)
def test_verb_phrases(spark, text, phrase):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(phrases.verb_phrase(F.col("t"))).first()[0] == phrase


def test_pairs_have_the_verb_phrase_between_them(spark):
    t = "Acme Corp shall be governed by Ohio law. Beta signed Gamma ABC DEF Delta."
    docs = spark.createDataFrame([("d", t), ("n", None)], "doc_id string, text string")
    names = [("Acme Corp", "PARTY"), ("Ohio", "JURISDICTION"), ("Beta", "PARTY"), ("Gamma", "PARTY"), ("Delta", "PARTY")]
    spans = extract.occurrences(docs, spark.createDataFrame([("d", *n) for n in names], "doc_id string, name string, label string")).withColumnRenamed("name", "text")
    got = {(r.entity1, r.entity2): r.predicate for r in triples.entity_pairs(extract.sentence_spans(docs), spans).collect()}
    assert got["Acme Corp", "Ohio"] == "shall be governed by" and got["Beta", "Gamma"] == "signed"
    assert ("Gamma", "Delta") not in got  # all in capitals


def test_every_place_of_every_name_and_texts_move_once(spark):
    docs = spark.createDataFrame([(1, "aa AA aaa b"), (2, None), (3, "")], "doc_id int, text string")
    names = spark.createDataFrame([(1, "aa", "X"), (1, "aa", "X"), (1, "B", "Y"), (2, "q", "Z"), (3, "", "Z"), (1, None, "Z")], "doc_id int, name string, label string")
    got = extract.occurrences(docs, names)
    assert sorted(map(tuple, got.collect())) == [(1, "B", "Y", 10, 11), (1, "aa", "X", 0, 2), (1, "aa", "X", 3, 5), (1, "aa", "X", 6, 8)]
    assert sorted(r.start for r in extract.occurrences(docs, names, first_only=True).collect()) == [0, 10]


ITEMS = [
    (["Acme", "B-P"], {"word": "Acme", "label": "B-P"}), (["pays", "O"], {"word": "pays", "label": "O"}),
]


def raw(spark, rows):
    return spark.createDataFrame([(s, None if l is None else [json.dumps(x) if not isinstance(x, str) else x for x in l], f) for s, l, f in rows], records.RAW)


def test_records_are_recovered_or_skipped_and_counted(spark, tmp_path):
    good = [{"word": "Acme", "label": "B-P"}, {"word": "pays", "label": "O"}]
    rows = [
        ("Acme pays", good, "a"), ("Acme pays, then", [*good, {",": "O"}, {"then": "O"}], "b"), ("none", None, "c"), ("empty", [], "c"), ("pays all", [{"word": "pays", "label": "O"}], "d"),
        ("broken", [*good, "not json"], "e"), ("list", [*good, "[1]"], "e"), ("three", [{"word": "a", "tag": "O", "x": "y"}], "e"), ("null", [{"word": None, "label": "O"}], "e"), (None, good, None), ("Acme pays", good, "a"),
    ]
    d = records.read_labelled(raw(spark, rows))
    got = d.collect()
    assert [r.status for r in got] == ["kept", "kept", "skipped", "skipped", "unlabelled", *["skipped"] * 4, "kept", "kept"]
    assert [r.recovered for r in got][:2] == [0, 2] and got[1].labels[2] == (",", "O") and got[2].labels is None
    counts = records.write_training(d, f"{tmp_path}/out")
    assert counts == {"sentences": 11, "kept": 4, "unlabelled": 1, "skipped": 6, "with_recovery": 1, "recovered_items": 2}
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    assert records.write_training(d.limit(0), f"{tmp_path}/none")["sentences"] == 0


def test_combined_set(spark):
    spans = spark.createDataFrame([("By Ohio.", [(3, 7, "J", "Ohio")]), ("nothing", [])], "text string, entities array<struct<start:int,end:int,label:string,text:string>>")
    d = records.read_labelled(raw(spark, [("Acme Inc pays", [{"word": "Acme", "label": "B-P"}, {"Inc": "I-P"}, {"word": "pays", "label": "O"}], "f"), ("skip", [], "f"), ("Acme Inc pays", [{"word": "Acme", "label": "B-P"}, {"Inc": "I-P"}, {"word": "pays", "label": "O"}], "f")]))
    got = sorted((r.origin, r.text, [tuple(e) for e in r.entities]) for r in records.combine(spans, d).collect())
    assert got == [("labelled", "Acme Inc pays", [(0, 8, "P", "Acme Inc")]), ("spans", "By Ohio.", [(3, 7, "J", "Ohio")])]


def test_a_stopped_run_goes_on_without_doubles(spark, tmp_path):
    todo = spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, 1)], "k string, v long"))
    log, calls = resume.Log(spark, f"file://{tmp_path}/log"), itertools.count()

    def work(rows):
        if next(calls) == 3:
            raise RuntimeError("stopped")
        return rows.filter("v % 10 > 0")  # some keys give no row

    with pytest.raises(RuntimeError):
        log.run(todo, "k", work, 6)
    assert len(log.done()) == 3 and 0 < log.rows().count() < 180
    # a batch whose rows were written but which was never named as done
    todo.limit(5).write.parquet(f"file://{tmp_path}/log/rows/halfway")
    before = log.rows().count()
    again = resume.Log(spark, f"file://{tmp_path}/log")
    assert again.run(todo, "k", lambda d: d.filter("v % 10 > 0"), 6) == 3
    assert again.rows().count() == 180 > before and again.rows().select("k").distinct().count() == 180
    assert again.run(todo, "k", lambda d: d, 6) == 0 and again.pending(todo, "k").collect() == [(None, 1)]
    assert again.clean() == 1 and again.rows().count() == 180
    assert resume.Log(spark, f"file://{tmp_path}/none").rows("k string").count() == 0
    assert resume.Log(spark, f"file://{tmp_path}/none").run(todo.limit(0), "k", work) == 0


def test_samples_from_the_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text(f"The party number {i} shall pay. no\nShort one. It is so that the Buyer pays {i} today.")
    first = cli.samples(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", batches=3)
    assert first["sentences"] == 10
    (tmp_path / "in" / "9.txt").write_text("Yet another party shall pay now.")
    assert cli.samples(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", batches=3) == {"batches": 1, "removed": 0, "sentences": 11}


def plain_best(edges, source, target, most):
    """All simple walks up to a length."""
    step = {}
    for a, b, r, c in edges:
        if a is None or b is None or a == b:
            continue
        for x, y, back in ((a, b, 0), (b, a, 1)):
            step.setdefault(x, {}).setdefault(y, []).append((-(c or 0.0), r, back))
    found, front = [], [(source, [source], 0.0)]
    for hop in range(1, most + 1):
        front = [(y, [*nodes, y], s - min(es)[0]) for x, nodes, s in front for y, es in step.get(x, {}).items() if y not in nodes]
        found = [(-round(s, 9), nodes) for y, nodes, s in front if y == target]
        if found:
            best = min(found)
            return hop, round(-best[0] / hop, 6), best[1]
    return None


def test_best_paths_equal_plain_ones(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("RS"), rng.choice([0.5, 0.75, 0.875, None])) for _ in range(34)] + [(None, "n1", "R", 1.0), ("n2", "n2", "R", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, relation string, confidence double")
    pairs = [(f"n{a}", f"n{b}") for a in range(0, 12, 3) for b in range(12)] + [("n0", "far")]
    got = {(r.source, r.target): r for r in graph.best_paths(e, spark.createDataFrame(pairs, "source string, target string"), 3).collect()}
    for a, b in pairs:
        expected = plain_best(edges, a, b, 3) if a != b else None
        assert ((a, b) in got) == (expected is not None)
        if expected:
            r = got[a, b]
            import re

            assert (r.hops, r.confidence) == pytest.approx(expected[:2]) and re.split(r" -[RS]-> | <-[RS]- ", r.path) == expected[2]
    assert [(r.hops, -r.confidence) for r in sorted(got.values(), key=lambda r: r.rank)] == sorted((r.hops, -r.confidence) for r in got.values())
    assert graph.best_paths(e.limit(0), spark.createDataFrame(pairs, "source string, target string")).count() == 0


def test_functions_of_sql(spark):
    names = sql.register(spark)
    assert {"text_chunks", "text_sentences", "search_tokens"} <= set(names)
    spark.createDataFrame([(1, "A b. C d.\nE"), (2, None), (3, "")], "doc_id int, text string").createOrReplaceTempView("few_texts")
    q = lambda s: sorted(map(tuple, spark.sql(s).collect()))
    assert q("SELECT doc_id, sid, sentence FROM few_texts, LATERAL text_sentences(text)") == [(1, 1, "A b"), (1, 2, "C d"), (1, 3, "E")]
    assert q("SELECT chunk, c.text FROM few_texts, LATERAL text_chunks(few_texts.text, 2, 1) c") == [(0, "A b C d"), (1, "C d E"), (2, "E")]
    assert q("SELECT search_tokens('A-b 9'), text_words(' a  b '), normalize_entity(' x., '), is_valid_entity('the'), is_valid_entity('Acme'), is_junk_predicate('1 2 a'), is_junk_predicate('ab')") == [(["a", "b", "9"], ["a", "b"], "x", False, True, True, False)]
    for bad in ("text_chunks(text, 2, 2)", "text_chunks(text, doc_id, 1)", "text_sentences(doc_id)", "text_chunks(text, 'x', 1)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT 1 FROM few_texts, LATERAL {bad}").collect()


def test_a_report_names_what_it_found_and_what_is_missing(spark):
    from graphloom.operators import retrieve

    s = spark.createDataFrame([(1, "Acme works in Ohio", [("Acme", "PARTY"), ("Ohio", "JURISDICTION")]), (2, "Beta Sons signs", [("Beta Sons", "PARTY")])], "sid long, text string, entities array<struct<text:string,label:string>>")
    v = spark.createDataFrame([("Acme", "PARTY"), ("Ohio", "JURISDICTION")], "id string, type string")
    e = spark.createDataFrame([("Acme", "Ohio", "LOCATED_IN", 0.9), ("Acme", "Ohio", "GOVERNED_BY", 0.5)], "src string, dst string, relation string, confidence double")
    c = spark.createDataFrame([("Beta Sons", "License", "PARTY_OF", None)], "src string, dst string, relation string, confidence double")
    engine = retrieve.Engine(s, v, e, c)
    text = retrieve.report(engine.evidence("Acme, Ohio and Beta Sons"))
    assert "Names: Acme, Beta Sons, Ohio" in text and "Acme -LOCATED_IN-> Ohio (1 hops, 0.90)" in text and "Without facts: Beta Sons" in text
    assert text.endswith("Unverified:\nBeta Sons PARTY_OF License")
    none = retrieve.report(engine.evidence("nothing known"))
    assert none == "Names: none\nPassages:\nnone\nPaths:\nnone\nFacts:\nnone"
    with pytest.raises(ValueError, match="empty"):
        engine.evidence(" ")


def test_views_to_look_through_a_run(spark):
    r = spark.createDataFrame(
        [("a", "GOVERNED_BY", "b", "PARTY", "repaired", "type_relabel", None), ("a", "GOVERNED_BY", "c", "JURISDICTION", "validated", None, None), ("a", "PARTY_OF", "d", "PARTY", "validated", None, None), ("a", "GOVERNED_BY", "e", "PARTY", "rejected", None, "domain/range violation")],
        "subject string, relation string, object string, object_type string, validation_status string, repair_reason string, reject_reason string",
    )
    rules = spark.createDataFrame([("PARTY", "PARTY_OF", "CONTRACT", 3)], "subject string, relation string, object string, frequency long")
    m = spark.createDataFrame([("PARTY", f"name {i}") for i in range(50)] + [("PARTY", None)], "label string, text string")
    assert set(sql.inspection_views(r, rules, m)) == {"reject_reasons", "object_leaks", "domain_rules", "mention_sample"}
    q = lambda s: sorted(map(tuple, spark.sql(s).collect()))
    assert q("SELECT relation, object_type, n FROM object_leaks WHERE leak") == [("GOVERNED_BY", "PARTY", 1)]  # the planted one, which repair let through
    assert q("SELECT * FROM reject_reasons") == [("domain_range", 1)] and q("SELECT count(*), max(words) FROM mention_sample") == [(30, 2)]
    sql.inspection_views(r.limit(0), rules.limit(0), m.limit(0))
    assert q("SELECT count(*) FROM object_leaks") == [(0,)]
