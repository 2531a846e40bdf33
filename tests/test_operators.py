"""Operators on small inputs with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import similarity, text
from graphloom.operators import components, coref, extract, graph, learn, resolve, retrieve, triples
from graphloom.sources import io
from graphloom.streaming import stream


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "value, quality",
    [("x", 0.0), ("--", 0.0), ("a b c d e f g h i", 0.0), ("as provided herein", 0.0), ("x ***", 0.0), ("42", 0.0), ("ab", 0.0), ("A, B, C", 0.0), ("IBM", 0.45), ("Abc", 0.35), ("Supply Agreement", 1.0), ("Gamma Group", 0.8), (None, 0.0)],
)
def test_mention_quality(spark, value, quality):
    assert one(spark, text.mention_quality(F.col("v")), v=value) == quality


@pytest.mark.parametrize("name, core", [("Beta Distribution, LLC", "Beta Distribution"), ("Omega Co., Inc.", "Omega"), ("Acme Holdings", "Acme Holdings"), ("Inc", "Inc"), ("X Limited Liability Company", "X")])
def test_strip_legal_suffix(spark, name, core):
    got = one(spark, text.strip_legal_suffix(F.col("v")), v=name)
    assert got == core or (name == "Inc" and got == "")


def test_predicates_by_substring_and_by_word(spark):
    assert one(spark, text.normalize_predicate(F.col("v")), v="this promise") == "IS_A"
    assert one(spark, text.normalize_predicate(F.col("v"), whole_words=True), v="this promise") == "OTHER"
    assert one(spark, text.normalize_predicate(F.col("v")), v=" Dated as of ") == "EFFECTIVE_ON"


def test_sentence_around(spark):
    t = "One. Two is here\nThree goes on"
    at = t.index("is")
    assert one(spark, text.sentence_around(F.col("v"), F.lit(at), F.lit(at + 2)), v=t) == "Two is here"
    assert one(spark, text.sentence_around(F.col("v"), F.lit(len(t) - 2), F.lit(len(t))), v=t) == "Three goes on"


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("v")), v="A Page 3 of 9\n12\n\n\n\nb\t\tc ★ é") == "A \n\nb c   é"


def test_gestalt_and_edit_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "a string, b string")
    r = df.select(similarity.gestalt_similarity("a", "b").alias("g"), similarity.levenshtein_similarity(F.col("a"), F.col("b")).alias("l")).collect()
    assert (r[0].g, r[0].l, r[1].g, r[1].l) == (0.75, 0.5, 1.0, 1.0)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(2000, 2000), (7, 1)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 1000 for k in range(1000, 1200)) and got[2000] == 2000 and len(got) == 262
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pair_features_without_the_own_edge(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    v = spark.createDataFrame([(n, "T") for n in "abcdxy"], "id string, type string")
    p = {(r.u, r.v): r for r in graph.pair_features(e, v).collect()}
    ab = p["a", "b"]
    assert ab.has_edge and ab.common == 1 and ab.preferential == 1 and ab.jaccard == 1.0
    assert abs(ab.adamic_adar - 1 / np.log(3)) < 1e-12 and abs(ab.resource_allocation - 1 / 3) < 1e-12
    assert p["x", "y"].common == 0 and p["x", "y"].preferential == 0 and not p["a", "d"].has_edge


def test_paths_take_the_least_of_equal_length(spark):
    e = spark.createDataFrame([("s", "b"), ("s", "a"), ("a", "t"), ("b", "t"), ("t", "u"), ("u", "v"), ("v", "w")], "src string, dst string")
    pairs = spark.createDataFrame([("s", "t"), ("s", "v"), ("s", "w"), ("s", "s"), ("s", "nowhere")], "source string, target string")
    got = {r.target: (r.hops, r.path) for r in graph.shortest_paths(e, pairs).collect()}
    assert got == {"t": (2, "s > a > t"), "v": (4, "s > a > t > u > v")}


TRIPLE = "subject string, subject_type string, relation string, object string, object_type string, predicate string, sentence string, filename string, seq long"


@pytest.mark.parametrize(
    "row, reason, subject, object_",
    [
        (("this", "PARTY", "PARTY_OF", "Supply Agreement", "CONTRACT"), "artifact_entity", None, None),
        (("Acme Group", "PARTY", "PARTY_OF", "ACME GROUP", "PARTY"), "empty_or_self", None, None),
        (("Supply Agreement", "CONTRACT", "PARTY_OF", "Acme Group", "PARTY"), "direction_swap", "Acme Group", "Supply Agreement"),
        (("Supply Agreement", "PARTY", "EFFECTIVE_ON", "May 4, 2020", "PARTY"), "type_relabel", "Supply Agreement", "May 4, 2020"),
        (("Supply Agreement", "CONTRACT", "EFFECTIVE_ON", "Acme Group", "PARTY"), "effective_on_contract_date_repair", "Supply Agreement", "May 4, 2020"),
        (("Acme Group", "PARTY", "PARTY_OF", "Beta Group", "PARTY"), "party_of_party_contract_repair", "Acme Group", None),
        (("Acme Group", "PARTY", "LOCATED_IN", "Beta Group", "PARTY"), "located_in_jurisdiction_repair", "Acme Group", "Ohio"),
        (("Acme Group", "PARTY", "EFFECTIVE_ON", "Beta Group", "PARTY"), "unrepairable_schema_violation", None, None),
    ],
)
def test_repair_paths(spark, row, reason, subject, object_):
    said = "The Supply Agreement of May 4, 2020 binds Acme Group, located in Ohio."
    r = triples.repair(spark.createDataFrame([(*row, "x", said, "f", 1)], TRIPLE)).first()
    assert r.repair_reason == reason and r.new_subject == subject
    assert object_ is None or r.new_object == object_


def test_fanout_keeps_the_best_and_first(spark):
    rows = [("s", "CONTRACT", "EFFECTIVE_ON", o, "DATE", "p", "x", f, i) for i, (o, f) in enumerate([("d2", "f"), ("d1", "f"), ("d1", "g"), ("d3", "g"), ("d3", "g")])]
    rows.append(("s", "CONTRACT", "IS_A", "z", "DATE", "p", "x", "f", 9))
    got = sorted((r.filename, r.object) for r in triples.cap_fanout(spark.createDataFrame(rows, TRIPLE)).collect())
    assert got == [("f", "d2"), ("f", "z"), ("g", "d3"), ("g", "d3")]


def test_accounting_of_validation(spark):
    rows = [(f"Acme {i}", "PARTY", "PARTY_OF", "Supply Agreement", "CONTRACT", "party to", "x", "f", i) for i in range(6)]
    rows += [("Supply Agreement", "CONTRACT", "PARTY_OF", "Beta Group", "PARTY", "party to", "x", "f", 7), ("this", "PARTY", "PARTY_OF", "Beta Group", "PARTY", "p", "x", "f", 8)]
    raw = spark.createDataFrame(rows, TRIPLE)
    s = triples.repair_summary(triples.validate_with_repairs(raw, triples.induce_rules(raw))).first()
    assert (s.unique_triples, s.validated, s.repaired, s.rejected) == (8, 6, 1, 1)


def test_oversized_blocks_are_skipped_and_neighbours_bound(spark):
    few = [(i, f"acme widgets {chr(97 + i)}", "PARTY", "f") for i in range(14)]
    pairs = resolve.candidate_pairs(resolve.representatives(spark.createDataFrame(few, "id int, text string, label string, filename string")))
    assert pairs.count() == sum(min(10, 13 - i) for i in range(14))
    many = [(i, f"acme widgets n{i}", "PARTY", "f") for i in range(121)]
    assert resolve.candidate_pairs(resolve.representatives(spark.createDataFrame(many, "id int, text string, label string, filename string"))).count() == 0


def test_entity_matching_prefers_long_names_and_drops_suffixes(spark):
    names = spark.createDataFrame([("Electric City Corp.",), ("Electric",), ("Beta Distribution, LLC",), ("the",), ("City Works Inc",)], "name string")
    q = spark.createDataFrame([(1, "What did Electric City Corp. sell to Beta Distribution?"), (2, "nothing")], "qid int, q string")
    assert sorted((r.name, r.step) for r in retrieve.match_entities(q, names).collect()) == [("Beta Distribution, LLC", 2), ("Electric City Corp.", 1)]


def test_query_of_stop_words_keeps_them():
    assert retrieve.query_terms("the of it") == ["the", "of", "it"] and retrieve.query_terms("The Law") == ["law"]


def test_engine_marks_candidates(spark):
    s = spark.createDataFrame([(1, "Acme works in Ohio", [("Acme", "PARTY"), ("Ohio", "JURISDICTION")]), (2, "Beta signs", [("Beta", "PARTY")]), (3, "all else", [])], "sid long, text string, entities array<struct<text:string,label:string>>")
    v = spark.createDataFrame([("Acme", "PARTY"), ("Ohio", "JURISDICTION")], "id string, type string")
    e = spark.createDataFrame([("Acme", "Ohio", "LOCATED_IN", 0.9)], "src string, dst string, relation string, confidence double")
    c = spark.createDataFrame([("Beta", "License", "PARTY_OF", 0.5)], "src string, dst string, relation string, confidence double")
    engine = retrieve.Engine(s, v, e, c)
    assert {(r.node, r.validated) for r in engine.facts("Acme and Beta").collect()} == {("Acme", True), ("Beta", False)}
    assert "[UNVERIFIED]" in engine.prompt("Acme and Beta") and engine.search("Acme Ohio", 1).first().id == 1
    assert [r.path for r in engine.paths("Acme in Ohio").collect()] == ["Acme > Ohio"]


def test_key_variants(spark):
    r = spark.createDataFrame([("a", None, "r", "b"), (None, "h", "r", "t"), ("", None, "r", "b")], "source string, head string, relation string, target string")
    assert sorted(map(tuple, retrieve.key_variants(r).collect())) == [("a", "r", "b"), ("h", "r", "t")]


def test_words_to_spans_recovers_offsets(spark):
    rows = [(1, "Acme Inc. pays Beta", [("Acme", "B-PARTY"), ("Inc.", "I-PARTY"), ("pays", "O"), ("Beta", "B-PARTY")]), (2, "x", [(None, "O"), ("zz", "B-A")]), (3, None, None)]
    d = spark.createDataFrame(rows, "sid long, sentence string, labels array<struct<word:string,label:string>>")
    assert sorted(map(tuple, extract.words_to_spans(d).collect())) == [(1, 0, 9, "PARTY", "Acme Inc."), (1, 15, 19, "PARTY", "Beta")]


def test_entity_pairs(spark):
    t = "Acme is governed by Ohio. ACME AND Ohio"
    s = spark.createDataFrame([("d", 1, 0, t[:25]), ("d", 2, 26, t[26:])], "doc_id string, sid int, start int, text string")
    e = spark.createDataFrame([("d", "Acme", "PARTY", 0, 4), ("d", "Ohio", "JURISDICTION", 20, 24), ("d", "ACME", "PARTY", 26, 30), ("d", "Ohio", "JURISDICTION", 35, 39)], "doc_id string, text string, label string, start int, end int")
    assert [(r.entity1, r.predicate, r.relation) for r in triples.entity_pairs(s, e).collect()] == [("Acme", "is governed by", "GOVERNED_BY")]


def test_antecedents(spark):
    d = spark.createDataFrame([(1, "Both Parties met Acme . They left it there"), (2, "it stands"), (3, None)], "doc_id long, text string")
    got = sorted((r.pronoun, r.antecedent) for r in coref.nearest_antecedent(coref.marked_tokens(d)).collect() if r.doc_id == 1)
    assert got == [("They", "Parties"), ("it", "Acme")]


def test_text_folder_graph_files_and_manifest(spark, tmp_path):
    for n, t in (("b.txt", "two"), ("a.txt", "one"), ("c.md", "no")):
        (tmp_path / n).write_text(t)
    d = io.text_folder(spark, str(tmp_path), 1).collect()
    assert [(r.doc_id, r.text) for r in d] == [("a.txt", "one")]
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"a","type":"T"},{"id":"b"}],"links":[{"source":"a","target":"b","relation":"R","confidence":0.5}]}')
    v, e = io.node_link(spark, str(tmp_path / "g.json"))
    assert v.count() == 2 and e.first().inferred is False
    io.write_graphml(v, e, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 5 and sum("<edge " in x for x in lines) == 1
    assert io.optional(spark, lambda: spark.read.parquet(str(tmp_path / "missing")), "a int").count() == 0
    old = io.manifest(spark.createDataFrame([("p", "x"), ("q", "y")], "path string, text string"))
    new = spark.createDataFrame([("p", "x"), ("q", "z"), ("r", None)], "path string, text string")
    assert sorted(r.path for r in io.changed(new, old).collect()) == ["q", "r"]


def test_ingest_upserts(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        docs = spark.readStream.schema("doc_id long, text string").parquet(src)
        stream.ingest(docs, target, str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(f"{target}/v1").select("doc_id", "text").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_occurrences_and_overlaps(spark):
    d = spark.createDataFrame([("d", "Acme, acme and A.c"), ("e", None)], "doc_id string, text string")
    n = spark.createDataFrame([("d", "Acme", "PARTY"), ("d", "A.C", "PARTY"), ("e", "x", "PARTY")], "doc_id string, name string, label string")
    got = sorted((r.name, r.start, r.end) for r in extract.occurrences(d, n).collect())
    assert got == [("A.C", 15, 18), ("Acme", 0, 4), ("Acme", 6, 10)]
    assert extract.occurrences(d, n, first_only=True).count() == 2
    p = spark.createDataFrame([("d", 0, 4), ("d", 6, 10)], "doc_id string, start int, end int")
    assert [r.start for r in coref.without_overlap(p, p.filter("start = 6")).collect()] == [0]


def test_run_over_a_folder_and_again(spark, tmp_path):
    from graphloom.__main__ import run
    from graphloom.plans import fixtures

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name, body in fixtures.DOCUMENTS[:1]:
        (src / name).write_text(body)
    first = run(spark, str(src), out, None)
    assert first["documents"] == 1 and first["accepted"] >= 3
    (src / fixtures.DOCUMENTS[2][0]).write_text(fixtures.DOCUMENTS[2][1])
    second = run(spark, str(src), out, None, incremental=True)
    assert second["documents"] == 1
    assert spark.read.json(f"{out}/validated_triples").select("doc_id").distinct().count() == 2
    assert run(spark, str(src), out, None, incremental=True)["documents"] == 0
    assert spark.read.json(f"{out}/validated_triples").select("doc_id").distinct().count() == 2


def test_fresh_table_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    src = tmp_path / "src"
    src.mkdir()
    (src / "a").write_text("x")
    for _ in range(2):
        assert io.fresh_table(spark, str(tmp_path / "t"), [str(src)], build).count() == 3
    assert built == [1]


def test_incremental_run_keeps_entities_of_other_documents(spark, tmp_path):
    from graphloom.__main__ import ask, run
    from graphloom.plans.fixtures import DOCUMENTS

    texts, out = tmp_path / "texts", str(tmp_path / "out")
    texts.mkdir()
    (texts / DOCUMENTS[0][0]).write_text(DOCUMENTS[0][1])
    run(spark, str(texts), out)
    before = {r.canonical for r in spark.read.json(f"{out}/entities").collect()}
    (texts / DOCUMENTS[2][0]).write_text(DOCUMENTS[2][1])
    run(spark, str(texts), out, incremental=True)
    after = {r.canonical for r in spark.read.json(f"{out}/entities").collect()}
    assert before and before < after
    assert "Facts:" in ask(spark, out, "Who is a party of the supply agreement of Acme Widgets Inc.?")
    with pytest.raises(ValueError, match="empty"):
        ask(spark, out, "  ")


def test_node_link_files_read_back(spark, tmp_path):
    from graphloom.sources import io

    v = spark.createDataFrame([("a", "PARTY"), ("b", None)], "id string, type string")
    e = spark.createDataFrame([("a", "b", "R", 0.5)], "src string, dst string, relation string, confidence double")
    io.write_node_link(v, e, str(tmp_path / "g"))
    v2, e2 = io.read_node_link(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, v2.collect())) == [("a", "PARTY"), ("b", None)] and [tuple(r) for r in e2.collect()] == [("a", "b", "R", 0.5, False)]
    assert spark.read.json(str(tmp_path / "g/metadata")).first()["links"] == 1


def test_triples_of_any_shape(spark, tmp_path):
    import json

    from graphloom.sources import io

    rows = [{"subject": "a", "predicate": "p", "object": "b", "validated": True}, {"head": "c", "rel_type": "q", "tail": "d", "validation_status": "rejected"}, {"subject": "x"}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"triples": rows}))
    for name in ("list", "wrapped"):
        assert sorted(map(tuple, io.triples_of(spark, str(tmp_path / f"{name}.json")).collect())) == [("a", "p", "b"), ("c", "q", "d")]
    assert [tuple(r) for r in io.triples_of(spark, str(tmp_path / "none.json"), str(tmp_path / "list.json"), validated_only=True).collect()] == [("a", "p", "b")]


def test_stratified_takes_the_least_hashes_of_each_label(spark):
    from graphloom.operators import learn

    d = spark.range(5000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN 'rare' WHEN id % 7 = 0 THEN NULL ELSE 'often' END AS label")
    n = {r.label: r["count"] for r in learn.stratified(d, "label", "id", 200).groupBy("label").count().collect()}
    assert n == {"rare": 100, "often": 200, None: 200}


def test_names_are_found_wherever_they_stand(spark):
    from graphloom.operators import retrieve

    q = spark.createDataFrame([(1, "xAcme Widgets, Inc. and beta distribution"), (2, None), (3, "")], "qid int, q string")
    n = spark.createDataFrame([("Acme Widgets, Inc.",), ("Beta Distribution, LLC",), ("Gamma",), (None,)], "name string")
    assert sorted(map(tuple, retrieve.match_entities(q, n).collect())) == [(1, "Acme Widgets, Inc.", 1), (1, "Beta Distribution, LLC", 2)]


def test_pairs_around_a_hub_in_squares(spark, monkeypatch):
    from graphloom.operators import graph

    e = spark.createDataFrame([(f"s{i}", o) for i in range(30) for o in ("hub", f"o{i % 4}")], "src string, dst string")
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("type", F.lit("T"))
    whole = sorted(map(tuple, graph.pair_features(e, v).select("u", "v", "common").collect()))
    monkeypatch.setattr(graph, "SIDE", 7)
    assert sorted(map(tuple, graph.pair_features(e, v).select("u", "v", "common").collect())) == whole


def test_the_latest_version_of_a_document_stays(spark, tmp_path):
    from graphloom.streaming import stream

    rows = [(1, "old", 5), (1, "new", 9), (2, "only", 1), (1, "older", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, at long").repartition(4, "text").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("doc_id long, text string, at long").parquet(f"{tmp_path}/in")
    stream.ingest(s, f"{tmp_path}/out", f"{tmp_path}/state", order="at")
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/out/v0").collect()) == [(1, "new"), (2, "only")]


def test_hashed_vectors_are_of_unit_norm_and_alike_for_like_words(spark):
    d = spark.createDataFrame([(1, "Red ring"), (2, "ring, red!"), (3, "blue"), (4, ""), (5, None)], "id int, t string").filter("t is not null")
    v = {r.id: np.array(r.embedding) for r in learn.hashed_vectors(d, "t").collect()}
    assert np.allclose(v[1], v[2]) and abs(v[1] @ v[1] - 1) < 1e-6 and v[1] @ v[3] < 0.5 and not v[4].any()
