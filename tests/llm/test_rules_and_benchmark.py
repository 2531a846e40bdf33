import duckdb

from graphloom.llm import decontam as D
from graphloom.llm import quality_rules as Q


def test_rules_against_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Q.quality_rules(docs).drop("failed")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    cols = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {cols} from ({Q.sql()})").fetchall())


def test_repeats_and_symbols(spark):
    w = [f"w{i}" for i in range(40)]
    once, twice = " ".join(w), " ".join(w[:20] + w[:10] + w[20:])
    rows = [(1, once), (2, twice), (3, "a " * 25), (4, "x#$ y" + " z" * 20), (5, "l\nl\n \nl")]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_repeat_words == 0 and got[2].n_repeat_words == 20
    assert got[3].n_repeat_words == 25 and got[3].base_failed and not got[3].kept
    assert got[4].n_symbols == 2 and got[5].n_dup_lines == 2 and got[5].n_words == 3


def test_labels_agree(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    r = Q.quality_rules(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(x.kept == bool(x.quality) for x in r) >= 0.97 * len(r)


def test_filter_above_does_not_copy_the_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = Q.quality_rules(docs).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(Q.WORD) == 1 and "Python" not in plan


def test_messy_rules(messy, empty):
    rows = Q.quality_rules(messy).collect()
    assert len(rows) == messy.count()
    assert [(r.n_words, r.kept) for r in rows if r.doc_id in (3, 4, 5)] == [(0, False)] * 3
    assert [r.n_words for r in rows if r.doc_id == 6] == [30_001]
    assert Q.quality_rules(empty).count() == 0


def check(spark, docs, items, **how):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in D.decontaminate(docs, items, **how).collect()}
    pairs = [(r.item_id and str(r.item_id), r.text) for r in items.collect() if r.item_id is not None]
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == D.brute_force(r.text, pairs)
    return got


def test_benchmark_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, long), (2, "just Four words, here"), (3, "solo"), (4, ""), (5, None), (10, long), (7, "a a a a a a a a a a a a")], "item_id long, text string")
    texts = ["x " + " ".join(f"W{i}" for i in range(3, 16)) + "!", "JUST four-words here; solo", "a " * 30, None, "", " ".join(f"w{i}" for i in range(9)), "é solo\x00solo", "four words here just"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = check(spark, docs, items)
    assert got[0][1] == 13 and got[0][2] == 2
    assert check(spark, docs, items, block_bytes=40) == got  # many passes give the same


def test_benchmark_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = D.decontaminate(docs, items).drop("items")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({D.SQL})").fetchall())
    assert got.filter("contaminated").count() > 0


def test_messy_benchmark(spark, messy, empty):
    items = spark.createDataFrame([(None, "one"), (1, "quick brown fox")], "item_id long, text string")
    rows = {r.doc_id: r for r in D.decontaminate(messy, items).collect()}
    assert rows[8].n_hit == 1 and rows[8].n_items == 0 and rows[8].contaminated
    assert rows[1].n_items == 1 and rows[3].n_words == 0
    assert D.decontaminate(empty, items).count() == 0
    assert D.decontaminate(messy, items.filter("false")).filter("contaminated").count() == 0


def test_passes_over_benchmark_blocks_find_the_same(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    from graphloom.llm import decontam

    one, many = (sorted(map(tuple, decontam.decontaminate(docs, items, **how).collect())) for how in ({}, {"block_bytes": 20_000}))
    assert one == many
