"""Every registered query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from graphloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(norm, x)) + "]"
    return str(x)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, sf_dir, con, name):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    r = con.sql(plans.ORACLE_SQL[name])
    assert sorted(r.columns) == cols
    expected = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({plans.ORACLE_SQL[name]})").fetchall()
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    assert sorted(tuple(map(norm, x)) for x in got) == sorted(tuple(map(norm, x)) for x in expected)


@pytest.mark.parametrize("name", ["extracted_mentions", "contract_graph", "entity_match", "er_gestalt", "tfidf_kmeans", "graph_search"])
def test_other_queries_give_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_each_has_a_name():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 70
