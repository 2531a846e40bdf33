"""Names in texts against a plain search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import names as op


def plain(text, names, cores, min_core=4):
    """Every name looked for by itself, as in the definition."""
    text = text.lower()
    taken, out = set(), []
    for full, name in sorted(((n.lower(), n) for n in names), key=lambda x: (-len(x[0]), x[1])):
        at = text.find(full)
        span = set(range(at, at + len(full)))
        if at >= 0 and not taken & span:
            out.append((name, 1))
            taken |= span
    found = {n for n, _ in out}
    by_core = {}
    for n in sorted(names):
        if len(cores[n]) >= min_core:
            by_core.setdefault(cores[n], []).append(n)
    for core in sorted(by_core, key=lambda c: (-len(c), c)):
        for m in re.finditer(rf"\b{re.escape(core)}\b", text):
            span = set(range(*m.span()))
            if not taken & span:
                out += [(n, 2) for n in by_core[core] if n not in found]
                found.update(by_core[core])
                taken |= span
                break
    return sorted(out)


def made(seed=3):
    r = np.random.default_rng(seed)
    words = ["acme", "Acme", "beta", "Béta", "ab", "a-b", "north", "northern", "Co", "star", "aab aab"]
    pick = lambda n: " ".join(r.choice(words, n))
    names = {f"{pick(int(r.integers(1, 4)))}{r.choice(['', ' Inc.', ', LLC', ' Corp', ' Ltd'])}" for _ in range(80)}
    texts = [f"{pick(int(r.integers(0, 12)))}{r.choice(['', ' inc.', 'x', ', llc and ', '_'])}{pick(int(r.integers(0, 6)))}" for _ in range(150)]
    return sorted(names), texts


@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_equals_a_plain_search(spark, block_bytes):
    names, texts = made()
    n = spark.createDataFrame([(x,) for x in names], "name string")
    kept = n.filter(op.is_valid_entity(F.col("name"))).select("name", F.lower(op.strip_legal_suffix(F.col("name"))).alias("core")).collect()
    q = spark.createDataFrame(list(enumerate(texts)), "qid int, q string").repartition(3)
    got = {}
    for r in op.match_entities(q, n, block_bytes=block_bytes).collect():
        got.setdefault(r.qid, []).append((r.name, r.step))
    valid, cores = [r.name for r in kept], {r.name: r.core for r in kept}
    expected = {i: plain(t, valid, cores) for i, t in enumerate(texts)}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in expected.items() if x}
    assert {s for x in expected.values() for _, s in x} == {1, 2}


def test_names_that_begin_alike_are_no_hot_key(spark):
    """A text is read once: what leaves a task are the hits of a text, not all names of one head."""
    n = spark.range(5_000).select(F.format_string("Customer#%09d", "id").alias("name"))
    q = spark.createDataFrame([(i, f"the order of customer#{i:09d} and of customer#{i + 1:09d}") for i in range(50)], "qid long, q string")
    got = op.match_entities(q, n)
    assert got.count() == 100 and got.select("name").distinct().count() == 51
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_messy_rows(spark):
    n = spark.createDataFrame([("Acme Widgets, Inc.",), ("ACME WIDGETS, INC.",), (None,), ("",), ("the",), ("Zürich AG",)], "name string")
    long = "word " * 60_000 + "acme widgets" + " word" * 60_000 + " zürich ag"
    rows = [(1, None), (2, ""), (None, "by Acme Widgets, Inc."), (3, long), (3, long), (4, "nothing")]
    for block in (1 << 20, 100):
        got = sorted(map(tuple, op.match_entities(spark.createDataFrame(rows, "qid int, q string"), n, block_bytes=block).collect()), key=str)
        # of names equal but for case the first one counts; without the suffix both are meant
        assert got == sorted([(None, "ACME WIDGETS, INC.", 1), *2 * [(3, "ACME WIDGETS, INC.", 2), (3, "Acme Widgets, Inc.", 2), (3, "Zürich AG", 1)]], key=str)
    q = spark.createDataFrame(rows, "qid int, q string")
    assert op.match_entities(q, n.limit(0)).collect() == [] and op.match_entities(q.limit(0), n).collect() == []


def test_a_large_dictionary_is_no_row_of_passes(spark, monkeypatch):
    """Texts are read once whatever the dictionary's size: two tables are written, not one for each block."""
    written = []
    kept = op.materialise
    monkeypatch.setattr(op, "materialise", lambda df, what, *a: written.append(what) or kept(df, what, *a))
    n = spark.range(3_000).select(F.format_string("Customer#%09d", "id").alias("name"))
    q = spark.createDataFrame([(i, f"of customer#{i:09d} and customer#{i + 1:09d}") for i in range(40)], "qid long, q string")
    got = op.match_entities(q, n, block_bytes=4_000)
    assert got.count() == 80 and got.select("name").distinct().count() == 41 and written == ["patterns", "pieces"]
    assert sum(len(h) + 64 for h, _ in op.heads(op.patterns(n), 4_000)) <= 4_000
