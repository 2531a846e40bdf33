import io
import zipfile

import duckdb
import numpy as np
import pytest

from graphloom.llm import quality_mil as M
from graphloom.llm import url_filter as U
from graphloom.llm import warc as W


def plain_rule(host, path):
    best = None
    for rule, verdict in U.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


URLS = [
    "http://a.example.com/en/7x", "http://EXAMPLE.com/en/8?x=/en/7", "https://b.net/de/8", "https://example.net/de/8/9", "x.org/es/", "http://y.org/es/1#a", "http://cheap-pills.example.com/fr/1", "http://freebets.shop/", None, "", "://", "http://a.b?c/d", "a://b://c/d",
    "http://notcom/en/", "http://com/en/", "http://xexample.com/en/7",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>the free and cheap bets of the news of the day</p>" * 3, 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, score int")
    got = {r.page_id: r for r in U.url_filter(pages).collect()}
    for i, u in enumerate(URLS):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = rest
        for mark in "/?#":
            host = host.split(mark)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        assert (got[i].host, got[i].path) == (host.lower(), path)
        rule, verdict = plain_rule(host.lower(), path)
        assert got[i].rule == rule and (rule is None or got[i].verdict == verdict)
    assert got[6].verdict == "block" and got[8].verdict == "allow" and got[8].score is None
    assert U.url_filter(pages.filter("false")).count() == 0


def test_segmenter():
    s = U.Segmenter.of({"free": 50, "bets": 20, "news": 30, "the": 100})
    assert s("freebets") == ["free", "bets"] and s("") == [] and "".join(s("zzznews")) == "zzznews" and s("zzznews")[-1] == "news"


def test_spam_hosts_are_blocked(spark, sf_dir):
    r = U.url_filter(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).filter("rule is null").collect()
    assert all((x.verdict == "block") == ("-" in x.host) for x in r)


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    raw = W.zip_bytes([("a/x", b"hello" * 9), ("i", b"xyz"), ("none", b"")], zip64)
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert z.testzip() is None and z.read("i") == b"xyz"
    p = W.Package(Sized(raw))
    assert p.read(*p.place("a/x")) == b"hello" * 9 and p.place("none")[1] == 0


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_other_writers_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"q" * 100)
        z.writestr(zipfile.ZipInfo("packed"), b"p" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6zz"
    p = W.Package(Sized(out.getvalue()))
    assert p.read(*p.place("big")) == b"q" * 100
    with pytest.raises(ValueError):
        p.place("packed")
    with pytest.raises(ValueError):
        W.Package(Sized(b"not a zip file"))


def test_round_trip_against_sql(spark, sf_dir):
    big, small = "é<p>x</p>" * 200, "tiny"
    rows = [(5, "http://a\r\nb", big, "d"), (9, None, big, "d"), (9, None, big, "d"), (1, "u", big, None), (2, "u", small, "d"), (3, "u", small, "d"), (4, "u", None, "d"), (6, "u", "", "d"), (None, "u", big + "!", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    con = duckdb.connect()
    for df, name in ((pages, "a"), (spark.read.parquet(f"{sf_dir}/pages.parquet"), "b")):
        pdf = df.select("page_id", "html").toPandas()  # noqa: F841
        con.sql("create or replace view pages as select page_id::bigint as page_id, html from pdf")
        for how in ({}, {"package_bytes": 500, "zip64": True}):
            got = W.round_trip(df, **how)
            cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
            key = lambda r: tuple((v is None, v or 0 if not isinstance(v, str) else v) for v in r)
            assert sorted(map(tuple, got.select(*cols.split(", ")).collect()), key=key) == sorted(con.sql(f"select {cols} from ({W.SQL})").fetchall(), key=key), name
    full = W.read_archives(W.write_archives(pages, W.scratch(spark, "w")), payload=True)
    kept = {(r.page_id, r.record_type): r for r in full.collect()}
    assert kept[9, "response"].payload.decode() == big and kept[5, "revisit"].payload is None and kept[5, "revisit"].url == "http://a%0D%0Ab"
    assert W.round_trip(pages.filter("false")).count() == 0


def test_gradient_is_right():
    rng = np.random.default_rng(1)
    grams, stats = rng.random((9, M.BUCKETS)).astype(np.float64) * 0.05, rng.random((9, M.N_STATS))
    doc, label = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0, 1])
    m = M.Model.new(stats)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}

    def loss():
        y = m.forward(grams, stats, doc, 3)["y"]
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    g = m.gradient(grams, doc, m.forward(grams, stats, doc, 3), label)
    for name in m.p:
        i = tuple(0 for _ in m.p[name].shape)
        m.p[name][i] += 1e-4
        up = loss()
        m.p[name][i] -= 2e-4
        assert abs((up - loss()) / 2e-4 - g[name][i]) < 1e-3, name
        m.p[name][i] += 1e-4


def test_passages_do_not_depend_on_neighbours():
    texts = [b"", b"ab", b"the cat sat. " * 90, "日本語 ".encode() * 50, b"x" * 512, b"y" * 513]
    g, s, d = M.passages(texts)
    assert np.bincount(d).tolist() == [1, 1, 3, 1, 1, 2]
    for i, t in enumerate(texts):
        g1, s1, _ = M.passages([t])
        assert np.allclose(g[d == i], g1) and np.allclose(s[d == i], s1)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = M.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)


def test_messy_quality(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None), (None, 1)], "doc_id long, quality int")
    rows = M.quality_scores(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert M.quality_scores(empty, labels).count() == 0
    assert {r.score for r in M.quality_scores(messy, labels.filter("false")).collect()} == {0.5}
