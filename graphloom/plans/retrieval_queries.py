"""Retrieval queries over documents, embeddings, parts and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import learn, retrieve
from .registry import literal, query, table, values
from .text_queries import by_rest, said

QUERY = "the er tion and license of"
TERMS = retrieve.query_terms(QUERY)

BM25 = """d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM d) GROUP BY 1),
w0 AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), w AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM w0) ELSE raw END AS idf FROM w0),
q AS (SELECT unnest([{terms}]) AS term), tf AS (SELECT doc_id, len(t) AS l, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
bm AS (SELECT doc_id, sum(coalesce(idf, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))) AS score FROM tf LEFT JOIN w USING (term), st GROUP BY doc_id)""".format(terms=", ".join(f"'{t}'" for t in TERMS))


def bm25(spark, sf_dir):
    return retrieve.bm25(table(spark, sf_dir, "documents"), TERMS)


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM bm ORDER BY rank LIMIT 20")
def bm25_topk(spark, sf_dir):
    """SIM8, SIM11, AGG25 and WIN8."""
    top = bm25(spark, sf_dir).orderBy(F.desc(F.round("score", 9)), "id").limit(20)
    return retrieve.ranked(top, "rank").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), (F.col("rank") + 1).alias("rank"))


@query(f"WITH {BM25} SELECT n::BIGINT AS docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM w0)::BIGINT AS terms, round((SELECT avg(raw) FROM w0), 6) AS mean_idf, (SELECT count(*) FROM w0 WHERE raw < 0)::BIGINT AS negative FROM st")
def bm25_stats(spark, sf_dir):
    """AGG25."""
    d = table(spark, sf_dir, "documents").select(text.search_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    c = retrieve.corpus_stats(d, F.col("t"))
    raw = retrieve.term_stats(d, F.col("t")).join(F.broadcast(c)).select((F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    r = raw.agg(F.count("*").alias("terms"), F.round(F.avg("raw"), 6).alias("mean_idf"), F.count_if(F.col("raw") < 0).alias("negative"))
    return c.join(r).select(F.col("n").alias("docs"), F.round("avgdl", 6).alias("avgdl"), "terms", "mean_idf", "negative")


@query(f"WITH {BM25} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM w ORDER BY df DESC, term LIMIT 50")
def postings_df(spark, sf_dir):
    """The most widespread terms."""
    d = table(spark, sf_dir, "documents").select(text.search_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    w = retrieve.idf(retrieve.term_stats(d, F.col("t")), retrieve.corpus_stats(d, F.col("t")))
    return w.orderBy(F.desc("df"), "term").limit(50).select("term", "df", F.round("idf", 6).alias("idf"))


COS = "qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), cs AS (SELECT vec_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)) AS score FROM embeddings, qv)"


def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieve.cosine(e, e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))


@query(f"WITH {COS} SELECT vec_id, round(score, 6) AS score FROM cs ORDER BY round(score, 9) DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    """SIM9."""
    return cosine(spark, sf_dir).orderBy(F.desc(F.round("score", 9)), "id").limit(20).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


RRF = f"""WITH {BM25}, {COS}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS r FROM bm), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) - 1 AS r FROM cs),
rrf AS (SELECT id, sum(1 / (60 + r)) AS rrf FROM (SELECT * FROM a WHERE r < 100 UNION ALL SELECT * FROM b WHERE r < 100) GROUP BY id)"""


@query(f"{RRF} SELECT id, round(rrf, 6) AS rrf FROM rrf ORDER BY round(rrf, 9) DESC, id LIMIT 20")
def rrf_fusion(spark, sf_dir):
    """WIN12."""
    f = retrieve.fuse([bm25(spark, sf_dir), cosine(spark, sf_dir)], 100)
    return f.orderBy(F.desc(F.round("rrf", 9)), "id").limit(20).select("id", F.round("rrf", 6).alias("rrf"))


@query(
    f"""{RRF}, pool AS (SELECT id, rrf FROM rrf ORDER BY round(rrf, 9) DESC, id LIMIT 20), near AS (SELECT doc_id AS id, 1 / (1 + min(CASE source WHEN 'src0' THEN 0 ELSE 1 END)) AS g FROM documents WHERE source IN ('src0', 'src1') GROUP BY doc_id)
SELECT id, round(rrf * (1 + 0.35 * coalesce(g, 0)), 6) AS boosted FROM pool LEFT JOIN near USING (id)"""
)
def graph_boost(spark, sf_dir):
    """SIM10 and JOI13, with a document's source as its entity."""
    pool = retrieve.fuse([bm25(spark, sf_dir), cosine(spark, sf_dir)], 100).orderBy(F.desc(F.round("rrf", 9)), "id").limit(20).withColumnRenamed("rrf", "score")
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.upper("source").alias("node"))
    reach = spark.createDataFrame([("src0", 0), ("src1", 1)], "node string, hop int")
    return retrieve.graph_boost(pool, m, reach).select("id", F.round("boosted", 6).alias("boosted"))


DICT = """m AS (SELECT p_partkey AS sid, 1 AS pos, CASE WHEN p_size % 4 = 0 THEN upper(p_name) WHEN p_size % 4 = 1 THEN p_name || ',' ELSE p_name END AS t, p_brand AS label FROM part),
n AS (SELECT *, trim(trim(t, ' '), ',.;:''"') AS text FROM m), k AS (SELECT *, lower(text) AS key FROM n WHERE length(text) > 0),
sh AS (SELECT key, count(*) AS frequency, min_by(text, struct_pack(a := text = upper(text), b := sid, c := pos)) AS display FROM k GROUP BY key),
lb AS (SELECT key, label, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(sid), label) AS r FROM k GROUP BY key, label),
dict AS (SELECT key, display, label, frequency FROM sh JOIN lb USING (key) WHERE r = 1)"""


def part_dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = F.when(F.col("p_size") % 4 == 0, F.upper("p_name")).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(","))).otherwise(F.col("p_name"))
    return retrieve.dictionary(p.select(F.col("p_partkey").alias("sid"), F.lit(1).alias("pos"), t.alias("text"), F.col("p_brand").alias("label")))


@query(f"WITH {DICT} SELECT key, display, label, frequency::BIGINT AS frequency FROM dict")
def entity_dictionary(spark, sf_dir):
    """AGG24 and AGG5."""
    return part_dictionary(spark, sf_dir).select("key", "display", "label", "frequency")


@query(f"WITH {DICT} SELECT key, label, frequency::BIGINT AS frequency, starts_with(key, 'r') AS is_prefix FROM dict WHERE contains(key, 'r') ORDER BY is_prefix DESC, frequency DESC, key LIMIT 8")
def suggest(spark, sf_dir):
    """WIN14."""
    return retrieve.suggest(part_dictionary(spark, sf_dir), " R").select("key", "label", "frequency", "is_prefix")


_ENT = [("acme", "Acme", "PARTY", 9), ("beta", "Beta", "PARTY", 9), ("supply agreement", "Supply Agreement", "CONTRACT", 4), ("ohio", "Ohio", "JURISDICTION", 2), ("a b c d e f g", "x", "DATE", 50), ("odd", "odd", "NOTHING", 3)]
_CASES = " ".join(f"WHEN '{k}' THEN replace({literal(v)}, '{{}}', display)" for k, v in fixed.EXAMPLES.items())


@query(
    f"""WITH {values("e0", "key, display, label, frequency", _ENT)}, {DICT}, e AS (SELECT * FROM e0 UNION ALL SELECT key, display, CASE substring(label, 7)::INT % 5 WHEN 0 THEN 'PARTY' WHEN 1 THEN 'CONTRACT' WHEN 2 THEN 'JURISDICTION' WHEN 3 THEN 'EFFECTIVE_DATE' ELSE 'OTHER' END, frequency FROM dict),
t AS (SELECT * FROM e ORDER BY frequency DESC, key LIMIT 400), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY frequency DESC, key) AS k FROM t WHERE len(string_split(key, ' ')) <= 6)
SELECT label, CASE label {_CASES} END AS question FROM o WHERE k = 1 AND CASE label {_CASES} END IS NOT NULL"""
)
def example_questions(spark, sf_dir):
    """WIN15."""
    d = part_dictionary(spark, sf_dir)
    label = by_rest(F.substring("label", 7, 9).cast("int"), *map(F.lit, ("PARTY", "CONTRACT", "JURISDICTION", "EFFECTIVE_DATE", "OTHER")))
    own = spark.createDataFrame(_ENT, "key string, display string, label string, frequency long")
    return retrieve.examples(own.union(d.select("key", "display", label, "frequency")))


_ASKED = [(1, "What is the governing law of Beta Distribution and Acme Widgets, Inc.?"), (2, "effective date and notice"), (3, "who?")]


_TEXTS = "t AS (SELECT o_orderkey AS qid, lower('Order of ' || c_name || ' in ' || n_name || ' by ' || s_name) AS q FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = k)"


@query(
    f"""WITH {_TEXTS}, n AS (SELECT c_name AS name FROM customer UNION SELECT n_name FROM nation UNION SELECT s_name FROM supplier UNION SELECT r_name FROM region),
h AS (SELECT qid, name, instr(q, lower(name)) AS a, length(name) AS l FROM t JOIN n ON contains(q, lower(name)))
SELECT qid, name, 1 AS step FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.qid = h.qid AND (x.l > h.l OR (x.l = h.l AND x.name < h.name)) AND x.a < h.a + h.l AND h.a < x.a + x.l)"""
)
def entity_match(spark, sf_dir):
    """JOI11: customers, suppliers, nations and regions named in a line about each order, the longest first."""
    t = lambda n: table(spark, sf_dir, n)
    first = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(first, "o_orderkey", "left").join(t("supplier"), "s_suppkey", "left")
    said = F.concat(F.lit("Order of "), "c_name", F.lit(" in "), "n_name", F.lit(" by "), "s_name")
    names = t("customer").select(F.col("c_name").alias("name")).union(t("nation").select("n_name")).union(t("supplier").select("s_name")).union(t("region").select("r_name"))
    return retrieve.match_entities(o.select(F.col("o_orderkey").alias("qid"), said.alias("q")), names)


_HINTS = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN contains(lower(q), '{p}') THEN {r!r} ELSE []::VARCHAR[] END" for p, r in fixed.RELATION_HINTS.items()) + "])))"


_QUESTIONS = """SELECT (o_orderkey + 1000)::INT AS qid, CASE o_orderkey % 6 WHEN 0 THEN 'Which governing law binds order ' || o_orderkey || '?' WHEN 1 THEN 'Who is the Distributor or subsidiary of ' || o_custkey WHEN 2 THEN 'When does order ' || o_orderkey || ' terminate' WHEN 3 THEN 'effective date and NOTICE of ' || o_orderpriority
WHEN 4 THEN 'jurisdiction' ELSE o_orderstatus END AS q FROM orders"""


@query(f"WITH {values('s0', 'qid, q', _ASKED)}, s AS (SELECT * FROM s0 UNION ALL {_QUESTIONS}) SELECT qid, array_to_string({_HINTS}, ',') AS hints, CASE WHEN contains(lower(q), 'law') THEN 1 ELSE 0 END AS found FROM s")
def relation_hints(spark, sf_dir):
    """TXT23 and TXT25."""
    key = F.col("o_orderkey")
    shapes = (
        said("Which governing law binds order ", key, "?"), said("Who is the Distributor or subsidiary of ", F.col("o_custkey")), said("When does order ", key, " terminate"),
        said("effective date and NOTICE of ", F.col("o_orderpriority")), F.lit("jurisdiction"), F.col("o_orderstatus"),
    )
    s = spark.createDataFrame(_ASKED, "qid int, q string").union(table(spark, sf_dir, "orders").select((key + 1000).cast("int"), by_rest(key, *shapes)))
    return s.select("qid", F.array_join(text.relation_hints(F.col("q")), ",").alias("hints"), text.heuristic_score(F.lit("Law (any)"), F.col("q")).alias("found"))


_FACTS = [
    (1, "Acme", "GOVERNED_BY", "Ohio", True), (2, "Acme", "PARTY_OF", "Supply Agreement", True), (3, "Supply Agreement", "EFFECTIVE_ON", "May 1 2020", True), (4, "Beta", "LOCATED_IN", "Ohio", False),
    (5, "Beta", "PARTY_OF", "License", False), (6, "Supply Agreement", "GOVERNED_BY", "Ohio", False),
]
_ASK = "supply agreement governed ohio ohio nation_7 located"
_AT = ", ".join(f"'{t}'" for t in _ASK.split())


_RETRIEVED = f"""WITH {values("f0", "id, s, p, o, ok", _FACTS)}, f AS (SELECT * FROM f0 UNION ALL SELECT (c_custkey + 100)::INT, c_name, 'LOCATED_IN', n_name, c_custkey % 3 > 0 FROM customer JOIN nation ON n_nationkey = c_nationkey), d AS (SELECT id, ok, list_filter(string_split(lower(s || ' ' || replace(p, '_', ' ') || ' ' || o || '.' || CASE WHEN ok THEN '' ELSE ' [UNVERIFIED]' END), ' '), lambda x: x <> '') AS t FROM f),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM d) GROUP BY 1), w0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM w0) ELSE raw END AS idf FROM w0), tf AS (SELECT id, ok, len(t) AS l, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (SELECT unnest([{_AT}]) AS term)),
bm AS (SELECT id, ok, sum(coalesce(idf, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))) AS score FROM tf LEFT JOIN w USING (term), st GROUP BY ALL)
SELECT id, ok AS validated, round(score, 6) AS score FROM (SELECT * FROM bm ORDER BY round(score, 9) DESC, id LIMIT 5) WHERE score > 0"""


def facts_of_customers(spark, sf_dir):
    """The fixture's facts, and where each customer is, every third one unverified."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    own = spark.createDataFrame(_FACTS, "id int, s string, p string, o string, ok boolean")
    return own.union(c.select((F.col("c_custkey") + 100).cast("int"), "c_name", F.lit("LOCATED_IN"), "n_name", F.col("c_custkey") % 3 > 0))


@query(_RETRIEVED)
def fact_retrieval(spark, sf_dir):
    """SIM15 and TXT22: BM25 over facts as sentences."""
    f = facts_of_customers(spark, sf_dir)
    sentences = f.select("id", "ok", text.verbalize(F.col("s"), F.col("p"), F.col("o"), F.col("ok")).alias("text"))
    top = retrieve.bm25(sentences, _ASK.split(), "id", tokens=text.words(F.lower("text"))).orderBy(F.desc(F.round("score", 9)), "id").limit(5).filter("score > 0")
    return top.join(f.select("id", F.col("ok").alias("validated")), "id").select("id", "validated", F.round("score", 6).alias("score"))


@query(f"SELECT count(*) FILTER (validated)::BIGINT AS validated, count(*) FILTER (NOT validated)::BIGINT AS unvalidated, count(*)::BIGINT AS retrieved, {len(_FACTS)} + (SELECT count(*) FROM customer)::BIGINT AS total FROM ({_RETRIEVED})")
def retrieved_counts(spark, sf_dir):
    """AGG26: validated and unvalidated facts among those retrieved, and all there are."""
    r = fact_retrieval(spark, sf_dir).agg(F.count_if("validated").alias("validated"), F.count_if(~F.col("validated")).alias("unvalidated"), F.count("*").alias("retrieved"))
    return r.join(F.broadcast(facts_of_customers(spark, sf_dir).agg(F.count("*").alias("total"))))


@query()
def graph_search(spark, sf_dir):
    """The whole search over customers' orders: names, BM25, vectors, fusion and boost."""
    from .graph_queries import customer_graph

    v, e = customer_graph(spark, sf_dir)
    s = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    said = F.concat("c_name", F.lit(" has order "), F.col("o_orderkey").cast("string"), F.lit(" with priority "), "o_orderpriority")
    s = s.select(F.col("o_orderkey").alias("sid"), said.alias("text"), F.array(F.struct(F.col("c_name").alias("text"), F.lit("PARTY").alias("label"))).alias("entities"))
    return retrieve.Engine(s, v, e).search("Which order of Customer#000000001 is urgent").select("id", "score", "near", "boosted", "text")


@query()
def hashed_neighbours(spark, sf_dir):
    """ML13 and SIM9: the parts nearest to the first one by vectors of hashed words, where no encoder is at hand."""
    p = learn.hashed_vectors(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")
    first = p.orderBy("p_partkey").limit(1)
    near = retrieve.cosine(p.select(F.col("p_partkey").alias("id"), "embedding"), first.select(F.col("embedding").alias("q")), "id")
    return near.orderBy(F.desc(F.round("score", 6)), "id").limit(10)
