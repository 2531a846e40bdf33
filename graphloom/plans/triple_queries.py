"""Triples over the star schema, their verdicts and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..functions import fixed
from ..operators import extract, resolve, triples
from ..session import materialise
from . import fixtures
from .registry import in_list, query, table
from .text_queries import ARTIFACT, QUALITY, infer_sql, norm_sql


def raw_triples(spark, sf_dir):
    """Customers, suppliers, orders, dates and nations as triples; some are planted wrong by their key."""
    t = lambda n: table(spark, sf_dir, n)
    k, nation = F.col("o_orderkey"), t("nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    order = F.concat(F.lit("order "), k.cast("string"))
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("nk"))
    o = o.select("o_orderkey", "c_name", "n_name", order.alias("ord"), day.alias("day"), F.col("o_orderpriority").alias("f"))
    lit, c = F.lit, F.col

    def rows(d, s, st, rel, ob, ot, pred, sent, f, seq):
        return d.select(*[x.alias(n) for x, n in zip((s, st, lit(rel), ob, ot, pred, sent, f, seq), triples.RAW, strict=True)])

    flip = k % 7 == 0
    said = F.concat(c("ord"), lit(" of "), c("c_name"), lit(" dated "), c("day"))
    party = rows(o, F.when(flip, c("ord")).otherwise(c("c_name")), F.when(flip, "CONTRACT").otherwise("PARTY"), "PARTY_OF", F.when(flip, c("c_name")).otherwise(c("ord")), F.when(flip, "PARTY").otherwise("CONTRACT"), lit("party to"), said, c("f"), 1_000_000_000_000 + k)
    dated = rows(o, c("ord"), lit("CONTRACT"), "EFFECTIVE_ON", c("day"), F.when(k % 11 == 0, "PARTY").otherwise("EFFECTIVE_DATE"), lit("dated as of"), said, c("f"), 2_000_000_000_000 + k)
    law = F.concat(c("ord"), lit(" is governed by the laws of Texas, says "), c("c_name"))
    wrong = k % 13 == 0
    ruled = rows(o, c("ord"), lit("CONTRACT"), "GOVERNED_BY", F.when(wrong, c("c_name")).otherwise(c("n_name")), F.when(wrong, "PARTY").otherwise("JURISDICTION"), lit("governed by"), law, c("f"), 3_000_000_000_000 + k)
    own = rows(o.filter(k % 17 == 0), c("ord"), lit("CONTRACT"), "IS_A", F.upper("ord"), lit("CONTRACT"), lit("is"), said, c("f"), 4_000_000_000_000 + k)
    cust = t("customer").join(nation, F.col("c_nationkey") == F.col("nk"))
    seat = rows(cust, c("c_name"), lit("PARTY"), "LOCATED_IN", c("n_name"), lit("JURISDICTION"), lit("located in"), F.concat(c("c_name"), lit(" is located in "), c("n_name")), lit("customers"), 5_000_000_000_000 + c("c_custkey"))
    li = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("nk")).join(o.select(c("o_orderkey"), "ord", "f"), F.col("l_orderkey") == F.col("o_orderkey"))
    seq = c("l_orderkey") * 1000 + c("l_linenumber")
    entered = rows(li, c("s_name"), lit("PARTY"), "ENTERED_INTO", c("ord"), lit("CONTRACT"), F.when(c("l_returnflag") == "R", "executed").otherwise("entered into"), F.concat(c("s_name"), lit(" ships line "), c("l_linenumber").cast("string")), c("f"), 6_000_000_000_000 + seq)
    also = rows(li, c("ord"), lit("CONTRACT"), "GOVERNED_BY", c("n_name"), lit("JURISDICTION"), lit("construed by"), F.concat(c("ord"), lit(" is construed by "), c("n_name")), c("f"), 7_000_000_000_000 + seq)
    return party.union(dated).union(ruled).union(own).union(seat).union(entered).union(also)


RAW = """o AS (SELECT o_orderkey AS k, c_name, n_name, 'order ' || o_orderkey AS ord, strftime(o_orderdate, '%m/%d/%Y') AS day, o_orderpriority AS f
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
li AS (SELECT s_name, nation.n_name AS n_name, ord, f, l_orderkey * 1000 + l_linenumber AS seq, l_returnflag, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN o ON l_orderkey = o.k),
raw(subject, subject_type, relation, object, object_type, predicate, sentence, filename, seq) AS (
SELECT CASE WHEN k % 7 = 0 THEN ord ELSE c_name END, CASE WHEN k % 7 = 0 THEN 'CONTRACT' ELSE 'PARTY' END, 'PARTY_OF', CASE WHEN k % 7 = 0 THEN c_name ELSE ord END,
  CASE WHEN k % 7 = 0 THEN 'PARTY' ELSE 'CONTRACT' END, 'party to', ord || ' of ' || c_name || ' dated ' || day, f, 1000000000000 + k FROM o
UNION ALL SELECT ord, 'CONTRACT', 'EFFECTIVE_ON', day, CASE WHEN k % 11 = 0 THEN 'PARTY' ELSE 'EFFECTIVE_DATE' END, 'dated as of', ord || ' of ' || c_name || ' dated ' || day, f, 2000000000000 + k FROM o
UNION ALL SELECT ord, 'CONTRACT', 'GOVERNED_BY', CASE WHEN k % 13 = 0 THEN c_name ELSE n_name END, CASE WHEN k % 13 = 0 THEN 'PARTY' ELSE 'JURISDICTION' END, 'governed by',
  ord || ' is governed by the laws of Texas, says ' || c_name, f, 3000000000000 + k FROM o
UNION ALL SELECT ord, 'CONTRACT', 'IS_A', upper(ord), 'CONTRACT', 'is', ord || ' of ' || c_name || ' dated ' || day, f, 4000000000000 + k FROM o WHERE k % 17 = 0
UNION ALL SELECT c_name, 'PARTY', 'LOCATED_IN', n_name, 'JURISDICTION', 'located in', c_name || ' is located in ' || n_name, 'customers', 5000000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'PARTY', 'ENTERED_INTO', ord, 'CONTRACT', CASE WHEN l_returnflag = 'R' THEN 'executed' ELSE 'entered into' END, s_name || ' ships line ' || l_linenumber, f, 6000000000000 + seq FROM li
UNION ALL SELECT ord, 'CONTRACT', 'GOVERNED_BY', n_name, 'JURISDICTION', 'construed by', ord || ' is construed by ' || n_name, f, 7000000000000 + seq FROM li)"""
CAPPED = f"""{RAW}, cnt AS (SELECT subject, relation, filename, object, count(*) AS n, min(seq) AS first FROM raw WHERE relation IN {in_list(list(fixed.FANOUT_CAPS))} GROUP BY ALL),
keep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, filename ORDER BY n DESC, first, object) AS k FROM cnt) WHERE k <= 1),
capped AS (SELECT * FROM raw WHERE relation NOT IN {in_list(list(fixed.FANOUT_CAPS))} UNION ALL SELECT r.* FROM raw r SEMI JOIN keep USING (subject, relation, filename, object))"""
RULES = f"""rc AS (SELECT relation, subject_type, object_type, count(*) AS frequency FROM capped WHERE relation <> 'OTHER' AND length({norm_sql("subject")}) >= 2 AND length({norm_sql("object")}) >= 2 GROUP BY ALL),
rr AS (SELECT *, frequency / sum(frequency) OVER (PARTITION BY relation) AS support, frequency / sum(frequency) OVER (PARTITION BY relation, subject_type) AS confidence,
  row_number() OVER (PARTITION BY relation ORDER BY frequency DESC, subject_type, object_type) AS rk FROM rc),
rules AS (SELECT subject_type AS subject, relation, object_type AS object, frequency, support, confidence FROM rr WHERE rk <= 3 AND frequency >= 5 AND support >= 0.08 AND confidence >= 0.6)"""
_OK = lambda r, s, o: "CASE " + " ".join(f"WHEN {r} = '{k}' THEN " + " OR ".join(f"({s} = '{a}' AND {o} = '{b}')" for a, b in v) for k, v in fixed.DOMAIN_RANGE.items()) + " ELSE TRUE END"
_QUALITY = lambda c: QUALITY.replace("(n,", f"({c},").replace("length(n)", f"length({c})")


def score_sql(source: str, name: str) -> str:
    return f"""{name}_u AS (SELECT subject, relation, object, count(*) AS mentions, count(DISTINCT substring(sentence, 1, 160)) AS sentence_support, count(DISTINCT lower(predicate)) AS predicates,
  min_by(subject_type, seq) AS subject_type, min_by(object_type, seq) AS object_type, min_by(sentence, seq) AS sentence, min_by(filename, seq) AS filename, min_by(predicate, seq) AS predicate, min(seq) AS seq FROM {source} GROUP BY ALL),
{name}_s AS (SELECT subject, count(*) AS sm FROM {source} GROUP BY 1),
{name}_p AS (SELECT *, sum(pr) OVER (PARTITION BY relation) AS rr FROM (SELECT relation, subject_type, object_type, count(*) AS pr FROM {source} GROUP BY ALL)),
{name}_q AS (SELECT u.*, sm, pr, rr, coalesce(x.confidence, CASE WHEN y.relation IS NOT NULL THEN 0.0::DOUBLE ELSE 0.45::DOUBLE END) AS type_prior, {_QUALITY(norm_sql("u.subject"))} AS qs, {_QUALITY(norm_sql("u.object"))} AS qo
  FROM {name}_u u JOIN {name}_s USING (subject) JOIN {name}_p USING (relation, subject_type, object_type)
  LEFT JOIN rules x ON x.relation = u.relation AND x.subject = u.subject_type AND x.object = u.object_type LEFT JOIN (SELECT DISTINCT relation FROM rules) y ON y.relation = u.relation),
{name}_c AS (SELECT *, least(1.0::DOUBLE, 0.28 * (1 - exp(-mentions / 3)) + 0.22 * (1 - exp(-sentence_support / 2)) + 0.18 * (mentions / sm) + 0.14 * least(1.0::DOUBLE, 0.55 + 0.15 * predicates)
  + 0.10 * CASE WHEN qs > 0 AND qo > 0 THEN 2 / (1 / qs + 1 / qo) WHEN qs > 0 THEN qs WHEN qo > 0 THEN qo ELSE 0.0 END + 0.08 * greatest(type_prior, pr / rr))::DOUBLE AS confidence FROM {name}_q),
{name} AS (SELECT *, CASE WHEN subject = '' OR object = '' OR lower(subject) = lower(object) THEN 'empty/self triple' WHEN NOT ({_OK("relation", "subject_type", "object_type")}) THEN 'domain/range violation'
  WHEN confidence < 0.22 THEN 'confidence below threshold' END AS reject_reason FROM {name}_c)"""


JUDGED = f"{CAPPED}, {RULES}, {score_sql('capped', 'judged')}"


def capped(spark, sf_dir):
    """Written once, since rules, counts and scores all read it; the triples before the cap are made twice, which costs less than to write them."""
    return materialise(triples.cap_fanout(raw_triples(spark, sf_dir)), "capped-triples")


@query(f"WITH {RAW} SELECT relation, subject_type, object_type, count(*)::BIGINT AS n, count(DISTINCT subject)::BIGINT AS subjects FROM raw GROUP BY ALL")
def kg_triples(spark, sf_dir):
    return raw_triples(spark, sf_dir).groupBy("relation", "subject_type", "object_type").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query(f"WITH {CAPPED} SELECT subject, relation, object, filename, count(*)::BIGINT AS n FROM capped WHERE relation IN {in_list(list(fixed.FANOUT_CAPS))} GROUP BY ALL")
def fanout_cap(spark, sf_dir):
    """WIN1."""
    return capped(spark, sf_dir).filter(F.col("relation").isin(list(fixed.FANOUT_CAPS))).groupBy("subject", "relation", "object", "filename").agg(F.count("*").alias("n"))


@query(f"WITH {CAPPED}, {RULES} SELECT subject, relation, object, frequency::BIGINT AS frequency, round(support, 6) AS support, round(confidence, 6) AS confidence FROM rules")
def rule_induction(spark, sf_dir):
    """AGG9."""
    r = triples.induce_rules(capped(spark, sf_dir))
    return r.withColumn("support", F.round("support", 6)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {JUDGED} SELECT subject, relation, object, mentions::BIGINT AS mentions, sentence_support::BIGINT AS sentence_support, predicates::BIGINT AS predicates, round(confidence, 6) AS confidence, reject_reason FROM judged")
def triple_verdicts(spark, sf_dir):
    """AGG12 to AGG14, JOI9, WIN2 and the order of verdicts."""
    raw = capped(spark, sf_dir)
    v = triples.verdicts(triples.score(raw, triples.induce_rules(raw)))
    return v.select("subject", "relation", "object", "mentions", "sentence_support", "predicates", F.round("confidence", 6).alias("confidence"), "reject_reason")


@query(f"""WITH {JUDGED} SELECT CASE WHEN reject_reason LIKE 'empty%' THEN 'empty_or_self' WHEN reject_reason LIKE 'domain%' THEN 'domain_range' ELSE 'low_confidence' END AS bucket, relation, count(*)::BIGINT AS n,
round(avg(confidence), 6) AS mean_confidence FROM judged WHERE reject_reason IS NOT NULL GROUP BY ALL""")
def reject_buckets(spark, sf_dir):
    """AGG17."""
    raw = capped(spark, sf_dir)
    v = triples.verdicts(triples.score(raw, triples.induce_rules(raw))).filter("reject_reason is not null")
    return v.groupBy(triples.reject_bucket(F.col("reject_reason")).alias("bucket"), "relation").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(
    f"""WITH {JUDGED}, c AS (SELECT coalesce(avg(confidence) FILTER (reject_reason IS NULL), 0) AS p, count(*) FILTER (reject_reason IS NULL) / count(*) AS r, coalesce(avg(confidence) FILTER (reject_reason IS NOT NULL), 0) AS x FROM judged)
SELECT round(p, 6) AS precision_proxy, round(r, 6) AS recall_proxy, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1_proxy, round(x, 6) AS mean_rejected FROM c"""
)
def proxy_metrics(spark, sf_dir):
    """AGG20."""
    raw = capped(spark, sf_dir)
    return triples.proxy_metrics(triples.verdicts(triples.score(raw, triples.induce_rules(raw))))


@query(f"WITH {JUDGED} SELECT relation, subject_type, object_type, count(*)::BIGINT AS n, NOT ({_OK('relation', 'subject_type', 'object_type')}) AS leak FROM judged WHERE reject_reason IS NULL GROUP BY ALL")
def object_leaks(spark, sf_dir):
    """FIL9: whether a triple of wrong types has passed."""
    raw = capped(spark, sf_dir)
    return triples.object_leaks(triples.verdicts(triples.score(raw, triples.induce_rules(raw))))


@query(f"WITH {CAPPED}, {RULES} SELECT subject, relation, object, frequency::BIGINT AS frequency, row_number() OVER (ORDER BY frequency DESC, relation, subject, object)::INT AS rank FROM rules")
def rules_by_frequency(spark, sf_dir):
    """WIN16."""
    return triples.by_frequency(triples.induce_rules(capped(spark, sf_dir))).select("subject", "relation", "object", "frequency", "rank")


_NEAR = norm_sql(f"regexp_extract(coalesce(w, ''), '{fixed.JURISDICTION_NEAR}', 1)")
REPAIRED = f"""{JUDGED}, rej AS (SELECT *, {infer_sql("subject", "subject_type")} AS st, {infer_sql("object", "object_type")} AS ot FROM judged WHERE reject_reason IS NOT NULL),
win AS (SELECT *, CASE WHEN instr(lower(sentence), lower(subject)) > 0 THEN substring(sentence, greatest(1, instr(lower(sentence), lower(subject)) - 80),
  least(length(sentence), instr(lower(sentence), lower(subject)) - 1 + length(subject) + 80) - greatest(1, instr(lower(sentence), lower(subject)) - 80) + 1) END AS w FROM rej),
tried AS (SELECT *, CASE WHEN lower(subject) = lower(object) THEN 'empty_or_self' WHEN NOT ({_OK("relation", "st", "ot")}) AND ({_OK("relation", "ot", "st")}) THEN 'direction_swap' WHEN {_OK("relation", "st", "ot")} THEN 'type_relabel'
  WHEN relation = 'GOVERNED_BY' AND {_NEAR} <> '' THEN 'governed_by_jurisdiction_repair' ELSE 'unrepairable_schema_violation' END AS repair_reason, {_NEAR} AS near FROM win),
pool AS (SELECT CASE WHEN repair_reason = 'direction_swap' THEN object ELSE subject END AS subject, CASE WHEN repair_reason = 'direction_swap' THEN ot ELSE st END AS subject_type, relation,
  CASE repair_reason WHEN 'direction_swap' THEN subject WHEN 'type_relabel' THEN object ELSE near END AS object, CASE repair_reason WHEN 'direction_swap' THEN st WHEN 'type_relabel' THEN ot ELSE 'JURISDICTION' END AS object_type,
  predicate, sentence, filename, seq FROM tried WHERE repair_reason NOT IN ('empty_or_self', 'unrepairable_schema_violation')), {score_sql("pool", "again")},
done AS (SELECT t.subject, t.relation, t.object, repair_reason, t.reject_reason AS why, CASE repair_reason WHEN 'direction_swap' THEN t.st WHEN 'type_relabel' THEN t.ot ELSE 'JURISDICTION' END AS new_type, CASE WHEN repair_reason IN ('empty_or_self', 'unrepairable_schema_violation') OR a.reject_reason IS NOT NULL THEN 'rejected' ELSE 'repaired' END AS status, a.confidence AS nc
  FROM tried t LEFT JOIN again a ON t.relation = a.relation AND CASE WHEN repair_reason = 'direction_swap' THEN t.object ELSE t.subject END = a.subject
  AND CASE repair_reason WHEN 'direction_swap' THEN t.subject WHEN 'type_relabel' THEN t.object ELSE near END = a.object)"""


def resolved(spark, sf_dir):
    raw = capped(spark, sf_dir)
    return triples.validate_with_repairs(raw, triples.induce_rules(raw))


@query(f"WITH {REPAIRED} SELECT relation, repair_reason, status AS validation_status, count(*)::BIGINT AS n, round(avg(nc), 6) AS mean_confidence FROM done GROUP BY ALL")
def repair_outcomes(spark, sf_dir):
    """Repair paths and what became of them."""
    r = resolved(spark, sf_dir).filter("repair_reason is not null")
    mean = F.round(F.avg(F.when(F.col("validation_status") == "repaired", F.col("confidence"))), 6)
    return r.groupBy("relation", "repair_reason", "validation_status").agg(F.count("*").alias("n"), mean.alias("mean_confidence"))


@query(
    f"""WITH {REPAIRED}, v AS (SELECT count(*) AS n FROM judged WHERE reject_reason IS NULL), d AS (SELECT count(*) FILTER (status = 'repaired') AS r, count(*) FILTER (status = 'rejected') AS x FROM done)
SELECT (v.n + r + x)::BIGINT AS unique_triples, v.n::BIGINT AS validated, r::BIGINT AS repaired, x::BIGINT AS rejected, round(v.n / (v.n + r + x), 6) AS pass_rate, round((v.n + r) / (v.n + r + x), 6) AS pass_rate_repaired FROM v, d"""
)
def repair_summary(spark, sf_dir):
    """AGG15 and AGG16."""
    return triples.repair_summary(resolved(spark, sf_dir))


@query(
    f"""WITH {REPAIRED}, x AS (SELECT 'validated' AS validation_status, 'none' AS reason FROM judged WHERE reject_reason IS NULL UNION ALL SELECT status, CASE status WHEN 'repaired' THEN repair_reason ELSE CASE WHEN why LIKE 'empty%' THEN 'empty_or_self' WHEN why LIKE 'domain%' THEN 'domain_range' ELSE 'low_confidence' END END FROM done),
n AS (SELECT validation_status, reason, count(*) AS n FROM x GROUP BY ALL)
SELECT validation_status, reason, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY validation_status), 6) AS share FROM n"""
)
def repair_reasons(spark, sf_dir):
    """AGG15: the histogram of reasons."""
    return triples.reasons(resolved(spark, sf_dir))


_LEAK = " OR ".join(f"(relation = '{k}' AND object_type NOT IN {in_list(v)})" for k, v in fixed.OBJECT_TYPES.items())


@query(
    f"""WITH {REPAIRED}, a AS (SELECT relation, object_type FROM judged WHERE reject_reason IS NULL UNION ALL SELECT relation, new_type FROM done WHERE status = 'repaired')
SELECT relation, object_type, {_LEAK} AS leak, count(*)::BIGINT AS n FROM a GROUP BY ALL"""
)
def leaks_after_repair(spark, sf_dir):
    """FIL9 and API5: accepted triples, repaired ones among them, whose object does not suit the relation, by a view of SQL."""
    raw = capped(spark, sf_dir)
    rules = materialise(triples.induce_rules(raw), "rules")
    names = raw.select(F.col("subject_type").alias("label"), F.col("subject").alias("text"))
    sql.inspection_views(triples.validate_with_repairs(raw, rules), rules, names)
    return spark.sql("SELECT relation, object_type, leak, n FROM object_leaks")


@query(f"WITH {RAW} SELECT relation, predicate, count(*)::BIGINT AS n FROM raw GROUP BY ALL ORDER BY n DESC, relation, predicate LIMIT 20")
def relation_frequencies(spark, sf_dir):
    """AGG8."""
    return raw_triples(spark, sf_dir).groupBy("relation", "predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation", "predicate").limit(20)


@query(
    """WITH p AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), c AS (SELECT (SELECT count(*) FROM p SEMI JOIN g USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng),
r AS (SELECT tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS p, CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS r FROM c)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM r"""
)
def prf_eval(spark, sf_dir):
    """AGG21, JOI10 and SET1 over the labels."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return triples.prf(l.filter("toxic = 1"), l.filter("quality = 0"), ["doc_id"])


@query()
def contract_graph(spark, sf_dir):
    """EXP2, entity resolution, pattern relations and the two-tier check over all documents and the fixture."""
    m = materialise(extract.mentions(fixtures.with_documents(spark, sf_dir)), "mentions")
    e = resolve.resolve(m.select(F.col("mention_id").alias("id"), "text", "label", F.col("doc_id").alias("filename")))
    linked = materialise(e.select("entity_id", "canonical", F.explode("mention_ids").alias("mention_id")), "entities")
    return triples.two_tier(triples.rule_relations(m, linked))
