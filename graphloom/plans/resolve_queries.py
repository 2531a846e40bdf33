"""Dictionaries, linking and entity resolution over parts and fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.similarity import er_probability, hard_conflict, levenshtein_similarity, pair_features
from ..operators import resolve
from . import fixtures
from .registry import query, table
from .text_queries import MENTIONS, QUALITY, acronym_sql, key_sql, mentions, norm_sql, tokens_sql, years_sql

_Q = lambda c: QUALITY.replace("(n,", f"({norm_sql(c)},").replace("length(n)", f"length({norm_sql(c)})")


def part_mentions(spark, sf_dir):
    """Parts by name, some of them misspelt or with a word more."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _typo(F.col("p_name"), F.col("p_size")).alias("text"), F.lit("PARTY").alias("label"), F.col("p_brand").alias("filename"))


def _typo(name, size):
    return F.when(size % 3 == 0, name).when(size % 3 == 1, F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(F.concat(name, F.lit(" set")))


KB = f"""kb AS (SELECT label, canonical, count(*) AS frequency FROM (SELECT p_type AS label, lower(trim(p_name, ' ')) AS canonical FROM part)
  WHERE length(canonical) > 2 AND {_Q("canonical")} > 0 GROUP BY ALL HAVING count(*) >= 2)"""


def kb(spark, sf_dir):
    return resolve.knowledge_base(table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("text")))


@query(f"WITH {KB} SELECT label, canonical, frequency::BIGINT AS frequency FROM kb")
def kb_build(spark, sf_dir):
    """AGG2."""
    return kb(spark, sf_dir)


def typos(spark, sf_dir):
    """Part names as written, and again without their last letter or with a word more."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("n"), F.col("p_size").alias("s"))
    return p.select("label", _typo(F.col("n"), F.col("s")).alias("text"))


LINKED = f"""{KB}, docs AS (SELECT *, substring(canonical, 1, 1) AS block, string_split(canonical, ' ') AS w FROM kb),
size AS (SELECT label, block, count(*) AS n, avg(len(w)) AS avgdl FROM docs GROUP BY ALL),
tf AS (SELECT label, block, canonical, frequency, l, term, count(*) AS tf FROM (SELECT label, block, canonical, frequency, len(w) AS l, unnest(w) AS term FROM docs) GROUP BY ALL),
df0 AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT label, block, term, n, avgdl, count(*) AS df FROM tf JOIN size USING (label, block) GROUP BY label, block, term, n, avgdl)),
df AS (SELECT * REPLACE (CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY label, block) ELSE idf END AS idf) FROM df0),
post AS (SELECT tf.*, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl)) AS part FROM tf JOIN df USING (label, block, term)),
m AS (SELECT DISTINCT label, text FROM (SELECT p_type AS label, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN substring(p_name, 1, length(p_name) - 1) ELSE p_name || ' set' END AS text FROM part)
  WHERE length(text) > 2 AND {_Q("text")} > 0),
q AS (SELECT label, text, substring(lower(text), 1, 1) AS block, unnest(string_split(lower(trim(text, ' ')), ' ')) AS term FROM m),
sc AS (SELECT label, text, canonical, frequency, sum(part) AS bm25 FROM q JOIN post USING (label, block, term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY label, text ORDER BY round(bm25, 9) DESC, frequency DESC, canonical) AS rank FROM sc),
c AS (SELECT *, 0.5 * CASE WHEN max(bm25) OVER w > 0 THEN bm25 / max(bm25) OVER w ELSE 0 END + 0.5 * (1 - levenshtein(lower(text), canonical) / greatest(length(text), length(canonical))) AS score FROM rk WHERE rank <= 20 WINDOW w AS (PARTITION BY label, text)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, text ORDER BY round(score, 9) DESC, rank) AS k FROM c) WHERE k = 1),
linked AS (SELECT m.label, m.text, CASE WHEN coalesce(score >= 0.72, FALSE) THEN canonical ELSE m.text END AS canonical, coalesce(score, 0.0) AS score, coalesce(score >= 0.72, FALSE) AS linked,
  coalesce(score >= 0.72, FALSE) AND canonical <> m.text AS changed FROM m LEFT JOIN f USING (label, text))"""


@query(f"WITH {LINKED} SELECT label, text, canonical, round(score, 6) AS score, linked, changed FROM linked")
def link_mentions(spark, sf_dir):
    """JOI5, JOI18, SIM7 and WIN7."""
    return resolve.link(typos(spark, sf_dir), kb(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {LINKED} SELECT label, count(*)::BIGINT AS total, count(*) FILTER (linked)::BIGINT AS linked, count(*) FILTER (changed)::BIGINT AS changed, round(count(*) FILTER (linked) / count(*), 6) AS rate,
coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN changed THEN text || ' -> ' || canonical END) FILTER (changed))[1:3], '; '), '') AS examples FROM linked GROUP BY label"""
)
def link_report(spark, sf_dir):
    """AGG3."""
    return resolve.link_report(resolve.link(typos(spark, sf_dir), kb(spark, sf_dir)))


@query(f"WITH {LINKED} SELECT 0.72::DOUBLE AS threshold_a, 0.9::DOUBLE AS threshold_b, count(*) FILTER (linked)::BIGINT AS linked_a, count(*) FILTER (score >= 0.9)::BIGINT AS linked_b FROM linked")
def link_versions(spark, sf_dir):
    """AGG4: two runs side by side."""
    a = resolve.link(typos(spark, sf_dir), kb(spark, sf_dir))
    return a.agg(F.count_if("linked").alias("linked_a"), F.count_if(F.col("score") >= 0.9).alias("linked_b")).select(F.lit(0.72).alias("threshold_a"), F.lit(0.9).alias("threshold_b"), "linked_a", "linked_b")


def score_sql(a: str, b: str, label: str, fa: str, fb: str) -> str:
    ka, kb_ = key_sql(a, label), key_sql(b, label)
    ta, tb = f"list_distinct({tokens_sql(a)})", f"list_distinct({tokens_sql(b)})"
    longest = f"greatest(length({ka}), length({kb_}))"
    lev = f"(CASE WHEN {longest} = 0 THEN 1.0 ELSE 1 - levenshtein({ka}, {kb_}) / {longest} END)"
    jac = f"(CASE WHEN len({ta}) + len({tb}) = 0 THEN 0.0 ELSE len(list_intersect({ta}, {tb})) / len(list_distinct(list_concat({ta}, {tb}))) END)"
    acr = f"(CASE WHEN {acronym_sql(a)} <> '' AND {acronym_sql(a)} = {acronym_sql(b)} THEN 1.0 ELSE 0.0 END)"
    same = f"(CASE WHEN {fa} IS NOT DISTINCT FROM {fb} THEN 1.0 ELSE 0.0 END)"
    ratio = f"(least(length({ka}), length({kb_})) / greatest(length({ka}), length({kb_}), 1))"
    return f"1 / (1 + exp(-(-3.1 + 2.4 * {lev} + 2.0 * {jac} + 1.5 * {acr} + 0.4 * {same} + 0.7 * {ratio})))"


def conflict_sql(a: str, b: str, la: str, lb: str) -> str:
    p = lambda c: key_sql(c, "'PARTY'")
    return f"""({la} <> {lb} OR (len({years_sql(a)}) > 0 AND len({years_sql(b)}) > 0 AND len(list_intersect({years_sql(a)}, {years_sql(b)})) = 0)
  OR ({la} = 'PARTY' AND (length({p(a)}) <= 3 OR length({p(b)}) <= 3) AND {p(a)} <> {p(b)}))"""


@query(
    f"""WITH {MENTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY id) AS k FROM m)
SELECT a.id AS id_a, b.id AS id_b, round({score_sql("a.t", "b.t", "a.label", "a.filename", "b.filename")}, 6) AS score,
{conflict_sql("a.t", "b.t", "a.label", "b.label")} AS conflict, round(1 - levenshtein(lower(a.t), lower(b.t)) / nullif(greatest(length(a.t), length(b.t)), 0), 6) AS lev
FROM o a JOIN o b ON a.filename = b.filename AND b.k - a.k BETWEEN 1 AND 3 UNION ALL
SELECT a.id, b.id, round({score_sql("a.t", "b.t", "a.label", "a.filename", "b.filename")}, 6), {conflict_sql("a.t", "b.t", "a.label", "b.label")}, round(1 - levenshtein(lower(a.t), lower(b.t)) / nullif(greatest(length(a.t), length(b.t)), 0), 6)
FROM m0 a JOIN m0 b ON a.id < b.id AND a.filename <> b.filename"""
)
def er_features(spark, sf_dir):
    """SIM1 and SIM3 to SIM6: each mention with the next three of its file, and those of the fixture's other files."""
    m = mentions(spark, sf_dir)
    of = Window.partitionBy("filename").orderBy("id")
    row = F.struct(*m.columns)
    near = m.select(row.alias("a"), F.array(*[F.lead(row, k).over(of) for k in (1, 2, 3)]).alias("next")).select("a", F.explode("next").alias("b")).filter("b is not null")
    few = spark.createDataFrame(fixtures.MENTIONS, m.schema).select(row.alias("a"))
    other = few.join(F.broadcast(few.withColumnRenamed("a", "b")), F.expr("a.id < b.id and a.filename <> b.filename"))  # the fixture's 28 rows
    x, y = F.col("a.t"), F.col("b.t")
    f = pair_features(x, y, F.col("a.label"), F.col("a.filename"), F.col("b.filename"))
    lev = F.when(F.greatest(F.length(x), F.length(y)) > 0, levenshtein_similarity(x, y))
    p = near.unionByName(other)
    return p.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(er_probability(f), 6).alias("score"), hard_conflict(x, y, F.col("a.label"), F.col("b.label")).alias("conflict"), F.round(lev, 6).alias("lev"))


REPS = f"""m0 AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN substring(p_name, 1, length(p_name) - 1) ELSE p_name || ' set' END AS t, 'PARTY' AS label, p_brand AS filename FROM part),
m AS (SELECT *, {key_sql("t", "'PARTY'")} AS key FROM m0),
reps AS (SELECT label, key, min(id) AS rep, min_by(t, id) AS t, min_by(filename, id) AS filename, count(*) AS n FROM m GROUP BY ALL),
blocks AS (SELECT *, substring(string_split(key, ' ')[1], 1, 4) || '|' || coalesce(substring(string_split(key, ' ')[2], 1, 4), '') AS block FROM reps),
ranked AS (SELECT *, count(*) OVER (PARTITION BY label, block) AS size, row_number() OVER (PARTITION BY label, block ORDER BY rep) AS rn FROM blocks),
pairs AS (SELECT a.rep AS rep_a, b.rep AS rep_b, a.t AS ta, b.t AS tb, a.label, a.block, a.filename AS fa, b.filename AS fb FROM ranked a JOIN ranked b ON a.label = b.label AND a.block = b.block AND b.rn BETWEEN a.rn + 1 AND a.rn + 10 WHERE a.size <= 120),
scored AS (SELECT *, {score_sql("ta", "tb", "label", "fa", "fb")} AS score FROM pairs WHERE NOT {conflict_sql("ta", "tb", "label", "label")})"""


@query(f"WITH {REPS} SELECT block, size::BIGINT AS size, count(*)::BIGINT AS names, sum(n)::BIGINT AS mentions FROM ranked GROUP BY ALL")
def er_blocks(spark, sf_dir):
    """JOI2, JOI4 and JOI16."""
    r = resolve.representatives(part_mentions(spark, sf_dir)).withColumn("block", resolve.block_key(F.col("text"), F.col("label")))
    return r.groupBy("block").agg(F.count("*").alias("names"), F.sum("n").alias("mentions")).select("block", F.col("names").alias("size"), "names", "mentions")


@query(f"WITH {REPS} SELECT rep_a, rep_b, round(score, 6) AS score, score >= 0.72 AS merged FROM scored")
def er_pairs(spark, sf_dir):
    """JOI3 and SIM6."""
    p = resolve.score_pairs(resolve.candidate_pairs(resolve.representatives(part_mentions(spark, sf_dir))))
    return p.select("rep_a", "rep_b", F.round("score", 6).alias("score"), "merged")


@query(f"WITH {REPS} SELECT rep_a, rep_b, round(score, 6) AS score, score >= 0.72 AS merged FROM scored WHERE score >= 0.45 ORDER BY label, rep_a, rep_b LIMIT 50000")
def er_audit(spark, sf_dir):
    """WIN17: the scored pairs that a reader looks through, the first 50,000 of them."""
    p = resolve.audit(resolve.score_pairs(resolve.candidate_pairs(resolve.representatives(part_mentions(spark, sf_dir)))))
    return p.select("rep_a", "rep_b", F.round("score", 6).alias("score"), "merged")


CLUSTERS = f"""{REPS}, link AS (SELECT rep_a AS a, rep_b AS b FROM scored WHERE score >= 0.72 UNION SELECT rep_b, rep_a FROM scored WHERE score >= 0.72),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS rep, min(b) AS cluster FROM reach GROUP BY a),
members AS (SELECT m.*, cluster FROM m JOIN reps USING (label, key) JOIN comp USING (rep)),
forms AS (SELECT cluster, t, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, t) AS k FROM members GROUP BY cluster, t),
clusters AS (SELECT cluster, min(label) AS label, count(*) AS size, list_sort(list(DISTINCT t)) AS aliases, len(list(DISTINCT filename)) AS files FROM members GROUP BY cluster)"""


@query(
    f"""WITH RECURSIVE {CLUSTERS} SELECT 'e_' || substring(sha1(label || '||' || t), 1, 12) AS entity_id, t AS canonical, c.cluster, size::BIGINT AS size, array_to_string(aliases, '; ') AS aliases, files::BIGINT AS files,
round(least(1.0, 0.55 + 0.1 * size), 6)::DOUBLE AS confidence FROM clusters c JOIN forms f ON c.cluster = f.cluster AND k = 1"""
)
def er_clusters(spark, sf_dir):
    """GRA3, GRA12 and AGG5 to AGG7."""
    e = resolve.resolve(part_mentions(spark, sf_dir))
    return e.select("entity_id", "canonical", "cluster", F.size("mention_ids").cast("long").alias("size"), F.array_join("aliases", "; ").alias("aliases"), F.size("filenames").cast("long").alias("files"), F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH RECURSIVE {CLUSTERS} SELECT (SELECT count(*) FROM scored)::BIGINT AS pairs, (SELECT count(*) FROM scored WHERE score >= 0.72)::BIGINT AS merged, count(*)::BIGINT AS clusters, round(avg(size), 6) AS mean_size, max(size)::BIGINT AS max_size FROM clusters"""
)
def er_stats(spark, sf_dir):
    """AGG19."""
    m = part_mentions(spark, sf_dir)
    p = resolve.score_pairs(resolve.candidate_pairs(resolve.representatives(m))).agg(F.count("*").alias("pairs"), F.count_if("merged").alias("merged"))
    c = resolve.resolve(m).select(F.size("mention_ids").alias("s")).agg(F.count("*").alias("clusters"), F.round(F.avg("s"), 6).alias("mean_size"), F.max("s").cast("long").alias("max_size"))
    return p.join(c)


@query()
def er_gestalt(spark, sf_dir):
    """SIM2: the pairs again with the Ratcliff-Obershelp ratio."""
    p = resolve.score_pairs(resolve.candidate_pairs(resolve.representatives(part_mentions(spark, sf_dir))), gestalt=True)
    return p.select("rep_a", "rep_b", "char_sim", "score", "merged")


assert fixed.ER_WEIGHTS["char_sim"] == 2.4  # the SQL above spells the weights out
