"""Coreference and learnt operators; learnt ones give rows that no SQL can."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coref, crf, extract, learn, links, ward
from ..operators import graph as graph_ops
from ..session import materialise, parts_for
from .registry import in_list, query, table
from .text_queries import TOKENS
from .triple_queries import raw_triples

MARKED = f"""t AS (SELECT doc_id, i AS pos, w[i] AS w, regexp_replace(lower(w[i]), '[^a-z]', '', 'g') AS bare FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents))),
m AS (SELECT *, bare IN {in_list(coref.SINGULAR + coref.PLURAL)} AS pro, bare IN {in_list(coref.PLURAL)} AS pl FROM t),
k AS (SELECT doc_id, pos, w, pro, NOT pro AND regexp_matches(w, '^[A-Z]') AND length(bare) > 3 AS ph, CASE WHEN pro THEN pl ELSE bare LIKE '%s' OR bare LIKE '%parties%' END AS plural FROM m),
a AS (SELECT *, last_value(CASE WHEN ph AND plural THEN w END IGNORE NULLS) OVER x AS many, last_value(CASE WHEN ph AND NOT plural THEN w END IGNORE NULLS) OVER x AS one, last_value(CASE WHEN ph THEN w END IGNORE NULLS) OVER x AS anyone
  FROM k WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {MARKED} SELECT doc_id, pos::INT AS pos, w AS pronoun, coalesce(CASE WHEN plural THEN many ELSE one END, anyone) AS antecedent FROM a WHERE pro")
def asof_antecedent(spark, sf_dir):
    """JOI15, NLP2 and NLP4: the nearest phrase before each pronoun."""
    return coref.nearest_antecedent(coref.marked_tokens(table(spark, sf_dir, "documents")))


@query(
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 1 AND quality = 1) AS fp, count(*) FILTER (toxic = 0 AND quality = 0) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def classification_metrics(spark, sf_dir):
    """AGG27."""
    l = table(spark, sf_dir, "labels").withColumn("poor", 1 - F.col("quality"))  # noqa: E741
    return learn.metrics(l, "toxic", "poor")


@query()
def tfidf_kmeans(spark, sf_dir):
    """ML6, ML8, ML9, AGG10 and AGG11: clusters of part names by words."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    d = learn.word_tfidf(learn.stratified(learn.short_first(p, "p_type", "p_name"), "p_type", "p_partkey"), "p_name")
    c, score = learn.clusters(d, 8)
    return learn.profile(c, "p_type", "p_name").withColumn("silhouette", F.lit(score))


@query()
def char_bisecting(spark, sf_dir):
    """ML7: clusters of names by letters, divisive."""
    d = learn.char_tfidf(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name")
    c, score = learn.clusters(d, 6, hierarchical=True)
    return learn.profile(c, "p_type", "p_name").withColumn("silhouette", F.lit(score))


@query()
def ward_clusters(spark, sf_dir):
    """ML10, AGG10 and AGG11: all part names in the Ward clusters of a sample, by letters."""
    d = materialise(learn.char_tfidf(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name"), "names")
    c = materialise(ward.ward(d, "p_partkey", 6), "ward")
    return learn.profile(c, "p_type", "p_name").join(F.broadcast(learn.purity(c, "p_type").withColumnRenamed("purity", "purity_of_all")))


_TOP = "n AS (SELECT p_size % 7 AS cluster, p_type, count(*) AS n FROM part GROUP BY ALL)"


@query(
    f"""WITH {_TOP}, o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, p_type) AS k FROM n)
SELECT cluster, sum(n)::BIGINT AS size, max(CASE WHEN k = 1 THEN p_type END) AS dominant, round(max(n) / sum(n), 6) AS purity, string_agg(p_type || ':' || n, ',' ORDER BY p_type) AS labels,
(SELECT round(sum(m) / sum(s), 6) FROM (SELECT max(n) AS m, sum(n) AS s FROM n GROUP BY cluster)) AS purity_of_all FROM o GROUP BY cluster"""
)
def cluster_profile(spark, sf_dir):
    """AGG10 and AGG11: the profile of given groups of parts."""
    c = table(spark, sf_dir, "part").withColumn("cluster", F.col("p_size") % 7)
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    p = learn.profile(c, "p_type", "p_name").select("cluster", "size", "dominant", F.round("purity", 6).alias("purity"), labels.alias("labels"))
    return p.join(F.broadcast(learn.purity(c, "p_type").withColumnRenamed("purity", "purity_of_all")))


def word_graph(spark, sf_dir):
    """Words of conversations; an edge joins two that stand side by side in two turns or more."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
    beside = F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 1)).alias("a"), F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 1)).alias("b")))
    p = t.filter(F.size("w") > 1).select("conv_id", "turn", beside.alias("p")).select("conv_id", "turn", F.least("p.a", "p.b").alias("src"), F.greatest("p.a", "p.b").alias("dst")).filter("src <> dst").distinct()
    e = p.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1").select("src", "dst", F.lit("BESIDE").alias("relation"), F.lit(0.5).alias("confidence"))
    e = materialise(e, "beside")
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return v.withColumn("type", F.when(F.length("id") > 4, "LONG").otherwise("SHORT")), e


WORD = "[a-zà-ÿ]{3,}"
WORDS_BESIDE = f"""tw AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{WORD}') AS w FROM conversations), tp AS (SELECT DISTINCT conv_id, turn, unnest(list_zip(w[:-2], w[2:])) AS z FROM tw WHERE len(w) > 1),
s AS (SELECT least(z[1], z[2]) AS u, greatest(z[1], z[2]) AS v FROM (SELECT DISTINCT conv_id, turn, [least(z[1], z[2]), greatest(z[1], z[2])] AS z FROM tp) WHERE z[1] <> z[2] GROUP BY ALL HAVING count(*) > 1),
adj AS (SELECT u AS node, v AS other FROM s UNION ALL SELECT v, u FROM s), deg AS (SELECT node, count(*) AS d FROM adj GROUP BY 1)"""


@query(
    f"""WITH {WORDS_BESIDE}, c AS (SELECT s.u, s.v, count(*) AS common, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS aa, sum(1 / d) AS ra FROM s JOIN adj x ON x.node = s.u JOIN adj y ON y.node = s.v AND y.other = x.other JOIN deg ON deg.node = x.other GROUP BY 1, 2),
p AS (SELECT DISTINCT s.u, s.v FROM s ANTI JOIN c USING (u, v) JOIN adj x ON x.node = s.u AND x.other <> s.v JOIN adj m ON m.node = x.other AND m.other <> s.u JOIN adj y ON y.node = s.v AND y.other = m.other AND y.other <> s.u)
SELECT s.u, s.v, coalesce(common, 0)::BIGINT AS common, round(coalesce(common / nullif(a.d + b.d - 2 - coalesce(common, 0), 0), 0), 6) AS jaccard, ((a.d - 1) * (b.d - 1))::BIGINT AS preferential, round(coalesce(aa, 0), 6) AS adamic_adar, round(coalesce(ra, 0), 6) AS resource_allocation,
abs(a.d - b.d)::BIGINT AS degree_gap, ((length(s.u) > 4) = (length(s.v) > 4))::INT AS same, CASE WHEN common > 0 THEN 2 WHEN p.u IS NOT NULL THEN 3 ELSE 0 END::INT AS path
FROM s JOIN deg a ON a.node = s.u JOIN deg b ON b.node = s.v LEFT JOIN c ON c.u = s.u AND c.v = s.v LEFT JOIN p ON p.u = s.u AND p.v = s.v"""
)
def edge_features(spark, sf_dir):
    """GRA4 for every edge of the word graph, as if it were not there, with the length of the way round it."""
    v, e = word_graph(spark, sf_dir)
    x = links.features(e, v, e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return x.select("u", "v", *[F.round(c, 6).alias(c) if c in ("jaccard", "adamic_adar", "resource_allocation") else F.col(c) for c in links.FEATURES])


@query()
def link_prediction(spark, sf_dir):
    """ML11, ML12 and GRA5: figures of both models on edges and non-edges that neither was fitted on."""
    v, e = word_graph(spark, sf_dir)
    return links.fit_predictor(e, v)[1]


@query()
def inferred_links(spark, sf_dir):
    """GRA10, FIL7 and WIN11: the word graph with the likeliest ten links after its own edges."""
    v, e = word_graph(spark, sf_dir)
    model, _ = links.fit_predictor(e, v)
    added = links.predicted(e, v, model) if model else e.limit(0).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("confidence").alias("probability"))
    return graph_ops.add_inferred(e, materialise(added, "links"))


@query()
def coref_classifier(spark, sf_dir):
    """ML2 to ML4, SIM12 and NLP6."""
    return learn.coref_classifier(table(spark, sf_dir, "documents"))


@query()
def coref_metrics(spark, sf_dir):
    """ML2 and ML4: the kernel and a linear machine on pairs of documents that neither has seen."""
    pairs, inputs = learn.coref_pairs(coref.marked_tokens(table(spark, sf_dir, "documents")))
    return learn.coref_kernel(materialise(pairs, "coref-pairs"), inputs)[1]


@query()
def relation_classifiers(spark, sf_dir):
    """ML5 and SIM13 over the triples of the star schema."""
    r = raw_triples(spark, sf_dir).select(
        F.col("seq").alias("pair_id"), F.col("subject_type").alias("label1"), F.col("object_type").alias("label2"), F.length("subject").alias("length1"), F.length("object").alias("length2"),
        F.col("predicate").rlike(" (to|by|of|in|as)$").cast("int").alias("has_preposition"), "relation",
    )
    return learn.relation_classifiers(r)


# Patterns of personal data, by label; a number may be several words.
PERSONAL = {"CARD": r"\b\d{16}\b", "EMAIL": r"[\w.]+@[\w.]+\w", "IP": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "PHONE": r"\+\d{1,2} \(\d{3}\) \d{3}-\d{4}"}
# A sign that every match holds, which is looked for first.
SIGNS = {"EMAIL": "@", "PHONE": "+"}
TAGS = ["O", *[f"{b}-{x}" for x in PERSONAL for b in "BI"]]


def holds_personal(text):
    """Whether any of the patterns for personal data is found."""
    return reduce(or_, [F.contains(text, F.lit(SIGNS.get(k, ""))) & text.rlike(p) for k, p in PERSONAL.items()])


#: Bytes of written words that a part takes; their features take far more.
WORD_BYTES = 1 << 19


def tagged_words(spark, sf_dir):
    """Words of all lines of all documents, tagged by the spans of the patterns for personal data; spans are looked for only where a line holds any."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "t"))
    lines = lines.select(F.concat_ws(":", "doc_id", "at").alias("sid"), "t").withColumn("held", holds_personal(F.col("t")))
    some = materialise(lines.filter("held").drop("held"), "lines")
    spans = None
    for label, pattern in PERSONAL.items():
        found = some.select("sid", F.explode(extract._matches(pattern, 0)(F.col("t"))).alias("m")).select("sid", F.col("m.start").alias("a"), F.col("m.end").alias("b"), F.lit(label).alias("label"))
        spans = found if spans is None else spans.union(found)
    others = lines.filter("not held and t <> ''").select("sid", F.posexplode(F.split("t", " ")).alias("i", "word")).select("sid", F.col("i") + 1, "word", F.lit("O"))
    return materialise(extract.bio_encode(some, spans, overlap=True).union(others), "tagged")


def personal_tagger(spark, sf_dir, held_out_only=False):
    """The field for personal data over ``tagged_words``; features that it learns from are made of tagged lines alone."""
    words = tagged_words(spark, sf_dir)
    some = materialise(words.filter("tag <> 'O'").select("sid").distinct(), "tagged")
    features = lambda w: extract.word_features(w.repartition(parts_for(words, WORD_BYTES), "sid"))
    tagged = features(words.join(some, "sid", "left_semi"))
    return crf.tagger(features(words), extract.WORD_FEATURES, TAGS, iterations=40, held_out_only=held_out_only, tagged=tagged)


@query()
def token_tagger(spark, sf_dir):
    """ML1: a conditional random field for personal data; a fifth of the lines is held out."""
    return personal_tagger(spark, sf_dir)


@query()
def tagger_report(spark, sf_dir):
    """ML1 and AGG27: figures of each tag but O on all lines held out, those without personal data among them."""
    t = personal_tagger(spark, sf_dir, held_out_only=True)
    return learn.class_report(t.filter("tag <> 'O' or predicted <> 'O'"), "predicted", "tag")


_CLASS = """n AS (SELECT p, a, count(*) AS n FROM pairs WHERE p IS NOT NULL AND a IS NOT NULL GROUP BY ALL),
c AS (SELECT class, sum(tp) AS tp, sum(said) AS said, sum(support) AS support FROM (SELECT a AS class, CASE WHEN p = a THEN n ELSE 0 END AS tp, 0 AS said, n AS support FROM n UNION ALL SELECT p, 0, n, 0 FROM n) GROUP BY 1),
r AS (SELECT class, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, support FROM c)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM r"""


@query(f"WITH pairs AS (SELECT event_type AS a, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), {_CLASS}")
def class_report(spark, sf_dir):
    """AGG27 for several classes: how well a user's last event foretells the next."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return learn.class_report(table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), before.alias("p")), "p", "a")


@query()
def coref_comparison(spark, sf_dir):
    """NLP6: the rule and the classifier side by side."""
    d = table(spark, sf_dir, "documents")
    marked = materialise(coref.marked_tokens(d).filter("is_pronoun or is_phrase"), "marked")
    return coref.compare(coref.nearest_antecedent(marked), learn.coref_classifier(d, marked=marked))
