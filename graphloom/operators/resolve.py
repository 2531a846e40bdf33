"""Entity dictionaries, linking by BM25 and edit distance, entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.similarity import er_probability, hard_conflict, levenshtein_similarity, pair_features
from ..functions.text import canonical_tokens, mention_quality, stable_id, words, years_conflict
from .components import connected_components


def knowledge_base(mentions: DataFrame, min_count: int = 2) -> DataFrame:
    """(label, canonical, frequency) of mentions (label, text): lower-cased, not noise, met ``min_count`` times."""
    m = mentions.select("label", F.lower(F.btrim("text")).alias("canonical")).filter((F.length("canonical") > 2) & (mention_quality(F.col("canonical")) > 0))
    return m.groupBy("label", "canonical").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= min_count)


def link(mentions: DataFrame, kb: DataFrame, top: int = 20, threshold: float = 0.72, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, epsilon: float = fixed.BM25_EPSILON) -> DataFrame:
    """Links each distinct (label, text) to an entry of its block (label, first letter).

    BM25 over the block picks ``top`` candidates; half its share of the best
    score and half the edit similarity make the score; the earlier BM25 rank
    wins ties, dates of other years are passed over, and below ``threshold``
    the mention stays as it is. Terms meet on (block, term) and scores are sums
    over them, so no mention meets a whole block.
    """
    block = lambda c: F.substring(F.lower(c), 1, 1)
    docs = kb.select("label", "canonical", "frequency", block(F.col("canonical")).alias("block"), words(F.col("canonical")).alias("w"))
    docs = docs.withColumn("len", F.size("w"))
    key = ["label", "block"]
    size = docs.groupBy(*key).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tf = docs.select(*key, "canonical", "frequency", "len", F.explode("w").alias("term")).groupBy(*key, "canonical", "frequency", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*key, "term").agg(F.count("*").alias("df")).join(size, key)
    df = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    df = df.withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.avg("idf").over(Window.partitionBy(*key))).otherwise(F.col("idf")))
    post = tf.join(df, [*key, "term"])
    post = post.withColumn("part", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl"))))
    m = mentions.select("label", "text").distinct().filter((F.length("text") > 2) & (mention_quality(F.col("text")) > 0))
    q = m.select("label", "text", block(F.col("text")).alias("block"), F.explode(words(F.lower(F.btrim("text")))).alias("term"))
    scored = q.join(post.select(*key, "canonical", "frequency", "term", "part"), [*key, "term"]).groupBy("label", "text", "canonical", "frequency").agg(F.sum("part").alias("bm25"))
    mention = Window.partitionBy("label", "text")
    order = mention.orderBy(F.desc(F.round("bm25", 9)), F.desc("frequency"), "canonical")
    c = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("best", F.max("bm25").over(mention))
    lexical = F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(0.0)
    c = c.withColumn("score", 0.5 * lexical + 0.5 * levenshtein_similarity(F.col("text"), F.col("canonical")))
    c = c.filter(~(F.col("label").isin("DATE", "EFFECTIVE_DATE") & years_conflict(F.col("text"), F.col("canonical"))))
    first = c.withColumn("k", F.row_number().over(mention.orderBy(F.desc(F.round("score", 9)), "rank"))).filter("k = 1").select("label", "text", "canonical", "score")
    out = m.join(first, ["label", "text"], "left")
    linked = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select("label", "text", F.when(linked, F.col("canonical")).otherwise(F.col("text")).alias("canonical"), F.coalesce("score", F.lit(0.0)).alias("score"), linked.alias("linked"), (linked & (F.col("canonical") != F.col("text"))).alias("changed"))


def link_report(linked: DataFrame) -> DataFrame:
    """Per label: total, linked, changed, rate and three examples."""
    ex = linked.filter("changed").select("label", F.concat("text", F.lit(" -> "), "canonical").alias("ex")).distinct()
    ex = ex.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("ex"))).filter("k <= 3")
    ex = ex.groupBy(F.col("label").alias("_l")).agg(F.array_join(F.array_sort(F.collect_list("ex")), "; ").alias("examples"))
    n = F.count("*")
    counts = linked.groupBy("label").agg(n.alias("total"), F.count_if("linked").alias("linked"), F.count_if("changed").alias("changed"), F.round(F.count_if("linked") / n, 6).alias("rate"))
    return counts.join(ex, F.col("label").eqNullSafe(F.col("_l")), "left").select("label", "total", "linked", "changed", "rate", F.coalesce("examples", F.lit("")).alias("examples"))


def block_key(text: Column, label: Column) -> Column:
    """Of dates the year; else the starts of the first two key words."""
    t = canonical_tokens(text, label)
    key = F.array_join(t, " ")
    year = F.regexp_extract(key, r"\b(?:19|20)\d{2}\b", 0)
    dated = F.when(year != "", year).otherwise(F.element_at(t, -1))
    plain = F.concat(F.substring(F.get(t, 0), 1, 4), F.lit("|"), F.coalesce(F.substring(F.get(t, 1), 1, 4), F.lit("")))
    return F.when(F.size(t) == 0, "#").when(label.isin("DATE", "EFFECTIVE_DATE"), dated).otherwise(plain)


def representatives(mentions: DataFrame) -> DataFrame:
    """Mentions (id, text, label, filename) of an equal key as one: its first by id stands for all."""
    key = F.array_join(canonical_tokens(F.col("text"), F.col("label")), " ")
    m = mentions.withColumn("key", key)
    return m.groupBy("label", "key").agg(F.min_by(F.struct("id", "text", "filename"), "id").alias("first"), F.count("*").alias("n")).select(
        F.col("first.id").alias("rep"), "label", "key", F.col("first.text").alias("text"), F.col("first.filename").alias("filename"), "n"
    )


def candidate_pairs(reps: DataFrame, max_block: int = 120, neighbours: int = 10) -> DataFrame:
    """Pairs within a block, each with the next ``neighbours`` in order; larger blocks than ``max_block`` are skipped.

    The band join is on (block, rank) after each row is put at its rank and the
    ranks before, so a block costs its size times the neighbours.
    """
    r = reps.withColumn("block", block_key(F.col("text"), F.col("label")))
    of = Window.partitionBy("label", "block")
    large = r.groupBy("label", "block").agg(F.count("*").alias("size")).filter(F.col("size") > max_block).select(F.col("label").alias("_l"), F.col("block").alias("_b"))
    r = r.join(large, F.col("label").eqNullSafe(F.col("_l")) & F.col("block").eqNullSafe(F.col("_b")), "left_anti").withColumn("rn", F.row_number().over(of.orderBy("rep")))
    cols = ["rep", "text", "filename"]
    left = r.select("label", "block", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + neighbours)).alias("rn"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = r.select("label", "block", "rn", *[F.col(c).alias(f"{c}_b") for c in cols])
    return left.join(right, ["label", "block", "rn"]).drop("rn")


def score_pairs(pairs: DataFrame, gestalt: bool = False, threshold: float = fixed.ER_THRESHOLD) -> DataFrame:
    """Features, probability and whether a pair merges; pairs in hard conflict are left out."""
    a, b, label = F.col("text_a"), F.col("text_b"), F.col("label")
    p = pairs.filter(~hard_conflict(a, b, label, label))
    f = pair_features(a, b, label, F.col("filename_a"), F.col("filename_b"), gestalt)
    p = p.select("*", *[c.alias(k) for k, c in f.items()])
    return p.withColumn("score", er_probability({k: F.col(k) for k in f})).withColumn("merged", F.col("score") >= threshold)


def audit(scored: DataFrame, most: int = 50_000, least: float = 0.45) -> DataFrame:
    """The first ``most`` scored pairs that merged or score ``least``, by label and ids; without ``most`` (None) all of them."""
    kept = scored.filter(F.col("merged") | (F.col("score") >= least))
    return kept if most is None else kept.orderBy("label", "rep_a", "rep_b").limit(most)


def resolve(mentions: DataFrame, gestalt: bool = False, threshold: float = fixed.ER_THRESHOLD) -> DataFrame:
    """Entities of mentions (id, text, label, filename).

    Equal keys are one; blocks, neighbours, conflicts and scores decide which
    others merge; components are entities. The canonical form is the most
    frequent (the least of equals); the id hashes label and canonical form.
    """
    reps = representatives(mentions)
    merged = score_pairs(candidate_pairs(reps), gestalt, threshold).filter("merged")
    comp = connected_components(merged, "rep_a", "rep_b")
    placed = reps.join(comp, reps["rep"] == comp["node"], "left").select("label", "key", F.coalesce("component", "rep").alias("cluster"))
    m = mentions.withColumn("key", F.array_join(canonical_tokens(F.col("text"), F.col("label")), " ")).join(placed, ["label", "key"])
    forms = m.groupBy("cluster", "text").agg(F.count("*").alias("n"))
    top = forms.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "text"))).filter("k = 1").select("cluster", F.col("text").alias("canonical"))
    c = m.groupBy("cluster").agg(
        F.min("label").alias("label"),
        F.array_sort(F.collect_set("text")).alias("aliases"),
        F.array_sort(F.collect_set("id")).alias("mention_ids"),
        F.array_sort(F.collect_set("filename")).alias("filenames"),
        F.least(F.lit(1.0), 0.55 + 0.1 * F.count("*")).alias("confidence"),
    )
    return c.join(top, "cluster").select(stable_id("e", F.col("label"), F.col("canonical")).alias("entity_id"), "canonical", "label", "aliases", "mention_ids", "filenames", "confidence", "cluster")
