"""Learnt operators on Spark ML: clusters, coreference, classifiers and their figures."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, parts_for
from . import coref, kernel


def stratified(df: DataFrame, label: str, id_col: str, most: int = 500, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each label, in the order of a hash.

    The number of rows of a label sets how far up its hashes may reach (with
    six deviations to spare), so only about ``most`` rows of each are ordered.
    """
    of = 1 << 40
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(of))
    share = (F.lit(float(most)) + 6 * most**0.5 + 10) / F.count("*")
    reach = df.groupBy(F.col(label).alias("_l")).agg(F.least(F.lit(1.0), share).alias("_reach"))
    d = df.withColumn("_h", h).join(reach, F.col(label).eqNullSafe(F.col("_l"))).filter(F.col("_h") <= F.col("_reach") * of)
    k = F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col))
    return d.withColumn("_k", k).filter(F.col("_k") <= most).select(*df.columns)


def split(df: DataFrame, id_col: str, parts: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 42) -> list[DataFrame]:
    """Rows by the hash of their id, the same in every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(10_000)) / 10_000
    at, out = 0.0, []
    for p in parts:
        out.append(df.filter((u >= at) & (u < at + p)))
        at += p
    return out


def word_tfidf(df: DataFrame, text_col: str, features: int = 1000, min_df: int = 2) -> DataFrame:
    """TF-IDF of 1- to 3-word grams, of unit norm."""
    d = df.withColumn("_w", F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    for n in (2, 3):
        d = NGram(n=n, inputCol="_w", outputCol=f"_w{n}").transform(d)
    d = d.withColumn("_g", F.concat("_w", "_w2", "_w3"))
    return _tfidf(d, features, min_df).drop("_w", "_w2", "_w3")


def char_tfidf(df: DataFrame, text_col: str, features: int = 600, min_df: int = 2) -> DataFrame:
    """TF-IDF of the 2- to 5-letter grams within words; rows are dealt out first, since each becomes many times as large."""
    df = df.repartition(parts_for(df))
    padded = F.transform(F.filter(F.split(F.lower(text_col), r"\s+"), lambda x: x != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    def grams(w, n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))

    g = F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[grams(w, n) for n in (2, 3, 4, 5)]))))
    return _tfidf(df.withColumn("_g", g), features, min_df)


def _tfidf(d: DataFrame, features: int, min_df: int) -> DataFrame:
    stages = [CountVectorizer(inputCol="_g", outputCol="_tf", vocabSize=features, minDF=min_df), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")]
    return Pipeline(stages=stages).fit(d).transform(d).drop("_g", "_tf", "_idf")


def clusters(features: DataFrame, k: int = 8, hierarchical: bool = False, seed: int = 42) -> tuple[DataFrame, float]:
    """``features`` with cluster, and the silhouette."""
    model = (BisectingKMeans if hierarchical else KMeans)(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    out = model.transform(features)
    score = ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(out) if out.select("cluster").distinct().count() > 1 else 0.0
    return out, score


def profile(clustered: DataFrame, label: str, text_col: str) -> DataFrame:
    """Per cluster: size, dominant label, its share (purity), how often each label comes, and five examples; a null label counts as an empty one."""
    named = clustered.withColumn("_l", F.coalesce(F.col(label).cast("string"), F.lit("")))
    n = named.groupBy("cluster", "_l").agg(F.count("*").alias("n"))
    c = n.groupBy("cluster").agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "n")))).alias("labels"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "_l"))).filter("k = 1").select("cluster", F.col("_l").alias("dominant"), F.col("n").alias("most"))
    shown = clustered.select("cluster", F.col(text_col).alias("t")).dropna().distinct().withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("t"))).filter("k <= 5")
    shown = shown.groupBy("cluster").agg(F.array_sort(F.collect_list("t")).alias("examples"))
    return c.join(shown, "cluster", "left").join(top, "cluster").select("cluster", "size", "dominant", (F.col("most") / F.col("size")).alias("purity"), "labels", "examples")


def purity(clustered: DataFrame, label: str) -> DataFrame:
    """One row: the share of all rows that have the most frequent label of their cluster."""
    n = clustered.groupBy("cluster", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_l")).agg(F.count("*").alias("n"))
    per = n.groupBy("cluster").agg(F.max("n").alias("most"), F.sum("n").alias("size"))
    return per.agg(F.round(F.coalesce(F.try_divide(F.sum("most"), F.sum("size")), F.lit(0.0)), 6).alias("purity"))


def short_first(df: DataFrame, label: str, text_col: str, most: int = 500, most_words: int = 8) -> DataFrame:
    """Of each label the texts of at most ``most_words`` words, if there are min(50, most) of them; else all."""
    short = F.size(F.split(F.btrim(F.col(text_col)), r"\s+")) <= most_words
    enough = df.groupBy(F.col(label).alias("_l")).agg((F.count_if(short) >= min(50, most)).alias("_enough"))
    return df.join(enough, F.col(label).eqNullSafe(F.col("_l"))).filter(~F.col("_enough") | short).select(*df.columns)


def metrics(df: DataFrame, predicted: str, actual: str, count: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns in one row; ``count`` is how often a row counts."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    many = (lambda c: F.coalesce(F.sum(F.when(c, F.col(count))), F.lit(0))) if count else F.count_if
    d = df.agg(many(p & a).alias("tp"), many(p & ~a).alias("fp"), many(~p & a).alias("fn"), many(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return d.select("tp", "fp", "fn", "tn", part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def coref_pairs(marked: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, pos, pronoun, candidate, at, features, label) of marked words: the last phrases before each pronoun, and the names of the features.

    Weak labels: the phrase of the nearest-antecedent rule is the right one.
    """
    pairs = coref.candidates(coref.with_antecedent(marked), keep=("antecedent",))
    f = coref.pair_features(F.col("pronoun"), F.col("candidate"), F.col("pos") - F.col("at"), F.lit(True), F.lit(False))
    label = (F.col("candidate") == F.col("antecedent")).cast("int")
    return pairs.select("doc_id", "pos", "pronoun", "candidate", "at", *[c.cast("double").alias(k) for k, c in f.items()], "antecedent", label.alias("label")), list(f)


def coref_kernel(pairs: DataFrame, inputs: list[str], sample: int = 20_000, seed: int = 42) -> tuple[kernel.Kernel | None, DataFrame]:
    """(machine, figures) from ``coref_pairs``: a Gaussian kernel beside a linear machine.

    A balanced sample of at most ``sample`` pairs is learnt from. A fifth of the
    documents, by hash, gives the figures: a row for each model with accuracy,
    precision, recall and F1 over all their pairs, of which equal ones are judged
    once and count by their number. Without both labels there is no
    machine and no row.
    """
    held = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    id_ = F.concat_ws("|", "doc_id", "pos", "at")
    train = materialise(stratified(pairs.filter(~held).withColumn("_id", id_), "label", "_id", sample // 2, seed), "coref")
    machine = kernel.fit(train, inputs, "label", "_id", seed=seed)
    line = "model string, tp long, fp long, fn long, tn long, accuracy double, precision double, recall double, f1 double"
    if machine is None:
        return None, pairs.sparkSession.createDataFrame([], line)
    test = pairs.filter(held).groupBy(*inputs, "label").agg(F.count("*").alias("_n"))
    vectors = VectorAssembler(inputCols=inputs, outputCol="features")
    linear = LinearSVC(maxIter=60, labelCol="label", weightCol="_weight").fit(vectors.transform(kernel.balanced(train, "label")))
    scored = {"kernel": test.withColumn("said", (machine.probability() > 0.5).cast("int")), "linear": linear.transform(vectors.transform(test)).withColumn("said", F.col("prediction").cast("int"))}
    rows = [metrics(d, "said", "label", "_n").select(F.lit(name).alias("model"), "*") for name, d in scored.items()]
    return machine, rows[0].union(rows[1])


def coref_classifier(docs: DataFrame, sample: int = 20_000, seed: int = 42, marked: DataFrame | None = None) -> DataFrame:
    """The likeliest phrase of each pronoun, where its probability exceeds one half.

    Every pronoun with a phrase before it is judged, by the machine of
    ``coref_kernel``, equal pairs once; without one there are no rows. Null and
    empty texts have none. ``marked`` are the words of ``docs`` where they are made already.
    """
    pairs, inputs = coref_pairs(coref.marked_tokens(docs) if marked is None else marked)
    pairs = materialise(pairs.withColumn("x", F.struct(*inputs)), "coref-pairs")
    machine, _ = coref_kernel(pairs, inputs, sample, seed)
    x = pairs.groupBy("x").agg(F.lit(1)).select("x", "x.*")
    p = pairs.join(materialise(x.select("x", (machine.probability() if machine else F.lit(0.0)).alias("p")), "coref-scores"), "x")
    best = p.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.desc("p"), F.desc("at")))).filter("k = 1 AND p > 0.5")
    return best.select("doc_id", "pos", "pronoun", F.col("candidate").alias("antecedent"), "p")


#: Parts into which the rows of equal features are dealt, so that a forest's trees still draw different ones.
SHARES = 64


def relation_classifiers(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Accuracy of three classifiers of relation from (pair_id, label1, label2, length1, length2, has_preposition, relation).

    Rows of equal features count by their number: they are added up in one
    pass, and the classifiers are fitted on weighted rows, whose number is bounded by
    the different features and not by the pairs.
    """
    inputs = ["label1", "label2", "length1", "length2", "has_preposition"]
    test_of = F.pmod(F.xxhash64(F.lit(42), F.col("pair_id")), F.lit(10_000)) / 10_000 >= 0.7
    share = F.pmod(F.xxhash64(F.lit(43), F.col("pair_id")), F.lit(SHARES)).cast("int")
    d = materialise(pairs.groupBy(*inputs, "relation", test_of.alias("_test"), share.alias("_share")).agg(F.count("*").cast("double").alias("_weight")), "relation-pairs")
    d = d.join(F.broadcast(d.groupBy("relation").agg(F.sum("_weight").alias("_n")).filter(F.col("_n") >= least).select("relation")), "relation", "left_semi")
    # labels by how often they come, then by name, as over all pairs
    for c in ("label1", "label2", "relation"):
        n = d.groupBy(F.col(c).alias("_v")).agg(F.sum("_weight").alias("_n")).filter("_v is not null").orderBy(F.desc("_n"), "_v").collect()
        index = F.create_map(*[F.lit(x) for i, r in enumerate(n) for x in (r["_v"], float(i))])[F.col(c)] if n else F.lit(None)
        d = d.withColumn(f"_{c}", F.coalesce(index, F.lit(float(len(n)))))
    d = VectorAssembler(inputCols=[f"_{c}" if c in ("label1", "label2") else c for c in inputs], outputCol="features").transform(d)
    d = materialise(d.select("features", "_relation", "_weight", "_test"), "relation-features")
    train, test = d.filter("not _test"), d.filter("_test")
    weight = train.agg(F.sum("_weight")).first()[0] or 1.0
    by = {"labelCol": "_relation", "weightCol": "_weight"}
    # a leaf holds five pairs at least
    forest = RandomForestClassifier(numTrees=20, maxDepth=10, minInstancesPerNode=1, minWeightFractionPerNode=min(0.49, 5 / weight), seed=42, **by)
    out = []
    for name, c in (("linear_svm", OneVsRest(classifier=LinearSVC(maxIter=10), **by)), ("random_forest", forest), ("naive_bayes", NaiveBayes(modelType="gaussian", **by))):
        right = F.when(F.col("prediction") == F.col("_relation"), F.col("_weight")).otherwise(0.0)
        out.append(c.fit(train).transform(test).agg(F.lit(name).alias("model"), F.coalesce(F.sum("_weight"), F.lit(0.0)).cast("long").alias("rows"), F.try_divide(F.sum(right), F.sum("_weight")).alias("accuracy")))
    return out[0].union(out[1]).union(out[2])


def class_report(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class, then of all classes alike (macro) and by their support (weighted).

    Classes are the values of both columns; rows with a null in either are left out.
    """
    pairs = df.select(F.col(predicted).cast("string").alias("p"), F.col(actual).cast("string").alias("a")).dropna().groupBy("p", "a").agg(F.count("*").alias("n"))
    c = pairs.select(F.col("a").alias("class"), F.when(F.col("p") == F.col("a"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("said"), F.col("n").alias("support"))
    c = c.union(pairs.select("p", F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long"))).groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "said", "support")])
    part = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp = F.col("tp")
    c = c.select("class", part(tp, F.col("said")).alias("precision"), part(tp, F.col("support")).alias("recall"), part(2 * tp, F.col("said") + F.col("support")).alias("f1"), "support")
    rates = ("precision", "recall", "f1")
    macro = c.agg(*[F.avg(x).alias(x) for x in rates], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *rates, "support")
    weighted = c.agg(*[part(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in rates], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *rates, "support")
    return c.union(macro).union(weighted).filter("support is not null").select("class", *[F.round(x, 6).alias(x) for x in rates], "support")


def hashed_vectors(df: DataFrame, text_col: str, dim: int = 256) -> DataFrame:
    """Unit vectors of hashed words, where no encoder is at hand."""
    d = df.withColumn("_w", F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    d = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(d)
    d = Normalizer(inputCol="_tf", outputCol="_u").transform(d)
    return d.withColumn("embedding", vector_to_array("_u", "float32")).drop("_w", "_tf", "_u")


