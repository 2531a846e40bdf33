"""Retrieval: BM25, vectors, rank fusion, graph boost, suggestions, answers' evidence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.similarity import dot
from ..functions.text import normalize_entity, search_tokens
from . import graph
from .names import match_entities


def query_terms(text: str) -> list[str]:
    """Terms of a query without stop words; all of them if nothing else is left."""
    import re

    terms = re.findall("[a-z0-9]+", text.lower())
    return [t for t in terms if t not in fixed.QUERY_STOP_WORDS] or terms


def term_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df) of a column of tokens."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents, avgdl."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"))


def idf(stats: DataFrame, corpus: DataFrame, epsilon: float = fixed.BM25_EPSILON) -> DataFrame:
    """(term, df, idf); a negative idf becomes ``epsilon`` of the mean over all terms."""
    raw = stats.join(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _count_of(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """(id, score) of every document; a term twice in the query counts twice.

    Frequencies of the few query terms are counted within each row, so only
    document frequencies are grouped; one row of corpus totals and the query's
    idf are broadcast.
    """
    t = search_tokens(F.coalesce(F.col(text_col), F.lit(""))) if tokens is None else tokens
    d = docs.select(F.col(id_col).alias("id"), t.alias("t"))
    corpus = corpus_stats(d, F.col("t"))
    wanted = sorted(set(terms))
    weights = idf(term_stats(d, F.col("t")), corpus).filter(F.col("term").isin(wanted))
    # one row: idf by term
    row = weights.agg(*[F.coalesce(F.max(F.when(F.col("term") == w, F.col("idf"))), F.lit(0.0)).alias(f"w{i}") for i, w in enumerate(wanted)])
    d = d.join(F.broadcast(corpus)).join(F.broadcast(row))
    length = F.size("t")
    total = F.lit(0.0)
    for i, w in enumerate(wanted):
        tf = _count_of(w)
        total = total + terms.count(w) * F.col(f"w{i}") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)))
    return d.select("id", total.alias("score"))


def ranked(scores: DataFrame, name: str) -> DataFrame:
    """``scores`` (id, score) with a 0-based rank, best first, then by id."""
    return scores.withColumn(name, F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")) - 1)


def cosine(vectors: DataFrame, query: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) against the one vector of ``query`` (q)."""
    return vectors.join(F.broadcast(query.select("q").limit(1))).select(F.col(id_col).alias("id"), dot(F.col(vec_col), F.col("q")).alias("score"))


def fuse(channels: list[DataFrame], pool: int, k: int = fixed.RRF_K) -> DataFrame:
    """(id, rrf) from the first ``pool`` of each channel (id, score): the sum of 1 / (k + rank), ranks from 0.

    Each channel is cut to its pool by a distributed top-k before ranks are given.
    """
    parts = None
    for c in channels:
        top = c.orderBy(F.desc(F.round("score", 9)), "id").limit(pool)
        r = ranked(top, "rank").select("id", (1 / (k + F.col("rank"))).alias("part"))
        parts = r if parts is None else parts.union(r)
    return parts.groupBy("id").agg(F.sum("part").alias("rrf"))


def graph_boost(base: DataFrame, mentions: DataFrame, reach: DataFrame, weight: float = fixed.GRAPH_BOOST) -> DataFrame:
    """``base`` (id, score) with boosted = score * (1 + weight * sum of 1 / (1 + hop)) over reached entities (id, node) of a text.

    Names meet in lower case.
    """
    near = mentions.select("id", F.lower("node").alias("key")).distinct().join(reach.select(F.lower("node").alias("key"), "hop").groupBy("key").agg(F.min("hop").alias("hop")), "key")
    gain = near.groupBy("id").agg(F.sum(1 / (1 + F.col("hop"))).alias("near"))
    return base.join(gain, "id", "left").withColumn("near", F.coalesce("near", F.lit(0.0))).withColumn("boosted", F.col("score") * (1 + weight * F.col("near")))


def dictionary(mentions: DataFrame) -> DataFrame:
    """(key, display, label, frequency) of mentions (sid, pos, text, label).

    The display form in mixed case is preferred, then the first one seen; the
    majority label, the first of equals.
    """
    m = mentions.withColumn("text", normalize_entity(F.col("text"))).filter(F.length("text") > 0).withColumn("key", F.lower("text")).withColumn("at", F.struct("sid", "pos"))
    upper = F.col("text") == F.upper("text")
    shown = m.groupBy("key").agg(F.count("*").alias("frequency"), F.min_by("text", F.struct(upper, "at", "text")).alias("display"))
    votes = m.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    label = votes.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "at", "label"))).filter("k = 1").select("key", "label")
    return shown.join(label, "key")


def suggest(entities: DataFrame, prefix: str, limit: int = 8, most_words: int = 6) -> DataFrame:
    """Names (key, frequency) that start with ``prefix``, then those that hold it, each by frequency."""
    p = prefix.strip().lower()
    e = entities.filter(F.size(F.split("key", r"\s+")) <= most_words).filter(F.col("key").contains(p) & F.lit(bool(p)))
    return e.withColumn("is_prefix", F.col("key").startswith(p)).orderBy(F.desc("is_prefix"), F.desc("frequency"), "key").limit(limit)


def examples(entities: DataFrame, pool: int = 400, most_words: int = 6) -> DataFrame:
    """(label, question) from the most frequent name of each label among the first ``pool``."""
    top = entities.orderBy(F.desc("frequency"), "key").limit(pool).filter(F.size(F.split("key", r"\s+")) <= most_words)
    one = top.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("frequency"), "key"))).filter("k = 1")
    templates = F.create_map(*[F.lit(x) for kv in fixed.EXAMPLES.items() for x in kv])[F.col("label")]
    return one.select("label", F.replace(templates, F.lit("{}"), F.col("display")).alias("question")).filter("question is not null")


class Engine:
    """Searches over sentences (sid, text, entities array<struct<text,label>>) and a graph (vertices, edges).

    Statistics are DataFrames that are made once and cached by the session's
    own means; a search returns one row per sentence and leaves the rest lazy.
    """

    def __init__(self, sentences: DataFrame, vertices: DataFrame, edges: DataFrame, candidates: DataFrame | None = None, vectors: DataFrame | None = None):
        self.sentences, self.vertices, self.edges, self.candidates, self.vectors = sentences, vertices, edges, candidates, vectors
        mentions = sentences.select("sid", F.posexplode("entities").alias("pos", "e")).select("sid", "pos", "e.text", "e.label")
        self.mentions = mentions
        self.entities = dictionary(mentions)

    def names(self) -> DataFrame:
        return self.entities.select(F.col("display").alias("name")).union(self.vertices.select("id")).distinct()

    def recognised(self, text: str) -> DataFrame:
        q = self.sentences.sparkSession.createDataFrame([(0, text)], "qid int, q string")
        return match_entities(q, self.names())

    def search(self, text: str, k: int = 5, vector: DataFrame | None = None) -> DataFrame:
        """The k best sentences: BM25 and, with a query vector, cosine, fused; a pool of 4 k is boosted by the graph."""
        lexical = bm25(self.sentences, query_terms(text), "sid")
        channels = [lexical]
        if vector is not None and self.vectors is not None:
            channels.append(cosine(self.vectors, vector, "sid"))
        base = fuse(channels, 4 * k).withColumnRenamed("rrf", "score") if len(channels) > 1 else lexical.filter("score > 0")
        pool = base.orderBy(F.desc(F.round("score", 9)), "id").limit(4 * k)
        anchors = self.recognised(text).select(F.col("name").alias("node"))
        reach = graph.bfs(self.edges, anchors)
        boosted = graph_boost(pool, self.mentions.select(F.col("sid").alias("id"), F.col("text").alias("node")), reach)
        best = boosted.orderBy(F.desc(F.round("boosted", 9)), "id").limit(k)
        return best.join(self.sentences.select(F.col("sid").alias("id"), "text"), "id").orderBy(F.desc(F.round("boosted", 9)), "id")

    def facts(self, text: str, most: int = 5, expand: DataFrame | None = None) -> DataFrame:
        """Facts of the entities named (and of ``expand``'s nodes): validated ones, else candidates marked unverified."""
        low = text.lower()
        hints = sorted({r for phrase, rs in fixed.RELATION_HINTS.items() if phrase in low for r in rs})
        who = self.recognised(text).select(F.col("name").alias("node"))
        who = who.union(expand.select("node")).distinct() if expand is not None else who
        good = graph.facts(self.edges, who, hints, most).withColumn("validated", F.lit(True))
        if self.candidates is None:
            return good
        missing = who.join(good.select("node").distinct(), "node", "left_anti")
        return good.unionByName(graph.facts(self.candidates, missing, None, most).withColumn("validated", F.lit(False)))

    def paths(self, text: str, pairs: int = 6) -> DataFrame:
        """Shortest paths between the first pairs of entities named."""
        names = sorted(r["name"] for r in self.recognised(text).orderBy("name").limit(20).collect())
        few = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]][:pairs]
        return graph.shortest_paths(self.edges, self.sentences.sparkSession.createDataFrame(few, "source string, target string"))

    def evidence(self, text: str, k: int = 5, pairs: int = 6) -> dict:
        """Names, passages, best paths between the first pairs of names, facts, and names without a checked fact; an empty question is an error."""
        if not text.strip():
            raise ValueError("an empty question")
        names = sorted(r["name"] for r in self.recognised(text).orderBy("name").limit(20).collect())
        spark = self.sentences.sparkSession
        few = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]][:pairs]
        paths = graph.best_paths(self.edges, spark.createDataFrame(few, "source string, target string")).orderBy("rank").collect() if few else []
        facts = [r.asDict() for r in self.facts(text).orderBy("node", "rank").collect()]
        known = {f["node"] for f in facts if f["validated"]}
        return {"names": names, "passages": self.search(text, k).collect(), "paths": [p.asDict() for p in paths], "facts": facts, "missing": [n for n in names if n not in known]}

    def prompt(self, text: str, k: int = 5) -> str:
        """The evidence of a query as text for an answerer; none is called here."""
        said = [r["text"] for r in self.search(text, k).collect()]
        known = [f"{r['node']} {r['relation']} {r['other']}" + ("" if r["validated"] else " [UNVERIFIED]") for r in self.facts(text).collect()]
        return "\n".join([f"Question: {text}", "Passages:", *[f"- {s}" for s in said], "Facts:", *[f"- {f}" for f in known]])

    def answer(self, text: str, answerer=None, k: int = 5) -> dict:
        """Names, passages, facts and paths of a query, and what ``answerer`` makes of the prompt if one is given."""
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        out = {"names": rows(self.recognised(text)), "passages": rows(self.search(text, k)), "facts": rows(self.facts(text)), "paths": rows(self.paths(text))}
        return out | {"answer": answerer(self.prompt(text, k)) if answerer else None}


def key_variants(records: DataFrame) -> DataFrame:
    """(subject, predicate, object) from rows that name them in any of the usual ways; incomplete rows go."""
    def first(*names: str) -> Column:
        have = [F.nullif(F.btrim(F.col(n).cast("string")), F.lit("")) for n in names if n in records.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    r = records.select(
        first("source", "subject", "head", "canonical1", "entity1").alias("subject"), first("relation", "predicate", "label", "rel_type").alias("predicate"), first("target", "object", "tail", "canonical2", "entity2").alias("object")
    )
    return r.dropna()


def render(rows: Iterator) -> str:
    """Result rows as numbered lines."""
    return "\n".join(f"{i}. [{r['boosted']:.4f}] {r['text']}" for i, r in enumerate(rows, 1))


def report(found: dict) -> str:
    """What ``Engine.evidence`` found, as text: names, passages, ways between names, facts, and facts that no check has passed for names that have none."""
    fact = lambda f: f"{f['node']} {f['relation']} {f['other']}" + ("" if f["confidence"] is None else f" ({f['confidence']:.2f})")
    good, other = [f for f in found["facts"] if f["validated"]], [f for f in found["facts"] if not f["validated"]]
    lines = [f"Names: {', '.join(found['names']) or 'none'}", "Passages:", render(found["passages"]) or "none", "Paths:"]
    lines += [f"{p['path']} ({p['hops']} hops, {p['confidence']:.2f})" for p in found["paths"]] or ["none"]
    lines += ["Facts:", *([fact(f) for f in good] or ["none"])]
    if found["missing"]:
        lines.append(f"Without facts: {', '.join(found['missing'])}")
    return "\n".join([*lines, *(["Unverified:", *[fact(f) for f in other]] if other else [])])
