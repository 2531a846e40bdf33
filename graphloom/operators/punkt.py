"""Sentences by what the corpus itself shows about its full stops.

Words that hardly ever come without a full stop are abbreviations: each type's
counts with and without one give a log-likelihood ratio, weighed by its length,
by the stops inside it and by how often it comes without. Words that begin a
sentence far more often than chance are starters. Both are counted in Spark and
joined to the possible ends of sentences; a text is cut by plain expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# Fixed values.
ABBREVIATION, STARTER = 0.3, 30.0
STOP_SHARE = 0.99
# End of the fixed values.
#: Where a sentence may end: a mark, up to three closing signs, and blank space behind them.
CUT = r"(?<=[.!?][\"')\]]{0,3})(?=\s)"
_OPENING, _CLOSING = r"^[\"'(\[{]+", r"[\"')\]},;:!?]+$"


def bare(token: Column) -> Column:
    """A word without the signs around it, in lower case; a full stop at its end stays, and numbers are all one."""
    w = F.lower(F.regexp_replace(F.regexp_replace(token, _OPENING, ""), _CLOSING, ""))
    return F.when(w.rlike(r"^-?[.,]?\d[\d,.-]*\.$"), "##number##.").when(w.rlike(r"^-?[.,]?\d[\d,.-]*$"), "##number##").otherwise(w)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def type_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n, stopped): how often each word comes, and with a full stop behind it."""
    w = docs.select(F.explode(F.transform(_words(F.col(text_col)), bare)).alias("w")).filter(F.col("w").rlike(r"[^.]"))
    stop = F.col("w").endswith(".")
    return w.groupBy(F.when(stop, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")).alias("type")).agg(F.count("*").alias("n"), F.count_if(stop).alias("stopped"))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, score) of the types that score ``ABBREVIATION`` or more; of empty counts none."""
    total = counts.agg(F.sum("n").cast("double").alias("all_n"), F.sum("stopped").cast("double").alias("all_stopped"))
    t = counts.filter((F.col("stopped") > 0) & F.col("type").rlike(r"\p{L}")).crossJoin(F.broadcast(total))  # one row
    n, k, p = F.col("n"), F.col("stopped"), F.col("all_stopped") / F.col("all_n")
    by_chance = k * _log(p) + (n - k) * _log(1 - p)
    as_rule = k * F.log(F.lit(STOP_SHARE)) + (n - k) * F.log(F.lit(1 - STOP_SHARE))
    inside = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inside
    score = -2 * (by_chance - as_rule) * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -(n - k))
    return t.select("type", score.alias("score")).filter(F.col("score") >= ABBREVIATION)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, piece, last, next): texts cut wherever a sentence may end, with the words on both sides of each cut."""
    d = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), CUT)).alias("i", "piece"))
    w = _words(F.col("piece"))
    d = d.select(id_col, "i", "piece", bare(F.get(w, F.size(w) - 1)).alias("last"), F.get(w, F.lit(0)).alias("first"))
    return d.select(id_col, "i", "piece", "last", F.lead("first").over(Window.partitionBy(id_col).orderBy("i")).alias("next"))


def starters(parts: DataFrame, counts: DataFrame, short: DataFrame) -> DataFrame:
    """(type, score) of words that stand behind a sure end of a sentence far more often than elsewhere.

    An end is sure where the word before it is no abbreviation, initial or
    number. The score is a log-likelihood ratio of at least ``STARTER``.
    """
    ends = parts.filter(F.col("next").isNotNull()).withColumn("type", F.regexp_replace("last", r"\.$", "")).join(short.select("type"), "type", "left_anti")
    ends = ends.filter(~F.col("type").rlike(r"^(\p{L}|##number##)$"))
    seen = ends.select(F.regexp_replace(bare(F.col("next")), r"\.$", "").alias("type")).groupBy("type").agg(F.count("*").alias("first"))
    total = counts.agg(F.sum("n").cast("double").alias("all_n")).crossJoin(ends.agg(F.count("*").cast("double").alias("ends")))  # one row
    t = seen.join(counts, "type").crossJoin(F.broadcast(total)).filter(F.col("type").rlike(r"^\p{L}+$"))
    a, b, ab, n = F.col("ends"), F.col("n").cast("double"), F.col("first").cast("double"), F.col("all_n")
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)

    def likelihood(k: Column, m: Column, q: Column) -> Column:
        return k * _log(q) + (m - k) * _log(1 - q)

    score = -2 * (likelihood(ab, a, p) + likelihood(b - ab, n - a, p) - likelihood(ab, a, p1) - likelihood(b - ab, n - a, p2))
    return t.select("type", F.when((n > a) & (p1 > p), score).otherwise(0.0).alias("score")).filter(F.col("score") >= STARTER)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(abbreviations, starters) of a corpus, as written tables."""
    counts = materialise(type_counts(docs, text_col), "types")
    short = materialise(abbreviations(counts), "abbreviations")
    return short, materialise(starters(pieces(docs, id_col, text_col), counts, short), "starters")


def sentences(docs: DataFrame, short: DataFrame, first: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sid, sentence): the texts' sentences, counted from 1, without the blank space around them.

    A text may end a sentence behind each mark. It does not where the word before the full
    stop is an abbreviation or an initial, unless a capital starter follows,
    nor behind a number's full stop that a small letter follows. Every row of
    ``docs`` is a text of its own; ids should be unique. Null, empty and blank texts have no
    sentence.
    """
    p = pieces(docs, id_col, text_col)
    type_ = F.regexp_replace("last", r"\.$", "")
    p = p.withColumn("type", F.when(F.col("last").endswith("."), type_)).withColumn("start", F.regexp_replace(bare(F.col("next")), r"\.$", ""))
    p = p.join(short.select("type", F.lit(True).alias("short")), "type", "left").join(first.select(F.col("type").alias("start"), F.lit(True).alias("starts")), "start", "left")
    held = F.coalesce(F.col("short"), F.lit(False)) | F.col("type").rlike(r"^\p{L}$")
    capital = F.regexp_replace("next", _OPENING, "").rlike(r"^\p{Lu}")
    goes_on = (held & ~(capital & F.coalesce(F.col("starts"), F.lit(False)))) | ((F.col("type") == "##number##") & F.regexp_replace("next", _OPENING, "").rlike(r"^\p{Ll}"))
    p = p.withColumn("ends", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    of = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("k", F.coalesce(F.sum("ends").over(of), F.lit(0)))
    s = p.groupBy(id_col, "k").agg(F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("x"))
    s = s.select(id_col, "k", F.regexp_replace(F.array_join(F.transform("x", lambda r: r["piece"]), ""), r"^\s+|\s+$", "").alias("sentence")).filter("sentence <> ''")
    return s.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("k")).alias("sid"), "sentence")
