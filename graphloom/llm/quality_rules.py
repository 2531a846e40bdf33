"""Quality rules: one native projection compiled from a threshold table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import narrow

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on as with be by at this are from an or a "
    "le la les de des et en un une du que qui dans pour par sur au pas "
    "der die das und von zu mit sich auf für ist im dem nicht ein eine als den "
    "el y los se del las con una para es al lo como su"
).split()

#: A word also counts as a stop word with a capital or one of these behind it.
TRAILING = ("", ".", ",", ";", ":")

#: (rule, numerator, denominator, "most" or "least", per cent, from this many words on).
#: A text fails a rule where 100 x numerator is beyond per cent x denominator.
THRESHOLDS = (
    ("word_length_low", "word_chars", "n_words", "least", 250, 20),
    ("word_length_high", "word_chars", "n_words", "most", 1200, 20),
    ("symbols", "n_symbols", "n_words", "most", 10, 20),
    ("stop_words", "n_stop_words", "n_words", "least", 10, 50),
    ("dup_lines", "n_dup_lines", "n_lines", "most", 30, 20),
)

MIN_WORDS, MAX_REPEAT_PER_CENT, WINDOW = 20, 30, 8


def stop_forms(words=STOP_WORDS) -> list[str]:
    """Each word in lower case and with a capital, with each trailing mark."""
    return sorted({f + mark for w in words for f in (w, w[:1].upper() + w[1:]) for mark in TRAILING})


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once although lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _once(value: Column) -> Column:
    """``value``, marked so that the optimizer does not copy it into filters and lambdas above."""
    return F.when(F.monotonically_increasing_id() < 0, None).otherwise(value)


def _repeat_words(words: Column, hashes: Column, window: int) -> Column:
    """Words covered by windows whose hash comes twice or more.

    Windows are sorted by (hash, position); one beside an equal hash is
    repeated. Sorted positions then add min(window, distance to the last one).
    """
    entries = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        return F.filter(
            s,
            lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == e["h"])),
        )

    positions = F.array_sort(F.transform(_let(entries, repeated), lambda e: e["i"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        positions,
        start,
        lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(window), i - a["last"])).alias("total")),
        lambda a: a["total"],
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS, keep_text: bool = False) -> DataFrame:
    """Counts, base verdict and rule verdict of every whole text.

    One narrow projection: no shuffle, no user function. Windows are told
    apart by a 64-bit hash of their words within one text. Ratios are compared
    as integers, so no rounding decides. A null or empty text has no words and
    fails the base; repeated rows each get a row; an empty table gives none;
    other columns are not read. ``failed`` lists the rules that a text breaks.
    """
    d = narrow(docs, id_col, text_col)
    d = d.select(F.col(id_col), F.col(text_col).alias("_t"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.select(
        "*",
        _once(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    n = F.size("_words")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
    )
    d = d.select("*", _once(hashes).alias("_hashes"))
    repeats = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeat_words(F.col("_words"), F.col("_hashes"), WINDOW))
    d = d.select(
        id_col,
        "_t",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _once(F.coalesce(repeats, F.lit(0)).cast("long")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(stop_forms()))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PER_CENT * F.col("n_words"))
    fails = [
        F.when(
            (F.col("n_words") >= least) & ((100 * F.col(a) > cent * F.col(b)) if way == "most" else (100 * F.col(a) < cent * F.col(b))),
            F.lit(name),
        )
        for name, a, b, way, cent, least in thresholds
    ]
    d = d.select("*", base.alias("base_failed"), F.array_compact(F.array(*fails)).alias("failed"))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return d.withColumnRenamed("_t", text_col) if keep_text else d.drop("_t")


def sql(thresholds=THRESHOLDS) -> str:
    """The same in DuckDB SQL over the view ``documents``."""
    stop = ", ".join("'" + w + "'" for w in stop_forms())
    rules = " AND ".join(
        f"NOT (n_words >= {least} AND 100 * {a} {'>' if way == 'most' else '<'} {cent} * {b})" for _, a, b, way, cent, least in thresholds
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS s
        FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, i - prev))::BIGINT AS n
        FROM (SELECT r, i, lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i) AS prev FROM rep) GROUP BY r),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PER_CENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed,
       NOT base_failed AND {rules} AS kept FROM b"""
