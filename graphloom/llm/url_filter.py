"""URL filter: rules first, else naive Bayes over words that a unigram Viterbi finds in names."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, narrow

#: Rules: (host and path, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: Words of names that are to be blocked. They label the URLs that naive Bayes
#: learns from: one with such a word is an example to block, any other to allow.
SEED_WORDS = (
    "adult ads bet bets betting cam cams casino cheap escort free gambling hack keygen loan lottery malware "
    "nude payday phishing pill pills poker porn scam sex slots spam torrent track viagra virus warez win xxx"
).split()
#: Seeds that are common words: they label a URL only beside another seed.
WEAK_SEEDS = ("cheap", "free", "track", "win")

#: Letters of the longest word that segmentation looks for, and letters of a name whose words are listed at once.
MAX_WORD, LETTERS = 24, 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is this one or above it and whose path starts this one; null if none."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


@dataclass
class Segmenter:
    """Splits a name into the words of the likeliest sequence."""

    log_p: dict[str, float]
    unknown: float
    memo: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def of(counts: dict[str, int], total: int | None = None) -> Segmenter:
        """``total`` is that of all words, where ``counts`` has some of them."""
        total = total or sum(counts.values()) or 1
        return Segmenter({w: math.log(n / total) for w, n in counts.items()}, math.log(0.1 / total))

    def __call__(self, name: str) -> list[str]:
        """Viterbi over ends of words; an unknown stretch costs more for each letter."""
        if (known := self.memo.get(name)) is not None:
            return known
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - MAX_WORD), end):
                length = end - start
                p = best[start] + self.log_p.get(name[start:end], self.unknown - 2.5 * length)
                if p > best[end]:
                    best[end], back[end] = p, start
        out, end = [], n
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        out.reverse()
        if len(self.memo) < 200_000:
            self.memo[name] = out
        return out


_PARTS = re.compile(r"[^\W\d_]+")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of letters of hosts and paths, each with its mark."""
    for batch in batches:
        k, mark, part = [], [], []
        for key, host, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for m, text in (("h:", host), ("p:", path.lower())):
                for name in _PARTS.findall(text):
                    k.append(key)
                    mark.append(m)
                    part.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(mark, pa.string()), pa.array(part, pa.string())], names=["k", "mark", "part"])


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What may be a word of each name, ``LETTERS`` places at a time; a long name may give one more than once."""
    for batch in batches:
        for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k in range(0, len(name), LETTERS):
                w = sorted({name[i:j] for i in range(k, min(len(name), k + LETTERS)) for j in range(i + 1, min(len(name), i + MAX_WORD) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(w), pa.int64()), pa.array(w, pa.string())], names=["i", "w"])


def _segmented(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(Segmenter.of({x["w"]: x["n"] for x in known or []}, total)(name))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["part", "words"])

    return run


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(w, n) of every word of all texts; seed words at least twice."""
    w = texts.select(F.explode(F.regexp_extract_all(F.lower(F.regexp_replace(F.col(column), "<[^>]*>", " ")), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    counts = w.groupBy("w").agg(F.count("*").alias("n"))
    seeds = texts.sparkSession.createDataFrame([(s, 2) for s in SEED_WORDS], "w string, n long")
    return materialise(counts.union(seeds).groupBy("w").agg(F.max("n").alias("n")), "words")


def segmented(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, words) of distinct parts, by the counts of all words that occur in them."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    numbered = materialise(parts.select("part").withColumn("i", F.monotonically_increasing_id()), "url-names")
    known = numbered.select("i", "part").mapInArrow(_substrings, "i long, w string").join(counts, "w").groupBy("i").agg(F.collect_set(F.struct("w", "n")).alias("known"))
    return numbered.join(known, "i", "left").select("part", "known").mapInArrow(_segmented(total), "part string, words array<string>")


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = 0.0) -> DataFrame:
    """A row per page: host, path, rule, verdict, score.

    The verdict is the rule's. Without a rule it is "block" where the log odds
    of naive Bayes exceed ``threshold``, else "allow". Words of all page texts
    and tokens of all URLs are counted and joined in Spark; the driver gets
    totals alone. A null url or one without ``://`` has an empty host and
    path, no score, and is allowed; repeated rows each get a row; an empty
    table gives none; other columns are not read.
    """
    d = narrow(pages, id_col, url_col, html_col)
    urls = d.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    named = urls.filter("host <> ''")
    keys = materialise(named.groupBy("host", "path").agg(F.count("*").alias("m")).withColumn("k", F.monotonically_increasing_id()), "urls")
    parts = materialise(keys.select("k", "host", "path").mapInArrow(_parts, "k long, mark string, part string"), "url-parts")
    words = materialise(segmented(parts.select("part").distinct(), word_counts(d, html_col)), "url-words")
    tokens = materialise(parts.join(words, "part").select("k", "mark", F.explode("words").alias("w")).groupBy("k", "mark", "w").agg(F.count("*").alias("c")), "url-tokens")
    found = F.collect_set(F.when(F.col("w").isin(*SEED_WORDS), F.col("w")))
    strong = F.max((F.col("w").isin(*SEED_WORDS) & ~F.col("w").isin(*WEAK_SEEDS)).cast("int"))
    labels = tokens.groupBy("k").agg(F.greatest(strong, (F.size(found) > 1).cast("int")).alias("label"))
    known = materialise(keys.select("k", "m").join(labels, "k", "left").select("k", "m", F.coalesce("label", F.lit(0)).alias("label")), "url-labels")
    n, bad = (x or 0 for x in known.agg(F.sum("m"), F.sum(F.col("m") * F.col("label"))).first())
    times = F.col("c") * F.col("m")
    counts = materialise(tokens.join(known, "k").groupBy("mark", "w").agg(F.sum(times * F.col("label")).alias("n1"), F.sum(times * (1 - F.col("label"))).alias("n0")), "url-counts")
    seen, all1, all0 = (x or 0 for x in counts.agg(F.count("*"), F.sum("n1"), F.sum("n0")).first())
    seen = max(1, seen)  # the vocabulary that add-one smoothing spreads over
    odds = F.log((F.col("n1") + 1) / F.lit(float(all1 + seen))) - F.log((F.col("n0") + 1) / F.lit(float(all0 + seen)))
    sums = tokens.join(counts.select("mark", "w", odds.alias("odds")), ["mark", "w"]).groupBy("k").agg(F.sum(F.col("c") * F.col("odds")).alias("s"))
    score = F.round(F.lit(math.log((bad + 1) / (n - bad + 1))) + F.coalesce("s", F.lit(0.0)), 9)  # sums differ by their order
    by_url = keys.join(sums, "k", "left").select("host", "path", score.alias("score"))
    scored = named.join(by_url, ["host", "path"], "left").select("_id", "host", "path", "score")
    scored = scored.union(urls.filter("host = ''").select("_id", "host", "path", F.lit(None).cast("double")))
    ruled = scored.select(F.col("_id").alias(id_col), "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("rule"), "score")
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in r])[F.col("rule")] if rules else F.lit(None).cast("string")
    return ruled.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("score") > threshold, "block").otherwise("allow")))
