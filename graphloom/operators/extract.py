"""Text to rows: sentences, chunks, tagged words, mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import canonical_key, normalize_mention, sentence_around, stable_id, words


def sentence_array(text: Column) -> Column:
    """Parts between full stops and line ends, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]+"), lambda s: F.btrim(s, F.lit(" \t\r")))
    return F.filter(parts, lambda s: s != "")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per sentence, counted from 1; a null or empty text has none."""
    d = docs.select(id_col, F.posexplode(sentence_array(F.col(text_col))).alias("p", "sentence"))
    return d.select(id_col, (F.col("p") + 1).alias("sid"), "sentence")


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sid, start, text) of sentences as they stand, with their mark, so that offsets hold."""
    parts = _matches(r"[^.\n]+[.\n]*|[.\n]+", 0)(F.col(text_col))
    d = docs.select(id_col, F.posexplode(parts).alias("k", "m"))
    return d.select(id_col, (F.col("k") + 1).alias("sid"), F.col("m.start").alias("start"), F.col("m.value").alias("text"))


def chunks(docs: DataFrame, size: int = 10, overlap: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of ``size`` sentences that share ``overlap`` with the next."""
    d = docs.select(id_col, sentence_array(F.col(text_col)).alias("s")).filter(F.size("s") > 0)
    step = size - overlap
    d = d.select(id_col, "s", F.posexplode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(step))).alias("chunk", "at"))
    return d.select(id_col, "chunk", F.array_join(F.slice("s", F.col("at") + 1, size), " ").alias("text"))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word between blanks, counted from 1."""
    w = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\r\n]+"), lambda x: x != "")
    return docs.select(id_col, F.posexplode(w).alias("p", "w")).select(id_col, (F.col("p") + 1).alias("pos"), "w")


#: Features of a word's neighbours: one before, one behind, two before, two behind.
AROUND = {
    "p1": ("is_title", "is_upper", "is_company_suffix", "is_month", "is_date_indicator"),
    "n1": ("is_title", "is_upper", "is_company_suffix", "is_month", "is_legal_term"),
    "p2": ("is_title", "is_company_suffix"),
    "n2": ("is_title", "is_legal_term"),
}
#: A word each of whose runs of letters is one capital with small letters behind it.
TITLE_CASE = r"^[^\p{L}]*\p{Lu}\p{Ll}*([^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$"


def word_features(words: DataFrame, id_col: str = "sid", pos_col: str = "pos", word_col: str = "word") -> DataFrame:
    """``words`` with the features of each word (``WORD_FEATURES``) and of two neighbours on either side.

    Neighbours are rows of one ``id_col`` in the order of ``pos_col``; where there
    is none its features are null, and first and last words have bos and eos. A
    null word has null features.
    """
    w, lw = F.col(word_col), F.lower(word_col)
    letters = w.rlike(r"\p{L}")
    shape = {
        "lower": lw, "is_upper": letters & (F.upper(w) == w), "is_title": w.rlike(TITLE_CASE), "is_digit": w.rlike(r"^\d+$"), "has_hyphen": w.contains("-"), "has_digit": w.rlike(r"\d"), "has_mark": w.rlike("[.,;:]"),
        "prefix2": F.left(lw, F.lit(2)), "prefix3": F.left(lw, F.lit(3)), "suffix2": F.right(lw, F.lit(2)), "suffix3": F.right(lw, F.lit(3)), "length": F.least(F.length(w), F.lit(20)),
        "is_all_caps": letters & (F.upper(w) == w) & (F.length(w) > 1), "has_currency": w.startswith("$") | lw.isin(fixed.CURRENCY), "is_section": lw.isin(fixed.SECTIONS),
    }
    own = words.select("*", *[c.alias(k) for k, c in shape.items()], *[lw.isin(v).alias(k) for k, v in fixed.GAZETTEERS.items()])
    win = Window.partitionBy(id_col).orderBy(pos_col)
    out = []
    for side, names in AROUND.items():
        near = F.lag if side[0] == "p" else F.lead
        seen = near(F.struct("lower", *names), int(side[1])).over(win)
        out += [seen["lower"].alias(side), *[seen[n].alias(f"{side}_{n}") for n in names]]
    ends = [F.lag(F.lit(True), 1, False).over(win).alias("bos"), F.lead(F.lit(True), 1, False).over(win).alias("eos")]
    return own.select("*", *out, *[(~c).alias(k) for c, k in zip(ends, ("bos", "eos"), strict=True)])


WORD_FEATURES = [
    "lower", "is_upper", "is_title", "is_digit", "has_hyphen", "has_digit", "has_mark", "prefix2", "prefix3", "suffix2", "suffix3", "length", "is_all_caps", "has_currency", "is_section", *fixed.GAZETTEERS,
    *[x for side, names in AROUND.items() for x in (side, *[f"{side}_{n}" for n in names])], "bos", "eos",
]


def token_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word_features`` of each word between blanks."""
    return word_features(tokens(docs, id_col, text_col), id_col, "pos", "w")


def label_samples_with_text(docs: DataFrame, most: int = 20, batch: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first ``most`` sentences of 5 to 30 words with a capital, in batches; null and empty texts have none."""
    s = sentences(docs, id_col, text_col)
    s = s.filter(F.size(words(F.col("sentence"))).between(5, 30) & F.col("sentence").rlike(r"\p{Lu}"))
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy(id_col).orderBy("sid"))).filter(F.col("rn") <= most)
    return s.select(id_col, "sid", "rn", F.floor((F.col("rn") - 1) / batch).cast("int").alias("batch"), "sentence")


def label_samples(docs: DataFrame, most: int = 20, batch: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``label_samples_with_text`` without the texts."""
    return label_samples_with_text(docs, most, batch, id_col, text_col).drop("sentence")


def bio_decode(tagged: DataFrame) -> DataFrame:
    """(sid, start, label, text) from rows (sid, pos, word, tag): runs that begin with B-."""
    win = Window.partitionBy("sid").orderBy("pos")
    run = F.sum(F.when(F.col("tag").startswith("I-"), 0).otherwise(1)).over(win)
    g = tagged.withColumn("run", run).groupBy("sid", "run")
    e = g.agg(F.min("pos").alias("start"), F.min_by("tag", "pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return e.filter(F.col("first").startswith("B-")).select("sid", "start", F.expr("substring(first, 3)").alias("label"), F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def bio_encode(lines: DataFrame, spans: DataFrame, overlap: bool = False) -> DataFrame:
    """(sid, pos, word, tag) from lines (sid, t) and spans (sid, a, b, label); the first span that fits wins."""
    parts = F.split("t", " ")
    w = lines.filter("t <> ''").select("sid", F.posexplode(parts).alias("i", "word"))
    before = Window.partitionBy("sid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("int")
    w = w.select("sid", (F.col("i") + 1).alias("pos"), "word", start.alias("ws"))
    end = F.col("ws") + F.length("word")
    fits = (F.col("ws") < F.col("b")) & (end > F.col("a")) if overlap else (F.col("ws") >= F.col("a")) & (end <= F.col("b"))
    j = w.join(spans.withColumnRenamed("sid", "_sid"), (F.col("sid") == F.col("_sid")) & fits, "left")
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("sid", "pos").orderBy("a")))
    j = j.withColumn("nth", F.row_number().over(Window.partitionBy("sid", "a").orderBy("pos")))
    tag = F.when(F.col("label").isNull(), "O").when(F.col("nth") == 1, F.concat(F.lit("B-"), "label")).otherwise(F.concat(F.lit("I-"), "label"))
    return j.filter("k = 1").select("sid", "pos", "word", tag.alias("tag"))


def words_to_spans(labelled: DataFrame) -> DataFrame:
    """(sid, start, end, label, text) from (sid, sentence, labels array<struct<word,label>>).

    Each word is looked for behind the one before; words that are not found,
    and items without a word or label, are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sentences, labels = (batch.column(batch.schema.get_field_index(c)) for c in ("sid", "sentence", "labels"))
            out: list[tuple] = []
            for i in range(batch.num_rows):  # one sentence's words are Python objects at a time
                sentence, own = sentences[i].as_py(), labels[i].values
                at, spans, live = 0, [], None
                items = {} if own is None else {f.name: c.to_pylist() for f, c in zip(own.type, own.flatten(), strict=True)}
                for word, tag in zip(items.get("word", ()), items.get("label", ()), strict=True):
                    k = sentence.find(word, at) if sentence and word else -1
                    if k < 0 or not tag:
                        continue
                    at = k + len(word)
                    if tag.startswith("B-"):
                        live = [k, at, tag[2:]]
                        spans.append(live)
                    elif tag.startswith("I-") and live:
                        live[1] = at
                    else:
                        live = None
                sid = sids[i].as_py()
                out += [(sid, *x, sentence[x[0] : x[1]]) for x in spans]
                if len(out) >= SPANS:
                    yield _span_rows(out)
                    out = []
            if out:
                yield _span_rows(out)

    return labelled.mapInArrow(run, "sid long, start int, end int, label string, text string")


#: Spans in a batch on its way back to Spark.
SPANS = 10_000


def _span_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sid", "start", "end", "label", "text"])


def _matches(pattern: str, group: int):
    """Offsets of all matches, which Spark's own functions do not give."""

    @F.pandas_udf("array<struct<value:string,start:int,end:int>>")
    def find(column: pd.Series) -> pd.Series:
        import re

        p = re.compile(pattern)
        return pd.Series([[{"value": m.group(group), "start": m.start(group), "end": m.end(group)} for m in p.finditer(t)] if t else [] for t in column])

    return find


def _places(text: Column, names: Column) -> Column:
    """Where each of a text's names stands in it, without overlaps of one name."""

    @F.pandas_udf("array<struct<name:string,label:string,start:int>>")
    def find(texts: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for t, few in zip(texts, own, strict=True):
            found = []
            for x in few:
                low = x["name"].lower()
                at = t.find(low)
                while at >= 0:
                    found.append({"name": x["name"], "label": x["label"], "start": at})
                    at = t.find(low, at + len(low))
            out.append(found)
        return pd.Series(out)

    return find(text, names)


def _labelled(label: str):
    return lambda m: F.struct(F.lit(label).alias("label"), m.alias("m"))


def mentions(docs: DataFrame, most_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mention_id, label, text, start, end, sentence) by patterns.

    The document's name gives a CONTRACT; dates, organisations, contract titles
    and jurisdictions are found in the whole text, or in its first
    ``most_chars`` characters, equal ones at one place once.
    """
    head = F.coalesce(F.col(text_col), F.lit(""))
    head = head if most_chars is None else F.substring(head, 1, most_chars)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), head.alias("head"))
    kinds = (
        ("EFFECTIVE_DATE", fixed.LONG_DATE, 0),
        ("PARTY", fixed.ORGANISATION, 0),
        ("CONTRACT", fixed.CONTRACT_HINT, 1),
        ("JURISDICTION", fixed.JURISDICTION_HINT, 1),
    )
    # one scan of the texts, which go no further than the sentence of each match
    every = F.concat(*[F.transform(_matches(pattern, group)("head"), _labelled(label)) for label, pattern, group in kinds])
    found = d.select("doc_id", "t", F.explode(every).alias("x")).select("doc_id", "t", "x.label", F.col("x.m.value").alias("value"), "x.m.start", "x.m.end")
    found = found.select("doc_id", "label", normalize_mention(F.col("value"), dashes=True).alias("text"), "start", "end", sentence_around(F.col("t"), F.col("start"), F.col("end")).alias("sentence"))
    text, label = F.col("text"), F.col("label")
    key = canonical_key(text, label)
    place = canonical_key(text).isin(fixed.US_STATES) | (F.size(words(text)) <= 4)
    keep = F.when(label == "JURISDICTION", place).when(label == "PARTY", ~text.rlike(fixed.MODAL) & (F.length(text) >= 3)).otherwise(F.length(text) >= 3)
    found = found.filter(keep).withColumn("key", key).dropDuplicates(["doc_id", "label", "key", "start"])
    found = found.drop("key")
    name = normalize_mention(F.replace(F.col("doc_id").cast("string"), F.lit("_"), F.lit(" ")), dashes=True)
    title = d.select("doc_id", name.alias("sentence"), F.regexp_extract(name, fixed.TITLE, 1).alias("text")).filter("text <> ''")
    title = title.select("doc_id", F.lit("CONTRACT").alias("label"), "text", F.lit(0).alias("start"), F.lit(0).alias("end"), "sentence")
    out = title.unionByName(found)
    return out.withColumn("mention_id", stable_id("m", F.col("doc_id"), text, label, F.col("start")))


def occurrences(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_only: bool = False) -> DataFrame:
    """(doc_id, name, label, start, end) of names (doc_id, name, label) in their documents, without regard to case.

    Every occurrence counts; ``first_only`` keeps the first of each. Null texts and names have none.
    """
    own = names.filter("name <> ''").groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("name", "label"))).alias("names"))
    d = docs.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).join(own, id_col)  # each text moves once
    found = _places(F.col("t"), F.col("names"))
    d = d.select(id_col, F.explode(found).alias("x")).select(id_col, "x.*")
    if first_only:
        d = d.groupBy(id_col, "name", "label").agg(F.min("start").alias("start"))
    return d.select(id_col, "name", "label", "start", (F.col("start") + F.length("name")).alias("end"))
