"""Spelling variants: frequent words that are one insertion, deletion or replacement apart.

Each word gives the hash of itself and of every deletion of one letter, all
made at once in numpy from polynomial hashes of its prefixes and suffixes.
Keys are dealt out by their leading bits and sorted; words that meet at a key
are looked at as strings. Two words of one length are near if they meet after
the deletion of the same place, and a longer one is near to a shorter one
whose own key is that of a deletion. Both are counted group by group: a member
of a group of k has k - 1 near words there and the most frequent other member
as its candidate, so no pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard
from ._common import freed, materialise, narrow, slices_of_bytes
from ._crc_sql import crc32_sql

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that a word has at least; how much more frequent a form is; one run in so many loses a letter.
MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
#: Two primes below 2^31 and the bases of the polynomials; a key holds both remainders.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 999979)
#: Bytes of words whose keys are made at once, and keys that leave at once.
STEP, KEYS = 1 << 20, 1 << 17
#: Keys go by this many leading bits to their partition.
RADIX_BITS = 16


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """1, base, base^2... modulo the prime."""
    out = np.ones(max(1, n), np.uint64)
    k = 1
    while k < n:
        more = min(k, n - k)
        out[k : k + more] = out[:more] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
        k += more
    return out


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key, head) of each word itself (place -1) and of each deletion.

    A prefix hash is the sum of letter times base^place up to the place; in the
    suffix hash each power is one less, as behind the deletion. ``head`` marks the first
    letter of a run of equal ones: deleting any letter of a run gives the same
    string, so heads give each shorter string once.
    """
    codes = np.frombuffer(b"".join(words).decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([sum((b & 0xC0) != 0x80 for b in w) if not w.isascii() else len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - start[word]
    own, cut = np.zeros(len(words), np.uint64), np.zeros(len(codes), np.uint64)
    for base, prime in zip(BASES, PRIMES, strict=True):
        p, power = np.uint64(prime), _powers(base, prime, int(size.max(initial=1)))
        at = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[place] % p)])  # up to each letter
        behind = np.concatenate([[np.uint64(0)], np.cumsum(np.where(place > 0, codes * power[place - 1] % p, np.uint64(0)))])
        whole = (at[start + size] - at[start]) % p
        prefix = at[:-1] - at[start[word]]
        suffix = behind[(start + size)[word]] - behind[1:]
        own = own << np.uint64(32) | whole
        cut = cut << np.uint64(32) | (prefix + suffix) % p
    head = (place == 0) | np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)  # so that leading bits differ
    return (
        np.concatenate([np.arange(len(words)), word]), np.concatenate([np.full(len(words), -1), place]),
        np.concatenate([mix(own), mix(cut)]), np.concatenate([np.zeros(len(words), bool), head]),
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(radix, key, id, place, head) of words (id, word)."""
    for batch in batches:
        for part, _ in slices_of_bytes(batch, "word", STEP):
            ids = part.column("id").to_numpy()
            word, place, key, head = deletion_keys(part.column("word").cast(pa.binary()).to_pylist())
            for a in range(0, len(key), KEYS):
                s = slice(a, a + KEYS)
                radix = (key[s].view(np.uint64) >> np.uint64(64 - RADIX_BITS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(radix), pa.array(key[s]), pa.array(ids[word[s]]), pa.array(place[s].astype(np.int32)), pa.array(head[s])], names=["radix", "key", "id", "place", "head"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, link, id, place) of the words that meet, from rows sorted by (key, place, id).

    ``link`` is the place that both lack, or -1 where the words of place -1 are
    deletions of the others. Keys that come whole in a batch are taken together.
    """
    for rows in _whole_keys(batches):
        key, place, ids, head = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "place", "id", "head"))
        again = (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (place[1:] >= 0)
        same = np.concatenate([[False], again]) | np.concatenate([again, [False]])
        first = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(first) - 1
        has_own = (place[first] == -1)[group]
        heads = has_own & head
        own = has_own & (place == -1) & (np.bincount(group[heads], minlength=group[-1] + 1) > 0)[group]
        longer = heads | own
        pick = np.concatenate([np.flatnonzero(same), np.flatnonzero(longer)])
        link = np.concatenate([place[same], np.full(longer.sum(), -1, np.int32)])
        if len(pick):
            yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array(link, pa.int32()), pa.array(ids[pick]), pa.array(place[pick], pa.int32())], names=["key", "link", "id", "place"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a key ends."""
    held: list[pa.RecordBatch] = []
    join = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # where the last key begins
        if last or (held and held[-1].column("key")[-1].as_py() != key[-1]):
            if last:
                held.append(batch.slice(0, last))
            yield join()
            held = []
        held.append(batch.slice(last))
    if held:
        yield join()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the frequent words of whole texts.

    Words are maximal runs of letters up to U+00FF with only A to Z in lower case.
    One run in ``damage`` by the hash of its document and itself loses a letter
    that the hash picks; a run of a document without id loses none. Counts are
    combined in each task before they are shuffled.
    """
    d = narrow(docs, id_col, text_col)
    r = d.select(F.col(id_col).cast("string").alias("d"), F.explode(F.split(text_col, "[^A-Za-zÀ-ÿ]+")).alias("w")).filter(F.length("w") >= min_length)
    r = r.withColumn("w", F.translate("w", CAPITALS, SMALL))
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    r = r.select("w", F.when(h % damage == 0, h % F.length("w")).alias("at"))
    r = r.select(F.when(F.col("at").isNotNull(), without("w", F.col("at"))).otherwise(F.col("w")).alias("word"))
    return r.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def without(word: str, place: Column) -> Column:
    """The word without the code point at a place from 0."""
    at = place.cast("int")
    return F.concat(F.substring(F.col(word), F.lit(1), at), F.substring(F.col(word), at + 2, F.length(word)))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, candidate (n, word)) of the words (id, word, n) that have near words; ``words`` is a written table."""
    keys = words.select("id", "word").mapInArrow(freed(_keys), "radix int, key long, id long, place int, head boolean")
    keys = keys.repartition("radix").sortWithinPartitions("key", "place", "id")
    met = keys.select("key", "place", "id", "head").mapInArrow(freed(_meetings), "key long, link int, id long, place int")
    m = met.join(words, "id").withColumn("rest", F.when(F.col("place") < 0, F.col("word")).otherwise(without("word", F.col("place"))))
    # within a group the word that the others are deletions to comes first, then the most frequent
    group = Window.partitionBy("key", "link", "rest")
    order = group.orderBy((F.col("place") >= 0).cast("int"), F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    m = m.select("id", "link", "place", F.count("*").over(group).alias("k"), F.row_number().over(order).alias("at"), F.first(entry).over(whole).alias("top"), F.nth_value(entry, 2).over(whole).alias("next"), F.min("place").over(group).alias("least"))
    m = m.filter((F.col("k") > 1) & ((F.col("link") >= 0) | (F.col("least") < 0)))
    beside = F.when((F.col("link") >= 0) | (F.col("at") == 1), F.col("k") - 1).otherwise(1)
    best = F.when(F.col("at") == 1, F.col("next")).otherwise(F.col("top"))
    m = m.select("id", beside.alias("beside"), best.alias("best"))
    return m.groupBy("id").agg(F.sum("beside").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form), by following forms to the last.

    Each round joins the table to itself and so doubles the steps; a form is
    ``RATIO`` times as frequent as its word, so chains are no longer than the
    logarithm of the largest count and rounds few.
    """
    t = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = t.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(t.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(t)
        t = step
        if t.filter("moved").isEmpty():
            return t.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = DAMAGE) -> DataFrame:
    """A row for each frequent word: n, n_near, form with its count, root.

    The form is the near word of largest count (the first in code-point order
    of equal ones) if that is ``ratio`` times the word's at least. Null and
    empty texts have no words, an empty table no rows, and repeated rows count
    as often as they come. A text is taken whole; a word of any length takes
    part, and 80 bytes for each of its letters while its keys are made.
    """
    counts = word_counts(docs, id_col, text_col, min_length, min_count, damage)
    words = materialise(counts.withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words)
    fits = -F.col("best.less") >= ratio * F.col("n")
    judged = words.join(near, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
    )
    judged = materialise(judged, "judged")
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_RUNS = f"SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{CAPITALS}', '{SMALL}') AS w FROM documents"

SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, w, count(*) AS k FROM ({_RUNS}) WHERE length(w) >= {MIN_LENGTH} GROUP BY doc_id, w),
h AS (SELECT w, k, {crc32_sql("(doc_id || ':' || w)")} AS h FROM r),
c AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM c WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
x AS (SELECT word, n, unnest(range(length(word))) AS i FROM w), y AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM x),
p AS (SELECT a.word AS u, b.word AS v FROM y a JOIN y b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
UNION SELECT y.word, w.word FROM y JOIN w ON w.word = y.rest UNION SELECT w.word, y.word FROM y JOIN w ON w.word = y.rest),
q AS (SELECT u, v, n, row_number() OVER (PARTITION BY u ORDER BY n DESC, encode(v)) AS k, count(*) OVER (PARTITION BY u) AS n_near FROM p JOIN w ON w.word = v),
f AS (SELECT w.word, w.n, coalesce(q.n_near, 0)::BIGINT AS n_near, CASE WHEN q.n >= {RATIO} * w.n THEN v END AS form, CASE WHEN q.n >= {RATIO} * w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON q.u = w.word AND q.k = 1),
t AS (SELECT word, word AS at, form AS nxt FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.nxt)
SELECT f.word, n, n_near, form, form_n, t.at AS root FROM f JOIN t ON t.word = f.word AND t.nxt IS NULL"""
