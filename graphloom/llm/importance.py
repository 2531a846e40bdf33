"""Target-distribution importance resampling.

Hashed counts of word runs in all texts and in the target give each bucket a
gain; a document's weight is the mean gain of its features, and a seeded
Gumbel draw turns weights into scores, of which the highest are a sample
without replacement.

The highest scores are found by an external sort that stops early: each task
sorts its eligible rows into run files, cut at splitters into ranges of the
order of scores; a tournament tree merges the pieces of a range row by row,
over several passes where there are more pieces than ``fan``. Rows of each
range are counted before, so every tree knows the rank of its first row and
ends at the exact draw count. What lies behind is copied, unmerged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import as_bytes, groups, materialise, narrow, open_fs, release, scratch
from ._crc_sql import crc32_sql

#: Buckets of features, words of the longest run, words that a drawn document has at least.
BUCKETS, LONGEST, MIN_WORDS = 10_000, 1, 20
#: Share of eligible documents that is drawn, in per cent, and the seed.
PER_CENT, SEED = 10, 2024
#: Rows of a run that is sorted in memory; rows that a range should have; ranges at most; pieces that one tree merges.
RUN_ROWS, RANGE_ROWS, MOST_RANGES, FAN = 1_000_000, 1_000_000, 4096, 128
#: Rows that a tree reads of a piece, and gives out, at once.
BLOCK = 2048
#: Bytes of text that are split into words at once.
STEP = 1 << 20

_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def features(text: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of features) of each part of a text; runs go over the ends of parts."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + STEP)
        part, look = text[at:end].translate(_LETTERS), 256
        while end < len(text) and part[-1:] != b" ":  # up to the end of a word
            more = text[end : end + look].translate(_LETTERS)
            stop = more.find(b" ") + 1 or len(more)
            part, end, look = part + more[:stop], end + stop, look * 2
        words = part.split()
        runs = words
        if longest > 1:
            w = held + words
            new = len(held)
            runs = [b" ".join(w[i - n + 1 : i + 1]) for n in range(1, longest + 1) for i in range(max(new, n - 1), len(w))]
            held = w[-(longest - 1) :]
        yield len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets
        at = end


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket in all texts; a null text has none. Each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                for _, b in features(text, longest, buckets):
                    total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
        release()

    rows = narrow(texts, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)) with u from the hash of seed and id; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document.

    Weights are learnt from all texts of both tables. A null or empty text has
    no feature and weight 0; repeated rows each get a row. The gains that are
    broadcast are one number a bucket.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col)
    g = spark.sparkContext.broadcast(gains(bucket_counts(d, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, text in zip(ids, as_bytes(batch.column(1)), strict=True):
                words = n = total = 0
                for k, b in features(text, longest, buckets):
                    words, n, total = words + k, n + len(b), total + int(g.value[b].sum())
                weight = total // n if n else 0
                out.append((words, n, weight, weight + gumbel(i, seed)))
            numbers = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(numbers[:, k]) for k in range(4)]], names=["id", "n_words", "n_features", "weight", "score"])
        release()

    kind = d.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of losers over sources that each give (key, row) in ascending order of key."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, n = sources, len(sources)
        self.head = [next(s, None) for s in sources]
        self.lost = [-1] * n  # at each inner node the source that lost there; at 0 the winner
        for i in range(n):
            self._climb(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (a < b and not y[0] < x[0])

    def _climb(self, i: int, building: bool = False) -> None:
        node = (i + len(self.sources)) // 2
        while node:
            other = self.lost[node]
            if other < 0 and building:
                self.lost[node] = i
                return
            if self._beats(other, i):
                self.lost[node], i = i, other
            node //= 2
        self.lost[0] = i

    def __iter__(self) -> Iterator:
        while self.sources and self.head[self.lost[0]] is not None:
            i = self.lost[0]
            yield self.head[i][1]
            self.head[i] = next(self.sources[i], None)
            self._climb(i)


def _key(score: int, doc_id) -> tuple:
    """Descending scores, then ascending ids, nulls last."""
    return -score, doc_id is None, doc_id


def _batches(fs, path: str, start: int, rows: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows ``start`` to ``start + rows`` of a run file, a block at a time."""
    with fs.open_input_file(path) as f:
        file = pa.ipc.open_file(f)
        k, end = start // block, start + rows
        while start < end:
            part = file.get_batch(k).slice(start - k * block, end - start)
            yield part
            start, k = start + part.num_rows, k + 1


def _piece(folder: str, file: str, start: int, rows: int, block: int) -> Iterator[tuple]:
    fs, path = open_fs(f"{folder}/{file}")
    for batch in _batches(fs, path, start, rows, block):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield _key(row[3], row[0]), row


def _merged(folder: str, pieces: list[tuple[str, int, int]], schema: pa.Schema, block: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in Tournament([_piece(folder, *p, block) for p in pieces]):
        held.append(row)
        if len(held) == block:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _write(folder: str, table: Iterator[pa.RecordBatch], schema: pa.Schema) -> tuple[str, int]:
    """A run file under a name of its own, so that a repeated task never meets another's."""
    import uuid

    name, n = f"{uuid.uuid4().hex}.arrow", 0
    fs, path = open_fs(f"{folder}/{name}")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f, pa.ipc.new_file(f, schema) as out:
        for batch in table:
            out.write_batch(batch)
            n += batch.num_rows
    return name, n


_PIECES = "range int, file string, start long, rows long"


def _runs(folder: str, splitters: list[tuple], run_rows: int, block: int):
    """Sorted runs of a task's rows, and where each range begins in them."""

    def sort(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.take(pa.compute.sort_indices(t, [("score", "descending"), ("id", "ascending")], null_placement="at_end")).combine_chunks()
        name, _ = _write(folder, iter(t.to_batches(max_chunksize=block)), t.schema)
        score, ids = t.column("score"), t.column("id")
        keys = _Keys(score.to_numpy(), ids)
        at = [0, *[bisect_right(keys, s) for s in splitters], t.num_rows]
        rows = [(r, name, a, b - a) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["range", "file", "start", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, run_rows):
                part = batch.slice(a, run_rows)
                if n + part.num_rows > run_rows:
                    yield from sort(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from sort(held)
        release()

    return run


class _Keys:
    """Keys of sorted rows, made when they are looked at."""

    def __init__(self, score: np.ndarray, ids: pa.ChunkedArray):
        self.score, self.ids = score, ids

    def __len__(self) -> int:
        return len(self.score)

    def __getitem__(self, i: int) -> tuple:
        return _key(int(self.score[i]), self.ids[i].as_py())


def _splitters(rows: DataFrame, n: int, ranges: int) -> list[tuple]:
    """Keys that cut the order into about equal ranges, from a sample of about 32 rows a range; they decide no result."""
    if ranges < 2:
        return []
    sample = rows.select("id", "score").sample(fraction=min(1.0, 32 * ranges / n), seed=7).limit(64 * ranges).collect()
    keys = sorted(_key(r.score, r.id) for r in sample)
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def _units(pieces: DataFrame, parts: int) -> DataFrame:
    """Pieces of a unit in one task, one unit after another."""
    return pieces.repartition(parts, "unit").sortWithinPartitions("unit", "file", "start")


def _schema(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.schema)


def draw(weighed: DataFrame, min_words: int = MIN_WORDS, per_cent: int = PER_CENT, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score) with rank: 1, 2, 3... of the drawn, null for others.

    Of the N rows with ``min_words`` words or more, floor(per_cent * N / 100)
    of the highest scores are drawn, equal scores in ascending order of id;
    of rows equal in both each has a rank of its own, in no fixed order. An
    empty table, or one without eligible rows, draws none. A task holds
    ``run_rows`` narrow rows, or a block of each of ``fan`` pieces; the driver
    holds a splitter and a count for each of at most ``MOST_RANGES`` ranges.
    """
    spark = weighed.sparkSession
    weighed = materialise(weighed, "weighed")
    fits = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    eligible = weighed.filter(fits).select("id", "n_features", "weight", "score", "n_words")
    rest = weighed.filter(~fits).select("id", "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    n = eligible.count()
    wanted = per_cent * n // 100
    if not n:
        return rest
    folder = scratch(spark, "runs")
    ranges = min(MOST_RANGES, -(-n // range_rows))
    splitters = _splitters(eligible, n, ranges)
    pieces = materialise(eligible.mapInArrow(_runs(folder, splitters, run_rows, block), _PIECES), "pieces")
    first, at = {}, 0
    for r in pieces.groupBy("range").agg(F.sum("rows").alias("rows")).orderBy("range").collect():  # one row a range
        first[r["range"]], at = at, at + r["rows"]
    reached = [r for r, a in first.items() if a < wanted]
    merged = pieces.filter(F.col("range") <= max(reached, default=-1))
    schema = _schema(eligible)
    while reached:
        k = F.row_number().over(Window.partitionBy("range").orderBy("file", "start")) - 1
        grouped = merged.withColumn("g", F.floor(k / fan))
        if grouped.filter("g > 0").isEmpty():
            break
        grouped = grouped.withColumn("unit", F.concat_ws(":", "range", "g"))
        parts = max(1, min(10_000, grouped.select("unit").distinct().count()))
        merged = materialise(_units(grouped.select("unit", *merged.columns), parts).mapInArrow(_pass(folder, schema, block), _PIECES), "pieces")
    ranked = _units(merged.withColumn("unit", F.col("range").cast("string")), max(1, len(reached))).select("unit", *merged.columns).mapInArrow(_ranks(folder, schema, block, {r: first[r] for r in reached}, wanted), _ranked_schema(eligible))
    behind = pieces.filter(F.col("range") > max(reached, default=-1)).mapInArrow(_copied(folder, block), _ranked_schema(eligible))
    return rest.unionByName(ranked).unionByName(behind)


def _ranked_schema(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", rank long"


def _of_unit(t: pa.Table) -> list[tuple[str, int, int]]:
    return list(zip(*[t.column(c).to_pylist() for c in ("file", "start", "rows")], strict=True))


def _pass(folder: str, schema: pa.Schema, block: int):
    """A longer run from the pieces of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "unit"):
            name, n = _write(folder, _merged(folder, _of_unit(t), schema, block), schema)
            yield pa.RecordBatch.from_pydict({"range": pa.array([t.column("range")[0].as_py()], pa.int32()), "file": [name], "start": [0], "rows": [n]})
        release()

    return run


def _with_rank(batch: pa.RecordBatch, rank) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64())], names=[*batch.schema.names, "rank"])


def _ranks(folder: str, schema: pa.Schema, block: int, first: dict[int, int], wanted: int):
    """The rows of each range with ranks; the tree of the last range stops at the draw count, and the rest of its pieces is copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "unit"):
            pieces, at = _of_unit(t), first[t.column("range")[0].as_py()]
            used = [0] * len(pieces)

            def counted(i: int, pieces=pieces, used=used) -> Iterator[tuple]:
                for key, row in _piece(folder, *pieces[i], block):
                    yield key, (i, row)

            held, left = [], min(wanted - at, sum(p[2] for p in pieces))
            for i, row in Tournament([counted(i) for i in range(len(pieces))]):
                held.append(row)
                used[i] += 1
                left -= 1
                if len(held) == block or not left:
                    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    yield _with_rank(batch, np.arange(at + 1, at + 1 + len(held)))
                    at, held = at + len(held), []
                if not left:
                    break
            for (file, start, rows), k in zip(pieces, used, strict=True):
                fs, path = open_fs(f"{folder}/{file}")
                for batch in _batches(fs, path, start + k, rows - k, block):
                    yield _with_rank(batch, [None] * batch.num_rows)
        release()

    return run


def _copied(folder: str, block: int):
    """The rows of pieces that no draw reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, rows in _of_unit(pa.Table.from_batches([batch])):
                fs, path = open_fs(f"{folder}/{file}")
                for part in _batches(fs, path, start, rows, block):
                    yield _with_rank(part, [None] * part.num_rows)
        release()

    return run


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """Every document with n_words, n_features, weight, score and its rank in the draw, else null; see ``weigh`` and ``draw``."""
    out = draw(weigh(docs, target, id_col, text_col, longest, buckets, seed), min_words, per_cent)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def _words_sql(table: str, columns: str) -> str:
    return f"SELECT {columns}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"


SQL = f"""WITH dw AS ({_words_sql("documents", "doc_id")}), bw AS ({_words_sql("benchmark", "item_id")}),
v AS (SELECT w, {crc32_sql("w")} % {BUCKETS} AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw))),
s AS (SELECT b, count(*) AS n FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN v USING (w) GROUP BY b),
c AS (SELECT (SELECT sum(n) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + {BUCKETS}) / ((s.n + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), c),
f AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN f USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM x WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, k::BIGINT AS rank FROM x LEFT JOIN (SELECT * FROM e WHERE k <= (SELECT {PER_CENT} * count(*) // 100 FROM e)) USING (doc_id)"""
