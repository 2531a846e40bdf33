"""A linear-chain conditional random field over tagged words.

Sentences are rows of hashed features. Each step of the fit broadcasts the
weights, lets every task run forward and backward over its sentences, adds the
gradients up in Spark and moves the weights on the driver, which never holds
more than they. The search is L-BFGS with an orthant-wise step for the absolute
part of the penalty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Buckets that feature names are hashed into.
BUCKETS = 1 << 15
# Fixed values.
L1, L2, ITERATIONS = 0.05, 0.05, 300
# End of the fixed values.
#: Words that are worked on at once, and numbers in a row of a gradient on its way.
WORDS, BLOCK = 20_000, 1 << 15


def hashed(features: DataFrame, names: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``features`` with x, the buckets of a word's features: name=value, of flags the name where true, nothing for nulls."""
    kinds = dict(features.dtypes)
    parts = [F.when(F.col(n), F.lit(n)) if kinds[n] == "boolean" else F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names]
    present = F.filter(F.array(*parts, F.lit("bias")), lambda x: x.isNotNull())
    return features.withColumn("x", F.array_distinct(F.transform(present, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))))


def sentences(words: DataFrame, tags: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """(sid, x, k, y) from rows (sid, pos, x, tag): the buckets of all words, how many each has, and their tags by number.

    A sentence is one row; a tag that is not among ``tags`` counts as the first one.
    Columns of words named in ``also`` become arrays of the sentence.
    """
    number = F.coalesce(F.array_position(F.array(*map(F.lit, tags)), F.col("tag")) - 1, F.lit(0))
    w = words.select("sid", "pos", "x", F.greatest(number, F.lit(0)).cast("int").alias("y"), *also)
    s = w.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", *also))).alias("w"))
    return s.select("sid", F.flatten("w.x").alias("x"), F.transform("w", lambda r: F.size(r["x"])).alias("k"), F.col("w.y").alias("y"), *[F.col(f"w.{c}").alias(c) for c in also])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def chains(emission: np.ndarray, jumps: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the sum over all taggings, probability of each tag at each word, expected jumps) of padded sentences.

    Sums go forward and back as products scaled to 1 at each word; where weights
    lie so far apart that these vanish, as logarithms.
    """
    n, steps, k = emission.shape
    live = np.arange(steps)[:, None] < length
    e = np.ascontiguousarray(emission.transpose(1, 0, 2))
    top, high = e.max(axis=2), jumps.max()
    e, by = np.exp(e - top[:, :, None]), np.exp(jumps - high)
    ahead, scale, share = np.empty_like(e), np.ones((steps, n)), np.empty_like(e)
    new, behind, expected = e[0], np.ones((n, k)), np.zeros((k, k))
    with np.errstate(all="ignore"):
        for t in range(steps):
            new = np.where(live[t, :, None], (new @ by) * e[t], new) if t else new
            scale[t] = new.sum(axis=1)
            new = ahead[t] = new / scale[t][:, None]
        share[-1] = ahead[-1]
        for t in range(steps - 2, -1, -1):
            out = np.where(live[t + 1, :, None], e[t + 1] * behind / scale[t + 1][:, None], 0.0)
            expected += ahead[t].T @ out
            behind = np.where(live[t + 1, :, None], out @ by.T, 1.0)
            share[t] = ahead[t] * behind
        total = ((np.log(scale) + top) * live).sum(axis=0) + (length - 1) * high
    if not (scale.min() > 1e-200 and np.isfinite(share).all() and np.isfinite(expected).all()):
        return _chains_in_logs(emission, jumps, length)
    return total, (share * live[:, :, None]).transpose(1, 0, 2), expected * by


def _chains_in_logs(emission: np.ndarray, jumps: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, steps, k = emission.shape
    live = np.arange(steps) < length[:, None]
    ahead = np.empty_like(emission)
    ahead[:, 0] = emission[:, 0]
    for t in range(1, steps):
        new = emission[:, t] + _log_sum(ahead[:, t - 1, :, None] + jumps, 1)
        ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
    total = _log_sum(ahead[:, -1], 1)
    behind, expected = np.zeros((n, k)), np.zeros((k, k))
    share = np.zeros_like(emission)
    share[:, -1] = np.exp(ahead[:, -1] - total[:, None])
    for t in range(steps - 2, -1, -1):
        on = live[:, t + 1]
        out = emission[:, t + 1] + behind
        pair = np.exp(ahead[:, t, :, None] + jumps + out[:, None, :] - total[:, None, None])
        expected += pair[on].sum(axis=0)
        behind = np.where(on[:, None], _log_sum(jumps + out[:, None, :], 2), behind)
        share[:, t] = np.exp(ahead[:, t] + behind - total[:, None])
    return total, share * live[:, :, None], expected


@dataclass
class Field:
    """Weights of (bucket, tag) and of (tag, next tag)."""

    tags: list[str]
    weights: np.ndarray
    jumps: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, tags: list[str], buckets: int) -> Field:
        k = len(tags)
        return Field(tags, flat[: buckets * k].reshape(buckets, k), flat[buckets * k :].reshape(k, k))

    def emission(self, x: np.ndarray, per_word: np.ndarray) -> np.ndarray:
        word = np.repeat(np.arange(len(per_word)), per_word)
        return np.stack([np.bincount(word, w[x], len(per_word)) for w in np.ascontiguousarray(self.weights.T)], 1)

    def _padded(self, x: np.ndarray, per_word: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all words, and padded ones with a row for each sentence."""
        flat = self.emission(x, per_word)
        out = np.zeros((len(length), int(length.max()), len(self.tags)))
        out[np.arange(out.shape[1]) < length[:, None]] = flat
        return flat, out

    def gradient(self, x: np.ndarray, per_word: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log likelihood of sentences, and its gradient by all weights."""
        k = len(self.tags)
        flat, padded = self._padded(x, per_word, length)
        total, share, expected = chains(padded, self.jumps, length)
        live = np.arange(padded.shape[1]) < length[:, None]
        right = flat[np.arange(len(y)), y].sum()
        last = np.zeros(len(y), bool)
        last[np.cumsum(length) - 1] = True
        a, b = y[:-1][~last[:-1]], y[1:][~last[:-1]]
        off = share[live]
        off[np.arange(len(y)), y] -= 1
        word = np.repeat(np.arange(len(per_word)), per_word)
        by_weight = np.stack([np.bincount(x, o[word], len(self.weights)) for o in np.ascontiguousarray(off.T)], 1)
        seen = np.bincount(a * k + b, minlength=k * k).reshape(k, k)
        return float(total.sum() - right - self.jumps[a, b].sum()), np.concatenate([by_weight.ravel(), (expected - seen).ravel()])

    def best(self, x: np.ndarray, per_word: np.ndarray, length: np.ndarray | None = None) -> list[int]:
        """The likeliest tags of one sentence, or of all the words of several of these lengths."""
        length = np.array([len(per_word)]) if length is None else length
        _, e = self._padded(x, per_word, length)
        n, steps, k = e.shape
        score, back, rows = e[:, 0], np.empty((steps, n, k), np.int16), np.arange(n)
        for t in range(1, steps):
            way = score[:, :, None] + self.jumps
            back[t] = way.argmax(axis=1)
            score = np.where((t < length)[:, None], way.max(axis=1) + e[:, t], score)
        out = np.empty((n, steps), np.int64)
        last = score.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            out[:, t] = last
            last = np.where(t < length, back[t, rows, last], last) if t else last
        return out[np.arange(steps) < length[:, None]].tolist()


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(rows, (x, buckets of each word, y, words of each sentence)), sentences of like length together."""
    size = batch.column("y").value_lengths().to_numpy(zero_copy_only=False)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    ends, first = [], 0
    for i, n in enumerate(size[order].tolist()):
        if i > first and (i - first + 1) * n > WORDS:
            ends.append(i)
            first = i
    for rows in np.split(order, ends) if len(order) else ():
        few = batch.take(pa.array(rows))
        yield rows, (*(few.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "k", "y")), size[rows].astype(np.int64))


def loss_and_gradient(rows: DataFrame, flat: np.ndarray, tags: list[str], buckets: int) -> tuple[float, np.ndarray]:
    """Both over all sentences: a partial gradient from each task, added up in Spark by blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        field, loss, total = Field.of(shared.value, tags, buckets), 0.0, np.zeros(len(shared.value))
        for batch in batches:
            for _, part in _parts(batch):
                own, g = field.gradient(*part)
                loss, total = loss + own, total + g
        n = TaskContext.get().partitionId()
        for a in range(0, len(total), BLOCK):
            yield pa.RecordBatch.from_pydict({"block": pa.array([a], pa.int64()), "task": pa.array([n], pa.int32()), "loss": [loss if a == 0 else 0.0], "g": pa.array([total[a : a + BLOCK].tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")  # so that sums are the same each time
        g = np.sum([np.frombuffer(b) for b in pdf["g"]], axis=0)
        return pd.DataFrame([(pdf["block"].iloc[0], pdf["loss"].sum(), g.tobytes())], columns=["block", "loss", "g"])

    sent = rows.mapInArrow(run, "block long, task int, loss double, g binary")
    got = sorted(sent.groupBy("block").applyInPandas(add, "block long, loss double, g binary").collect())
    shared.unpersist()
    if not got:
        return 0.0, np.zeros(len(flat))
    return sum(r.loss for r in got), np.concatenate([np.frombuffer(r.g) for r in got])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, l1: float = 0.0, l2: float = 0.0, iterations: int = 100, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """The x of least f(x) + l1 |x| + l2 x^2, by limited-memory quasi-Newton steps.

    Where l1 is positive a step stays in the orthant that its slope points to,
    and weights that would change sign become zero.
    """

    def whole(x: np.ndarray) -> tuple[float, np.ndarray]:
        v, g = f(x)
        return v + l2 * float(x @ x) + l1 * float(np.abs(x).sum()), g + 2 * l2 * x

    def slope(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not l1:
            return g
        side = np.where(x != 0, g + l1 * np.sign(x), 0.0)
        at_zero = np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))
        return np.where(x != 0, side, at_zero)

    value, g = whole(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for i in range(iterations):
        s = slope(x, g)
        if np.abs(s).max(initial=0) < tolerance * max(1.0, np.abs(x).max(initial=0)):
            break
        d, used = -s, []
        for dx, dg, rho in reversed(steps):
            a = rho * (dx @ d)
            used.append(a)
            d = d - a * dg
        if steps:
            dx, dg, _ = steps[-1]
            d = d * ((dx @ dg) / (dg @ dg))
        for (dx, dg, rho), a in zip(steps, reversed(used), strict=True):
            d = d + (a - rho * (dg @ d)) * dx
        if l1:
            d = np.where(d * s < 0, d, 0.0)
        size = 1.0 if steps else 1 / max(1.0, float(np.sqrt(s @ s)))
        while True:
            new = x + size * d
            if l1:
                new = np.where(new * np.where(x != 0, np.sign(x), -np.sign(s)) > 0, new, 0.0)
            after, g_new = whole(new)
            if after <= value + 1e-4 * float(s @ (new - x)) or size < 1e-6:
                break
            size /= 2
        if after >= value:
            break
        dx, dg = new - x, g_new - g
        if dx @ dg > 1e-12:
            steps = [*steps, (dx, dg, 1 / (dx @ dg))][-memory:]
        done = (value - after) < 1e-6 * max(1.0, abs(value))
        x, value, g = new, after, g_new
        if done:
            break
    return x


def fit(rows: DataFrame, tags: list[str], buckets: int = BUCKETS, l1: float = L1, l2: float = L2, iterations: int = ITERATIONS) -> Field:
    """A field of all ``sentences`` rows; of none its weights are zero.

    ``rows`` is read once a step, so it should be a written table.
    """
    k = len(tags)
    x = minimise(lambda w: loss_and_gradient(rows, w, tags, buckets), np.zeros(buckets * k + k * k), l1, l2, iterations)
    return Field.of(x, tags, buckets)


def tag(rows: DataFrame, field: Field) -> DataFrame:
    """(sid, pos, word, tag, predicted) of every word of ``sentences`` rows with their words and tags, counted from 1."""
    shared = rows.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Field = shared.value
        names = np.array(own.tags, object)
        for batch in batches:
            for at, (x, k, _, length) in _parts(batch):
                pos = np.arange(len(k)) - np.repeat(np.cumsum(length) - length, length) + 1
                sid = batch.column("sid").take(pa.array(np.repeat(at, length)))
                said = [batch.column(c).take(pa.array(at)).flatten() for c in ("word", "tag")]
                yield pa.RecordBatch.from_arrays([sid, pa.array(pos, pa.int32()), *said, pa.array(names[own.best(x, k, length)], pa.string())], names=["sid", "pos", "word", "tag", "predicted"])

    return rows.mapInArrow(run, f"sid {rows.schema['sid'].dataType.simpleString()}, pos int, word string, tag string, predicted string")


def tagger(words: DataFrame, names: list[str], tags: list[str], held_out: int = 5, iterations: int = ITERATIONS, buckets: int = BUCKETS, seed: int = 42, held_out_only: bool = False, tagged: DataFrame | None = None) -> DataFrame:
    """(sid, pos, word, tag, held_out, predicted) of rows (sid, pos, word, tag, features named in ``names``).

    Learns from the sentences of which any word has a tag other than the first
    of ``tags``, but for one in ``held_out`` of all sentences by hash of sid; all
    sentences are tagged, with ``held_out_only`` all of those held out.
    Positions are counted from 1 without gaps. Null words are words like others
    with few features; no rows give none. Features are made on the way, so ``words``
    should be those of a written table, dealt by sid. ``tagged`` may hold the rows of the
    sentences with such tags (others are passed over), where these are at hand.
    """
    own = F.pmod(F.xxhash64(F.lit(seed), F.col("sid")), F.lit(held_out)) == 0
    made = lambda d: hashed(d, names, buckets).select("sid", F.col("pos").cast("int").alias("pos"), "word", "tag", "x")
    tagged = words if tagged is None else tagged
    some = materialise(tagged.filter(F.col("tag").isin(tags[1:])).select("sid").distinct().filter(~own), "tagged")
    learn = sentences(made(tagged.join(some, "sid", "left_semi")), tags).select("x", "k", "y")
    learn = materialise(learn.repartition(2 * words.sparkSession.sparkContext.defaultParallelism), "sentences")
    field = fit(learn, tags, buckets, iterations=iterations)
    rows = sentences(made(words.filter(own) if held_out_only else words), tags, ("word", "tag"))
    return tag(rows, field).select("sid", "pos", "word", "tag", own.alias("held_out"), "predicted")
