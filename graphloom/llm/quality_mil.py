"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Each passage is encoded (hashed byte
trigrams and a few ratios, through one tanh layer); gated attention weighs the
encodings, and a logistic layer scores their weighted mean. All weights are
learnt together from document labels alone, in numpy.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove
from ._common import as_bytes, materialise, narrow, open_fs, scratch

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 512
BUCKETS = 1024
#: Labelled documents that are learnt from at most, each with all its passages.
TRAIN_DOCS = 3000
THRESHOLD = 0.3
#: Bytes of text that are encoded at once.
STEP = 2_000_000
#: Passages whose encodings are held at once, in scoring a long text and in learning.
SLICE = 8192
#: Windows of a long text that are sorted at once to find repeated ones.
WINDOWS = 4_000_000
_GRAM = 16

_CLASSES = np.zeros(256, np.uint8)  # 1 letters, 2 capitals, 3 digits, 4 spaces, 5 line ends, 6 other marks
_CLASSES[[*range(97, 123), *range(128, 256)]] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
_CLASSES[[9, 11, 12, 13, 32]] = 4
_CLASSES[10] = 5
_CLASSES[[x for x in range(33, 127) if not chr(x).isalnum() and x not in b".,"]] = 6
N_STATS = 11


def _windows(b: np.ndarray) -> np.ndarray:
    """A hash of each window of ``_GRAM`` bytes."""
    h = np.zeros(len(b) - _GRAM + 1, np.uint64)
    for k in range(0, _GRAM, 8):  # two words of 8 bytes, mixed
        word = sum(b[k + j : len(b) - _GRAM + 1 + k + j].astype(np.uint64) << np.uint64(8 * j) for j in range(8))
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def repeats(text: bytes) -> np.ndarray:
    """The share of each passage's windows that come again anywhere in a long text.

    Windows are sorted a part of their hashes at a time, about ``WINDOWS`` of
    them, so memory does not grow with the text; each part reads it once.
    """
    n = len(text) - _GRAM + 1
    again, parts = np.zeros(-(-len(text) // PASSAGE), np.int64), np.uint64(max(1, -(-n // WINDOWS)))
    for part in range(int(parts)):
        keys, places = [], []
        for a in range(0, max(0, n), STEP):
            h = _windows(np.frombuffer(text[a : a + STEP + _GRAM - 1], np.uint8))
            own = np.flatnonzero(h % parts == part)
            keys.append(h[own])
            places.append(((own + a) // PASSAGE).astype(np.int32))
        if keys:
            key, place = np.concatenate(keys), np.concatenate(places)
            del keys, places
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = key[1:] == key[:-1]
            hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            again += np.bincount(place[order[hit]], minlength=len(again))
    windows = np.minimum(PASSAGE, np.maximum(0, n - PASSAGE * np.arange(len(again))))
    return (again / np.maximum(1, windows)).astype(np.float32)


def long_passages(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``passages`` gives for one long text, ``SLICE`` passages at a time."""
    share = repeats(text)
    for k in range(0, len(share), SLICE):
        n = min(SLICE, len(share) - k)
        grams, stats, _ = passages([text[k * PASSAGE : (k + n) * PASSAGE + 2]])  # trigrams go over the end of a passage
        grams, stats = grams[:n], stats[:n]
        stats[:, 8], stats[:, 10] = share[k : k + n], np.log1p(len(text)) / 10
        yield grams, stats


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root trigram shares, ratios, document) of each passage; an empty text has one passage of zeros."""
    sizes = np.array([len(t) for t in texts])
    pieces = np.maximum(1, -(-sizes // PASSAGE))
    doc = np.repeat(np.arange(len(texts)), pieces)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    start = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PASSAGE
    end = np.minimum(start + PASSAGE, at[doc] + sizes[doc])
    length, n = end - start, len(doc)
    b = np.frombuffer(b"".join(texts), np.uint8)
    stats = np.zeros((n, N_STATS), np.float32)
    grams = np.zeros((n, BUCKETS), np.float32)
    if len(b):
        piece = np.repeat(np.arange(n), length)
        within = np.repeat(at[doc] + sizes[doc], length) - np.arange(len(b))  # bytes up to the text's end
        full = length > 0
        stats[:, :6] = np.bincount(piece * 7 + _CLASSES[b], minlength=7 * n).reshape(n, 7)[:, 1:] / np.maximum(1, length)[:, None]
        if len(b) > 2:
            w = b.astype(np.uint32)
            key = (w[:-2] | w[1:-1] << np.uint32(8) | w[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(22)
            ok = within[:-2] > 2
            count = np.bincount(piece[:-2][ok] * BUCKETS + key[ok], minlength=n * BUCKETS).reshape(n, BUCKETS)
            total = np.maximum(1, count.sum(axis=1))
            stats[:, 6] = (count > 0).sum(axis=1) / total
            stats[:, 7] = count.max(axis=1) / total
            grams = np.sqrt(count / total[:, None]).astype(np.float32)
        if len(b) > _GRAM:
            h = _windows(b)
            pick = np.flatnonzero(within[: len(h)] >= _GRAM)  # all windows within a text
            key = h[pick] ^ doc[piece[pick]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
            again = np.bincount(piece[pick], times[inverse] > 1, n)
            stats[:, 8] = again / np.maximum(1, np.bincount(piece[pick], minlength=n))
        stats[:, 9] = np.where(full, 1, 0)
    stats[:, 10] = np.log1p(sizes[doc]) / 10
    return grams, stats, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights: encoder (E, S, b), gated attention (V, U, w), score (c, d); mean and spread of the ratios."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    @staticmethod
    def new(stats: np.ndarray, dim: int = 24, inner: int = 12, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": draw(BUCKETS, dim) * 8, "S": draw(N_STATS, dim), "b": np.zeros(dim, np.float32), "V": draw(dim, inner), "U": draw(dim, inner), "w": draw(inner, 1)[:, 0], "c": draw(dim, 1)[:, 0], "d": np.zeros(1, np.float32)}
        return Model(p, stats.mean(axis=0), stats.std(axis=0) + 1e-3)

    def forward(self, grams: np.ndarray, stats: np.ndarray, doc: np.ndarray, n: int) -> dict:
        p, s = self.p, np.clip((stats - self.mean) / self.spread, -8, 8)
        h = np.tanh(grams @ p["E"] + s @ p["S"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        top = np.full(n, -np.inf, np.float32)
        np.maximum.at(top, doc, e)
        a = np.exp(e - top[doc])
        a /= np.bincount(doc, a, n)[doc]
        z = np.stack([np.bincount(doc, a * h[:, k], n) for k in range(h.shape[1])], 1).astype(np.float32)
        return {"s": s, "h": h, "v": v, "u": u, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, grams: np.ndarray, doc: np.ndarray, f: dict, label: np.ndarray) -> dict[str, np.ndarray]:
        p, h, v, u, a = self.p, f["h"], f["v"], f["u"], f["a"][:, None]
        dy = ((f["y"] - label) / len(label)).astype(np.float32)
        dz = dy[:, None] * p["c"]
        at = dz[doc]
        da = (at * h).sum(axis=1)
        de = f["a"] * (da - np.bincount(doc, f["a"] * da, len(label))[doc])
        dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
        dh = (a * at + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": grams.T @ dh, "S": f["s"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}


    def _attended(self, grams: np.ndarray, stats: np.ndarray) -> dict:
        """Encodings of passages and their attention before it is shared out."""
        p, s = self.p, np.clip((stats - self.mean) / self.spread, -8, 8)
        h = np.tanh(grams @ p["E"] + s @ p["S"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return {"s": s, "h": h, "v": v, "u": u, "e": (v * u) @ p["w"]}

    def pooled(self, slices: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float, np.ndarray]:
        """(largest attention, sum, weighted mean of the encodings) of one text's slices, as running figures."""
        top, total, z = -np.inf, 0.0, np.zeros(len(self.p["c"]))
        for grams, stats in slices:
            f = self._attended(grams, stats)
            new = max(top, float(f["e"].max()))
            a = np.exp(f["e"] - new)
            keep = np.exp(top - new)
            top, total, z = new, total * keep + float(a.sum()), z * keep + a @ f["h"]
        return top, total, z / total

    def score(self, slices: Iterator[tuple[np.ndarray, np.ndarray]]) -> float:
        """The score of one text."""
        return float(_sigmoid(self.pooled(slices)[2] @ self.p["c"] + self.p["d"])[0])

    def streamed_gradient(self, docs: list, label: np.ndarray) -> dict[str, np.ndarray]:
        """What ``gradient`` gives for texts whose slices are made twice: for the pooled encodings, then for their share of the gradient.

        Each of ``docs`` gives an iterator of slices when called.
        """
        p, out = self.p, {k: np.zeros_like(x) for k, x in self.p.items()}
        for slices, y in zip(docs, label, strict=True):
            top, total, z = self.pooled(slices())
            dy = float((_sigmoid(z @ p["c"] + p["d"])[0] - y) / len(label))
            dz = dy * p["c"]
            out["c"] += (dy * z).astype(np.float32)
            out["d"] += np.float32(dy)
            mean = float(dz @ z)  # of the passages' own parts, weighted by attention
            for grams, stats in slices():
                f = self._attended(grams, stats)
                a = np.exp(f["e"] - top) / total
                de = (a * (f["h"] @ dz - mean))[:, None]
                dv, du = de * p["w"] * f["u"] * (1 - f["v"] ** 2), de * p["w"] * f["v"] * f["u"] * (1 - f["u"])
                dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
                for name, x in (("E", grams.T @ dh), ("S", f["s"].T @ dh), ("b", dh.sum(axis=0)), ("V", f["h"].T @ dv), ("U", f["h"].T @ du), ("w", (f["v"] * f["u"]).T @ de[:, 0])):
                    out[name] += x.astype(np.float32)
        return out


def _sliced(grams, stats: np.ndarray, a: int, b: int):
    """Makes the slices of rows a to b."""
    return lambda: ((grams[np.arange(k, min(b, k + SLICE))], stats[k : min(b, k + SLICE)]) for k in range(a, b, SLICE))


def fit(grams: np.ndarray | _Stored, stats: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of documents; ``doc`` ascends. A batch of over 4 ``SLICE`` passages goes a slice at a time."""
    model = Model.new(stats, seed=seed)
    first = np.searchsorted(doc, np.arange(len(label) + 1))
    m = {k: np.zeros_like(x) for k, x in model.p.items()}
    v, t, r = {k: np.zeros_like(x) for k, x in model.p.items()}, 0, np.random.default_rng(seed)
    for _ in range(epochs):
        order = r.permutation(len(label))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            if (first[docs + 1] - first[docs]).sum() > 4 * SLICE:
                grad = model.streamed_gradient([_sliced(grams, stats, first[i], first[i + 1]) for i in docs], label[docs])
            else:
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
                own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                g = grams[rows]
                grad = model.gradient(g, own, model.forward(g, stats[rows], own, len(docs)), label[docs])
            t += 1
            for name, x in grad.items():
                x = x.astype(np.float32) + decay * model.p[name]
                m[name] = 0.9 * m[name] + 0.1 * x
                v[name] = 0.999 * v[name] + 0.001 * x * x
                model.p[name] = (model.p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STEP or len(held) >= 4000:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sliced_texts(texts: list[bytes]) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The slices of each text: short texts are encoded together, a long one by itself."""
    for part in _parts(texts):
        if len(part) == 1 and len(part[0]) > STEP:
            yield long_passages(part[0])
        else:
            grams, stats, doc = passages(part)
            at = np.searchsorted(doc, np.arange(len(part) + 1))
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield iter([(grams[a:b], stats[a:b])])


def _examples(folder: str):
    """(d, label, digest, file, at, n, stats) of each document to learn from; the trigram shares of its passages are written to a file of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, end = f"{uuid.uuid4().hex}.grams", 0
        fs, path = open_fs(f"{folder}/{file}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for batch in batches:
                labels = batch.column(1).to_pylist()
                for k, slices in enumerate(_sliced_texts(as_bytes(batch.column(2)))):
                    digest, own, at = hashlib.blake2b(digest_size=16), [], end
                    for grams, stats in slices:
                        data = np.round(grams * 255).astype(np.uint8).tobytes()
                        digest.update(data)
                        out.write(data)
                        end += len(grams)
                        own.append(stats)
                    stats = np.concatenate(own)
                    columns = [pa.array([digest.digest()], pa.binary()), pa.array([file]), pa.array([at], pa.int64()), pa.array([len(stats)], pa.int32()), pa.array([stats.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([labels[k]], pa.int32()), *columns], names=["d", "label", "digest", "file", "at", "n", "stats"])

    return run


class _Stored:
    """Trigram shares of passages in files of a folder; rows are read by range, those of a document follow each other."""

    def __init__(self, folder: str, files: list[str], places: list[int], sizes: list[int]):
        self.files, self.places, self.first = files, places, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.folder, self.open = folder, {}

    def _read(self, doc: int, a: int, b: int) -> np.ndarray:
        name = self.files[doc]
        if name not in self.open:
            if len(self.open) > 64:
                self.open.pop(next(iter(self.open))).close()
            fs, path = open_fs(f"{self.folder}/{name}")
            self.open[name] = fs.open_input_file(path)
        data = self.open[name].read_at((b - a) * BUCKETS, (self.places[doc] + a) * BUCKETS)
        return np.frombuffer(data, np.uint8).reshape(-1, BUCKETS)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), BUCKETS), np.float32)
        doc = np.searchsorted(self.first, rows, "right") - 1
        cuts = np.flatnonzero((np.diff(rows) != 1) | (np.diff(doc) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if b > a:
                start = int(rows[a] - self.first[doc[a]])
                out[a:b] = self._read(int(doc[a]), start, start + int(b - a))
        return out / np.float32(255)


def learn(examples: DataFrame) -> Model | None:
    """Fits on rows (d long, label int, t text), on all passages of each; None without any.

    Tasks write the encoded passages to the shared folder, from where the driver
    reads a batch, or a slice of one, at a time. It holds their ratios, 44
    bytes a passage, which is a tenth of the texts learnt from.
    """
    spark = examples.sparkSession
    folder = scratch(spark, "examples")
    schema = "d long, label int, digest binary, file string, at long, n int, stats binary"
    rows = materialise(examples.mapInArrow(_examples(folder), schema), "examples")
    docs = sorted((r.d, bytes(r.digest), r.label, r.file, r.at, r.n, bytes(r.stats)) for r in rows.toLocalIterator())
    if not docs:
        return None
    sizes = [x[5] for x in docs]
    stats = np.concatenate([np.frombuffer(x[6], np.float32).reshape(-1, N_STATS) for x in docs])
    grams = _Stored(folder, [x[3] for x in docs], [x[4] for x in docs], sizes)
    model = fit(grams, stats, np.repeat(np.arange(len(docs)), sizes), np.array([x[2] for x in docs], np.float32))
    remove(spark, folder)
    return model


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            texts, out = as_bytes(batch.column(2)), []
            for part in _parts(texts):
                if model is None:
                    out.append(np.full(len(part), 0.5))
                    continue
                if len(part) == 1 and len(part[0]) > STEP:
                    out.append(np.array([model.score(long_passages(part[0]))]))
                    continue
                grams, stats, doc = passages(part)
                out.append(model.forward(grams, stats, doc, len(part))["y"])
            y = np.concatenate(out).astype(np.float64) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y)], names=["d", "held_out", "score"])

    return run


def held_out(id_column: Column) -> Column:
    """Whether an id is kept back from learning."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: held_out, score, predicted.

    Learns from at most ``train_docs`` labelled documents that are not held
    out, picked by a hash of their id, and from all passages of each (of a
    repeated id from its least text); their ids are broadcast. Then every whole text is scored, a passage at a time.
    Only the text enters a score. A null or empty text is one empty passage; a
    null id is not held out and has no label; labels that are null are left
    out; without labels every score is 0.5; repeated rows each get a row.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    l = narrow(labels, id_col, label_col).select(F.col(id_col).cast("long").alias("d"), F.col(label_col).cast("int").alias("label"))  # noqa: E741
    l = l.dropna().filter(~held_out(F.col("d"))).groupBy("d").agg(F.max("label").alias("label"))
    l = materialise(l, "labels")  # noqa: E741
    share = min(1.0, 0.95 * train_docs / max(1, l.count()))
    draw = F.pmod(F.xxhash64("d"), F.lit(1 << 30)) < int(share * (1 << 30))  # so that no partition sends many to the driver
    picked = l.filter(draw).orderBy(F.xxhash64("d"), "d").limit(train_docs)
    examples = d.join(F.broadcast(picked), "d").groupBy("d", "label").agg(F.min("t").alias("t"))  # one row of a repeated id
    model = learn(examples)
    shared = spark.sparkContext.broadcast(model)
    rows = d.select("d", F.coalesce(held_out(F.col("d")), F.lit(False)).alias("held_out"), "t")
    out = rows.mapInArrow(_scores(shared), "d long, held_out boolean, score double")
    return out.select(F.col("d").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
