"""Secret scans: patterns, and a character convolutional network for what they miss.

Patterns find assignments, access keys and long hex strings. Every other run of
key characters with a digit is a candidate; the network reads it with the
characters around it and gives a logit for each kind. It learns from the
findings of the patterns themselves, from weakened copies of them that no
pattern would find (without the name, the prefix, or short of the length), and
from runs that no pattern finds as counterexamples. Logits are calibrated on
findings kept back, where each kind's threshold is the highest that still
finds the stated share.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_texts, freed, materialise, narrow

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]*")
_KEY_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Characters of a candidate at least.
LEAST_RUN = 12
#: Characters before, of and behind a candidate that the network reads; a longer candidate is read in pieces.
BEFORE, BODY, BEHIND = 24, 48, 8
WIDE = BEFORE + BODY + BEHIND
#: About how many findings a state goes through before it is averaged with those of other chunks.
CHUNK = 4096
#: Passes over all findings. Runs that no pattern finds count as counterexamples though some are
#: secrets; more passes learn those by heart (of 40 hidden keys in the tests 15 were found after 12, 36 after 6).
PASSES = 6
#: Share of calibration findings that a threshold still finds.
RECALL = 0.95
EMBED, FILTERS, SPAN = 8, 24, 5
EPOCHS, BATCH, RATE = 12, 128, 0.004


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of each pattern match, in order."""
    out = [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of key characters with a digit, without those that overlap a span of ``base``."""
    out, at, k, reach = [], 0, 0, -1
    while digit := _DIGIT.search(text, at):
        a = digit.start()
        while a > at and text[a - 1] in _KEY_CHARACTERS:
            a -= 1
        at = _RUN.match(text, digit.start()).end()
        if at - a >= LEAST_RUN:
            while k < len(base) and base[k][0] < at:
                reach, k = max(reach, base[k][2]), k + 1
            if reach <= a:
                out.append((a, at))
    return out


def window(text: str, start: int, end: int, before: str | None = None) -> list[bytes]:
    """What the network reads of a candidate: a byte a character, one row for each piece of ``BODY``."""
    code = lambda s: s.replace("?", "\x01").encode("latin-1", "replace")
    left = code(text[max(0, start - BEFORE) : start] if before is None else before[-BEFORE:] if before else "").rjust(BEFORE, b"\0")
    right = code(text[end : end + BEHIND]).ljust(BEHIND, b"\0")
    return [left + code(text[a : min(end, a + BODY)]).ljust(BODY, b"\0") + right for a in range(start, max(end, start + 1), BODY)]


def findings(text: str) -> Iterator[tuple[int, bytes]]:
    """(kind or 3, window) to learn from: matches, weakened copies of them, and candidates outside."""
    base = base_spans(text)
    for start, kind, end, value in base:
        for w in window(text, value, end):
            yield kind, w
        if kind == 0:  # without the name and what stands before it
            yield from ((0, w) for w in window(text, value, end, ""))
        elif kind == 1:  # without its prefix
            yield from ((1, w) for w in window(text, start + 4, end, text[max(0, start - BEFORE) : start]))
        else:  # short of the pattern's length
            size = 20 + int(hashlib.blake2b(text[start:end].encode(), digest_size=2).hexdigest(), 16) % 12
            yield from ((2, w) for w in window(text[: start + size] + text[end : end + BEHIND], start, start + size))
    for a, b in candidates(text, base):
        yield from ((3, w) for w in window(text, a, b))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Embedding, one convolution, maxima over the body and over its surroundings, and a logit for each kind."""

    p: dict[str, np.ndarray]
    #: Slope and offset of the calibration and threshold of each kind.
    slope: np.ndarray
    offset: np.ndarray
    threshold: np.ndarray

    @staticmethod
    def new(seed: int = 12) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": draw(256, EMBED) * 8, "W": draw(SPAN * EMBED, FILTERS), "b": np.zeros(FILTERS, np.float32), "O": draw(2 * FILTERS, len(KINDS)), "c": np.zeros(len(KINDS), np.float32)}
        k = len(KINDS)
        return Network(p, np.ones(k), np.zeros(k), np.full(k, np.inf))

    def forward(self, x: np.ndarray) -> dict:
        """Logits of rows of ``WIDE`` codes."""
        n, steps = len(x), x.shape[1] - SPAN + 1
        e = self.p["E"][x]
        cols = np.stack([e[:, k : k + steps] for k in range(SPAN)], 2).reshape(n, steps, SPAN * EMBED)
        h = np.maximum(cols @ self.p["W"] + self.p["b"], 0)
        inside = slice(BEFORE - SPAN // 2, BEFORE + BODY - SPAN // 2)  # steps whose middle is in the body
        around = h.copy()
        around[:, inside] = -1
        at = np.stack([h[:, inside].argmax(1) + inside.start, around.argmax(1)], 1)
        z = np.take_along_axis(h, at, 1).reshape(n, 2 * FILTERS)
        return {"cols": cols, "at": at, "z": z, "y": z @ self.p["O"] + self.p["c"]}

    def gradient(self, x: np.ndarray, f: dict, dy: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        dz = np.where(f["z"] > 0, dy @ self.p["O"].T, 0).reshape(n, 2, FILTERS).astype(np.float32)
        rows, step = np.arange(n)[:, None, None], f["at"]
        picked = f["cols"][rows, step]  # n, 2, filters, columns
        dw = np.einsum("ipfc,ipf->cf", picked, dz)
        dcols = (dz[..., None] * self.p["W"].T).reshape(n, 2, FILTERS, SPAN, EMBED)
        de = np.zeros_like(self.p["E"])
        codes = x[rows[..., None], step[..., None] + np.arange(SPAN)]
        np.add.at(de, codes.ravel(), dcols.reshape(-1, EMBED))
        return {"E": de, "W": dw, "b": dz.sum((0, 1)), "O": f["z"].T @ dy, "c": dy.sum(0)}

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of each kind."""
        y = np.concatenate([self.forward(x[a : a + 512])["y"] for a in range(0, len(x), 512)]) if len(x) else np.zeros((0, len(KINDS)))
        return _sigmoid(y * self.slope + self.offset)


@dataclass
class State:
    """Weights of a network with the means and squares that Adam keeps of their gradients, and its steps."""

    p: dict[str, np.ndarray]
    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    steps: int = 0

    @staticmethod
    def of(net: Network) -> State:
        return State(net.p, *[{k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for part in (self.p, self.m, self.v) for x in part.values()]).astype(np.float64)

    def filled(self, flat: np.ndarray, steps: int) -> State:
        """A state of the same shapes with these numbers."""
        at, parts = 0, []
        for part in (self.p, self.m, self.v):
            parts.append({})
            for k, x in part.items():
                parts[-1][k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        return State(*parts, steps)

    def epoch(self, codes: np.ndarray, kind: np.ndarray, weight: np.ndarray, order: np.ndarray, batch: int = BATCH, rate: float = RATE) -> State:
        """The state after Adam's steps on the log loss over rows in this order; ``weight`` is that of a row of each kind."""
        p, m, v, t = dict(self.p), dict(self.m), dict(self.v), self.steps
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            net = Network(p, *[np.zeros(0)] * 3)
            f = net.forward(codes[rows])
            dy = (_sigmoid(f["y"]) - (kind[rows, None] == np.arange(len(KINDS)))) * weight[kind[rows], None] / len(rows)
            t += 1
            for name, g in net.gradient(codes[rows], f, dy.astype(np.float32)).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = (p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return State(p, m, v, t)


def _newton(a: float, b: float, g: np.ndarray, h: np.ndarray) -> tuple[float, float, float]:
    """(slope, offset, how far they moved) after a step of Platt scaling from sums over rows."""
    g, h = g + [1e-3 * (a - 1), 0], h + np.diag([1e-3, 1e-6])
    step = np.linalg.solve(h, g)
    step *= min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return max(1e-3, a - step[0]), b - step[1], float(np.abs(step).max())


def _platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit probabilities to labels, by Newton steps with Platt's softened targets."""
    up, down = int(label.sum()), int(len(label) - label.sum())
    t = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        q = _sigmoid(a * logit + b)
        w = q * (1 - q) + 1e-9
        a, b, _ = _newton(a, b, np.array([((q - t) * logit).sum(), (q - t).sum()]), np.array([[(w * logit * logit).sum(), (w * logit).sum()], [(w * logit).sum(), w.sum()]]))
    return a, b


def _logits(net: Network, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([net.forward(codes[a : a + 512])["y"] for a in range(0, len(codes), 512)]) if len(codes) else np.zeros((0, len(KINDS)), np.float32)


def fit(codes: np.ndarray, kind: np.ndarray, kept_back: np.ndarray, recall: float = RECALL, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 12) -> Network | None:
    """A network of rows that fit into memory: learnt on those that are not kept back, calibrated on those that are.

    A kind without findings in both parts gets no threshold, and so adds nothing.
    """
    net, r = Network.new(seed), np.random.default_rng(seed)
    learn, back = np.flatnonzero(~kept_back), np.flatnonzero(kept_back)
    if not len(learn):
        return None
    state = State.of(net)
    for _ in range(epochs):
        state = state.epoch(codes, kind, np.ones(len(KINDS) + 1), learn[r.permutation(len(learn))], batch, rate)
    net.p = state.p
    logit = _logits(net, codes[back])
    for k in range(len(KINDS)):
        own = kind[back] == k
        if own.any() and (kind[learn] == k).any():
            net.slope[k], net.offset[k] = _platt(logit[:, k].astype(np.float64), own.astype(np.float64))
            p = np.sort(_sigmoid(logit[own, k] * net.slope[k] + net.offset[k]))
            net.threshold[k] = p[int((1 - recall) * len(p))]
    return net


def training_rows(docs: DataFrame, text_col: str = "text", most: int | None = None) -> DataFrame:
    """(kind, h, codes): all distinct findings of all texts; with ``most`` at most so many of a kind, those of the least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({x for text in as_texts(batch.column(0)) for x in findings(text)})
            if rows:
                kind, codes = zip(*rows, strict=True)
                h = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "big", signed=True) for w in codes]
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(h, pa.int64()), pa.array(codes, pa.binary())], names=["kind", "h", "codes"])

    found = narrow(docs, text_col).mapInArrow(freed(run), "kind int, h long, codes binary")
    found = materialise(found.distinct(), "findings")
    if most is None:
        return found
    # only hashes up to about the wanted share are ordered
    reach = found.groupBy("kind").agg(F.least(F.lit(1.0), (F.lit(most + 6 * most**0.5 + 10)) / F.count("*")).alias("reach"))
    share = (F.col("h") / 2.0**64) + 0.5
    near = found.join(F.broadcast(reach), "kind").filter((share <= F.col("reach")) | (F.col("reach") >= 1))
    k = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
    return near.withColumn("k", k).filter(F.col("k") <= most).select("kind", "h", "codes")


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, codes, kind, kept back) of each chunk; a quarter of the findings, by hash, is kept back."""
    for i in range(batch.num_rows):
        codes = np.frombuffer(b"".join(batch.column("codes")[i].values.to_pylist()), np.uint8).reshape(-1, WIDE)
        kind, h = (np.asarray(batch.column(c)[i].values) for c in ("kind", "h"))
        yield batch.column("chunk")[i].as_py(), codes, kind, h % 4 == 0


def _learnt(chunks: DataFrame, weight: np.ndarray, seed: int = 12) -> Network | None:
    """A network of all rows that are not kept back; None without such rows."""
    net = Network.new(seed)
    state = State.of(net)
    for epoch in range(PASSES):
        shared = chunks.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, codes, kind, back in _rows_of(batch):
                    learn = np.flatnonzero(~back)
                    if len(learn):
                        s = shared.value.epoch(codes, kind, weight, learn[np.random.default_rng((seed, epoch, chunk)).permutation(len(learn))])
                        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "n": pa.array([len(learn)], pa.int64()), "steps": pa.array([s.steps], pa.int64()), "state": pa.array([(s.flat() * len(learn)).tobytes()], pa.binary())})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")  # so that sums are the same each time
            total = np.sum([np.frombuffer(x) for x in pdf["state"]], axis=0)
            return pd.DataFrame([(pdf["chunk"].iloc[0], pdf["n"].sum(), pdf["steps"].max(), total.tobytes())], columns=["chunk", "n", "steps", "state"])

        line = "chunk long, n long, steps long, state binary"
        got = sorted(chunks.mapInArrow(freed(run), line).groupBy(F.floor(F.col("chunk") / 64)).applyInPandas(add, line).collect())
        shared.unpersist()
        if not got:
            return None
        state = state.filled(np.sum([np.frombuffer(r.state) for r in got], axis=0) / sum(r.n for r in got), max(r.steps for r in got))
    net.p = state.p
    return net


def _calibrate(chunks: DataFrame, net: Network, recall: float, learnt: set[int]) -> None:
    """Slopes, offsets and thresholds from all rows kept back, in passes that only add up and count."""
    shared = chunks.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes, kind, back in _rows_of(batch):
                y = _logits(shared.value, codes[back]).astype(np.float32)
                own = y[np.arange(len(y)), np.minimum(kind[back], len(KINDS) - 1)]
                bits = own.view(np.int32).astype(np.int64)
                bits = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)  # in the order of the numbers
                yield pa.RecordBatch.from_arrays([pa.array(kind[back], pa.int32()), *[pa.array(y[:, k].astype(np.float64)) for k in range(len(KINDS))], pa.array(bits)], names=["kind", *(f"y{k}" for k in range(len(KINDS))), "bits"])

    d = materialise(chunks.mapInArrow(freed(run), "kind int, " + ", ".join(f"y{k} double" for k in range(len(KINDS))) + ", bits long"), "logits")
    of = {(r.kind, r.hi): r.n for r in d.filter(F.col("kind").isin([k for k in learnt if k < len(KINDS)])).groupBy("kind", F.shiftright("bits", 16).alias("hi")).agg(F.count("*").alias("n")).collect()}  # 2^16 a kind at most
    n = Counter()
    for (k, _), c in of.items():
        n[k] += c
    rows = d.count()
    curve, open_ = {k: (1.0, 0.0) for k in n}, set(n)
    for _ in range(30):
        if not open_:
            break
        sums = []
        for k in sorted(open_):
            y, (a, b) = F.col(f"y{k}"), curve[k]
            t = F.when(F.col("kind") == k, (n[k] + 1) / (n[k] + 2)).otherwise(1 / (rows - n[k] + 2))
            q = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * y + b))))
            w = q * (1 - q) + 1e-9
            sums += [F.sum(x).alias(f"{name}{k}") for name, x in (("gy", (q - t) * y), ("g", q - t), ("hyy", w * y * y), ("hy", w * y), ("h", w))]
        s = d.agg(*sums).first()
        for k in sorted(open_):
            a, b, moved = _newton(*curve[k], np.array([s[f"gy{k}"], s[f"g{k}"]]), np.array([[s[f"hyy{k}"], s[f"hy{k}"]], [s[f"hy{k}"], s[f"h{k}"]]]))
            curve[k] = (a, b)
            if moved < 1e-6:
                open_.discard(k)
    # the logit at the place of each kind's threshold: its upper half, then its lower one
    upper = {}
    for k in n:
        left = int((1 - recall) * n[k])
        for hi in sorted(hi for kind, hi in of if kind == k):
            if left < of[k, hi]:
                upper[k] = (hi, left)
                break
            left -= of[k, hi]
    low = F.col("bits").bitwiseAND(0xFFFF).alias("lo")
    within = F.lit(False)
    for k, (hi, _) in upper.items():
        within = within | ((F.col("kind") == k) & (F.shiftright("bits", 16) == hi))
    left = {k: x for k, (_, x) in upper.items()}
    for r in sorted(d.filter(within).groupBy("kind", low).agg(F.count("*").alias("n")).collect()):
        if 0 <= left[r.kind] < r.n:
            bits = np.int64(upper[r.kind][0]) << 16 | r.lo
            y = np.int32(bits ^ 0x7FFFFFFF if bits < 0 else bits).view(np.float32)
            net.slope[r.kind], net.offset[r.kind] = curve[r.kind]
            net.threshold[r.kind] = _sigmoid(y * net.slope[r.kind] + net.offset[r.kind])
        left[r.kind] -= r.n


def train(docs: DataFrame, text_col: str = "text", most: int | None = None, recall: float = RECALL) -> Network | None:
    """A network from the findings of all texts, each kind with the same weight in sum; None without findings.

    A kind without findings in both parts, to learn from and kept back, gets no
    threshold, and so adds nothing. Chunks are dealt by hash, so their size is even
    whatever the texts.
    """
    rows = training_rows(docs, text_col, most)
    counts = rows.groupBy("kind", (F.col("h") % 4 == 0).alias("back")).agg(F.count("*").alias("n")).collect()
    n = Counter()
    for r in counts:
        n[r.kind] += r.n
    if not any(k < len(KINDS) for k in n):
        return None
    parts = -(-n.total() // CHUNK)
    own = rows.groupBy(F.pmod(F.xxhash64("h"), F.lit(parts)).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("h", "kind", "codes"))).alias("x"))
    chunks = materialise(own.select("chunk", "x.h", "x.kind", "x.codes").repartition(min(parts, 1000)), "chunks")
    net = _learnt(chunks, np.array([n.total() / (len(n) * max(1, n[k])) for k in range(len(KINDS) + 1)]))
    if net:
        _calibrate(chunks, net, recall, {r.kind for r in counts if not r.back})
    return net


def added_spans(network: Network | None, texts: list[str], base: list[list[tuple[int, int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the candidates that reach a threshold; a candidate of several pieces by its best."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if network is None:
        return out
    held, codes = [], []

    def judge() -> None:
        p = network.probabilities(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WIDE))
        first = np.cumsum([0, *[n for *_, n in held]])[:-1]
        best = np.maximum.reduceat(p, first, axis=0)
        over = np.where(best >= network.threshold, best, -1)
        for (i, a, b, _), q in zip(held, over, strict=True):
            if q.max() >= 0:
                out[i].append((a, int(q.argmax()), b))
        held.clear()
        codes.clear()

    for i, text in enumerate(texts):
        for a, b in candidates(text, base[i]):
            w = window(text, a, b)
            held.append((i, a, b, len(w)))
            codes += w
            if len(codes) >= 4096:
                judge()
    if held:
        judge()
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_findings: int | None = None, recall: float = RECALL) -> DataFrame:
    """A row per document: n_assign, n_access, n_hex, base (spans of patterns), spans (with those of the network).

    Spans are kind:start:end by start and then kind, in code points with the end
    outside. The network learns from all findings and counterexamples of all texts,
    or from at most ``train_findings`` of each kind where that is given. It adds candidates that no
    pattern overlaps and takes none away. Null and empty texts have no spans;
    repeated rows each get a row, an empty table none; without findings nothing is
    added. Long candidates are read whole, in pieces.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(train(d, text_col, train_findings, recall))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_texts(batch.column(1))
            base = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, base)
            own = [[(a, k, b) for a, k, b, _ in x] for x in base]
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in own], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(map(_named, own), pa.string()), pa.array((_named(x + y) for x, y in zip(own, added, strict=True)), pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    kind = d.schema[id_col].dataType.simpleString()
    out = d.mapInArrow(freed(run), f"id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")
    return out.withColumnRenamed("id", id_col)
