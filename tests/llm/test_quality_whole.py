import numpy as np

from graphloom.llm import quality_mil as M


def plain_repeats(text):
    w = [text[i : i + 16] for i in range(len(text) - 15)]
    times = {x: w.count(x) for x in w}
    out = []
    for k in range(0, len(text), M.PASSAGE):
        own = w[k : k + M.PASSAGE]
        out.append(sum(times[x] > 1 for x in own) / max(1, len(own)))
    return out


def test_every_window_counts():
    rng = np.random.default_rng(5)
    for size in (17, 40, 90, 600, 1100):
        text = bytes(rng.integers(97, 123, size).tolist())
        text += text[:16]
        assert np.allclose(M.passages([b"x" * 30, text, b"y" * 40])[1][1:-1, 8], plain_repeats(text))


def test_long_texts_are_learnt_whole(spark, monkeypatch):
    seen = {}

    def fit(grams, stats, doc, label):
        seen.update(grams=grams[np.arange(len(doc))], stats=stats, n=np.bincount(doc).tolist(), label=label.tolist())

    monkeypatch.setattr(M, "fit", fit)
    texts = ["short", "word " * 10_000]
    M.learn(spark.createDataFrame([(2, 1, texts[1]), (1, 0, texts[0])], "d long, label int, t string"))
    grams, stats, _ = M.passages([t.encode() for t in texts])
    assert seen["n"] == [1, 98] and seen["label"] == [0, 1]
    assert np.allclose(seen["stats"], stats) and np.allclose(seen["grams"], grams, atol=0.003)


def test_a_repeated_id_is_learnt_from_once(spark, monkeypatch):
    from graphloom.llm import quality_mil

    seen = []
    monkeypatch.setattr(quality_mil, "learn", lambda rows: seen.append(rows.count()))
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(70)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    assert quality_mil.quality_scores(docs, labels).count() == 70 and seen[0] <= 7


def plain_score(model, text):
    """One passage after the other, as the formulas say."""
    p, enc, att = model.p, [], []
    grams, stats, _ = M.passages([text])
    for g, s in zip(grams, stats, strict=True):
        s = np.clip((s - model.mean) / model.spread, -8, 8)
        h = np.array([np.tanh(g @ p["E"][:, k] + s @ p["S"][:, k] + p["b"][k]) for k in range(len(p["b"]))])
        v = np.array([np.tanh(h @ p["V"][:, k]) for k in range(p["V"].shape[1])])
        u = np.array([1 / (1 + np.exp(-(h @ p["U"][:, k]))) for k in range(p["U"].shape[1])])
        enc.append(h)
        att.append(float((v * u) @ p["w"]))
    a = np.exp(np.array(att) - max(att))
    z = (a[:, None] * np.array(enc)).sum(0) / a.sum()
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))


def some_text(rng, size):
    return (b" ".join(bytes(rng.integers(97, 123, int(rng.integers(2, 9))).tolist()) for _ in range(size // 5)) + b"\n0123456789abcdef" * 3)[:size]


def test_slices_of_a_long_text_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(8)
    for size in (1, 3, 40, 512, 513, 5000, 40_003):
        text = some_text(rng, size)
        whole = M.passages([text])
        for slice_, windows, step in ((4, 700, 512), (1000, 10**6, 10**6), (7, 333, 2000)):
            monkeypatch.setattr(M, "SLICE", slice_)
            monkeypatch.setattr(M, "WINDOWS", windows)
            monkeypatch.setattr(M, "STEP", step)
            grams, stats = (np.concatenate(x) for x in zip(*M.long_passages(text), strict=True))
            np.testing.assert_allclose(grams, whole[0], atol=1e-6)
            np.testing.assert_allclose(stats, whole[1], atol=1e-6)


def test_scores_equal_a_plain_forward_pass(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [some_text(rng, n) for n in (0, 10, 700, 9000)]
    grams, stats, doc = M.passages(texts)
    model = M.Model.new(stats)
    expected = [plain_score(model, t) for t in texts]
    np.testing.assert_allclose(model.forward(grams, stats, doc, 4)["y"], expected, atol=1e-5)
    monkeypatch.setattr(M, "SLICE", 3)
    np.testing.assert_allclose([model.score(M.long_passages(t)) for t in texts[1:]], expected[1:], atol=1e-5)


def test_streamed_gradient_equals_that_of_the_whole(monkeypatch):
    rng = np.random.default_rng(10)
    texts = [some_text(rng, n) for n in (600, 9000, 3000)]
    grams, stats, doc = M.passages(texts)
    model, label = M.Model.new(stats), np.array([1.0, 0.0, 1.0], np.float32)
    whole = model.gradient(grams, doc, model.forward(grams, stats, doc, 3), label)
    monkeypatch.setattr(M, "SLICE", 4)
    first = np.searchsorted(doc, np.arange(4))
    parts = model.streamed_gradient([M._sliced(grams, stats, first[i], first[i + 1]) for i in range(3)], label)
    for name, x in whole.items():
        np.testing.assert_allclose(parts[name], x, atol=2e-5, err_msg=name)


def test_memory_of_a_long_text_is_bounded():
    """40 MB in a process of its own: what comes on top of the text and the libraries stays below 600 MB."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from graphloom.llm import quality_mil as M
text = np.random.default_rng(1).integers(97, 123, 40_000_000, dtype=np.uint8).tobytes()
model = M.Model.new(np.zeros((2, M.N_STATS), np.float32))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert 0 < model.score(M.long_passages(text)) < 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 600
