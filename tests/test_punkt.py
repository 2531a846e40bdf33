"""Sentence ends learnt from a corpus, against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.operators import punkt


def bare(t):
    t = re.sub(r"[\"')\]},;:!?]+$", "", re.sub(r"^[\"'(\[{]+", "", t)).lower()
    if re.fullmatch(r"-?[.,]?\d[\d,.-]*\.", t):
        return "##number##."
    return "##number##" if re.fullmatch(r"-?[.,]?\d[\d,.-]*", t) else t


def cut(text):
    out, at = [], 0
    for i in range(1, len(text)):
        if text[i].isspace() and re.search(r"[.!?][\"')\]]{0,3}$", text[:i]):
            out.append(text[at:i])
            at = i
    return [*out, text[at:]]


def plain(texts):
    """(abbreviations, starters, sentences of each text), a word at a time."""
    n, stopped = Counter(), Counter()
    for t in texts:
        for w in map(bare, t.split()):
            if set(w) - {"."}:
                n[w.removesuffix(".")] += 1
                stopped[w.removesuffix(".")] += w.endswith(".")
    all_n, all_stopped = sum(n.values()), sum(stopped.values())
    p, log = all_stopped / all_n, lambda x: math.log(max(x, 1e-12))
    short = set()
    for w, k in stopped.items():
        if k and any(c.isalpha() for c in w):
            inside = w.count(".")
            letters = len(w) - inside
            chance = k * log(p) + (n[w] - k) * log(1 - p)
            rule = k * math.log(0.99) + (n[w] - k) * math.log(1 - 0.99)
            if -2 * (chance - rule) * math.exp(-letters) * (inside + 1) * letters ** -(n[w] - k) >= 0.3:
                short.add(w)
    first, ends = Counter(), 0
    for t in texts:
        parts = cut(t)
        for a, b in zip(parts, parts[1:]):
            w = bare(a.split()[-1]).removesuffix(".") if a.split() else ""
            if w not in short and not re.fullmatch(r"[^\W\d_]|##number##", w) and b.split():
                ends += 1
                first[bare(b.split()[0]).removesuffix(".")] += 1
    like = lambda k, m, q: k * log(q) + (m - k) * log(1 - q)
    start = set()
    for w, ab in first.items():
        if w in n and re.fullmatch(r"[^\W\d_]+", w) and all_n > ends:
            q, q1, q2 = n[w] / all_n, ab / ends, (n[w] - ab) / (all_n - ends)
            if q1 > q and -2 * (like(ab, ends, q) + like(n[w] - ab, all_n - ends, q) - like(ab, ends, q1) - like(n[w] - ab, all_n - ends, q2)) >= 30:
                start.add(w)
    out = []
    for t in texts:
        parts, own = cut(t), [""]
        for i, a in enumerate(parts):
            own[-1] += a
            if i + 1 == len(parts):
                break
            last = bare(a.split()[-1]) if a.split() else ""
            follow = parts[i + 1].split()[0] if parts[i + 1].split() else None
            w = last.removesuffix(".") if last.endswith(".") else None
            head = re.sub(r"^[\"'(\[{]+", "", follow or "")[:1]
            held = w is not None and (w in short or (len(w) == 1 and w.isalpha()))
            starter = follow is not None and bare(follow).removesuffix(".") in start
            if follow is None or not ((held and not (head.isupper() and starter)) or (w == "##number##" and head.islower())):
                own.append("")
        out.append([s.strip() for s in own if s.strip()])
    return short, start, out


def corpus(seed=1):
    r = np.random.default_rng(seed)
    nouns = "agreement party company notice service product term payment court law clause schedule buyer seller".split()
    texts = []
    for _ in range(120):
        s = []
        for _ in range(int(r.integers(2, 7))):
            w = [str(x) for x in r.choice(nouns, int(r.integers(3, 8)))]
            if r.random() < 0.5:
                w.insert(int(r.integers(1, len(w))), str(r.choice(["Inc.", "Corp.", "e.g.", "No.", "Sec.", "J."])))
            if r.random() < 0.2:
                w.insert(1, str(r.choice(["(12.)", "3.5", "the 4th", "$5,000."])))
            w[0] = str(r.choice(["The", "The", "This", w[0].title()]))
            s.append(" ".join(w) + str(r.choice([".", ".", ".", "!", "?", '."', ".)"])))
        texts.append(str(r.choice([" ", "\n", "  "])).join(s))
    return texts + ["The deal with Acme Inc. The buyer pays.", "Signed by J. Smith.", "", "  ", "...", "No mark at all", "a. b. c."]


@pytest.fixture(scope="module")
def learnt(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return texts, docs, *punkt.learn(docs)


def test_abbreviations_and_starters_equal_plain_ones(learnt):
    texts, _, short, first = learnt
    a, s, _ = plain(texts)
    assert {r.type for r in short.collect()} == a and {"inc", "corp", "e.g", "sec"} <= a and not {"payment", "law"} & a
    assert {r.type for r in first.collect()} == s and {"the", "this"} <= s


def test_sentences_equal_plain_ones(spark, learnt):
    texts, docs, short, first = learnt
    got = {}
    for r in sorted(punkt.sentences(docs, short, first).collect()):
        got.setdefault(r.doc_id, []).append(r.sentence)
    expected = plain(texts)[2]
    assert [got.get(i, []) for i in range(len(texts))] == expected
    n = len(texts)
    assert expected[n - 7] == ["The deal with Acme Inc.", "The buyer pays."] and expected[n - 6] == ["Signed by J. Smith."]


def test_messy_rows(spark, learnt):
    _, _, short, first = learnt
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 50_000 + "Inc. goes on. End"), (5, "!! ?? ..")]
    got = {}
    for r in punkt.sentences(spark.createDataFrame(rows, "doc_id long, text string"), short, first).collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert set(got) == {4, 5} and len(got[4]) == 2 and sorted(got[5]) == ["!!", "..", "??"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").limit(0)
    none, nothing = punkt.learn(docs)
    assert none.count() == nothing.count() == punkt.sentences(docs, none, nothing).count() == 0
