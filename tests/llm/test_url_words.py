import functools
import math
import re
from collections import Counter

from graphloom.llm import url_filter as U


def test_rare_words_split_names(spark):
    """A word that comes once beside 25,000 more frequent ones still splits a host."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    frequent = ["q" + "".join(letters[i // 26**k % 26] for k in range(4)) for i in range(25_000)]
    pages = spark.createDataFrame([(1, "http://zebrafish.example/", " ".join(frequent * 2)), (2, "http://b.example/", "zebra fish")], "page_id long, url string, html string")
    counts = U.word_counts(pages, "html")
    assert counts.count() == 25_002 + len(U.SEED_WORDS)
    parts = spark.createDataFrame([("zebrafish",), ("xqaaaa",)], "part string")
    got = {r.part: r.words for r in U.segmented(parts, counts).collect()}
    assert got["zebrafish"] == ["zebra", "fish"] and got["xqaaaa"] == ["x", "qaaaa"]


def plain_verdicts(pages, rules=U.RULES):
    """(host, path, rule, verdict) of each url: rules one by one, names split by trying all splits, then add-one naive Bayes."""
    n = Counter({s: 2 for s in U.SEED_WORDS})
    seen = Counter(w for _, _, html in pages for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", html or "").lower()))
    n = {w: max(n[w], seen[w]) for w in {*n, *seen}}
    total = sum(n.values())

    @functools.cache
    def split(name):
        """(log probability, words) of the best split of a name."""
        if not name:
            return 0.0, ()
        cost = lambda w: math.log(n[w] / total) if w in n else math.log(0.1 / total) - 2.5 * len(w)
        return max(((cost(name[i:]) + split(name[:i])[0], (*split(name[:i])[1], name[i:])) for i in range(max(0, len(name) - 24), len(name))), key=lambda x: round(x[0], 9))

    def cut(url):
        if url is None or "://" not in url:
            return "", ""
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path

    urls = [cut(u) for _, u, _ in pages]
    tokens = {u: Counter((m, w) for m, text in (("h", u[0]), ("p", u[1].lower())) for part in re.findall(r"[^\W\d_]+", text) for w in split(part)[1]) for u in urls if u[0]}
    bad = {}
    for u, t in tokens.items():
        found = {w for _, w in t if w in U.SEED_WORDS}
        bad[u] = len(found) > 1 or bool(found - set(U.WEAK_SEEDS))
    counts = {True: Counter(), False: Counter()}
    for u in urls:
        if u[0]:
            counts[bad[u]].update(tokens[u])
    vocabulary = len({*counts[True], *counts[False]})
    all_ = {k: sum(c.values()) + vocabulary for k, c in counts.items()}
    named = [u for u in urls if u[0]]
    n_bad = sum(bad[u] for u in named)
    out = []
    for host, path in urls:
        fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        score = -1.0
        if host:
            score = math.log((n_bad + 1) / (len(named) - n_bad + 1)) + sum(c * math.log((counts[True][t] + 1) / all_[True] / ((counts[False][t] + 1) / all_[False])) for t, c in tokens[host, path].items())
        out.append((host, path, rule, dict(rules)[rule] if rule else "block" if round(score, 9) > 0 else "allow"))
    return out


def made_pages():
    text = "<p>casino zorp gadget meadow Fluss zorp meadow gadget the win</p>"
    pages = [(i, f"http://casinozorp{i}.example/zorp/{i}", text) for i in range(20)]
    pages += [(100 + i, f"https://meadow.example/gadget/{i}?q=casino", text) for i in range(120)]
    pages += [(300, "http://zorpzorp.example/zorp", text), (301, "http://gadgetmeadow.example/", text), (302, "ftp://win.example/zorp", None), (303, "http://freewin.example/", text)]
    return [*pages, (304, None, text), (305, "no scheme", text), (306, "HTTP://A.Example.COM/en/7", text), (307, "http://x.com/en/9", ""), (308, "http://b.org/es", text), (309, "http://" + "q" * 3000 + ".example/Fluss", text), (300, "http://zorpzorp.example/zorp", text)]


def test_verdicts_equal_a_plain_version(spark):
    pages = made_pages()
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    short = [(p, v) for p, v in zip(pages, plain_verdicts([(i, u if len(u or "") < 500 else "http://q.example/Fluss", h) for i, u, h in pages]), strict=True)]
    expected = sorted((p[0], v[0] if len(p[1] or "") < 500 else "q" * 3000 + ".example", v[1], v[2] or "", v[3]) for p, v in short)
    assert got == expected


def test_segmentation_and_bayes_block_what_the_list_does_not(spark):
    """No seed stands in this host or its path; its words come with those that do, so the list alone would allow it."""
    verdict = {r.page_id: r.verdict for r in U.url_filter(spark.createDataFrame(made_pages(), "page_id long, url string, html string")).collect()}
    assert not any(s in "zorpzorp.example/zorp" for s in U.SEED_WORDS)
    assert verdict[300] == "block" and verdict[301] == "allow" and verdict[100] == "allow" and verdict[3] == "block"


def test_a_very_long_name_is_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(U, "LETTERS", 50)
    name = ("zebrafish" * 400)[:3500]
    counts = spark.createDataFrame([("zebra", 50), ("fish", 50), ("rest", 10_000)], "w string, n long")
    parts = spark.createDataFrame([(name,), ("fish",)], "part string")
    import pyarrow as pa

    sizes = [b.num_rows for b in U._substrings(iter([pa.RecordBatch.from_pydict({"i": [1], "part": [name]})]))]
    assert len(sizes) == 70 and max(sizes) <= 50 * U.MAX_WORD
    got = {r.part: r.words for r in U.segmented(parts, counts).collect()}
    assert got["fish"] == ["fish"] and "".join(got[name]) == name and set(got[name][:700]) == {"zebra", "fish"}
