import pytest

LOREM = "the quick brown fox jumps over a lazy dog while the old man reads his book by the sea and the wind blows over all of it "


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and names that clash with the operators' own."""
    rows = [
        (1, LOREM * 4, "x", 1, True, "a", None),
        (2, LOREM * 4, "y", 2, False, "b", 1.0),
        (2, LOREM * 4, "y", 2, False, "b", 1.0),
        (3, None, None, None, None, None, None),
        (4, "", "z", 3, True, "c", 2.0),
        (5, " \n\t ", "z", 3, True, "c", 2.0),
        (None, "a text without an id, a text without an id", "q", 4, None, "d", 3.0),
        (6, "word " * 30_000 + "end", "long", 5, True, "e", 4.0),
        (7, "é ß ñ 日本語 😀 <|endoftext|> ▁ 𓀀 x²y\x1c z", "u", 6, True, "f", 5.0),
        (8, "one", "v", 7, True, "g", 6.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_bytes int, home boolean, fingerprint string, label double").repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.filter("false")


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
