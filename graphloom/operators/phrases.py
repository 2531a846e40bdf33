"""Verb phrases by a finite-state chunker over classes of words.

Each word has a class by word lists and endings: A auxiliary, V verb, R adverb,
P preposition or particle, O any other. ``aggregate`` folds the words of a text
through the states: before the first verb, in its auxiliaries, behind its verb,
done.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import words

#: Words that a text without a verb may have to count as a phrase itself.
MOST_BARE = 5


def stripped(text: Column) -> Column:
    """The words of a text without the marks around them."""
    w = F.transform(words(F.coalesce(text, F.lit(""))), lambda x: F.regexp_replace(x, r"^[\"'(\[{,.;:]+|[\"')\]},.;:!?]+$", ""))
    return F.filter(w, lambda x: x != "")


def word_class(word: Column) -> Column:
    """One letter; a word with a capital is no verb."""
    w = F.lower(word)
    base = F.regexp_replace(F.regexp_replace(w, r"(?:e?s|e?d|ing)$", ""), r"e$", "")
    small = word.rlike(r"^\p{Ll}")
    verb = w.isin(fixed.IRREGULAR_VERBS)
    for ending in ("", "s", "es", "d", "ed", "ing"):
        verb = verb | w.isin([v[:-1] + ending if v.endswith("e") and ending in ("ed", "ing", "es") else v + ending for v in fixed.VERBS])
    by_ending = w.rlike(r"^\p{L}{2,}(?:ed|ing)$") & (F.length(base) >= 3)
    return (
        F.when(w.isin(fixed.AUXILIARIES), "A").when(w.isin(fixed.ADVERBS) | (small & w.rlike(r"^\p{L}{2,}ly$")), "R").when(w.isin(fixed.PREPOSITIONS), "P").when(small & (verb | by_ending), "V").otherwise("O")
    )


def verb_phrase(text: Column) -> Column:
    """The first verb of a text with its auxiliaries before and the prepositions and adverbs behind it, in lower case.

    Auxiliaries may stand alone. A text without a verb counts whole if it has
    ``MOST_BARE`` words at most, as it is; a longer one, an empty and a null
    one have no phrase.
    """
    before, auxiliary, behind, done = 0, 1, 2, 3
    w = stripped(text)
    tagged = F.transform(w, lambda x: F.struct(F.lower(x).alias("w"), word_class(x).alias("c")))
    start = F.struct(F.lit(before).alias("state"), F.array().cast("array<string>").alias("said"))

    def step(s: Column, t: Column) -> Column:
        c, state = t["c"], s["state"]
        after = (
            F.when(state == before, F.when(c == "A", auxiliary).when(c == "V", behind).otherwise(before))
            .when(state == auxiliary, F.when(c.isin("A", "R"), auxiliary).when(c.isin("V", "P"), behind).otherwise(done))
            .when(state == behind, F.when(c.isin("P", "R"), behind).otherwise(done))
            .otherwise(done)
        )
        return F.struct(after.alias("state"), F.when((after == auxiliary) | (after == behind), F.concat(s["said"], F.array(t["w"]))).otherwise(s["said"]).alias("said"))

    said = F.aggregate(tagged, start, step, lambda s: s["said"])
    bare = F.when(F.size(w).between(1, MOST_BARE), F.array_join(w, " "))
    return F.transform(F.array(said), lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")).otherwise(bare))[0]
