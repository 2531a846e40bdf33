"""Text scalars as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

EDGE_MARKS = " \t\r\n,.;:()[]{}\"'"
#: Word characters by Unicode class, spelt so that other engines read it alike.
_NOT_KEPT = r"[^\p{L}\p{N}_\s.,;:()\-$%/']"


def clean_text(text: Column) -> Column:
    """Drops page marks, lines of digits, surplus blanks and symbols."""
    t = F.regexp_replace(text, r"(?i)\bPage\s+\d+\s+of\s+\d+\b", "")
    t = F.regexp_replace(t, r"(?m)^\s*\d+\s*$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(t, _NOT_KEPT, " "), F.lit(" \t\r\n\x0b\f"))


def normalize_mention(value: Column, dashes: bool = False) -> Column:
    """White space as one blank, marks off both ends; ``dashes`` also writes curly quotes and long dashes plainly."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    v = F.translate(v, "’–—", "'--") if dashes else v
    return F.btrim(F.btrim(F.regexp_replace(v, r"\s+", " ")), F.lit(EDGE_MARKS))


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, which retrieval counts."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def canonical_tokens(value: Column, label: Column | None = None) -> Column:
    v = F.regexp_replace(F.lower(normalize_mention(value)), "[^a-z0-9&' ]+", " ")
    tokens = F.filter(F.split(v, " "), lambda w: w != "")
    if label is None:
        return tokens
    bare = F.filter(tokens, lambda w: ~w.isin(fixed.ENTITY_SUFFIXES))
    return F.when(label == "PARTY", bare).otherwise(tokens)


def canonical_key(value: Column, label: Column | None = None) -> Column:
    """Lower-case key; of a PARTY without legal suffixes."""
    return F.array_join(canonical_tokens(value, label), " ")


def token_set(value: Column) -> Column:
    return F.array_distinct(canonical_tokens(value))


def acronym(value: Column) -> Column:
    parts = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    kept = F.filter(F.transform(parts, F.lower), lambda w: ~w.isin(fixed.ENTITY_SUFFIXES))
    return F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), "")


def years(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)))


def years_conflict(a: Column, b: Column) -> Column:
    x, y = years(a), years(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def mention_quality(value: Column, bare: bool = False) -> Column:
    """0 for noise, up to 1 for what reads like a name; the first rule that fits decides.

    ``bare`` says, here and below, that the value is normalised already, which
    spares normalising it for each rule.
    """
    v = value if bare else normalize_mention(value)
    zero = (
        (F.length(v) < 2)
        | v.rlike(r"^[\W_]+$")
        | (F.size(words(v)) > 8)
        | v.rlike(fixed.BOILERPLATE)
        | v.rlike(r"(?i)^[a-z]\s*\*+$")
        | v.rlike(r"^\d+$")
        | v.rlike(r"(?i)^[a-z]{1,2}$")
        | (F.length(v) - F.length(F.replace(v, F.lit(","))) >= 2)
    )
    return (
        F.when(zero, F.lit(0.0))
        .when(v.rlike(r"^[A-Z]{1,3}$"), F.lit(0.45))
        .when(F.length(v) <= 3, F.lit(0.35))
        .when(v.rlike(fixed.LEGAL_KEYWORD), F.lit(1.0))
        .otherwise(F.lit(0.8))
    )


def is_informative(value: Column) -> Column:
    v = normalize_mention(value)
    # two letters or digits side by side stay, whatever is normalised
    return F.coalesce(value.cast("string"), F.lit("")).rlike("[A-Za-z0-9]{2}") | ((F.length(v) >= 2) & ~v.rlike(r"^[\W_]+$"))


def normalize_entity(value: Column) -> Column:
    return F.btrim(F.btrim(value), F.lit(",.;:'\""))


def is_valid_entity(value: Column) -> Column:
    v = F.btrim(value)
    return F.length(v).between(3, 80) & ~F.lower(v).isin(fixed.QUERY_STOP_WORDS + fixed.GENERIC_ROLES)


def strip_legal_suffix(name: Column) -> Column:
    """Without legal suffixes at the end, however many follow each other."""
    return F.btrim(F.btrim(F.regexp_replace(F.btrim(name), rf"(?i)(?:[,.\s]*\b(?:{fixed.LEGAL_SUFFIX})\.?[\s,.]*)+$", "")), F.lit(",."))


def window_around(sentence: Column, anchor: Column, width: int = 80) -> Column:
    """What lies within ``width`` of the anchor's first place; null if it has none."""
    at = F.instr(F.lower(sentence), F.lower(normalize_mention(anchor)))
    start = F.greatest(F.lit(1), at - width)
    stop = F.least(F.length(sentence), at - 1 + F.length(anchor) + width)
    present = (at > 0) & (F.coalesce(F.length(sentence), F.lit(0)) > 0) & (F.coalesce(F.length(anchor), F.lit(0)) > 0)
    return F.when(present, F.substring(sentence, start, stop - start + 1))


def extract_date(text: Column) -> Column:
    return normalize_mention(F.regexp_extract(F.coalesce(text, F.lit("")), fixed.ANY_DATE, 0))


def extract_contract(text: Column) -> Column:
    """A title near by; else "agreement" where a strong marker stands."""
    t = normalize_mention(text)
    title = normalize_mention(F.regexp_extract(t, fixed.CONTRACT_TITLE_NEAR, 1))
    return F.when(title != "", title).when(t.rlike(fixed.STRONG_CONTRACT), "agreement").otherwise("")


def extract_jurisdiction(text: Column) -> Column:
    """What follows a phrase of place; else the longest known jurisdiction in the text."""
    t = F.coalesce(text, F.lit(""))
    near = normalize_mention(F.regexp_extract(t, fixed.JURISDICTION_NEAR, 1))
    names = sorted(fixed.KNOWN_JURISDICTIONS, key=lambda n: (-len(n), n))
    known = reduce(lambda c, n: c.when(F.lower(t).rlike(rf"\b{n}\b"), n), names[1:], F.when(F.lower(t).rlike(rf"\b{names[0]}\b"), names[0]))
    return F.when(near != "", near).otherwise(F.coalesce(known, F.lit("")))


def infer_type(value: Column, current: Column, bare: bool = False) -> Column:
    """DATE, CONTRACT or JURISDICTION by what the text holds, else the present label."""
    v = value if bare else normalize_mention(value)
    place = F.lower(v).rlike("|".join(fixed.KNOWN_JURISDICTIONS))
    return F.when(v.rlike(fixed.ANY_DATE), "DATE").when(v.rlike(fixed.STRONG_CONTRACT), "CONTRACT").when(place, "JURISDICTION").otherwise(current)


def is_entity_artifact(value: Column, bare: bool = False) -> Column:
    """Pronouns and clause numbers."""
    v = F.lower(value if bare else normalize_mention(value))
    parts = words(v)
    numbers = F.size(F.filter(parts, lambda w: w.rlike(r"^\d+$")))
    return (v == "") | v.isin(fixed.PRONOUN_ARTIFACTS) | v.rlike(r"^[\d\s]+$") | ((numbers >= 2) & (numbers >= F.size(parts) - 2))


def is_plausible_party(value: Column, bare: bool = False) -> Column:
    return ~is_entity_artifact(value, bare) & (infer_type(value, F.lit("PARTY"), bare) == "PARTY") & (mention_quality(value, bare) > 0)


def normalize_predicate(predicate: Column, whole_words: bool = False) -> Column:
    """The relation of the first rule whose phrase occurs; OTHER if none.

    Phrases are looked for as substrings ("is" occurs in "this");
    ``whole_words`` asks for word boundaries.
    """
    p = F.lower(F.btrim(predicate))
    has = (lambda k: p.rlike(rf"\b{k}\b")) if whole_words else (lambda k: p.contains(k))
    out = None
    for relation, phrases in fixed.PREDICATES:
        hit = reduce(lambda a, b: a | b, map(has, phrases))
        out = F.when(hit, relation) if out is None else out.when(hit, relation)
    return out.otherwise("OTHER")


def is_junk_predicate(predicate: Column) -> Column:
    """Fewer than six in ten characters are letters."""
    bare = F.replace(predicate, F.lit(" "))
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    return (F.length(bare) == 0) | (letters * 10 < F.length(bare) * 6)


def verbalize(subject: Column, predicate: Column, object_: Column, validated: Column) -> Column:
    return F.concat(subject, F.lit(" "), F.replace(predicate, F.lit("_"), F.lit(" ")), F.lit(" "), object_, F.lit("."), F.when(validated, "").otherwise(" [UNVERIFIED]"))


def relation_hints(query: Column) -> Column:
    """Distinct relation substrings that phrases of a query hint at."""
    q = F.lower(query)
    none = F.expr("cast(array() as array<string>)")
    parts = [F.when(q.contains(p), F.array(*map(F.lit, r))).otherwise(none) for p, r in fixed.RELATION_HINTS.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def heuristic_score(expected: Column, answer: Column) -> Column:
    """1 if the answer holds the expected text up to its bracket, 0 if not, -1 without one."""
    core = F.btrim(F.lower(F.substring_index(expected, "(", 1)))
    return F.when(F.coalesce(core, F.lit("")) == "", -1).when(F.lower(answer).contains(core), 1).otherwise(0)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 12 digits of the SHA-1 of the parts; a null counts as "None"."""
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined), 1, 12))


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """From the last "." or line end before ``start`` to the next after ``end`` (300 characters on if none), normalised."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    left = F.length(F.regexp_extract(before, r"(?s)^(.*[.\n])", 1))
    stop = F.length(F.regexp_extract(after, r"(?s)^([^.\n]*)[.\n]", 1))
    stop = F.when(after.rlike(r"[.\n]"), stop).otherwise(F.lit(300))
    return normalize_mention(F.substring(text, left + 1, end - left + stop), dashes=True)


