"""Text scalars, chunks and token sequences over documents, parts and fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import extract, phrases, punkt, triples
from . import fixtures
from .registry import in_list, query, table, values

#: Names of parts in the shapes that mentions take, beside those of the fixture.
PART_MENTIONS = """SELECT (p_partkey + 1000)::INT AS id, CASE p_partkey % 9 WHEN 0 THEN p_name || ', Inc.' WHEN 1 THEN upper(p_name) || ' LLC' WHEN 2 THEN p_name || ' Agreement ' || (1990 + p_size) WHEN 3 THEN 'State of ' || p_brand WHEN 4 THEN p_name || ', ' || p_type || ', and Sons'
WHEN 5 THEN substring(p_name, 1, 2) WHEN 6 THEN '  "' || p_name || '"  ' WHEN 7 THEN p_size || ' units ' || p_partkey || ' ' || p_size ELSE 'the ' || p_name || ' Holdings Co., Ltd.' END AS t,
CASE p_partkey % 4 WHEN 0 THEN 'CONTRACT' WHEN 1 THEN 'JURISDICTION' ELSE 'PARTY' END AS label, p_brand AS filename FROM part"""
MENTIONS = values("m0", "id, t, label, filename", fixtures.MENTIONS) + f", m AS (SELECT * FROM m0 UNION ALL {PART_MENTIONS})"
STRIP = " || chr(9) || chr(13) || chr(10) || ',.;:()[]{}\"'''"
SUFFIXES = in_list(fixed.ENTITY_SUFFIXES)


def by_rest(number, *values):
    """The value whose place is the rest of a number by how many there are."""
    out = None
    for i, v in enumerate(values):
        out = F.when(number % len(values) == i, v) if out is None else out.when(number % len(values) == i, v)
    return out


def said(*parts):
    """Columns as text, one behind the other; a str is itself."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def mentions(spark, sf_dir):
    """(id, t, label, filename) of the fixture and of all parts."""
    own = spark.createDataFrame(fixtures.MENTIONS, "id int, t string, label string, filename string")
    name, key, size = F.col("p_name"), F.col("p_partkey"), F.col("p_size")
    shapes = (
        said(name, ", Inc."), said(F.upper(name), " LLC"), said(name, " Agreement ", size + 1990), said("State of ", F.col("p_brand")), said(name, ", ", F.col("p_type"), ", and Sons"),
        F.substring(name, 1, 2), said('  "', name, '"  '), said(size, " units ", key, " ", size), said("the ", name, " Holdings Co., Ltd."),
    )
    labels = by_rest(key, F.lit("CONTRACT"), F.lit("JURISDICTION"), F.lit("PARTY"), F.lit("PARTY"))
    return own.union(table(spark, sf_dir, "part").select((key + 1000).cast("int"), by_rest(key, *shapes), labels, "p_brand"))


def norm_sql(c: str) -> str:
    return f"trim(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), ' '), ' '{STRIP})"


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({norm_sql(c)}), '[^a-z0-9&'' ]+', ' ', 'g'), ' '), lambda x: x <> '')"


def party_tokens_sql(c: str) -> str:
    return f"list_filter({tokens_sql(c)}, lambda x: x NOT IN {SUFFIXES})"


def key_sql(c: str, label: str) -> str:
    return f"CASE WHEN {label} = 'PARTY' THEN array_to_string({party_tokens_sql(c)}, ' ') ELSE array_to_string({tokens_sql(c)}, ' ') END"


def acronym_sql(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN {SUFFIXES}), lambda x: x[1]), '')"


def years_sql(c: str) -> str:
    return f"list_distinct(regexp_extract_all({c}, '\\b(?:19|20)\\d{{2}}\\b'))"


@query(
    r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
       '(?i)\bPage\s+\d+\s+of\s+\d+\b', '', 'g'), '(?m)^\s*\d+\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
       '[ \t]+', ' ', 'g'), '[^\p{L}\p{N}_\s.,;:()\-$%/'']', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)) AS cleaned
FROM documents"""
)
def clean_text(spark, sf_dir):
    """TXT1 over whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query(
    f"""WITH {MENTIONS}
SELECT id, {norm_sql("t")} AS normalized, {key_sql("t", "label")} AS key, array_to_string(list_sort(list_distinct({tokens_sql("t")})), ' ') AS tokens,
       {acronym_sql("t")} AS acronym, array_to_string(list_sort({years_sql("t")}), ' ') AS years,
       'm_' || substring(sha1(id || '||' || t), 1, 12) AS stable_id FROM m"""
)
def mention_keys(spark, sf_dir):
    """TXT2 to TXT6 and stable ids."""
    t, m = F.col("t"), mentions(spark, sf_dir)
    return m.select(
        "id",
        text.normalize_mention(t).alias("normalized"),
        text.canonical_key(t, F.col("label")).alias("key"),
        F.array_join(F.array_sort(text.token_set(t)), " ").alias("tokens"),
        text.acronym(t).alias("acronym"),
        F.array_join(F.array_sort(text.years(t)), " ").alias("years"),
        text.stable_id("m", F.col("id"), t).alias("stable_id"),
    )


QUALITY = f"""CASE WHEN length(n) < 2 OR regexp_full_match(n, '[\\W_]+') OR len(list_filter(regexp_split_to_array(n, '\\s+'), lambda x: x <> '')) > 8
       OR regexp_matches(n, '{fixed.BOILERPLATE}') OR regexp_full_match(n, '(?i)[a-z]\\s*\\*+') OR regexp_full_match(n, '\\d+')
       OR regexp_full_match(n, '(?i)[a-z]{{1,2}}') OR length(n) - length(replace(n, ',', '')) >= 2 THEN 0.0::DOUBLE
       WHEN regexp_full_match(n, '[A-Z]{{1,3}}') THEN 0.45::DOUBLE WHEN length(n) <= 3 THEN 0.35::DOUBLE
       WHEN regexp_matches(n, '{fixed.LEGAL_KEYWORD}') THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END"""
ARTIFACT = f"""(lower(n) = '' OR lower(n) IN {in_list(fixed.PRONOUN_ARTIFACTS)} OR regexp_full_match(n, '[\\d\\s]+')
       OR (len(list_filter(string_split(n, ' '), lambda x: regexp_full_match(x, '\\d+'))) >= 2
           AND len(list_filter(string_split(n, ' '), lambda x: regexp_full_match(x, '\\d+'))) >= len(list_filter(string_split(n, ' '), lambda x: x <> '')) - 2))"""


def infer_sql(n: str, current: str) -> str:
    return f"""CASE WHEN regexp_matches({n}, '{fixed.ANY_DATE}') THEN 'DATE' WHEN regexp_matches({n}, '{fixed.STRONG_CONTRACT}') THEN 'CONTRACT'
       WHEN regexp_matches(lower({n}), '{"|".join(fixed.KNOWN_JURISDICTIONS)}') THEN 'JURISDICTION' ELSE {current} END"""


@query(
    f"""WITH {MENTIONS}, k AS (SELECT *, {norm_sql("t")} AS n FROM m),
q AS (SELECT *, {QUALITY} AS quality, {ARTIFACT} AS artifact, {infer_sql("n", "label")} AS inferred, {infer_sql("n", "'PARTY'")} AS as_party FROM k)
SELECT id, quality, length(n) >= 2 AND NOT regexp_full_match(n, '[\\W_]+') AS informative,
       length(trim(t, ' ')) BETWEEN 3 AND 80 AND lower(trim(t, ' ')) NOT IN {in_list(fixed.QUERY_STOP_WORDS + fixed.GENERIC_ROLES)} AS valid_entity,
       trim(trim(t, ' '), ',.;:''"') AS entity_text,
       trim(trim(regexp_replace(trim(t, ' '), '(?i)(?:[,.\\s]*\\b(?:{fixed.LEGAL_SUFFIX})\\.?[\\s,.]*)+$', ''), ' '), ',.') AS core_name,
       inferred, artifact, NOT artifact AND as_party = 'PARTY' AND quality > 0 AS plausible_party FROM q"""
)
def mention_judgements(spark, sf_dir):
    """TXT7 to TXT11 and TXT17 to TXT19."""
    t = F.col("t")
    return mentions(spark, sf_dir).select(
        "id",
        text.mention_quality(t).alias("quality"),
        text.is_informative(t).alias("informative"),
        text.is_valid_entity(t).alias("valid_entity"),
        text.normalize_entity(t).alias("entity_text"),
        text.strip_legal_suffix(t).alias("core_name"),
        text.infer_type(t, F.col("label")).alias("inferred"),
        text.is_entity_artifact(t).alias("artifact"),
        text.is_plausible_party(t).alias("plausible_party"),
    )


def predicate_sql(p: str) -> str:
    rules = " ".join(f"WHEN {' OR '.join(f'contains({p}, {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{r}'" for r, keys in fixed.PREDICATES)
    return f"CASE {rules} ELSE 'OTHER' END"


@query(
    f"""WITH {values("p0", "id, t", fixtures.PREDICATES)}, p AS (SELECT * FROM p0 UNION ALL SELECT (p_partkey + 1000)::INT, CASE p_partkey % 7 WHEN 0 THEN 'entered into ' || p_name WHEN 1 THEN p_name || ' (' || p_size || ')' WHEN 2 THEN upper(p_name) WHEN 3 THEN 'is ' || p_name
WHEN 4 THEN '(' || p_size || ') ' || p_partkey WHEN 5 THEN 'shall be governed by_' || p_type ELSE 'of' END FROM part)
SELECT id, {predicate_sql("lower(trim(t, ' '))")} AS relation, length(replace(t, ' ', '')) = 0
       OR length(regexp_replace(replace(t, ' ', ''), '[^\\p{{L}}]', '', 'g')) * 10 < length(replace(t, ' ', '')) * 6 AS junk,
       lower(t) IN {in_list(fixed.GARBAGE_PREDICATES)} AS garbage, 'a ' || replace(t, '_', ' ') || ' b.' || CASE WHEN id % 2 = 0 THEN '' ELSE ' [UNVERIFIED]' END AS said FROM p"""
)
def predicate_rules(spark, sf_dir):
    """TXT20 to TXT22 and the garbage list of FIL2."""
    t, name, key, size = F.col("t"), F.col("p_name"), F.col("p_partkey"), F.col("p_size")
    shapes = (said("entered into ", name), said(name, " (", size, ")"), F.upper(name), said("is ", name), said("(", size, ") ", key), said("shall be governed by_", F.col("p_type")), F.lit("of"))
    p = spark.createDataFrame(fixtures.PREDICATES, "id int, t string").union(table(spark, sf_dir, "part").select((key + 1000).cast("int"), by_rest(key, *shapes)))
    return p.select(
        "id",
        text.normalize_predicate(t).alias("relation"),
        text.is_junk_predicate(t).alias("junk"),
        F.lower(t).isin(fixed.GARBAGE_PREDICATES).alias("garbage"),
        text.verbalize(F.lit("a"), t, F.lit("b"), F.col("id") % 2 == 0).alias("said"),
    )


_KNOWN = sorted(fixed.KNOWN_JURISDICTIONS, key=lambda n: (-len(n), n))
_NEAR = norm_sql(f"regexp_extract(w, '{fixed.JURISDICTION_NEAR}', 1)")
_TITLE = norm_sql("regexp_extract(" + norm_sql("w") + ", '" + fixed.CONTRACT_TITLE_NEAR.replace("'", "''") + "', 1)")


@query(
    f"""WITH {values("s0", "id, t, a", fixtures.SENTENCES)}, s AS (SELECT * FROM s0 UNION ALL SELECT (c_custkey + 1000)::INT, CASE c_custkey % 5 WHEN 0 THEN 'The Supply Agreement of ' || c_name || ' is effective as of March 4, 20' || (c_nationkey + 10) || ' and no later.'
WHEN 1 THEN repeat(c_mktsegment || ' ', 12) || c_name || ' is organized under the laws of Delaware, with ' || repeat(c_mktsegment || ' ', 12) WHEN 2 THEN c_name || ' was seated in new york on 3/4/20' || (c_nationkey + 10) || '.' WHEN 3 THEN 'Nothing about anyone.' ELSE 'In Ohio ' || lower(c_name) || ' signed the License.' END, c_name FROM customer),
x AS (SELECT *, CASE WHEN instr(lower(t), lower(a)) > 0 THEN substring(t, greatest(1, instr(lower(t), lower(a)) - 80),
      least(length(t), instr(lower(t), lower(a)) - 1 + length(a) + 80) - greatest(1, instr(lower(t), lower(a)) - 80) + 1) END AS w FROM s)
SELECT id, w AS around, {norm_sql(f"regexp_extract(coalesce(w, ''), '{fixed.ANY_DATE}', 0)")} AS date_text,
       CASE WHEN {_TITLE} <> '' THEN {_TITLE} WHEN regexp_matches({norm_sql("w")}, '{fixed.STRONG_CONTRACT}') THEN 'agreement' ELSE '' END AS contract_text,
       CASE WHEN {_NEAR} <> '' THEN {_NEAR} {" ".join(f"WHEN regexp_matches(lower(coalesce(w, '')), '{chr(92)}b{n}{chr(92)}b') THEN '{n}'" for n in _KNOWN)} ELSE '' END AS place_text
FROM x"""
)
def pattern_windows(spark, sf_dir):
    """TXT15 and TXT16."""
    name, key, year, market = F.col("c_name"), F.col("c_custkey"), F.col("c_nationkey") + 10, F.repeat(said(F.col("c_mktsegment"), " "), F.lit(12))
    shapes = (
        said("The Supply Agreement of ", name, " is effective as of March 4, 20", year, " and no later."), said(market, name, " is organized under the laws of Delaware, with ", market), said(name, " was seated in new york on 3/4/20", year, "."),
        F.lit("Nothing about anyone."), said("In Ohio ", F.lower(name), " signed the License."),
    )
    own = spark.createDataFrame(fixtures.SENTENCES, "id int, t string, a string")
    s = own.union(table(spark, sf_dir, "customer").select((key + 1000).cast("int"), by_rest(key, *shapes), name)).withColumn("w", text.window_around(F.col("t"), F.col("a")))
    w = F.col("w")
    return s.select("id", w.alias("around"), text.extract_date(w).alias("date_text"), text.extract_contract(w).alias("contract_text"), text.extract_jurisdiction(w).alias("place_text"))


SENTS = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"


@query(f"SELECT doc_id, i::INT AS sid, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTS} AS s FROM documents))")
def sentences(spark, sf_dir):
    """TXT13: a row per sentence."""
    return extract.sentences(table(spark, sf_dir, "documents"))


@query(
    f"""WITH d AS (SELECT doc_id, {SENTS} AS s FROM documents WHERE len({SENTS}) > 0)
SELECT doc_id, (i // 8)::INT AS chunk, array_to_string(s[i + 1 : i + 10], ' ') AS text FROM (SELECT doc_id, s, unnest(range(0, len(s), 8)) AS i FROM d)"""
)
def chunks(spark, sf_dir):
    """EXP1: ten sentences, two of them shared with the next chunk."""
    return extract.chunks(table(spark, sf_dir, "documents"))


@query(
    f"""WITH d AS (SELECT lang, doc_id, len({SENTS}) AS n, length(text) AS c FROM documents)
SELECT lang, count(*)::BIGINT AS docs, sum(n)::BIGINT AS sentences, sum(ceil(n / 8.0))::BIGINT AS chunks, max(c)::BIGINT AS longest FROM d GROUP BY ROLLUP (lang)"""
)
def corpus_stats(spark, sf_dir):
    """AGG1: totals by language and over all."""
    d = table(spark, sf_dir, "documents").select("lang", F.size(extract.sentence_array(F.col("text"))).alias("n"), F.length("text").alias("c"))
    return d.rollup("lang").agg(
        F.count("*").alias("docs"), F.sum("n").alias("sentences"), F.sum(F.ceil(F.col("n") / 8)).alias("chunks"), F.max("c").cast("long").alias("longest")
    )


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_hash_groups(spark, sf_dir):
    """Identity by content."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


TOKENS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '')"
_G = ", ".join(f"lower(w) IN {in_list(v)} AS {k}" for k, v in fixed.GAZETTEERS.items())


@query(
    f"""WITH t AS (SELECT doc_id, i AS pos, w[i] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents))),
f AS (SELECT doc_id, pos, w, lower(w) AS lw, lag(lower(w), 1) OVER x AS p1, lag(lower(w), 2) OVER x AS p2, lead(lower(w), 1) OVER x AS n1, lead(lower(w), 2) OVER x AS n2, {_G}
      FROM t WINDOW x AS (PARTITION BY doc_id ORDER BY pos))
SELECT p1 IS NULL AS bos, n1 IS NULL AS eos, is_month, is_legal_term, is_date_indicator, count(*)::BIGINT AS n, count(DISTINCT right(lw, 3))::BIGINT AS suffixes,
       count(p2)::BIGINT AS with_p2, count(n2)::BIGINT AS with_n2 FROM f GROUP BY ALL"""
)
def token_features(spark, sf_dir):
    """TXT24 and WIN5: features of each token and its neighbours, summed up."""
    f = extract.token_features(table(spark, sf_dir, "documents"))
    return f.groupBy(F.col("p1").isNull().alias("bos"), F.col("n1").isNull().alias("eos"), "is_month", "is_legal_term", "is_date_indicator").agg(
        F.count("*").alias("n"), F.countDistinct("suffix3").alias("suffixes"), F.count("p2").alias("with_p2"), F.count("n2").alias("with_n2")
    )


def _bare_sql(token: str) -> str:
    w = f"""lower(regexp_replace(regexp_replace({token}, '^["''(\\[{{]+', ''), '["'')\\]}},;:!?]+$', ''))"""
    return f"CASE WHEN regexp_matches({w}, '^-?[.,]?\\d[\\d,.-]*\\.$') THEN '##number##.' WHEN regexp_matches({w}, '^-?[.,]?\\d[\\d,.-]*$') THEN '##number##' ELSE {w} END"


def _type_sql(w: str) -> str:
    return f"regexp_replace({w}, '\\.$', '')"


_BLANK = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_LOG = "ln(greatest({}, 1e-12))"
_PUNKT = f"""pw AS (SELECT {_bare_sql("t")} AS w FROM (SELECT unnest({_BLANK.format("coalesce(text, '')")}) AS t FROM documents)),
pc AS (SELECT {_type_sql("w")} AS type, count(*) AS n, count(*) FILTER (ends_with(w, '.')) AS k FROM pw WHERE regexp_matches(w, '[^.]') GROUP BY 1),
pt AS (SELECT sum(n)::DOUBLE AS all_n, sum(k)::DOUBLE AS all_k FROM pc),
pl AS (SELECT *, length(type) - length(replace(type, '.', '')) AS inside, all_k / all_n AS p FROM pc, pt WHERE k > 0 AND regexp_matches(type, '\\p{{L}}')),
pa AS (SELECT type, -2 * (k * {_LOG.format("p")} + (n - k) * {_LOG.format("1 - p")} - k * ln(0.99::DOUBLE) - (n - k) * ln(1 - 0.99::DOUBLE)) * exp(-(length(type) - inside)) * (inside + 1) * pow((length(type) - inside)::DOUBLE, -(n - k)) AS score FROM pl),
short AS (SELECT type, score FROM pa WHERE score >= {punkt.ABBREVIATION}),
pp AS (SELECT doc_id, i, p[i] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]["'')\\]]{{0,3}})(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents))),
pq AS (SELECT doc_id, i, piece, {_bare_sql("w[-1]")} AS last, w[1] AS first FROM (SELECT *, {_BLANK.format("piece")} AS w FROM pp)),
pr AS (SELECT *, lead(first) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM pq),
pe AS (SELECT next, {_type_sql("last")} AS type FROM pr WHERE next IS NOT NULL),
pf AS (SELECT * FROM pe WHERE type NOT IN (SELECT type FROM short) AND NOT regexp_matches(type, '^(\\p{{L}}|##number##)$')),
ps AS (SELECT type, pc.n::DOUBLE AS b, first::DOUBLE AS ab, (SELECT count(*) FROM pf)::DOUBLE AS a, all_n AS n FROM (SELECT {_type_sql(_bare_sql("next"))} AS type, count(*) AS first FROM pf GROUP BY 1) JOIN pc USING (type), pt WHERE regexp_matches(type, '^\\p{{L}}+$')),
pu AS (SELECT type, ab / a > b / n AND n > a AS more, -2 * (ab * {_LOG.format("b / n")} + (a - ab) * {_LOG.format("1 - b / n")} + (b - ab) * {_LOG.format("b / n")} + (n - a - b + ab) * {_LOG.format("1 - b / n")}
  - ab * {_LOG.format("ab / a")} - (a - ab) * {_LOG.format("1 - ab / a")} - (b - ab) * {_LOG.format("(b - ab) / (n - a)")} - (n - a - b + ab) * {_LOG.format("1 - (b - ab) / (n - a)")}) AS score FROM ps),
starts AS (SELECT type, score FROM pu WHERE more AND score >= {punkt.STARTER})"""


@query(f"WITH {_PUNKT} SELECT 'abbreviation' AS kind, type, round(score, 6) AS score FROM short UNION ALL SELECT 'starter', type, round(score, 6) FROM starts")
def punkt_types(spark, sf_dir):
    """TXT13: abbreviations and sentence starters as the documents show them."""
    short, first = punkt.learn(table(spark, sf_dir, "documents"))
    return short.select(F.lit("abbreviation").alias("kind"), "type", F.round("score", 6).alias("score")).union(first.select(F.lit("starter"), "type", F.round("score", 6)))


@query(
    f"""WITH {_PUNKT}, x AS (SELECT doc_id, i, piece, CASE WHEN ends_with(last, '.') THEN {_type_sql("last")} END AS type, {_type_sql(_bare_sql("next"))} AS start, regexp_replace(next, '^["''(\\[{{]+', '') AS head FROM pr),
y AS (SELECT *, coalesce(((type IN (SELECT type FROM short) OR regexp_matches(type, '^\\p{{L}}$')) AND NOT (regexp_matches(head, '^\\p{{Lu}}') AND start IN (SELECT type FROM starts))) OR (type = '##number##' AND regexp_matches(head, '^\\p{{Ll}}')), FALSE) AS goes_on FROM x),
z AS (SELECT *, coalesce(sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM y),
g AS (SELECT doc_id, k, regexp_replace(string_agg(piece, '' ORDER BY i), '^\\s+|\\s+$', '', 'g') AS sentence FROM z GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k)::INT AS sid, sentence FROM g WHERE sentence <> ''"""
)
def punkt_sentences(spark, sf_dir):
    """TXT13: sentences of all documents by ends learnt from them."""
    d = table(spark, sf_dir, "documents")
    return punkt.sentences(d, *punkt.learn(d))


def _feature_sql() -> str:
    w = "w"
    shape = f"""lower({w}) AS lower, regexp_matches({w}, '\\p{{L}}') AND upper({w}) = {w} AS is_upper, regexp_matches({w}, '{extract.TITLE_CASE}') AS is_title, regexp_full_match({w}, '\\d+') AS is_digit, contains({w}, '-') AS has_hyphen,
regexp_matches({w}, '\\d') AS has_digit, regexp_matches({w}, '[.,;:]') AS has_mark, left(lower({w}), 2) AS prefix2, left(lower({w}), 3) AS prefix3, right(lower({w}), 2) AS suffix2, right(lower({w}), 3) AS suffix3, least(length({w}), 20)::INT AS length,
regexp_matches({w}, '\\p{{L}}') AND upper({w}) = {w} AND length({w}) > 1 AS is_all_caps, starts_with({w}, '$') OR lower({w}) IN {in_list(fixed.CURRENCY)} AS has_currency, lower({w}) IN {in_list(fixed.SECTIONS)} AS is_section, {_G}"""
    near = ", ".join(
        f"{'lag' if side[0] == 'p' else 'lead'}({c}, {side[1]}) OVER x AS {side if c == 'lower' else f'{side}_{c}'}" for side, names in extract.AROUND.items() for c in ("lower", *names)
    )
    return f"""WITH t AS (SELECT conv_id, turn, i AS pos, w[i] AS w FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, {TOKENS} AS w FROM conversations))),
f AS (SELECT conv_id, turn, pos, w, {shape} FROM t), g AS (SELECT *, {near}, lag(pos) OVER x IS NULL AS bos, lead(pos) OVER x IS NULL AS eos FROM f WINDOW x AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT conv_id, turn, pos::INT AS pos, {", ".join(extract.WORD_FEATURES)} FROM g"""


@query(_feature_sql())
def word_features(spark, sf_dir):
    """TXT24 in full: every feature of every word of the conversations, neighbours' included."""
    c = table(spark, sf_dir, "conversations").withColumn("sid", F.struct("conv_id", "turn"))
    f = extract.token_features(c, "sid")
    return f.select("sid.conv_id", "sid.turn", "pos", *extract.WORD_FEATURES)


_RANK = f"""SELECT doc_id, i AS sid, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTS} AS s FROM documents))"""


@query(
    f"""WITH s AS ({_RANK}), k AS (SELECT doc_id, sid, row_number() OVER (PARTITION BY doc_id ORDER BY sid) AS rn FROM s
  WHERE len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '')) BETWEEN 5 AND 30 AND regexp_matches(sentence, '\\p{{Lu}}'))
SELECT doc_id, sid::INT AS sid, rn::INT AS rn, ((rn - 1) // 20)::INT AS batch FROM k WHERE rn <= 20"""
)
def label_samples(spark, sf_dir):
    """EXP9: the first 20 sentences of a document that suit labelling."""
    return extract.label_samples(table(spark, sf_dir, "documents"))


BIO = [
    (1, 1, "Acme", "B-PARTY"), (1, 2, "Widgets", "I-PARTY"), (1, 3, "Inc", "I-PARTY"), (1, 4, "pays", "O"), (1, 5, "Beta", "B-PARTY"), (1, 6, "Gamma", "B-PARTY"),
    (1, 7, "on", "O"), (1, 8, "Monday", "I-DATE"), (1, 9, "by", "O"), (2, 1, "Ohio", "B-JURISDICTION"), (2, 2, "law", "I-PARTY"), (3, 1, "no", "O"), (3, 2, "Delta", "B-PARTY"),
]


@query(
    f"""WITH {values("t0", "sid, pos, word, tag", BIO)}, tw AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations),
t AS (SELECT * FROM t0 UNION ALL SELECT (conv_id * 1000 + turn + 10)::INT, i::INT, w[i], CASE i % 7 WHEN 1 THEN 'B-PARTY' WHEN 2 THEN 'I-PARTY' WHEN 3 THEN 'I-PARTY' WHEN 5 THEN 'I-DATE' WHEN 6 THEN 'B-DATE' ELSE 'O' END FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM tw)),
g AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY pos) AS run FROM t),
e AS (SELECT sid, run, min(pos) AS start, min_by(tag, pos) AS first, string_agg(word, ' ' ORDER BY pos) AS text FROM g GROUP BY sid, run)
SELECT sid, start::INT AS start, substring(first, 3) AS label, text FROM e WHERE first LIKE 'B-%'"""
)
def bio_decode(spark, sf_dir):
    """EXP5: entities from tags; an I- without an open entity is left out."""
    c = extract.tokens(table(spark, sf_dir, "conversations").withColumn("sid", (F.col("conv_id") * 1000 + F.col("turn") + 10).cast("int")), "sid")
    tag = by_rest(F.col("pos"), *map(F.lit, ("O", "B-PARTY", "I-PARTY", "I-PARTY", "O", "I-DATE", "B-DATE")))
    return extract.bio_decode(spark.createDataFrame(BIO, "sid int, pos int, word string, tag string").union(c.select("sid", "pos", F.col("w"), tag)))


SPANS = [(1, 0, 12, "PARTY"), (1, 18, 23, "PARTY"), (2, 4, 12, "DATE")]
LINES = [(1, "Acme Widgets pays Beta, promptly."), (2, "On 4 March all is due."), (3, "")]


def bio_sql(cond: str) -> str:
    turns = "(conv_id * 1000 + turn + 10)::INT"
    return f"""WITH {values("s0", "sid, t", LINES)}, {values("e0", "sid, a, b, label", SPANS)}, s AS (SELECT * FROM s0 UNION ALL SELECT {turns}, text FROM conversations WHERE text IS NOT NULL),
e AS (SELECT * FROM e0 UNION ALL SELECT {turns}, 0, 12, 'PARTY' FROM conversations UNION ALL SELECT {turns}, 20 + (conv_id % 9)::INT, 37, 'DATE' FROM conversations),
w AS (SELECT sid, i AS pos, p[i] AS word, (len(array_to_string(p[1 : i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS ws
      FROM (SELECT sid, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT sid, string_split(t, ' ') AS p FROM s WHERE t <> ''))),
j AS (SELECT w.sid, pos, word, a, label, row_number() OVER (PARTITION BY w.sid, pos ORDER BY a) AS k,
      row_number() OVER (PARTITION BY w.sid, a ORDER BY pos) AS nth FROM w LEFT JOIN e ON w.sid = e.sid AND {cond})
SELECT sid, pos::INT AS pos, word, CASE WHEN label IS NULL THEN 'O' WHEN nth = 1 THEN 'B-' || label ELSE 'I-' || label END AS tag FROM j WHERE k = 1"""


def lines_and_spans(spark, sf_dir):
    """The fixture's lines and spans, and turns of conversations with two spans each."""
    c = table(spark, sf_dir, "conversations").withColumn("sid", (F.col("conv_id") * 1000 + F.col("turn") + 10).cast("int"))
    lines = spark.createDataFrame(LINES, "sid int, t string").union(c.filter("text is not null").select("sid", "text"))
    spans = spark.createDataFrame(SPANS, "sid int, a int, b int, label string").union(c.select("sid", F.lit(0), F.lit(12), F.lit("PARTY")))
    return lines, spans.union(c.select("sid", (F.col("conv_id") % 9 + 20).cast("int"), F.lit(37), F.lit("DATE")))


@query(bio_sql("ws >= a AND ws + length(word) <= b"))
def bio_encode(spark, sf_dir):
    """EXP3: a word inside a span takes its tag."""
    return extract.bio_encode(*lines_and_spans(spark, sf_dir))


@query(bio_sql("ws < b AND ws + length(word) > a"))
def bio_encode_overlap(spark, sf_dir):
    """EXP4: a word that overlaps a span takes its tag."""
    return extract.bio_encode(*lines_and_spans(spark, sf_dir), overlap=True)


@query()
def extracted_mentions(spark, sf_dir):
    """EXP2 over all documents and the fixture."""
    return extract.mentions(fixtures.with_documents(spark, sf_dir))


@query(
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, sum(n) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)::BIGINT AS context_chars FROM t
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def context_windows(spark, sf_dir):
    """WIN6: what the ten turns before hold."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"), F.sum("n").over(w.rowsBetween(-10, -1)).alias("context_chars"))


def _class_sql(w: str) -> str:
    low = f"lower({w})"
    forms = sorted({v[:-1] + e if v.endswith("e") and e in ("ed", "ing", "es") else v + e for v in fixed.VERBS for e in ("", "s", "es", "d", "ed", "ing")} | set(fixed.IRREGULAR_VERBS))
    base = f"regexp_replace(regexp_replace({low}, '(?:e?s|e?d|ing)$', ''), 'e$', '')"
    small = f"regexp_matches({w}, '^\\p{{Ll}}')"
    return f"""CASE WHEN {low} IN {in_list(fixed.AUXILIARIES)} THEN 'A' WHEN {low} IN {in_list(fixed.ADVERBS)} OR ({small} AND regexp_matches({low}, '^\\p{{L}}{{2,}}ly$')) THEN 'R' WHEN {low} IN {in_list(fixed.PREPOSITIONS)} THEN 'P'
WHEN {small} AND ({low} IN {in_list(forms)} OR (regexp_matches({low}, '^\\p{{L}}{{2,}}(?:ed|ing)$') AND length({base}) >= 3)) THEN 'V' ELSE 'O' END"""


#: The phrase as a pattern over the letters of the words' classes, a twin of the fold.
_PHRASE = "A[AR]*[VP]?[PR]*|V[PR]*"


@query(
    f"""WITH s AS (SELECT doc_id, i AS sid, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTS} AS s FROM documents))),
w AS (SELECT doc_id, sid, list_filter(list_transform({_BLANK.format("sentence")}, lambda x: regexp_replace(x, '^["''(\\[{{,.;:]+|["'')\\]}},.;:!?]+$', '', 'g')), lambda x: x <> '') AS w FROM s),
c AS (SELECT doc_id, sid, w, array_to_string(list_transform(w, lambda x: {_class_sql("x")}), '') AS c FROM w),
p AS (SELECT *, regexp_extract(c, '{_PHRASE}') AS p, len(regexp_extract(c, '^[^AV]*')) AS a FROM c)
SELECT doc_id, sid::INT AS sid, CASE WHEN p <> '' THEN lower(array_to_string(w[a + 1 : a + len(p)], ' ')) WHEN len(w) BETWEEN 1 AND 5 THEN array_to_string(w, ' ') END AS phrase FROM p"""
)
def verb_phrases(spark, sf_dir):
    """NLP3: the verb phrase of every sentence of the documents."""
    s = extract.sentences(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "sid", phrases.verb_phrase(F.col("sentence")).alias("phrase"))


@query()
def relation_pairs(spark, sf_dir):
    """EXP10, JOI6, JOI7 and JOI17: names in one sentence and the words between them, over all documents and the fixture."""
    d = fixtures.with_documents(spark, sf_dir)
    names = extract.mentions(d).select("doc_id", F.col("text").alias("name"), "label")
    spans = extract.occurrences(d, names).select("doc_id", F.col("name").alias("text"), "label", "start", "end")
    s = extract.sentence_spans(d)
    return triples.entity_pairs(s, spans)
