"""The SQL surface, and training records of several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..operators import records
from ..session import scratch
from .registry import ORACLE_SQL, query, table
from .text_queries import chunks  # noqa: F401  (its SQL is that of ``sql_chunks`` too)


def _documents_view(spark, sf_dir) -> None:
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_of_sql")


@query(ORACLE_SQL["chunks"])
def sql_chunks(spark, sf_dir):
    """SQL surface: chunks of all documents by a table function."""
    _documents_view(spark, sf_dir)
    return spark.sql("SELECT d.doc_id, c.chunk, c.text FROM documents_of_sql d, LATERAL text_chunks(d.text, 10, 2) c")


@query(
    """WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) AS sentence FROM documents),
t AS (SELECT doc_id, sentence, regexp_extract_all(lower(sentence), '[a-z0-9]+') AS w FROM s)
SELECT doc_id, count(*)::BIGINT AS sentences, sum(len(w))::BIGINT AS tokens, count(*) FILTER (length(replace(sentence, ' ', '')) = 0 OR length(regexp_replace(replace(sentence, ' ', ''), '[^\\p{L}]', '', 'g')) * 10 < length(replace(sentence, ' ', '')) * 6)::BIGINT AS junk FROM t GROUP BY doc_id"""
)
def sql_sentences(spark, sf_dir):
    """SQL surface: sentences by a table function, counted by scalar ones."""
    _documents_view(spark, sf_dir)
    return spark.sql(
        "SELECT d.doc_id, count(*) AS sentences, sum(size(search_tokens(s.sentence))) AS tokens, count_if(is_junk_predicate(s.sentence)) AS junk FROM documents_of_sql d, LATERAL text_sentences(d.text) s GROUP BY d.doc_id"
    )


# One word in eleven is its own key, one in five hundred has a wrong key, and a seventh of the conversations no labels.
_WORDS_OF = "list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')"


def labelled_turns(spark, sf_dir):
    """Turns of conversations as records of labelled words, some of them damaged by rules of their place."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")

    def item(w, i):
        label = F.when(w.rlike("^[A-Z]"), "B-NAME").otherwise("O")
        return F.when(i % 11 == 10, F.to_json(F.map_from_arrays(F.array(w), F.array(label)))).when((i % 500 == 499), F.to_json(F.struct(w.alias("word"), label.alias("tag")))).otherwise(F.to_json(F.struct(w.alias("word"), label.alias("label"))))

    labels = F.when(F.col("conv_id") % 7 == 3, F.array().cast("array<string>")).otherwise(F.transform(words, item))
    return c.select(F.col("text").alias("sentence"), labels.alias("labels"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("source_file"))


_LABELLED = f"""w AS (SELECT conv_id, turn, text, {_WORDS_OF} AS w FROM conversations WHERE text IS NOT NULL), x AS (SELECT *, CASE WHEN conv_id % 7 = 3 THEN 0 ELSE len(w) END AS n FROM w),
r AS (SELECT *, CASE WHEN n = 0 THEN 'skipped' WHEN len(list_filter(range(n), lambda i: regexp_matches(w[i + 1], '^[A-Z]'))) > 0 THEN 'kept' ELSE 'unlabelled' END AS status, n // 11 AS rec FROM x)"""


@query(
    f"""WITH {_LABELLED}, s AS (SELECT *, CASE WHEN n >= 500 AND len(list_filter(range(n), lambda i: i % 500 = 499 AND i % 11 <> 10)) > 0 THEN 'broken' ELSE status END AS st FROM r)
SELECT count(*)::BIGINT AS sentences, count(*) FILTER (st = 'kept')::BIGINT AS kept, count(*) FILTER (st = 'unlabelled')::BIGINT AS unlabelled, count(*) FILTER (st IN ('skipped', 'broken'))::BIGINT AS skipped,
count(*) FILTER (st IN ('kept', 'unlabelled') AND rec > 0)::BIGINT AS with_recovery, coalesce(sum(rec) FILTER (st IN ('kept', 'unlabelled')), 0)::BIGINT AS recovered_items FROM s"""
)
def record_counts(spark, sf_dir):
    """EXP7: what became of the records, counted in the pass that writes them."""
    counts = records.write_training(records.read_labelled(labelled_turns(spark, sf_dir)), scratch(spark, "training"))
    return spark.createDataFrame([tuple(counts[c] for c in records.COUNTS)], ", ".join(f"{c} long" for c in records.COUNTS))


@query(
    f"""WITH {_LABELLED}, k AS (SELECT *, regexp_extract_all(text, '[ \\t\\r\\n]+') AS seps, CASE WHEN regexp_matches(text, '^[ \\t\\r\\n]') THEN 1 ELSE 0 END AS lead FROM r
  WHERE status = 'kept' AND (n < 500 OR len(list_filter(range(n), lambda i: i % 500 = 499 AND i % 11 <> 10)) = 0)),
e AS (SELECT 'c' || conv_id || '-' || turn AS source_file, w[i] AS word, (len(array_to_string(w[1 : i - 1], '')) + len(array_to_string(seps[1 : i - 1 + lead], '')))::INT AS a FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM k) WHERE regexp_matches(w[i], '^[A-Z]'))
SELECT 'labelled' AS origin, source_file, a AS start, (a + length(word))::INT AS "end", 'NAME' AS label, word AS entity FROM e
UNION ALL SELECT 'spans', NULL, 0, length(regexp_extract(text, '^([A-Z][a-z]+)'))::INT, 'NAME', regexp_extract(text, '^([A-Z][a-z]+)') FROM benchmark WHERE regexp_matches(text, '^[A-Z][a-z]+')"""
)
def combined_training(spark, sf_dir):
    """EXP8: the spans of benchmark items and labelled turns in one training set."""
    b = table(spark, sf_dir, "benchmark").filter("text is not null")
    first = F.regexp_extract("text", "^([A-Z][a-z]+)", 1)
    spans = b.select("text", F.when(first != "", F.array(F.struct(F.lit(0).alias("start"), F.length(first).alias("end"), F.lit("NAME").alias("label"), first.alias("text")))).otherwise(F.array()).alias("entities"))
    both = records.combine(spans, records.read_labelled(labelled_turns(spark, sf_dir)))
    return both.select("origin", "source_file", F.explode("entities").alias("e")).select("origin", "source_file", "e.start", "e.end", "e.label", F.col("e.text").alias("entity"))
