from graphloom import plans
from graphloom.operators import extract

BODY = "This Supply Agreement is made effective as of March 4, 2019 by and between Acme Widgets Inc. and Beta Distribution LLC."


def test_long_texts_are_read_whole(spark):
    docs = spark.createDataFrame([("a", "plain words here. " * 1000 + BODY)], "doc_id string, text string")
    assert "EFFECTIVE_DATE" in {r.label for r in extract.mentions(docs).collect()}
    assert extract.mentions(docs, 15000).count() == 0


def test_queries_read_the_table(spark, tmp_path):
    spark.createDataFrame([(77, BODY)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "77" in {r.doc_id for r in plans.QUERIES["extracted_mentions"](spark, str(tmp_path)).collect()}
