"""Structured Streaming: document ingest with upsert, windows, sessions and dedup of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.io import upsert


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first row of each user, type and minute within the watermark."""
    minute = events.withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("minute", late)
    return minute.dropDuplicates(["user_id", "event_type", "minute"]).select("user_id", "event_type", "minute")


def run_once(stream: DataFrame, key: list[str] | None, what: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there; rows of ``key`` replace earlier ones, without key they add up.

    Results and state lie in the shared folder, so that a restart goes on.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, what), scratch(spark, f"{what}-state")
    schema = stream.schema
    if key is None:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(schema).parquet(out)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    if mode == "complete":  # the last batch holds all
        last_epoch = rows.agg(F.max("_epoch")).first()[0]
        return rows.filter(F.col("_epoch") == last_epoch).select(*schema.names)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in schema.names if c not in key]), "_epoch").alias("r"))
    return last.select(*key, "r.*").select(*schema.names)


def ingest(documents: DataFrame, target: str, state: str, key: str = "doc_id", order: str | None = None) -> None:
    """Streams documents into versions of a table at ``target``: each batch is upserted into the last one.

    Of equal keys in a batch the row of the largest ``order`` stays (a time of
    the event, or an offset of its source); without ``order`` that of the
    last partition, which is not the order of arrival.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        place = F.monotonically_increasing_id()
        at = F.struct(F.col(order), place) if order else place
        last = batch.withColumn("_at", at).groupBy(key).agg(F.max_by(F.struct(*batch.columns), "_at").alias("r"))
        new = last.select("r.*")
        rows = new if epoch == 0 else upsert(spark.read.parquet(f"{target}/v{epoch - 1}"), new, [key])
        rows.write.mode("overwrite").parquet(f"{target}/v{epoch}")

    documents.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
