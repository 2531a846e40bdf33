"""Session settings and folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only where the session sets none and runs on a single machine (a local
    master) is one made; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back, which cuts its lineage.

    A later loss of an executor costs only what came after, and values drawn
    while computing (file names, partition ids) can't change on a retry.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Bytes of a compressed table that a part takes, some ten times as much in memory.
PART_BYTES = 2 << 20


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Into how many parts to deal ``df``, so that a part's size does not grow with the table; twice the cores at least.

    Of joins, whose size Spark takes for a product, that of all tables they read; of
    tables whose size Spark does not know (rows of the driver) the session's own number.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    if leaves.size() > 1:
        size = min(size, sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))
    if size >= 1 << 44:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(20_000, max(2 * spark.sparkContext.defaultParallelism, -(-size // part_bytes)))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Removes what ``materialise`` wrote; only for tables that nothing reads any more. Other tables stay."""
    for table in tables:
        path = vars(table).get("_scratch")
        if path:
            remove(table.sparkSession, path)
