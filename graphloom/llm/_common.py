"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch

__all__ = ["as_bytes", "as_texts", "freed", "get", "groups", "materialise", "narrow", "open_fs", "partition_id", "put", "scratch", "shuffle_partitions", "slices_of_bytes"]


def open_fs(uri: str):
    """(file system, path) of a URI, for executors and driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text without decoding it; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Each text; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, by exact name even where others differ by case alone."""
    places = [df.columns.index(c) for c in columns]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(c) for i, c in zip(places, columns, strict=True)])


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which rows are ordered, over all batches of a task."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and v[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = v[a]
    if held:
        yield pa.Table.from_batches(held)


def slices_of_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Parts of a batch with their bytes in a text column: ``most`` of them at most, but for single rows."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        yield batch.slice(a, b - a), int(upto[b] - upto[a])
        a = b


def put(uri: str, data: bytes) -> None:
    """Writes a whole file: under a name of this attempt, then moved into place."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, path)


def get(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives memory that a worker has freed back to the system; idle workers then hold little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freed(run, after=None):
    """``run`` for mapInArrow, with ``after()`` and a release at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            release()

    return wrapped
