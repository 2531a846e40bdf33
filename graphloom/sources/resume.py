"""Work that goes on where it stopped: batches of keys with a log of what is done.

The rows of a batch and its keys are written first, each in a folder of its
own; then one small file names the batch as done. Only named batches are read,
so a run that dies leaves nothing half done, and none of its keys twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove


class Log:
    """The batches at a path: ``rows/<batch>``, ``keys/<batch>`` and ``done/<batch>``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, what: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def done(self) -> list[str]:
        """The names of finished batches."""
        return [n for n in self._names("done") if not n.startswith(".")]

    def _mark(self, name: str, facts: dict) -> None:
        """The one step that makes a batch count: a file that is made, or exists already."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        own = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/.{name}")
        out = fs.create(own, True)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        if not fs.rename(own, path):
            raise OSError(f"can't name {name} as done")

    def _read(self, what: str, schema: str | None = None) -> DataFrame | None:
        names = self.done()
        return self.spark.read.parquet(*[f"{self.path}/{what}/{n}" for n in names]) if names else (self.spark.createDataFrame([], schema) if schema else None)

    def rows(self, schema: str | None = None) -> DataFrame | None:
        """The rows of all finished batches; without any an empty table of the schema, or None."""
        return self._read("rows", schema)

    def pending(self, todo: DataFrame, key: str) -> DataFrame:
        """Rows of ``todo`` whose key no finished batch has; a null key is never finished."""
        keys = self._read("keys")
        return todo if keys is None else todo.join(keys.select(key).distinct(), key, "left_anti").select(*todo.columns)

    def append(self, rows: DataFrame, keys: DataFrame) -> str:
        """Adds a finished batch: its rows, and the keys that it takes as done, also those that gave no row."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{name}")
        keys.distinct().write.parquet(f"{self.path}/keys/{name}")
        self._mark(name, {"columns": rows.columns})
        return name

    def clean(self) -> int:
        """Removes what runs that died have left; not while another one runs."""
        kept, gone = set(self.done()), 0
        for what in ("rows", "keys"):
            for name in set(self._names(what)) - kept:
                remove(self.spark, f"{self.path}/{what}/{name}")
                gone += 1
        return gone

    def run(self, todo: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], batches: int = 8) -> int:
        """Does ``work`` on what is pending, in up to ``batches`` batches by the hash of the key; the number of batches done.

        ``work`` gives the rows of a batch and must depend on its rows alone. A
        key falls into one batch with all its rows; rows with a null key are left out. Nothing
        pending is no batch.
        """
        n = 0
        for k in range(batches):
            own = self.pending(todo.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(batches)) == k)), key)
            keys = own.select(key).distinct()
            if keys.isEmpty():
                continue
            self.append(work(own), keys)
            n += 1
        return n
