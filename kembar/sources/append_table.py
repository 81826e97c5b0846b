"""A table that grows by appends, each of which is either whole or not there.

An append writes its rows to a folder of its own and then names all folders of the table in a new manifest. Only what the
latest manifest names is read: rows of an append that failed before that, or was run again, are never seen. Two writers at
once cannot both make the same generation; the later one is told to try again. Names are created by the store that holds
the table, which must refuse to create a file that exists (local folders and HDFS do).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class ConcurrentAppend(RuntimeError):
    """Another writer made the next generation first; nothing of this append is visible."""


class AppendTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, generation: int) -> str:
        return f"manifests/{generation:012d}.json"

    def generation(self) -> int:
        """The number of the latest manifest; 0 before the first append."""
        folder, store = self._file("manifests")
        if not store.exists(folder):
            return 0
        names = [status.getPath().getName() for status in store.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def folders(self, generation: int | None = None) -> list[str]:
        """The folders that a generation consists of, the latest by default."""
        generation = self.generation() if generation is None else generation
        if not generation:
            return []
        path, store = self._file(self._manifest(generation))
        reader = store.open(path)
        try:
            return json.loads(bytes(reader.readAllBytes()).decode())["folders"]
        finally:
            reader.close()

    def read(self, generation: int | None = None) -> DataFrame:
        folders = self.folders(generation)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _commit(self, generation: int, folders: list[str]) -> int:
        path, store = self._file(self._manifest(generation))
        try:
            out = store.create(path, False)
        except Exception as error:  # the store's own words differ; that the file exists now is what counts
            if store.exists(path):
                raise ConcurrentAppend(f"generation {generation} exists") from error
            raise
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        return generation

    def _written(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame, since: int | None = None) -> int:
        """Add rows and return the new generation. With `since`, only if that is still the latest one."""
        before = self.generation() if since is None else since
        return self._commit(before + 1, [*self.folders(before), self._written(rows)])

    def compact(self) -> int:
        """Rewrite all rows into one folder, in files of the size that Spark's rebalancing gives."""
        before = self.generation()
        return self._commit(before + 1, [self._written(self.read(before).hint("rebalance"))])
