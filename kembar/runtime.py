"""Where intermediate tables live, and how big a side may be to be broadcast."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}
_releases: dict[str, int] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session may go without one: it gets a temporary folder that goes away with the process.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read and write")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="kembar-")
    return _local_folders[context.applicationId].name


def session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kembar-{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the tables this session wrote to the shared folder; call it once no result depends on them."""
    context = spark.sparkContext
    _delete(spark, session_folder(spark))
    _releases[context.applicationId] = releases(spark) + 1


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def releases(spark: SparkSession) -> int:
    """How often this session released its tables: handles made before the last time are void."""
    return _releases.get(spark.sparkContext.applicationId, 0)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a write shuffles goes as soon as it is done, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back, so that later plans start from files."""
    return _written(df, table_path(df.sparkSession, name))


def written_in_turn(frames: list[DataFrame], name: str) -> DataFrame:
    """One written table of frames with one schema, of which only one at a time has its shuffles on disk."""
    path = table_path(frames[0].sparkSession, name)
    for df in frames:
        table = _written(df, path, "append")
    return table


def passing(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """A `written` table that is not needed for long, and what deletes it."""
    spark = df.sparkSession
    path = table_path(spark, name)
    return _written(df, path), lambda: _delete(spark, path)


def _written(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    spark = df.sparkSession
    with short_shuffles(spark):
        df.write.option("compression", "zstd").mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of few files enough tasks; a scan that already has them is left alone."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks, *keys)


def spread_work(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few but costly rows out to all tasks; adaptive execution would join such small partitions into one."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def _cell_bytes(field: T.StructField):
    name = F.col(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(name), F.lit(0)) * 16 + 8
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """About how much memory all of `df` takes, measured now."""
    row = F.lit(16)
    for field in df.schema:
        row = row + _cell_bytes(field)
    return df.agg(F.sum(row)).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all of `df`, measured now, is below `limit` bytes."""
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after measuring; otherwise leave the join to the optimizer and adaptive execution."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
