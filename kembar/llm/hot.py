"""Joins to one row per key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime

#: A key is dealt out once it holds more than this part of a task's fair share of rows.
SHARE = 4


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread_by: list[str], limit: int = runtime.BROADCAST_BYTES
) -> DataFrame:
    """Left join of `rows` to written `groups`, which has one row per key and the number of rows that have it in `size`.

    Groups of a measured, small size are broadcast. Otherwise both sides meet by key, and a key with more rows than a
    part of a task's share is dealt out in copies by `spread_by`. Keys with so many rows number SHARE times the tasks at
    most, so the list of them is small at any size of the input.
    """
    if runtime.fits_broadcast(groups, limit):
        return rows.join(F.broadcast(groups.drop(size)), keys, "left")
    tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = groups.agg(F.sum(size)).first()[0]
    share = max(1, total // (SHARE * tasks))
    counted = groups.withColumn("__copies", F.ceil(F.col(size) / F.lit(share)).cast("int")).drop(size)
    hot = counted.where(F.col("__copies") > 1).select(*keys, "__copies")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__copy", F.pmod(F.xxhash64(*spread_by), F.coalesce("__copies", F.lit(1))).cast("int")
    ).drop("__copies")
    copied = counted.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    return dealt.join(copied, [*keys, "__copy"], "left").drop("__copy")
