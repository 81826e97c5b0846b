"""An equi-join in which a key that very many rows hold is dealt out, and no other key is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime

#: A key is dealt out once it holds more than this part of a task's fair share of rows.
SHARE = 4


def dealt_join(many: DataFrame, few: DataFrame, key: str, spread_by: str, share: int | None = None) -> DataFrame:
    """Inner join of two written tables on `key`.

    Keys of `many` that `few` has are counted first (folded before the shuffle). A key with more than `share` rows is cut
    into copies by `spread_by`, and its rows of `few` go to every copy. There are at most SHARE keys per task of that
    kind, so their list may be broadcast at any size of the input.
    """
    wanted = few.select(key).distinct()
    counts = many.join(wanted, key, "left_semi").groupBy(key).agg(F.count("*").alias("__n"))
    if share is None:
        tasks = max(2, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        share = max(1, many.count() // (SHARE * tasks))
    hot = counts.where(F.col("__n") > share).select(key, F.ceil(F.col("__n") / F.lit(share)).cast("int").alias("__copies"))
    hot = F.broadcast(runtime.written(hot, "hot-keys"))
    copies = F.coalesce("__copies", F.lit(1))
    left = many.join(hot, key, "left").withColumn("__copy", F.pmod(F.xxhash64(spread_by), copies).cast("int")).drop("__copies")
    right = few.join(hot, key, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return left.join(right, [key, "__copy"]).drop("__copy")
