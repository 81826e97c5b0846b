"""Decision thresholds kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kembar import runtime
from kembar.functions import scores as s


def update_thresholds(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert: a changed section takes its new value, the others keep theirs."""
    both = table.select("section", "threshold", F.lit(0).alias("turn")).unionByName(
        changes.select("section", "threshold", F.lit(1).alias("turn"))
    )
    latest = Window.partitionBy("section").orderBy(F.col("turn").desc())
    return both.withColumn("at", F.row_number().over(latest)).where(F.col("at") == 1).select("section", "threshold")


def join_thresholds(
    queries: DataFrame, table: DataFrame, words: str = "words", default: float = s.DEFAULT_THRESHOLD,
    explicit: str | None = None,
) -> DataFrame:
    """Add `threshold_used`: an explicit value, else the section's value or the default, moved by text length."""
    named = table.select("section", F.col("threshold").alias("section_threshold"))
    joined = queries.join(runtime.broadcast_if_small(named), "section", "left")
    base = F.coalesce("section_threshold", F.lit(default))
    given = F.col(explicit) if explicit else None
    return joined.withColumn("threshold_used", s.dynamic_threshold(F.col(words), base, given)).drop("section_threshold")


def match_type_thresholds(scores: DataFrame, table: DataFrame, words: str = "words") -> DataFrame:
    """Judge (score_type, score, words) rows by thresholds per score type, moved by text length."""
    joined = scores.join(runtime.broadcast_if_small(table), "score_type", "left")
    used = s.dynamic_threshold(F.col(words), F.coalesce("threshold", F.lit(s.DEFAULT_THRESHOLD)))
    return joined.withColumn("threshold_used", F.round(used, 6)).drop("threshold").withColumn(
        "is_match", F.col("score") >= F.col("threshold_used")
    )
