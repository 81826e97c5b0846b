"""Counts and summaries of corpora and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar.functions import scores as s
from kembar.operators.rows import unpivot_sections
from kembar.schema import SECTIONS, section_order


def agg_corpus_info(proposals: DataFrame, sections=SECTIONS) -> DataFrame:
    """Number of proposals and categories, and the sections that hold any text."""
    present = [F.when(F.count(name) > 0, F.lit(name)) for name in sections]
    return proposals.agg(
        F.count("*").alias("total_proposals"), F.count_distinct("skema").alias("unique_skemas"),
        F.array_compact(F.array(*present)).alias("available_sections"),
    )


def skema_names(proposals: DataFrame) -> DataFrame:
    """Every category once, with its number of proposals."""
    return proposals.groupBy("skema").agg(F.count("*").alias("n_proposals"))


def agg_point_stats(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("total_points"), F.max(F.size("embedding")).alias("vector_size")).withColumn(
        "distance_metric", F.lit("cosine")
    )


def agg_skema_sections(points: DataFrame) -> DataFrame:
    """Per category: how many sections have points, and which. Pairs fold together before they are collected."""
    pairs = points.select("skema", "section").distinct()
    return pairs.groupBy("skema").agg(
        F.count("*").alias("n_sections"), F.sort_array(F.collect_list("section")).alias("sections")
    )


def agg_bulk_summary(items: DataFrame, scores: DataFrame, item: str = "query_index") -> DataFrame:
    """Mean and best score per batch item; an item without scores gets zeros. `items` may carry a `threshold`."""
    per_item = scores.groupBy(item).agg(
        F.avg("similarity_score").alias("mean"), F.max("similarity_score").alias("best"),
        F.count("similarity_score").alias("n"),
    )
    given = F.col("threshold") if "threshold" in items.columns else F.lit(None).cast("double")
    joined = items.select(item, s.summary_threshold(given).alias("threshold_used")).join(per_item, item, "left")
    return joined.select(
        item, F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("average_similarity_score"),
        F.round(F.coalesce("best", F.lit(0.0)), 4).alias("max_similarity_score"),
        F.coalesce(F.col("best") >= F.col("threshold_used"), F.lit(False)).alias("is_plagiarism"),
        F.coalesce("n", F.lit(0)).alias("columns_processed"), "threshold_used",
    )


def agg_columns_searched(batch: DataFrame, results: DataFrame, item: str = "query_index", items: DataFrame | None = None) -> DataFrame:
    """Per batch item: the sections that were searched, in section order, and the number of results.

    Items named in `items` of which no section has a text get an empty list.
    """
    ordered = F.transform(
        F.array_sort(F.collect_set(F.struct(section_order(F.col("section")).alias("at"), "section"))),
        lambda x: x["section"],
    )
    searched = batch.groupBy(item).agg(ordered.alias("columns_searched"))
    if items is not None:
        none = F.array().cast("array<string>")
        searched = items.select(item).distinct().join(searched, item, "left").withColumn("columns_searched", F.coalesce("columns_searched", none))
    counts = results.groupBy(item).agg(F.count("*").alias("total_results"))
    return searched.join(counts, item, "left").select(
        item, "columns_searched", F.coalesce("total_results", F.lit(0)).alias("total_results")
    )


def batch_rows(items: DataFrame, item: str = "query_index", sections=SECTIONS) -> DataFrame:
    """Wide batch items -> one row per section that has a text."""
    rows = unpivot_sections(items, sections, (item, "skema"))
    return rows.where(F.coalesce(F.col("text"), F.lit("")) != "")
