"""Cut long texts into segments and sum segment results up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kembar.functions import scores as s
from kembar.functions import text as t

# Words per segment of the named profiles, fixed values.
PROFILES = {"conservative": 200, "balanced": 100, "aggressive": 50}
SEGMENT_FROM_WORDS = 300
AGGREGATIONS = ("max", "top_k_average", "weighted_average")


def words_per_segment(profile: str | int) -> int:
    return PROFILES[profile] if isinstance(profile, str) else profile


def segment_text(df: DataFrame, keys: list[str], text_col: str = "text", profile: str | int = "balanced") -> DataFrame:
    """Rows (keys, segment_index, segment_text, segment_words); a sentence belongs where its first word falls.

    Windows run over the sentences of one text only.
    """
    size = words_per_segment(profile)
    rows = df.select(*keys, F.posexplode_outer(t.sentences(F.col(text_col))).alias("pos", "sentence"))
    rows = rows.where(F.col("sentence").isNotNull()).withColumn("words", t.word_count(F.col("sentence")))
    in_order = Window.partitionBy(*keys).orderBy("pos")
    before = F.sum("words").over(in_order) - F.col("words")
    rows = rows.withColumn("raw_index", F.floor(before / size))
    grouped = rows.groupBy(*keys, "raw_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), ". ")
        .alias("segment_text"),
        F.sum("words").alias("segment_words"),
    )
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("raw_index")) - 1
    return grouped.select(*keys, index.alias("segment_index"), "segment_text", "segment_words")


def should_segment(words, forced: bool | None = None):
    """Whether a text is cut: as forced, else from 300 words on."""
    return F.lit(forced) if forced is not None else words >= SEGMENT_FROM_WORDS


def agg_segments(results: DataFrame, keys: list[str], method: str = "top_k_average") -> DataFrame:
    """Sum up (segment_index, segment_words, similarity_score, is_plagiarism) per text."""
    best = F.max_by(
        F.col("segment_index"), F.struct(F.col("similarity_score"), -F.col("segment_index"))
    )
    top3 = F.slice(F.sort_array(F.collect_list("similarity_score"), asc=False), 1, 3)
    weighted = F.sum(F.col("similarity_score") * F.col("segment_words")) / F.sum("segment_words")
    summed = results.groupBy(*keys).agg(
        F.count("*").alias("total_segments"),
        F.count_if("is_plagiarism").alias("plagiarism_segments"),
        F.max("similarity_score").alias("max_similarity"),
        F.avg("similarity_score").alias("avg_similarity"),
        top3.alias("top3"),
        weighted.alias("weighted_similarity"),
        best.alias("best_segment"),
    )
    mean3 = F.aggregate("top3", F.lit(0.0), lambda a, x: a + x) / F.size("top3")
    chosen = {"max": F.col("max_similarity"), "top_k_average": mean3, "weighted_average": F.col("weighted_similarity")}
    return summed.select(
        *keys, "total_segments", "plagiarism_segments", F.round("max_similarity", 6).alias("max_similarity"),
        F.round("avg_similarity", 6).alias("avg_similarity"), F.round(mean3, 6).alias("top3_avg_similarity"),
        F.round(chosen[method], 6).alias("confidence_score"), "best_segment",
        s.segment_risk(F.col("plagiarism_segments"), F.col("total_segments")).alias("risk_level"),
        (F.col("plagiarism_segments") > 0).alias("is_plagiarism"),
    )
