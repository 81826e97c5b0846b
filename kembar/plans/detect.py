"""Verdicts on texts: single, cut into segments, in batches, and within a category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.functions import scores as s
from kembar.functions import text as t
from kembar.functions.pairs import lexical_metrics
from kembar.functions.vectors import encode
from kembar.operators import segments as seg
from kembar.operators.dense import nearest
from kembar.operators.summaries import agg_bulk_summary, batch_rows
from kembar.operators.thresholds import join_thresholds
from kembar.plans.search import join_matched_text


def join_skema_fallback(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Drop the category of a query where that category has no points in the section, and say so.

    A query without a section asks for all sections, so its category counts as known if any section has points of it.
    """
    known = points.select(F.col("skema").cast("string").alias("__skema"), F.col("section").alias("__section")).distinct()
    anywhere = known.select("__skema", F.lit(None).cast("string").alias("__section")).distinct()
    known = runtime.broadcast_if_small(runtime.written(known.unionAll(anywhere).distinct().withColumn("__known", F.lit(True)), "known-skemas"))
    asked = queries.withColumn("search_skema", F.nullif(F.col("skema"), F.lit(""))).drop("skema")
    same = (F.col("search_skema") == F.col("__skema")) & F.col("section").eqNullSafe(F.col("__section"))
    joined = asked.join(known, same, "left").drop("__skema", "__section")
    return joined.withColumns({
        "skema": F.when(F.col("__known"), F.col("search_skema")),
        "fallback_used": F.col("search_skema").isNotNull() & F.col("__known").isNull(),
    }).drop("__known")


def cleaned(queries: DataFrame) -> DataFrame:
    """Queries with text, without repeated sentences, and with their number of words."""
    rows = queries.where(~t.is_blank(F.col("text"))).withColumn("text", t.dedupe_sentences(F.col("text")))
    return rows.withColumn("words", t.word_count(F.col("text")))


def with_titles(hits: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Add the title of each hit document, from (doc_id, judul); null where there is none. Titles are read once per document."""
    if titles is None:
        return hits.withColumn("__title", F.lit(None).cast("string"))
    ids = hits.select("doc_id").distinct()
    found = titles.select("doc_id", F.col("judul").alias("__title")).join(runtime.broadcast_if_small(ids), "doc_id", "left_semi")
    found = runtime.written(found.groupBy("doc_id").agg(F.min("__title").alias("__title")), "titles")
    return hits.join(runtime.broadcast_if_small(found), "doc_id", "left")


def _judge(points: DataFrame, queries: DataFrame, k: int, encoder, thresholds, academic: bool, sizes, titles=None) -> DataFrame:
    """Verdict rows for cleaned queries (query_id, section, skema, text, words[, threshold]) with unique ids."""
    fallback = join_skema_fallback(queries, points)
    if thresholds is None:
        given = F.col("threshold") if "threshold" in queries.columns else None
        fallback = fallback.withColumn("threshold_used", s.dynamic_threshold(F.col("words"), explicit=given))
    else:
        given = "threshold" if "threshold" in queries.columns else None
        fallback = join_thresholds(fallback, thresholds, explicit=given)
    queries = runtime.written(fallback, "detect-queries")
    hits = nearest(points, encode(queries, "text", encoder), k, **sizes)
    hits = runtime.written(hits.withColumnRenamed("similarity_score", "semantic_similarity"), "detect-hits")
    hits = with_titles(join_matched_text(hits, points).withColumnRenamed("skema", "result_skema").drop("section"), titles)
    pairs = runtime.spread_work(queries.join(hits, "query_id", "left"), "query_id", "doc_id")
    pairs = lexical_metrics(pairs.withColumn("matched_text", F.coalesce("matched_text", F.lit(""))), "text",
                            "matched_text", academic)
    semantic, jaccard = F.col("semantic_similarity"), F.col("lexical.jaccard")
    overlap, sequence = F.col("lexical.word_overlap"), F.col("lexical.sequence")
    if academic:
        composite = s.composite_academic(semantic, jaccard, overlap, sequence, F.col("lexical.academic"))
    else:
        composite = s.composite_standard(semantic, jaccard, overlap, sequence)
    found = F.col("doc_id").isNotNull()
    judged = pairs.withColumns({
        "__composite": composite,
        "verdict": F.when(found, s.classify_match(semantic, jaccard, sequence)),
    })
    return judged.select(
        "query_id", "section", F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce(F.round("__composite", 4), F.lit(0.0)).alias("similarity_score"),
        F.coalesce(F.col("verdict.is_plagiarism"), F.lit(False)).alias("is_plagiarism"),
        F.when(found, F.col("matched_text")).alias("most_similar_article"),
        F.col("doc_id").alias("most_similar_article_id"), F.col("__title").alias("most_similar_article_judul"),
        F.round("threshold_used", 6).alias("threshold_used"),
        F.when(found, F.lit("indonesian_optimized" if academic else "single_text")).otherwise("basic").alias("analysis_type"),
        F.round(semantic, 4).alias("semantic_similarity"),
        F.when(found, F.col("lexical")).alias("lexical"), "verdict",
        F.coalesce(s.threshold_verdict(F.col("__composite"), F.col("threshold_used")), F.lit(False)).alias("legacy_threshold_result"),
        F.col("words").alias("text_length_words"), "search_skema", "result_skema", "fallback_used",
    )


def detect(
    points: DataFrame, queries: DataFrame, k: int = 1, encoder=None, thresholds: DataFrame | None = None,
    academic: bool = True, titles: DataFrame | None = None, **sizes,
) -> DataFrame:
    """Verdict per query (query_id, section, skema, text[, threshold]) from its nearest points.

    `titles` (doc_id, judul), for example the proposals, gives the title of the match.
    """
    return _judge(points, cleaned(queries), k, encoder, thresholds, academic, sizes, titles)


def cut_queries(queries: DataFrame, forced: bool | None = None, profile: str | int = "balanced") -> DataFrame:
    """Cleaned queries -> one row per segment; a query that is not cut, or has no sentence, is one segment. Adds `segment_id`."""
    queries = queries.withColumn("__cut", seg.should_segment(F.col("words"), forced))
    parts = seg.segment_text(queries.where(F.col("__cut")), ["query_id"], "text", profile)
    rest = [c for c in queries.columns if c not in ("query_id", "text", "words", "__cut")]
    units = queries.join(parts, "query_id", "left").select(
        "query_id", *rest, F.coalesce("segment_index", F.lit(0)).alias("segment_index"),
        F.coalesce("segment_text", "text").alias("segment_text"), F.coalesce("segment_words", "words").alias("segment_words"),
    )
    return runtime.written(units.withColumn("segment_id", F.monotonically_increasing_id()), "segments")


def detect_segments(
    points: DataFrame, queries: DataFrame, forced: bool | None = None, profile: str | int = "balanced", encoder=None,
    thresholds: DataFrame | None = None, academic: bool = True, titles: DataFrame | None = None, **sizes,
) -> DataFrame:
    """Verdict per segment of each query."""
    units = cut_queries(cleaned(queries), forced, profile)
    asked = units.select(
        F.col("segment_id").alias("query_id"), F.col("segment_text").alias("text"), F.col("segment_words").alias("words"),
        *[c for c in units.columns if c not in ("query_id", "segment_id", "segment_text", "segment_words", "segment_index")],
    )
    judged = _judge(points, asked, 1, encoder, thresholds, academic, sizes, titles).withColumnRenamed("query_id", "segment_id")
    return units.select("segment_id", "query_id", "segment_index", "segment_words", "segment_text").join(judged, "segment_id")


def detect_segmented(
    points: DataFrame, queries: DataFrame, forced: bool | None = None, profile: str | int = "balanced",
    method: str = "top_k_average", **options,
) -> DataFrame:
    """Verdict per query: summed over segments, or the single verdict where a query has one segment only.

    The classification is that of the best segment.
    """
    judged = runtime.written(
        detect_segments(points, queries, forced, profile, **options).drop("segment_id"), "segment-verdicts"
    )
    summed = seg.agg_segments(judged, ["query_id"], method)
    best = judged.select(
        "query_id", F.col("segment_index").alias("best_segment"), "section", "most_similar_article",
        "most_similar_article_id", "most_similar_article_judul", "threshold_used", "search_skema",
        F.col("verdict.classification").alias("classification"), F.col("verdict.explanation").alias("__why"),
        F.col("verdict.confidence").alias("__confidence"), F.col("verdict.risk_level").alias("__risk"),
        F.col("analysis_type").alias("__type"),
    )
    details = judged.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "segment_index", "similarity_score", "is_plagiarism", t.preview(F.col("segment_text"), 100).alias("segment_preview"),
        ))).alias("detailed_segments"),
        F.sum("segment_words").alias("text_length_words"),
    )
    many = F.col("total_segments") > 1
    # The three sentences that explain a verdict over segments.
    why = F.array(
        F.concat(F.lit("Analyzed "), F.col("total_segments").cast("string"), F.lit(" segments")),
        F.concat(F.lit("Found "), F.col("plagiarism_segments").cast("string"), F.lit(" potentially plagiarized segments")),
        F.lit(f"Aggregation strategy: {method}"),
    )
    return summed.join(best, ["query_id", "best_segment"]).join(details, "query_id").select(
        "query_id", "section", F.col("max_similarity").alias("similarity_score"), "is_plagiarism",
        "most_similar_article", "most_similar_article_id", "most_similar_article_judul", "threshold_used",
        "classification", F.when(many, why).otherwise(F.col("__why")).alias("explanation"),
        F.when(many, "segmented").otherwise(F.col("__type")).alias("analysis_type"), many.alias("segmentation_used"),
        "total_segments", "plagiarism_segments", "max_similarity", "avg_similarity", "top3_avg_similarity",
        F.when(many, F.col("confidence_score")).otherwise(F.col("__confidence")).alias("confidence_score"),
        F.when(many, F.col("risk_level")).otherwise(F.col("__risk")).alias("risk_level"),
        "text_length_words", "search_skema", "detailed_segments",
    )


def detect_bulk(
    points: DataFrame, items: DataFrame, profile: str | int = "balanced", **options
) -> tuple[DataFrame, DataFrame]:
    """Batch items -> (verdict per item and section, summary per item). Texts are always cut into segments."""
    rows = batch_rows(items)
    if "threshold" in items.columns:
        rows = rows.join(items.select("query_index", "threshold"), "query_index")
    rows = runtime.written(rows.withColumn("query_id", F.monotonically_increasing_id()), "bulk-rows")
    verdicts = detect_segmented(points, rows.drop("query_index"), True, profile, **options)
    verdicts = runtime.written(rows.select("query_id", "query_index").join(verdicts, "query_id").drop("query_id"), "bulk-verdicts")
    return verdicts, agg_bulk_summary(items, verdicts)


def detect_by_skema(points: DataFrame, queries: DataFrame, k: int = 1, fallback: bool = True, **options) -> DataFrame:
    """Verdict inside the query's category, or over the whole section where the category has no points.

    With `fallback` off, a query whose category has no points gets a row with an `error` and no verdict instead.
    """
    asked = queries.where(~t.is_blank(F.col("skema")))
    if fallback:
        return detect(points, asked, k, **options)
    looked = runtime.written(join_skema_fallback(asked, points), "skema-queries")
    known = looked.where(~F.col("fallback_used")).drop("search_skema", "fallback_used")
    verdicts = detect(points, known, k, **options).withColumn("error", F.lit(None).cast("string"))
    error = F.concat(F.lit("No points of category "), "search_skema", F.coalesce(F.concat(F.lit(" in section "), "section"), F.lit("")))
    missing = looked.where(F.col("fallback_used")).select(
        "query_id", "section", "search_skema", F.lit("error").alias("analysis_type"), error.alias("error"),
        F.lit(False).alias("fallback_used"),
    )
    return verdicts.unionByName(missing, allowMissingColumns=True)
