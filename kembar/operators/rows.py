"""Projections, filters and ranking on plain rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kembar import runtime
from kembar.functions import text as t
from kembar.functions.lists import COMMON_QUERIES
from kembar.schema import SECTIONS, section_order


def unpivot_sections(df: DataFrame, sections=SECTIONS, ids=("doc_id", "skema")) -> DataFrame:
    """One row per document and section; missing sections stay as null texts."""
    return df.unpivot(list(ids), list(sections), "section", "text")


def section_rows(df: DataFrame, section: str, skema: str | None = None, ids=("doc_id", "skema")) -> DataFrame:
    """One section of wide proposals as rows, of one category if given: only its column is read, nothing is unpivoted."""
    if skema is not None:
        df = df.where(F.col("skema") == skema)
    return df.select(*ids, F.lit(section).alias("section"), F.col(section).alias("text"))


def filter_min_chars(df: DataFrame, col: str = "text", more_than: int = 10) -> DataFrame:
    return df.where(F.length(t.strip(F.col(col))) > more_than)


def filter_nonblank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(~t.is_blank(F.col(col)))


def filter_query_text(df: DataFrame, col: str = "text", min_chars: int = 3) -> DataFrame:
    return df.where(F.length(t.strip(F.col(col))) >= min_chars)


def filter_section_skema(df: DataFrame, section: str | None = None, skema: str | None = None) -> DataFrame:
    """Equality on section and category, each only if given; reaches the scan."""
    if section is not None:
        df = df.where(F.col("section") == section)
    if skema is not None:
        df = df.where(F.col("skema") == skema)
    return df


def score_cutoff(df: DataFrame, bound: float, col: str = "similarity_score", strict: bool = False) -> DataFrame:
    return df.where(F.col(col) > bound) if strict else df.where(F.col(col) >= bound)


def fill_missing_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("")))


def project_match(df: DataFrame, text_col: str = "matched_text", length: int = 500, dots: bool = True) -> DataFrame:
    """Keep all columns, with the matched text cut to a preview."""
    return df.withColumn(text_col, t.preview(F.col(text_col), length, dots))


def own_limits(
    df: DataFrame, requests: DataFrame, k: int, bound: float | None = None, key: str = "query_id", score: str = "similarity_score"
) -> DataFrame:
    """Ranked rows within the `k` and `threshold` of their own request; where a request has none, `k` and `bound` hold.

    `df` has a `rank` and at least as many rows per request as it may keep. `requests` has one row per key.
    """
    own_k = F.coalesce("k", F.lit(k)) if "k" in requests.columns else F.lit(k)
    own_bound = F.coalesce("threshold", F.lit(bound)) if "threshold" in requests.columns else F.lit(bound)
    limits = requests.select(key, own_k.alias("__k"), own_bound.cast("double").alias("__bound"))
    joined = df.join(runtime.broadcast_if_small(limits), key)
    kept = (F.col("rank") <= F.col("__k")) & (F.col("__bound").isNull() | (F.col(score) >= F.col("__bound")))
    return joined.where(kept).drop("__k", "__bound")


def widest_limits(requests: DataFrame, k: int, bound: float | None = None) -> tuple[int, float | None]:
    """The greatest k and the least bound that any request asks for: what one search for all of them needs."""
    most = F.max(F.coalesce("k", F.lit(k))) if "k" in requests.columns else F.lit(k)
    least = F.lit(bound)
    if "threshold" in requests.columns:
        least = F.min(F.coalesce("threshold", F.lit(float("-inf") if bound is None else bound)))
    found = requests.agg(most.alias("k"), least.cast("double").alias("bound")).first()
    none = found["bound"] is None or found["bound"] == float("-inf")
    return found["k"] or k, bound if none else found["bound"]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark cuts to k rows per task before the shuffle, so hot keys stay small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def by_score(score: str = "similarity_score", sections=SECTIONS) -> list[Column]:
    """The one ranking used everywhere: score, then section order, then document."""
    return [F.col(score).desc(), section_order(F.col("section"), sections), F.col("doc_id")]


def best_match(df: DataFrame, keys: Sequence[str], score: str = "similarity_score") -> DataFrame:
    return top_k(df, keys, by_score(score), 1).drop("rank")


def sort_results(df: DataFrame, keys: Sequence[str] = ("query_id",), score: str = "similarity_score") -> DataFrame:
    return df.orderBy(*keys, *by_score(score))


def rerank_bulk(df: DataFrame, k: int, item: str = "query_index", score: str = "similarity_score") -> DataFrame:
    """Best k of an item over all its sections, where the searched section breaks ties before the document."""
    return top_k(df.drop("rank"), [item], by_score(score), k)


def union_sections(frames: Sequence[DataFrame]) -> DataFrame:
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.unionByName(frame)
    return joined


def sample_per_section(sections: DataFrame, n: int = 10, phrases=COMMON_QUERIES) -> DataFrame:
    """The first n texts of every section and the common queries: what to encode before the first search."""
    first = top_k(sections.where(F.col("text").isNotNull()), ["section"], [F.col("doc_id")], n)
    first = first.select("section", t.strip(F.col("text")).alias("text"))
    common = sections.sparkSession.createDataFrame([("query", p) for p in phrases], "section string, text string")
    return first.unionByName(common).where(F.col("text") != "")
