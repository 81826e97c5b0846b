"""Reuse of stored vectors, keyed by the md5 of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar.functions import text as t
from kembar.functions.vectors import encode
from kembar.sources.append_table import AppendTable

CACHE = "text_md5 string, embedding array<float>"
#: Folders from which on a cache is rewritten into one.
FOLDERS = 20


def distinct_texts(texts: DataFrame, col: str = "text") -> DataFrame:
    """One row per non-blank text. Copies fold together before the shuffle."""
    keyed = texts.where(~t.is_blank(F.col(col))).select(t.text_fingerprint(F.col(col)).alias("text_md5"), F.col(col).alias("text"))
    return keyed.groupBy("text_md5").agg(F.first("text").alias("text"))


def cache_misses(texts: DataFrame, cache: DataFrame, col: str = "text") -> DataFrame:
    """Distinct texts without a stored vector."""
    return distinct_texts(texts, col).join(cache.select("text_md5"), "text_md5", "left_anti")


def cache_hits(texts: DataFrame, cache: DataFrame, col: str = "text") -> DataFrame:
    """Distinct texts with their stored vector."""
    return distinct_texts(texts, col).join(cache, "text_md5")


def embedding_cache_refresh(texts: DataFrame, cache: DataFrame, encoder=None, col: str = "text") -> DataFrame:
    """The rows to append to the cache so that every text has a vector."""
    return encode(cache_misses(texts, cache, col), "text", encoder).select("text_md5", "embedding")


def refresh_cache(texts: DataFrame, cache: AppendTable, encoder=None, col: str = "text", folders: int = FOLDERS) -> DataFrame:
    """Encode the texts that a stored cache lacks, append their vectors, and return the cache.

    What is missing is found against one generation and appended to just that one, so vectors are stored once even with
    two writers: the later one fails and may start again. Many small appends are joined into one folder.
    """
    since = cache.generation()
    fresh = embedding_cache_refresh(texts, cache.read(since), encoder, col).persist()
    try:
        if not fresh.isEmpty():
            cache.append(fresh, since)
    finally:
        fresh.unpersist()
    if len(cache.folders()) > folders:
        cache.compact()
    return cache.read()
