"""Search entry points: single texts and batches, by TF-IDF or by vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.functions import pairs as p
from kembar.functions import scores as s
from kembar.functions import text as t
from kembar.functions.vectors import HashedEncoder, dense_cosine, encode
from kembar.operators import tfidf
from kembar.operators.dense import nearest
from kembar.operators.passages import pair_ngram_jaccard
from kembar.operators.rows import filter_query_text, own_limits, rerank_bulk, widest_limits
from kembar.operators.summaries import batch_rows
from kembar.schema import SECTIONS, section_order

KEYS = ["doc_id", "section"]
HUB_HITS = 1000
FULL_SCORES = ("exact_score", "fuzzy_score", "semantic_score", "final_score")


def matched_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of each hit document, once, and the number of copies that its hits are dealt out to.

    Only top-k survivors come here, so their keys go to the texts and not the other way round. Of several texts under one
    key, the first in order is taken.
    """
    sizes = hits.groupBy(*KEYS).agg(F.ceil(F.count("*") / F.lit(HUB_HITS)).cast("int").alias("copies"))
    found = texts.select(*KEYS, "text").join(runtime.broadcast_if_small(sizes), KEYS)
    return found.groupBy(*KEYS, "copies").agg(F.min("text").alias("text"))


def join_found(hits: DataFrame, found: DataFrame) -> DataFrame:
    """Left join of hits to `found` (keys, copies, ...), in which a document that very many queries hit has no hot key."""
    share = runtime.broadcast_if_small(found.select(*KEYS, "copies"))
    dealt = hits.join(share, KEYS, "left").withColumn(
        "__copy", F.pmod(F.xxhash64("query_id"), F.coalesce("copies", F.lit(1)))
    ).drop("copies")
    copied = found.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
    return dealt.join(runtime.broadcast_if_small(copied), [*KEYS, "__copy"], "left").drop("__copy")


def join_matched_text(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Left lookup of the stored text of each hit; a missing one becomes ''."""
    found = runtime.written(matched_texts(hits, texts), "matched-texts")
    joined = join_found(hits, found.withColumnRenamed("text", "matched_text"))
    return joined.withColumn("matched_text", F.coalesce("matched_text", F.lit("")))


def join_metadata(scored: DataFrame, metadata: DataFrame) -> DataFrame:
    return scored.join(metadata, "doc_id")


def score_hits(hits: DataFrame, queries: DataFrame, texts: DataFrame, encoder=None, fuzzy: bool = True) -> DataFrame:
    """Add matched text, exact, fuzzy, semantic and final score to written hits (query_id, section, doc_id).

    n-grams and vectors are made once per text and once per query; only the edit ratio works pair by pair.
    """
    found = runtime.written(runtime.spread_work(matched_texts(hits, texts), *KEYS), "matched-texts")
    exact = pair_ngram_jaccard(hits, queries, found, KEYS)
    asked = encode(queries.select("query_id", "section", F.col("text").alias("query_text")), "query_text", encoder, "__qv")
    vectors = encode(found.withColumnRenamed("text", "matched_text"), "matched_text", encoder, "__mv")
    pairs = join_found(hits, runtime.written(vectors, "matched-vectors"))
    pairs = pairs.withColumn("matched_text", F.coalesce("matched_text", F.lit("")))
    pairs = pairs.join(runtime.broadcast_if_small(runtime.written(asked, "query-vectors")), ["query_id", "section"])
    pairs = pairs.withColumn("semantic_score", F.coalesce(dense_cosine(F.col("__qv"), F.col("__mv")), F.lit(0.0)))
    pairs = runtime.spread_work(pairs.drop("__qv", "__mv"), "query_id", *KEYS)
    a, b = F.col("query_text"), F.col("matched_text")
    pairs = pairs.withColumn("fuzzy_score", p.fuzzy_ratio(a, b) if fuzzy else F.lit(0.0))
    pairs = pairs.join(exact, ["query_id", *KEYS], "left").withColumn("exact_score", F.coalesce("exact_score", F.lit(0.0)))
    final = s.final_score_adaptive(F.col("exact_score"), F.col("fuzzy_score"), F.col("semantic_score"), a, b)
    return pairs.withColumn("final_score", final).withColumns({name: F.round(name, 6) for name in FULL_SCORES})


def search_tfidf(
    index: tfidf.TfidfIndex, texts: DataFrame, queries: DataFrame, k: int = 10, cutoff: float = 0.1, encoder=None,
    fuzzy: bool = True,
) -> DataFrame:
    """Top k per (query_id, section) of `queries` (query_id, section, skema, text), with all five scores.

    Ranked by TF-IDF first; the costly scores and the texts are looked up for the survivors only.
    """
    queries = queries.where(~t.is_blank(F.col("text")))
    hits = runtime.written(tfidf.search(index, queries, k, cutoff), "tfidf-hits")
    return score_hits(hits, queries, texts, encoder, fuzzy).select(
        "query_id", "section", "rank", "doc_id", "skema", "similarity_score", *FULL_SCORES,
        t.preview(F.col("matched_text")).alias("matched_text"),
    )


def search_dense(
    points: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, cutoff: float | None = None,
    encoder=None, **sizes,
) -> DataFrame:
    """Top k nearest points of `queries` (query_id, section, skema, text or embedding), with their texts.

    A query may have a `k` and a `threshold` of its own; where it has none, the given ones hold.
    """
    requests = queries.select(*[c for c in ("query_id", "k", "threshold") if c in queries.columns]).distinct()
    if "embedding" not in queries.columns:
        queries = encode(filter_query_text(queries), "text", encoder)
    if len(requests.columns) == 1:
        hits = nearest(points, queries, k, threshold, cutoff, **sizes)
    else:
        most, least = widest_limits(requests, k, threshold)
        hits = own_limits(nearest(points, queries, most, least, cutoff, **sizes), requests, k, threshold)
    if "text" not in points.columns:
        return hits
    full = join_matched_text(runtime.written(hits, "dense-hits"), points)
    return full.select(
        "query_id", "rank", "doc_id", "skema", "section", "similarity_score",
        t.preview(F.col("matched_text")).alias("text_preview"), "matched_text",
    )


def search_bulk_tfidf(
    index: tfidf.TfidfIndex, texts: DataFrame, items: DataFrame, k: int = 1, cutoff: float = 0.1, encoder=None,
    fuzzy: bool = True,
) -> DataFrame:
    """Best k per batch item over its sections by final score. `items` has query_index, skema and section columns."""
    queries = batch_rows(items).withColumnRenamed("query_index", "query_id")
    found = search_tfidf(index, texts, queries, k, cutoff, encoder, fuzzy).withColumnRenamed("query_id", "query_index")
    return rerank_bulk(found, k, score="final_score")


def bulk_queries(items: DataFrame, sections=SECTIONS) -> DataFrame:
    """One query per item and section with text; the query id holds both."""
    order = section_order(F.col("section"), sections)
    rows = batch_rows(items, sections=sections)
    return rows.withColumn("query_id", F.col("query_index") * (len(sections) + 1) + order)


def search_bulk_dense(
    points: DataFrame, items: DataFrame, k: int = 5, threshold: float | None = None, cutoff: float | None = None,
    encoder=None, texts: bool = True, **sizes,
) -> DataFrame:
    """Best k per batch item over its sections by cosine, with their texts if wanted and if the points have them."""
    queries = encode(filter_query_text(bulk_queries(items)), "text", encoder or HashedEncoder())
    found = nearest(points, queries, k, threshold, cutoff, **sizes)
    found = found.withColumn("query_index", F.floor(F.col("query_id") / (len(SECTIONS) + 1)).cast("bigint"))
    best = rerank_bulk(found.drop("query_id"), k)
    if not texts or "text" not in points.columns:
        return best
    best = runtime.written(best.withColumnRenamed("query_index", "query_id"), "bulk-hits")
    full = join_matched_text(best, points).withColumnRenamed("query_id", "query_index")
    return full.withColumn("text_preview", t.preview(F.col("matched_text")))
