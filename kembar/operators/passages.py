"""Word n-grams as an inverted index: shared passages, containment and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kembar import runtime
from kembar.functions import text as t
from kembar.operators.hot import dealt_join


def ngram_rows(df: DataFrame, keys: list[str], text_col: str = "text", n: int = 3) -> DataFrame:
    """Distinct n-grams of every text, one per row."""
    return df.select(*keys, F.explode_outer(t.word_ngrams(F.col(text_col), n)).alias("ngram")).where(
        F.col("ngram").isNotNull()
    )


def shared_ngrams(queries: DataFrame, documents: DataFrame, n: int = 3, limit: int = runtime.BROADCAST_BYTES) -> DataFrame:
    """(query_id, doc_id, shared, query_size, doc_size) for each pair that shares an n-gram.

    Each document's n-grams are matched and summed in the task that made them: when the queries are small they are
    broadcast, so only pair counts are shuffled. Otherwise both sides meet by n-gram, and an n-gram that very many
    documents hold is dealt out.
    """
    wanted = runtime.written(
        ngram_rows(queries, ["query_id"], "text", n).withColumn(
            "query_size", F.count("*").over(Window.partitionBy("query_id"))
        ),
        "query-ngrams",
    )
    grams = documents.select("doc_id", t.word_ngrams(F.col("text"), n).alias("grams"))
    rows = grams.select("doc_id", F.size("grams").alias("doc_size"), F.explode_outer("grams").alias("ngram"))
    if runtime.fits_broadcast(wanted, limit):
        joined = rows.join(F.broadcast(wanted), "ngram")
    else:
        rows = runtime.written(rows.where(F.col("ngram").isNotNull()), "document-ngrams")
        joined = dealt_join(rows, wanted, "ngram", "doc_id")
    return joined.groupBy("query_id", "doc_id", "query_size", "doc_size").agg(F.count("*").alias("shared"))


def ngram_jaccard_join(queries: DataFrame, documents: DataFrame, n: int = 3) -> DataFrame:
    pairs = shared_ngrams(queries, documents, n)
    score = F.col("shared") / (F.col("query_size") + F.col("doc_size") - F.col("shared"))
    return pairs.select("query_id", "doc_id", F.round(score, 6).alias("exact_score"))


def pair_ngram_jaccard(hits: DataFrame, queries: DataFrame, texts: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """n-gram Jaccard of given (query_id, *keys) pairs; pairs without a shared n-gram are left out, their score is 0.

    `texts` has one row per `keys` (doc_id among them). Each text's n-grams are made once, however many queries hit it,
    and meet those of its own queries only: a join on document and n-gram, with one row per key on the text side.
    """
    own = [k for k in keys if k in queries.columns]
    asked = ngram_rows(queries, ["query_id", *own], "text", n).withColumn(
        "query_size", F.count("*").over(Window.partitionBy("query_id", *own))
    )
    wanted = runtime.written(hits.select("query_id", *keys).join(asked, ["query_id", *own]), "pair-ngrams")
    grams = texts.select(*keys, t.word_ngrams(F.col("text"), n).alias("grams"))
    rows = grams.select(*keys, F.size("grams").alias("doc_size"), F.explode_outer("grams").alias("ngram"))
    shared = rows.join(runtime.broadcast_if_small(wanted), [*keys, "ngram"])
    counted = shared.groupBy("query_id", *keys, "query_size", "doc_size").agg(F.count("*").alias("shared"))
    score = F.col("shared") / (F.col("query_size") + F.col("doc_size") - F.col("shared"))
    return counted.select("query_id", *keys, score.alias("exact_score"))


def ngram_containment(queries: DataFrame, documents: DataFrame, n: int = 3) -> DataFrame:
    """Share of the query's n-grams that the document has."""
    pairs = shared_ngrams(queries, documents, n)
    return pairs.select("query_id", "doc_id", F.round(F.col("shared") / F.col("query_size"), 6).alias("containment"))


def drop_boilerplate(grams: DataFrame, max_documents: int) -> DataFrame:
    """Leave out n-grams that occur in more than `max_documents` documents.

    The n-grams dropped are found by a count that folds map-side; there are at most rows / max_documents of them.
    """
    common = grams.groupBy("ngram").agg(F.count("*").alias("n")).where(F.col("n") > max_documents).select("ngram")
    common = runtime.written(common, "common-ngrams")  # counted once, however it is joined
    return grams.join(runtime.broadcast_if_small(common), "ngram", "left_anti")


def sentence_rows(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per sentence with its place and the md5 of its lower-cased form."""
    rows = df.select(*keys, F.posexplode_outer(t.sentences(F.col(text_col))).alias("pos", "sentence"))
    return rows.where(F.col("sentence").isNotNull()).withColumn("sentence_md5", F.md5(F.lower("sentence").cast("binary")))


def matched_passages(queries: DataFrame, documents: DataFrame, min_chars: int = 20) -> DataFrame:
    """Runs of neighbouring query sentences that a document holds word for word."""
    long_enough = F.length("sentence") >= min_chars
    wanted = runtime.written(sentence_rows(queries, ["query_id"]).where(long_enough), "query-sentences")
    copies = sentence_rows(documents, ["doc_id"]).where(long_enough).select("doc_id", "sentence_md5")
    wanted_keys = wanted.select("sentence_md5").distinct()
    copies = copies.join(runtime.broadcast_if_small(wanted_keys), "sentence_md5", "left_semi").distinct()
    hits = copies.join(runtime.broadcast_if_small(wanted), "sentence_md5")
    in_order = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    run = F.col("pos") - F.row_number().over(in_order)
    return hits.withColumn("run", run).groupBy("query_id", "doc_id", "run").agg(
        F.min("pos").alias("first_sentence"), F.max("pos").alias("last_sentence"),
        F.sum(F.length("sentence")).alias("matched_chars"),
    ).drop("run")


def drop_citations(sentences: DataFrame, references: DataFrame) -> DataFrame:
    """Leave out sentences whose md5 is in the list of quoted ones."""
    known = references.select("sentence_md5").distinct()
    return sentences.join(runtime.broadcast_if_small(known), "sentence_md5", "left_anti")
