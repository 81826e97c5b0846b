"""Exact deduplication: a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.llm.words import lower_az, text_or_empty, whole_rows

FAN_IN = 16
#: A digest and two further checks: rows count as equal only if all three agree.
KEY = ["digest", "n_bytes", "check"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, block, doc_id, digest, n_bytes, check) per row; a block is what one task of the scan has read."""
    normal = lower_az(text_or_empty(text_col))
    return docs.select(
        F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("block"),
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"),
        F.octet_length(normal).alias("n_bytes"), F.xxhash64(normal).alias("check"),
    )


def _merged(runs: DataFrame, largest: bool) -> DataFrame:
    """One level: the runs of a block become one run with the verified best identifier of every digest."""
    best = F.max("keep") if largest else F.min("keep")
    return runs.groupBy("block", *KEY).agg(best.alias("keep"), F.sum("members").alias("members"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, uid) for every row of `docs`.

    Each block of the scan sorts and folds its digests into a run. In each round, `fan_in` neighbouring blocks merge
    their runs into one, so that a digest has at most `fan_in` rows per merge however many copies there are; the rounds
    end with one run over all blocks, still spread by digest. The result goes back down the same tree, so no join meets
    more rows of one digest than one block has read.

    Null texts count as empty, empty texts are equal, null ids are smaller than any id. Rows that agree in id and text
    are copies like any others: one of them stays. Columns other than the two named are not read. No rows: no rows.
    """
    rows = runtime.written(digest_rows(docs, id_col, text_col), "digests")
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    first = rows.select("block", *KEY, F.struct("doc_id", "uid").alias("keep"), F.lit(1).cast("bigint").alias("members"))
    levels = [runtime.written(_merged(first, keep == "largest"), "run-0")]
    while blocks > 1:
        blocks = -(-blocks // fan_in)
        parents = levels[-1].withColumn("block", F.expr(f"block div {fan_in}").cast("int"))
        levels.append(runtime.written(_merged(parents, keep == "largest"), f"run-{len(levels)}"))
    found = levels.pop()
    while levels:
        child = levels.pop().select(*KEY, F.col("block").alias("child"), F.expr(f"block div {fan_in}").cast("int").alias("block"))
        found = child.join(found, [*KEY, "block"]).select(*KEY, F.col("child").alias("block"), "keep", "members")
    return rows.join(found, [*KEY, "block"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("members").alias("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "uid",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `docs` without later or earlier copies, all columns as they were.

    The rows that stay are found by id and digest; where rows agree in both, one of them stays.
    """
    groups = exact_groups(docs, id_col, text_col, keep).where("kept")
    stay = groups.select(F.col("doc_id").alias("stay_id"), F.unhex("text_sha256").alias("stay_digest"))
    digest = F.unhex(F.sha2(lower_az(text_or_empty(text_col)), 256))
    own = docs.select(whole_rows(docs), F.col(id_col).alias("id"), digest.alias("digest"))
    joined = own.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest")), "left_semi")
    return joined.dropDuplicates(["id", "digest"]).select("row.*")
