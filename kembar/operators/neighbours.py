"""Approximate nearest vectors: a forest of sorted signatures, of which a query reads a few pages around its place.

A signature holds the sides of many random hyperplanes a vector lies on, so vectors of like direction share a long beginning
and stand near each other when signatures are sorted. Each tree has its own hyperplanes. Sorted rows are cut into pages of
equally many entries, so nothing a query reads grows with the corpus, and copies of one vector fill pages of their own.
Pages hold ids; vectors are fetched once per candidate, and scored exactly.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.operators.dense import _best, _units
from kembar.operators.rows import by_score, top_k
from kembar.schema import section_order

BITS = 60
PAGE = 256
TREES = 16
#: Pages on either side of a query's own that it reads in each tree.
AROUND = 4
#: Pairs that are scored together.
STEP = 50_000

_HITS = "query_id bigint, doc_id bigint, skema string, section string, similarity_score double"


class Forest(NamedTuple):
    """Sorted pages (page, first, entries), the points themselves, and what the signatures are made with."""

    pages: DataFrame
    points: DataFrame
    dim: int
    trees: int
    seed: int


def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS))


def signature_numbers(matrix: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """One number below 2^BITS per row and tree; the first hyperplane is the highest bit."""
    above = (matrix @ planes > 0).reshape(len(matrix), trees, BITS)
    return (above * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(axis=2)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def build_forest(points: DataFrame, dim: int, trees: int = TREES, page: int = PAGE, seed: int = 7) -> Forest:
    """Index points (doc_id, skema, section, embedding); every point is in every tree. Tables are written."""
    from kembar.sources.proposals import numbered

    points = points.where(F.size("embedding") == dim)

    def signed(batches):
        planes = _planes(dim, trees, seed)
        for batch in batches:
            if batch.num_rows:
                values = signature_numbers(_matrix(batch.column("embedding"), dim), planes, trees)
                offsets = np.arange(len(values) + 1, dtype=np.int32) * trees
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("section"), pa.ListArray.from_arrays(offsets, values.ravel())],
                    ["doc_id", "section", "signatures"],
                )

    rows = points.select("doc_id", "section", "embedding").mapInArrow(signed, "doc_id bigint, section string, signatures array<bigint>")
    rows = rows.select("doc_id", "section", F.posexplode("signatures").alias("tree", "signature"))
    order = [F.col("tree"), F.col("signature"), F.col("doc_id"), F.col("section")]
    placed = numbered(runtime.written(rows, "signatures"), order, "at")
    entry = F.struct("tree", "signature", "doc_id", "section")
    pages = placed.groupBy(F.floor(F.col("at") / page).cast("bigint").alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    first = F.col("entries")[0]
    pages = pages.select("page", first["tree"].alias("tree"), first["signature"].alias("signature"), "entries")
    return Forest(runtime.written(pages, "forest-pages"), points, dim, trees, seed)


def _places(forest: Forest, queries: pa.Table) -> DataFrame:
    """(query, tree, page): the last page that starts at or before the place of the query in a tree.

    Queries travel to the page heads, where each task answers with one page per query and tree at most.
    """
    dim, trees, seed = forest.dim, forest.trees, forest.seed
    wanted = signature_numbers(_matrix(queries.column("embedding").combine_chunks(), dim), _planes(dim, trees, seed), trees)

    def run(batches):
        best = np.full((len(wanted), trees), -1, np.int64)
        for batch in batches:
            tree, head = batch.column("tree").to_numpy(), batch.column("signature").to_numpy()
            page = batch.column("page").to_numpy()
            # Page numbers rise with (tree, signature), so a page of an earlier tree starts before any place in a later one.
            order = np.argsort(page)
            keys = tree[order].astype(object) * (1 << BITS) + head[order]
            for at in range(trees):
                spot = np.searchsorted(keys, wanted[:, at].astype(object) + at * (1 << BITS), "right") - 1
                found = np.where(spot >= 0, page[order][np.maximum(spot, 0)] if len(order) else -1, -1)
                best[:, at] = np.maximum(best[:, at], found)
        query, place = np.nonzero(best >= 0)
        yield pa.RecordBatch.from_pydict({
            "query": pa.array(query.astype(np.int32)), "tree": pa.array(place.astype(np.int32)), "page": pa.array(best[query, place]),
        })

    heads = forest.pages.select("page", "tree", "signature").mapInArrow(run, "query int, tree int, page bigint")
    return heads.groupBy("query", "tree").agg(F.max("page").alias("page"))


def ann_candidates(
    forest: Forest | DataFrame, queries: DataFrame, dim: int, k: int = 10, around: int = AROUND, block: int = 2048, **sizes
) -> DataFrame:
    """Top k of each query (query_id, embedding) among the entries of the pages around its place in every tree.

    A query reads 2 * around + 1 pages per tree, whatever the corpus holds. Scores are exact; the choice is approximate.
    """
    if isinstance(forest, DataFrame):
        forest = build_forest(forest, dim, **sizes)
    spark = forest.points.sparkSession
    asked = runtime.written(queries.where(F.size("embedding") == dim).select("query_id", "embedding"), "ann-queries")
    parts = asked.count() // block + 1
    found = []
    for part in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        table = mine.toArrow()
        if len(table):
            found.append(_block(forest, table, k, around) if parts == 1 else runtime.written(_block(forest, table, k, around), "ann-hits"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, skema string, section string, similarity_score double, rank int")
    whole = found[0]
    for hits in found[1:]:
        whole = whole.unionByName(hits)
    return whole


def _block(forest: Forest, table: pa.Table, k: int, around: int) -> DataFrame:
    near = F.explode(F.sequence(F.col("page") - around, F.col("page") + around))
    places = runtime.written(_places(forest, table).select("query", F.col("tree").alias("in_tree"), near.alias("page")), "forest-places")
    entries = forest.pages.select("page", "entries").join(F.broadcast(places), "page").select("query", "in_tree", F.explode("entries").alias("e"))
    pairs = entries.where(F.col("e.tree") == F.col("in_tree")).select("query", "e.doc_id", "e.section")
    # A candidate's vector moves once, with the list of its queries, of which a block has a bounded number.
    asked = runtime.written(pairs.groupBy("doc_id", "section").agg(F.collect_set("query").alias("asked")), "ann-pairs")
    vectors = forest.points.select(
        "doc_id", F.col("skema").cast("string").alias("skema"), "section", section_order(F.col("section")).alias("section_order"), "embedding"
    )
    wanted = vectors.join(runtime.broadcast_if_small(asked), ["doc_id", "section"])
    return top_k(wanted.mapInArrow(_scorer(table, k), _HITS), ["query_id"], by_score(), k)


def _scorer(table: pa.Table, k: int):
    ids, units = table.column("query_id").to_numpy(), _units(table.column("embedding"))

    def run(batches):
        for batch in batches:
            mine = _units(batch.column("embedding"))
            many = np.diff(batch.column("asked").offsets.to_numpy())
            row, query = np.repeat(np.arange(len(mine)), many), batch.column("asked").flatten().to_numpy()
            score = np.concatenate([
                np.einsum("ij,ij->i", mine[row[at:at + STEP]], units[query[at:at + STEP]]) for at in range(0, len(row), STEP)
            ] or [np.zeros(0)]).round(6)
            docs, sections = batch.column("doc_id").to_numpy()[row], np.array(batch.column("section").to_pylist(), object)[row]
            order = batch.column("section_order").to_numpy()[row]
            found = _best({"query": query, "doc": docs, "order": order, "score": score, "at": np.arange(len(row))}, k)
            keep = found["at"]
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(ids[query[keep]]), "doc_id": pa.array(docs[keep]),
                "skema": pa.array(np.array(batch.column("skema").to_pylist(), object)[row][keep], pa.string()),
                "section": pa.array(sections[keep], pa.string()), "similarity_score": pa.array(score[keep]),
            })

    return run
