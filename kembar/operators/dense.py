"""Exact nearest vectors: Spark scans the points, one matrix product scores a batch, and clusters leave whole tiles out.

Queries travel in blocks with the tasks; points are scanned where they lie, once per block of queries, and never copied.
A `PointIndex` stores the points by the nearest of some centres, in rings of like angle to it. The angle between a query and
a point is at least the difference of their angles to the centre, so a ring whose least possible angle is too wide for
the bound, or for the k-th score known so far, is neither read nor scored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.functions.vectors import ZERO
from kembar.operators.rows import by_score, top_k
from kembar.schema import SECTIONS, section_order

#: Queries that travel at once, and the bytes of their vectors.
QUERY_BLOCK = 4096
QUERY_BYTES = 64 << 20
#: Sections or categories up to which a filter on points names them.
ASKED = 1000
CELLS = 1_000_000
#: Rows of a batch that are scored at once.
BATCH_ROWS = 2048
#: Centres of an index, at most; rings are this wide, in radians.
CENTRES = 1024
RING = 0.05
#: The cluster of vectors without a direction, whose cosine with anything is 0.
DEAD = -1
#: What angles may be off by, and what rounding to six digits may hide.
SLACK, ROUNDING = 1e-6, 1e-6

_HITS = "query_id bigint, doc_id bigint, skema string, section string, section_order int, similarity_score double"


def _units(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 1))
    sizes = pc.list_value_length(column)
    if sizes.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("vectors differ in length")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = values.reshape(rows, -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    dead = np.abs(matrix).max(axis=1, keepdims=True) <= ZERO
    return np.where(dead, 0.0, matrix / np.where(dead, 1.0, norms))


def _codes(values, book: dict) -> np.ndarray:
    return np.array([-1 if v is None else book.setdefault(v, len(book)) for v in values], dtype=np.int64)


class _Queries:
    """A block of queries, at most QUERY_BLOCK rows."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("query_id").to_numpy()
        self.units = _units(table.column("embedding"))
        self.sections: dict = {}
        self.skemas: dict = {}
        self.section = _codes(table.column("section").to_pylist(), self.sections)
        self.skema = _codes(table.column("skema").to_pylist(), self.skemas)


def _best(found: dict, k: int) -> dict:
    """Cut candidates to k per query by score, section order and document."""
    order = np.lexsort((found["doc"], found["order"], -found["score"], found["query"]))
    query = found["query"][order]
    starts = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(query)), 0)) if len(query) else starts
    keep = order[(np.arange(len(query)) - first) < k] if len(query) else order
    return {name: values[keep] for name, values in found.items()}


def _joined(parts: list[dict]) -> dict:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


class _Pruning(NamedTuple):
    """Angles of queries to centres, and the score that matters to each query from."""

    angles: np.ndarray
    alive: np.ndarray
    needs: np.ndarray

    def reached(self, cluster: int, ring: int) -> np.ndarray:
        """Numbers of the queries that a vector of this ring could matter to."""
        if cluster == DEAD:
            return np.flatnonzero(self.needs <= ROUNDING)
        angle = self.angles[:, cluster]
        gap = np.maximum(0.0, np.maximum(angle - (ring + 1) * RING, ring * RING - angle) - SLACK)
        best = np.where(self.alive, np.cos(np.minimum(gap, np.pi)), 0.0)
        return np.flatnonzero(best >= self.needs - ROUNDING)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _pruning(queries: _Queries, centres: np.ndarray, bound: float | None, kth: np.ndarray | None) -> _Pruning:
    needs = np.full(len(queries.ids), -np.inf if bound is None else bound)
    needs = needs if kth is None else np.maximum(needs, kth)
    return _Pruning(_angles(queries.units, centres), np.abs(queries.units).max(axis=1) > 0, needs)


def _tiles(batch) -> list[tuple[int, int, np.ndarray]]:
    """(cluster, ring, rows) of the tiles that a batch has rows of."""
    keys = batch.column("cluster").to_numpy().astype(np.int64) * 1000 + batch.column("ring").to_numpy()
    values, place = np.unique(keys, return_inverse=True)
    return [(int(value) // 1000, int(value) % 1000, np.flatnonzero(place == at)) for at, value in enumerate(values)]


def _score(batch, queries: _Queries, k: int | None, bound: float | None, strict: bool, pruning: _Pruning | None) -> list[dict]:
    units = _units(batch.column("embedding"))
    docs = batch.column("doc_id").to_numpy()
    order = batch.column("section_order").to_numpy()
    section, skema = batch.column("section").to_pylist(), batch.column("skema").to_pylist()
    section_code = np.array([queries.sections.get(s, -2) for s in section])
    skema_code = np.array([queries.skemas.get(s, -2) for s in skema])
    section, skema = np.array(section, dtype=object), np.array(skema, dtype=object)
    every = np.arange(len(queries.ids))
    if pruning is None:
        work = [(np.arange(len(docs)), every)]
    else:
        work = [(rows, pruning.reached(cluster, ring)) for cluster, ring, rows in _tiles(batch)]
    parts = []
    for members, asked in work:
        if not len(asked):
            continue
        asked_section, asked_skema, asked_units = queries.section[asked], queries.skema[asked], queries.units[asked]
        step = max(1, CELLS // len(asked))
        for start in range(0, len(members), step):
            rows = members[start:start + step]
            scores = units[rows] @ asked_units.T
            allowed = (asked_section == -1) | (section_code[rows, None] == asked_section)
            allowed &= (asked_skema == -1) | (skema_code[rows, None] == asked_skema)
            if bound is not None:
                allowed &= scores > bound if strict else scores >= bound
            scores = np.where(allowed, np.round(scores, 6), -np.inf)
            if k is not None and len(scores) > k:
                allowed &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
            row, query = np.nonzero(allowed)
            part = {
                "query": asked[query], "doc": docs[rows][row], "skema": skema[rows][row], "section": section[rows][row],
                "order": order[rows][row], "score": scores[row, query],
            }
            parts.append(part if k is None else _best(part, k))
    return parts


def _hits(found: dict, queries: _Queries) -> dict:
    return {
        "query_id": pa.array(queries.ids[found["query"]], pa.int64()), "doc_id": pa.array(found["doc"], pa.int64()),
        "skema": pa.array(found["skema"], pa.string()), "section": pa.array(found["section"], pa.string()),
        "section_order": pa.array(found["order"], pa.int32()),
        "similarity_score": pa.array(found["score"], pa.float64()),
    }


def _scan(queries: _Queries, k, bound, strict, centres=None, kth=None):
    def run(batches):
        best = None
        pruning = None if centres is None else _pruning(queries, centres, bound, kth)
        for batch in (batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS)):
            parts = _score(batch, queries, k, bound, strict, pruning)
            if k is None:
                for part in parts:
                    yield pa.RecordBatch.from_pydict(_hits(part, queries))
            elif parts:
                best = _best(_joined(parts if best is None else [best, *parts]), k)
        if best is not None:
            yield pa.RecordBatch.from_pydict(_hits(best, queries))

    return run


class PointIndex(NamedTuple):
    """Points with `cluster` and `ring`, the centres as rows of unit length, and the number of points of each tile."""

    points: DataFrame
    centres: np.ndarray
    tiles: DataFrame


def _centres(points: DataFrame, most: int) -> np.ndarray:
    """Distinct directions of a bounded sample: about the square root of the number of points, `most` at most."""
    total = points.count()
    wanted = max(1, min(most, int(total ** 0.5)))
    share = F.pmod(F.xxhash64("doc_id", "section"), F.lit(1 << 30))
    sample = points.where(share < F.lit(int(min(1.0, 4 * wanted / max(1, total)) * (1 << 30))))
    found = sample.select("embedding").limit(wanted).toArrow()
    units = _units(found.column("embedding")) if len(found) else np.zeros((0, 1))
    units = np.unique(units[np.abs(units).max(axis=1) > 0], axis=0) if len(units) else units
    return units if len(units) else np.zeros((0, units.shape[1]))


def build_point_index(points: DataFrame, path: str | None = None, centres: int = CENTRES) -> PointIndex:
    """Store points (doc_id, skema, section, embedding, ...) by cluster and ring.

    The folder of a cluster is not read unless some tile of it is needed; within a folder, files are cut by size, so a
    vector that a third of all points share makes many files and not one long task.
    """
    spark = points.sparkSession
    points = points.where(F.col("embedding").isNotNull())
    directions = _centres(points, centres)

    def assign(batches):
        for batch in batches:
            units = _units(batch.column("embedding"))
            cluster, ring = np.full(len(units), DEAD, np.int32), np.zeros(len(units), np.int32)
            alive = np.flatnonzero(np.abs(units).max(axis=1) > 0) if len(units) else np.zeros(0, int)
            if len(directions) and len(alive):
                cosine = units[alive] @ directions.T
                cluster[alive] = cosine.argmax(axis=1)
                ring[alive] = np.arccos(np.clip(cosine.max(axis=1), -1.0, 1.0)) // RING
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(ring)], [*batch.schema.names, "cluster", "ring"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    assigned = points.mapInArrow(assign, f"{fields}, cluster int, ring int")
    path = path or runtime.table_path(spark, "point-index")
    assigned.hint("rebalance", F.col("cluster")).sortWithinPartitions("cluster", "ring").write.partitionBy("cluster").parquet(path)
    stored = spark.read.schema(f"{fields}, ring int, cluster int").parquet(path)
    tiles = stored.groupBy("cluster", "ring").agg(F.count("*").alias("n"))
    return PointIndex(stored, directions, runtime.written(tiles, "point-tiles"))


def _needed_tiles(tiles: DataFrame, queries: _Queries, centres: np.ndarray, bound, kth) -> DataFrame:
    """(cluster, ring, n, n_queries) of tiles that some query needs. There are at most centres times 64 tiles."""
    def run(batches):
        pruning = _pruning(queries, centres, bound, kth)
        for batch in batches:
            cluster, ring = batch.column("cluster").to_pylist(), batch.column("ring").to_pylist()
            many = [len(pruning.reached(c, r)) for c, r in zip(cluster, ring, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("cluster", "ring", "n")), pa.array(many, pa.int64())],
                                             ["cluster", "ring", "n", "n_queries"])

    return tiles.select("cluster", "ring", "n").mapInArrow(run, "cluster int, ring int, n bigint, n_queries bigint").where(F.col("n_queries") > 0)


def _first_scores(index: PointIndex, points: DataFrame, queries: _Queries, k: int, bound, strict) -> np.ndarray:
    """The k-th score of each query among the points of the cluster nearest to it; a lower bound of its k-th score."""
    kth = np.full(len(queries.ids), -np.inf)
    if not len(index.centres):
        return kth
    closest = _angles(queries.units, index.centres).argmin(axis=1)
    near = points.where(F.col("cluster").isin(np.unique(closest).tolist()))
    found = near.mapInArrow(_scan(queries, k, bound, strict), _HITS)
    best = top_k(found, ["query_id"], by_score(), k).groupBy("query_id").agg(F.min("similarity_score").alias("s"), F.count("*").alias("n"))
    place: dict = {}
    for at, query in enumerate(queries.ids):
        place.setdefault(query, []).append(at)
    for row in best.where(F.col("n") == k).collect():
        kth[place[row["query_id"]]] = row["s"]
    return kth


def _asked(points: DataFrame, queries: _Queries) -> DataFrame:
    """Sections and categories that no query of a block asks for are not read."""
    for name, codes, book in (("section", queries.section, queries.sections), ("skema", queries.skema, queries.skemas)):
        if len(book) <= ASKED and (codes != -1).all():
            points = points.where(F.col(name).isin(list(book)))
    return points


def _query_blocks(queries: DataFrame, block: int, bytes_limit: int):
    """Queries as Arrow tables of at most about `block` rows and `bytes_limit` bytes, one after the other."""
    first = queries.limit(block + 1).toArrow()
    if len(first) <= block and first.nbytes <= bytes_limit:
        if len(first):
            yield first
        return
    queries = runtime.written(queries, "dense-queries")
    row = max(1, first.nbytes // max(1, len(first)))
    each = max(1, min(block, bytes_limit // row))
    parts = 2 * queries.count() // each + 1
    for part in range(parts):
        table = queries.where(F.pmod(F.xxhash64("query_id", "section"), F.lit(parts)) == part).toArrow()
        if len(table):
            yield table


def _prepared(points: DataFrame, sections) -> DataFrame:
    extra = [c for c in ("cluster", "ring") if c in points.columns]
    return points.withColumn("section_order", section_order(F.col("section"), sections)).select(
        "doc_id", F.col("skema").cast("string").alias("skema"), "section", "section_order", "embedding", *extra
    ).where(F.col("embedding").isNotNull())


def _prepared_queries(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_id", F.nullif(F.col("section"), F.lit("")).alias("section"),
        F.nullif(F.col("skema").cast("string"), F.lit("")).alias("skema"), "embedding",
    ).where(F.col("embedding").isNotNull())


def score_points(
    points: DataFrame | PointIndex, queries: DataFrame, k: int | None = None, bound: float | None = None, strict: bool = False,
    block: int = QUERY_BLOCK, bytes_limit: int = QUERY_BYTES, sections=SECTIONS,
) -> DataFrame:
    """Score points against queries; a query's section and category, where not null, must be equal.

    With `k`, every task gives at most k rows per query and block. Points are scanned in place for each block of
    queries; of a PointIndex only the tiles that some query of the block needs.
    """
    index = points if isinstance(points, PointIndex) else None
    rows = _prepared(index.points if index else points, sections)
    blocks = []
    for table in _query_blocks(_prepared_queries(queries), block, bytes_limit):
        carried = _Queries(table)
        asked = _asked(rows, carried)
        if index is None:
            blocks.append(asked.drop("cluster", "ring").mapInArrow(_scan(carried, k, bound, strict), _HITS))
            continue
        kth = None if k is None else _first_scores(index, asked, carried, k, bound, strict)
        tiles = _needed_tiles(index.tiles, carried, index.centres, bound, kth).select("cluster", "ring")
        needed = asked.join(F.broadcast(runtime.written(tiles, "needed-tiles")), ["cluster", "ring"], "left_semi")
        blocks.append(needed.mapInArrow(_scan(carried, k, bound, strict, index.centres, kth), _HITS))
    if not blocks:
        return rows.sparkSession.createDataFrame([], _HITS)
    if len(blocks) == 1:
        return blocks[0]
    done = [runtime.written(hits, "dense-hits") for hits in blocks]
    whole = done[0]
    for hits in done[1:]:
        whole = whole.unionByName(hits)
    return whole


def tiles_scored(
    index: PointIndex, queries: DataFrame, k: int | None = None, bound: float | None = None, sections=SECTIONS
) -> DataFrame:
    """(tiles, tiles_read, points, points_read, pairs, pairs_scored) over all queries: what an exact search leaves out."""
    parts = []
    rows = _prepared(index.points, sections)
    for table in _query_blocks(_prepared_queries(queries), QUERY_BLOCK, QUERY_BYTES):
        carried = _Queries(table)
        kth = None if k is None else _first_scores(index, _asked(rows, carried), carried, k, bound, False)
        needed = _needed_tiles(index.tiles, carried, index.centres, bound, kth)
        both = index.tiles.join(F.broadcast(needed.drop("n")), ["cluster", "ring"], "left")
        n, asking = F.col("n"), F.coalesce("n_queries", F.lit(0))
        parts.append(both.agg(
            F.count("*").alias("tiles"), F.sum("n").alias("points"), F.sum(n * len(carried.ids)).alias("pairs"),
            F.count_if(asking > 0).alias("tiles_read"), F.sum(F.when(asking > 0, n).otherwise(0)).alias("points_read"),
            F.sum(n * asking).alias("pairs_scored"),
        ))
    if not parts:
        return rows.sparkSession.createDataFrame([], "tiles bigint, points bigint, pairs bigint, tiles_read bigint, points_read bigint, pairs_scored bigint")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def nearest(
    points: DataFrame | PointIndex, queries: DataFrame, k: int = 10, threshold: float | None = None, cutoff: float | None = None,
    sections=SECTIONS, **sizes,
) -> DataFrame:
    """The k nearest points of every query: `threshold` keeps scores from it on, `cutoff` only scores above it."""
    bound, strict = (cutoff, True) if cutoff is not None else (threshold, False)
    found = score_points(points, queries, k, bound, strict, sections=sections, **sizes)
    ranked = top_k(found, ["query_id"], by_score(sections=sections), k)
    return ranked.drop("section_order")


def theta_join(points: DataFrame | PointIndex, queries: DataFrame, cutoff: float = 0.1, **sizes) -> DataFrame:
    """Every point whose cosine with a query is above `cutoff`, without a limit per query."""
    return score_points(points, queries, None, cutoff, True, **sizes).drop("section_order")
