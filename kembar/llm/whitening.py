"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become integers. Per batch of rows each dimension is shifted to start at 0 and cut into bit planes, packed across
rows into 64-bit words; the cross-product of two dimensions is then the sum of popcounts of ANDed planes, weighted by powers
of two. Sums of batches and tasks are exact, so the covariance is centred in integers and only then becomes floating point.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime

SCALE = 1024
SHIFT = 100_000
#: Entries beyond this have no place in the integers used; vectors with one are dropped like non-finite ones.
LARGEST = float(1 << 40)
#: Ranges of at most so many bits multiply within 64 bits for any batch; wider ones go on with Python's integers.
NARROW = 22
_SUM = pa.decimal128(38, 0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of rows whose vector is not null and has finite entries only, all below LARGEST in size."""
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("vector")
    )


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * entry) + SHIFT as rows of int64."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, dim) + SHIFT


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of a non-negative matrix, packed over rows in words, with their column and bit."""
    rows, dim = shifted.shape
    bits = [int(top).bit_length() for top in shifted.max(axis=0)]
    owner = np.repeat(np.arange(dim), bits)
    place = np.concatenate([np.arange(b) for b in bits]) if owner.size else np.zeros(0, np.int64)
    words = -(-rows // 64)
    planes = np.zeros((owner.size, words * 8), np.uint8)
    at = 0
    for column, many in enumerate(bits):
        values = np.ascontiguousarray(shifted[:, column])
        for bit in range(many):
            packed = np.packbits((values >> bit & 1).astype(np.uint8))
            planes[at, : packed.size] = packed
            at += 1
    return planes.view(np.uint64), owner, place


def cross_products(shifted: np.ndarray) -> np.ndarray:
    """Upper triangle of the exact products of all columns, by AND and popcount."""
    dim = shifted.shape[1]
    planes, owner, place = bit_planes(shifted)
    wide = place.size and int(place.max()) >= NARROW
    kind = object if wide else np.int64
    total = np.zeros((dim, dim), kind)
    if not place.size:
        return total
    weight = np.array([1 << int(b) for b in place], kind)
    for at in range(place.size):
        counts = np.bitwise_count(planes[at:] & planes[at]).sum(axis=1, dtype=np.int64).astype(kind)
        counts *= weight[at:] * weight[at]
        own = owner[at:] == owner[at]
        counts[1:][own[1:]] *= 2  # both orders of two planes of one column
        starts = np.flatnonzero(np.concatenate(([True], owner[at + 1:] != owner[at:-1])))
        total[owner[at], owner[at:][starts]] += np.add.reduceat(counts, starts)
    return total


def _scatter(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column("vector"), dim)
            low = x.min(axis=0)
            y = x - low
            low, part = low.astype(object), y.sum(axis=0).astype(object)
            rows = len(x)
            products += cross_products(y).astype(object)
            products += np.outer(low, part) + np.outer(part, low) + rows * np.outer(low, low)
            sums += part + rows * low
            n += rows
        if n:
            i, j = np.triu_indices(dim)
            first = [-1, *range(dim), *i.tolist()]
            second = [-1, *[-1] * dim, *j.tolist()]
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(first, pa.int32()), "j": pa.array(second, pa.int32()),
                "v": pa.array([Decimal(int(v)) for v in values], _SUM),
            })

    return run


class Whitening:
    """Size, sums, and the leading components of the covariance of integer vectors."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][:components]
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.values, self.axes = values[order], vectors[:, order]
        trace = float(np.trace(covariance))
        self.alive = self.values > max(trace, 1.0) * 1e-13
        self.explained = [float(v) / trace if live else 0.0 for v, live in zip(self.values, self.alive, strict=True)]


def vector_length(rows: DataFrame) -> int:
    """The most frequent number of entries; of equally frequent ones, the largest."""
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return top["d"] if top else 0


def fit_whitening(rows: DataFrame, dim: int, components: int = 8) -> Whitening | None:
    """Covariance (divisor n) of all rows, centred in integers; every task sends one sum per pair of dimensions.

    What reaches the driver is one number per pair of dimensions, however many rows there are.
    """
    sums = rows.mapInArrow(_scatter(dim), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = {(r["i"], r["j"]): int(r["v"]) for r in sums.collect()}
    if not found:
        return None
    n = found[-1, -1]
    s = [found[i, -1] for i in range(dim)]
    covariance = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            covariance[i, j] = covariance[j, i] = (n * found[i, j] - s[i] * s[j]) / (n * n)
    return Whitening(n, s, covariance, components)


def squared_lengths(centred: np.ndarray) -> list[int]:
    """Exact sums of squares of rows of integers."""
    if centred.dtype == object:
        return [sum(v * v for v in row) for row in centred.tolist()]
    high, low = centred >> 24, centred & ((1 << 24) - 1)
    parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(a << 48) + (b << 25) + c for a, b, c in zip(*parts, strict=True)]


def _project(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = model.axes / np.where(model.alive, np.sqrt(np.where(model.alive, model.values, 1.0)), 1.0)
        width = axes.shape[1]
        for batch in batches:
            x = integers(batch.column("vector"), model.dim)
            if not len(x):
                continue
            if int(np.abs(x).max()) * model.n + max(abs(s) for s in model.sums) < 1 << 62:
                exact = x * model.n - np.array(model.sums, np.int64)
            else:
                exact = x.astype(object) * model.n - np.array(model.sums, object)
            if exact.dtype != object and int(np.abs(exact).max()) >= 1 << 48:
                exact = exact.astype(object)
            projected = (exact.astype(np.float64) / model.n) @ axes
            flat = pa.array(projected.ravel(), pa.float64(), mask=~np.tile(model.alive, len(x)))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"),
                "deviation": pa.array([Decimal(v) for v in squared_lengths(exact)], _SUM),
                "whitened": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, flat),
            })

    return run


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over the components that have variance."""
    live = [k for k, alive in enumerate(model.alive) if alive]
    if not live:
        return 0.0
    means = whitened.agg(*(F.avg(F.col("whitened")[k]).alias(f"m{k}") for k in live)).first()
    pairs = [(a, b) for a in live for b in live if a <= b]

    def centred(k):
        return F.col("whitened")[k] - F.lit(means[f"m{k}"])

    products = whitened.agg(*(F.avg(centred(a) * centred(b)).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(products[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8
) -> DataFrame:
    """One row per usable vector and component: its whitened coordinate, and how well the whole is whitened.

    Rows with a null vector, or a null, non-finite or huge entry, are dropped; so are vectors of another length than the
    most frequent one. Repeated ids stay as they are. Components without variance have null coordinates and explain 0.
    No rows give no rows. Columns: the id, component (from 1), n, deviation (decimal, exact), whitened, explained,
    identity_error; other columns of the input do not matter.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    id_type = dict(rows.dtypes)["id"]
    dim = vector_length(rows)
    rows = runtime.spread(rows.where(F.size("vector") == dim)) if dim else rows.limit(0)
    model = fit_whitening(rows, dim, components) if dim else None
    schema = f"id {id_type}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        empty = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], f"`{id_col}` {id_type}, {empty}")
    projected = runtime.written(rows.mapInArrow(_project(model), schema), "whitened")
    error = identity_error(projected, model)
    explained = F.array(*(F.lit(e) for e in model.explained))
    return projected.select(
        F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "coordinate")
    ).select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        F.col("coordinate").alias("whitened"), F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
