"""Text encoders and vector arithmetic."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kembar.functions.text import tokenize_words

DEFAULT_DIM = 512
ZERO = 1e-8
#: Tokens that are counted at once.
PIECE_TOKENS = 1_000_000


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector is all but zero."""
    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def squares(v):
        return total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))

    def alive(v):
        return F.exists(v, lambda x: F.abs(x) > ZERO)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(alive(a) & alive(b), dot / (F.sqrt(squares(a)) * F.sqrt(squares(b)))).otherwise(F.lit(0.0))


def bucket(term: Column, dim: int = DEFAULT_DIM) -> Column:
    """The vector position of a term: the first eight hexadecimal digits of its md5, modulo the dimension."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim


def pieces(tokens: pa.Array, limit: int = PIECE_TOKENS) -> Iterator[pa.Array]:
    """Parts of a list array with about `limit` elements each, so that what is made of one at a time stays small."""
    ends = tokens.offsets.to_numpy()
    start = 0
    while start < len(tokens):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield tokens.slice(start, end - start)
        start = end


def hashed_counts(tokens: pa.Array, dim: int) -> np.ndarray:
    """Counts of hashed tokens, `dim` for each list, one list after the other."""
    lengths = np.diff(tokens.offsets.to_numpy())
    words = tokens.flatten().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    spots = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words.dictionary.to_pylist()], dtype=np.int64)
    cells = np.repeat(np.arange(len(tokens)), lengths) * dim
    if len(cells):
        cells += spots[words.indices.to_numpy()]
    return np.bincount(cells, minlength=len(tokens) * dim).astype(np.float32)


class HashedEncoder:
    """Counts of words, hashed into `dim` positions. Needs no model and gives the same vector everywhere."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim

    def vectors(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def counts(tokens: pa.Array) -> pa.Array:
            flat = np.concatenate([hashed_counts(part, dim) for part in pieces(tokens)] or [np.zeros(0, np.float32)])
            return pa.ListArray.from_arrays(np.arange(len(tokens) + 1, dtype=np.int32) * dim, flat)

        return counts(tokenize_words(F.coalesce(text, F.lit(""))))

    def encode(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        return df.withColumn(out_col, self.vectors(F.col(text_col)))


class ModelEncoder:
    """Any model: `load` runs once in each Python worker and returns texts -> array of shape (len(texts), dim)."""

    def __init__(self, load: Callable[[], Callable[[Sequence[str]], np.ndarray]], dim: int = DEFAULT_DIM):
        self.load, self.dim = load, dim

    def encode(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        load, dim = self.load, self.dim
        schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

        def run(batches):
            model = load()
            for batch in batches:
                texts = ["" if t is None else t for t in batch.column(text_col).to_pylist()]
                vectors = np.asarray(model(texts), dtype=np.float32).reshape(len(texts), dim)
                column = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, vectors.ravel())
                yield pa.RecordBatch.from_arrays(batch.columns + [column], names=batch.schema.names + [out_col])

        return df.mapInArrow(run, schema)


class StoredVectors:
    """Vectors that are already in a table: joined in by an id, nothing is computed."""

    def __init__(self, table: DataFrame, key: str, vector_col: str = "embedding"):
        self.table, self.key, self.vector_col = table, key, vector_col

    def encode(self, df: DataFrame, text_col: str = "", out_col: str = "embedding") -> DataFrame:
        return df.join(self.table.select(self.key, F.col(self.vector_col).alias(out_col)), self.key)


def encode(df: DataFrame, text_col: str, encoder=None, out_col: str = "embedding") -> DataFrame:
    return (encoder or HashedEncoder()).encode(df, text_col, out_col)
