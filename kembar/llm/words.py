"""What the operators of this package share: words, A-Z lower-casing, and batches of rows in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x20\\x09-\\x0D]+"
#: The same six characters, as Python's bytes.split() takes them.
SPACES = " \t\n\x0b\x0c\r"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def unused_name(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores behind it until none of `frames` has a column called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_rows(docs: DataFrame) -> Column:
    """All columns of a row in one, `row`, so that none can clash with those that are added."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def word_total(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def per_batch(df: DataFrame, run: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """`run` on each Arrow batch of `df`; it returns the columns of `schema` by name.

    Batches are bounded in bytes by Spark, so that very long texts do not pile up.
    """
    names = [field.name for field in df.sparkSession.createDataFrame([], schema).schema]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = run(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n] for n in names], names)

    return df.mapInArrow(batches, schema)
