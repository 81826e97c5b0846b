"""Column layouts shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = ("judul", "ringkasan", "pendahuluan", "masalah", "metode", "solusi")

PROPOSAL = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("skema", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in SECTIONS]
)

METADATA = T.StructType(PROPOSAL.fields[:2])


def section_order(section: Column, sections=SECTIONS) -> Column:
    """1-based position of a section name; unknown names come first as 0."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in sections]), section), F.lit(0)).cast("int")
