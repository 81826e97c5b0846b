"""Read and write proposals, points and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kembar import runtime
from kembar.functions.vectors import encode
from kembar.operators.rows import filter_min_chars, filter_nonblank, unpivot_sections
from kembar.schema import METADATA, PROPOSAL, SECTIONS, section_order

CSV = dict(
    header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    lineSep="\n",
)

POINT_FIELDS = "point_id bigint, doc_id bigint, skema string, section string, text string, embedding array<float>"


def read_proposals(spark: SparkSession, path: str, schema: T.StructType = PROPOSAL, fmt: str = "csv") -> DataFrame:
    """Wide proposals. A text may hold line breaks, so give large CSV inputs as many files."""
    if fmt == "csv":
        return spark.read.schema(schema).csv(path, multiLine=True, **CSV)
    return spark.read.schema(schema).format(fmt).load(path)


def write_proposals(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        df.write.csv(path, **CSV)
    else:
        df.write.format(fmt).save(path)


def metadata(proposals: DataFrame) -> DataFrame:
    return proposals.select("doc_id", "skema")


def write_metadata(proposals: DataFrame, path: str) -> None:
    """Ids and categories of proposals as CSV with a header."""
    metadata(proposals).write.csv(path, **CSV)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """What `write_metadata` wrote, or any CSV with an id and a category in this order."""
    return spark.read.schema(METADATA).csv(path, **CSV)


def sections_from_lines(df: DataFrame, text_col: str, ids: list[str], sections=SECTIONS) -> DataFrame:
    """Cut a text into sections: one line each, and all further lines for the last one."""
    last = len(sections)
    rest = F.array_join(F.slice("lines", last, F.greatest(F.size("lines") - (last - 1), F.lit(0))), "\n")
    columns = [F.get("lines", F.lit(i)).alias(name) for i, name in enumerate(sections[:-1])]
    columns.append(F.when(F.size("lines") >= last, rest).alias(sections[-1]))
    return df.select(*ids, F.split(F.col(text_col), "\n").alias("lines")).select(*ids, *columns)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without passing all rows through one task.

    Ranges are sorted and written with their place inside the range; the ranges' sizes give each one its offset. There
    is one size per range, so their table is never longer than the number of shuffle partitions.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    local = runtime.written(local, "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__offset"))
    rows = local.withColumns({"__part": part, "__place": place})
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__place")).drop(
        "__at", "__part", "__place", "__offset"
    )


def upload_points(proposals: DataFrame, path: str | None = None, encoder=None, sections=SECTIONS) -> DataFrame:
    """Points (one per section text of more than ten characters), numbered, encoded and written."""
    rows = filter_min_chars(unpivot_sections(proposals, sections))
    rows = numbered(rows, [F.col("doc_id"), section_order(F.col("section"), sections)], "point_id")
    points = encode(rows.select("point_id", "doc_id", "skema", "section", "text"), "text", encoder)
    if path is None:
        return runtime.written(points, "points")
    points.write.partitionBy("section").parquet(path)
    return read_points(points.sparkSession, path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT_FIELDS).parquet(path)


def write_vectors(proposals: DataFrame, section: str, path: str, encoder=None) -> None:
    """Vectors of one section; null and blank texts have none."""
    rows = filter_nonblank(proposals.select("doc_id", "skema", F.col(section).alias("text")))
    encode(rows, "text", encoder).write.parquet(path)


def write_vector_store(points: DataFrame, path: str) -> None:
    """Vectors in one folder per category and section. Adaptive execution cuts large groups and joins small ones."""
    points.hint("rebalance", F.col("skema"), F.col("section")).write.partitionBy("skema", "section").parquet(path)


def read_vector_store(spark: SparkSession, path: str, section: str | None = None, skema: str | None = None) -> DataFrame:
    fields = "doc_id bigint, text string, embedding array<float>, skema string, section string"
    store = spark.read.schema(fields).parquet(path)
    if skema is not None:
        store = store.where(F.col("skema") == skema)
    if section is not None:
        store = store.where(F.col("section") == section)
    return store
