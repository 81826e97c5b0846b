"""JSON batches in, JSON responses out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kembar.functions import text as t
from kembar.schema import SECTIONS


BROKEN = "_broken"


def explode_request(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """A request {"texts": [...], "top_k": n, "threshold": x} -> one row per element, in order.

    A request that is no such object, and one without elements, is one row with a null element; the first has an `error`.
    """
    request = F.from_json(F.col(json_col), "texts array<string>, top_k int, threshold double")
    error = F.when(F.col("r.texts").isNull(), F.lit("Invalid request"))
    return df.select(*keys, request.alias("r")).select(
        *keys, F.col("r.top_k").alias("top_k"), F.col("r.threshold").alias("threshold"), error.alias("error"),
        F.posexplode_outer("r.texts").alias("query_index", "element"),
    )


def parse_query_batch(
    df: DataFrame, json_col: str = "element", item: str = "query_index", mode: str = "describe", sections=SECTIONS
) -> tuple[DataFrame, DataFrame]:
    """Batch elements -> (items with one column per section, rejected elements with an error).

    `describe` and `plain` unwrap an object from a list and give each bad element an error row, worded in detail or
    not. `skip` takes objects only and drops everything else.
    """
    raw = t.strip(F.col(json_col))
    head = F.substring(raw, 1, 1)
    inner = F.when(head == "{", raw)
    if mode != "skip":
        # Only an object is unwrapped, not a string that looks like one.
        inner = inner.when(F.regexp_extract(raw, r"^\[\s*(.)", 1) == "{", F.get_json_object(raw, "$[0]"))
    fields = T.StructType([T.StructField(name, T.StringType()) for name in ("skema", *sections)])
    looked = df.withColumns({"__raw": raw, "__head": head, "__inner": inner})
    parsed = T.StructType([*fields.fields, T.StructField(BROKEN, T.StringType())])
    looked = looked.withColumn("__item", F.from_json("__inner", parsed, {"columnNameOfCorruptRecord": BROKEN}))
    looked = looked.withColumn("__ok", F.col("__item").isNotNull() & F.col(f"__item.{BROKEN}").isNull())
    good = looked.where(F.col("__ok")).select(item, *[F.col("__item")[f].alias(f) for f in fields.names])
    kind = (
        F.when(F.col("__head") == '"', "str").when(F.col("__head").isin("t", "f"), "bool")
        .when(F.col("__head") == "n", "NoneType").when(F.col("__raw").rlike(r"^-?\d+$"), "int").otherwise("float")
    )
    if mode == "describe":
        error = F.when(F.col("__head") == "{", F.concat(F.lit("Invalid JSON: "), "__raw")).when(F.col("__head") == "[", F.concat(F.lit("Invalid list format: "), "__raw")).otherwise(
            F.concat(F.lit("Expected dict but got "), kind, F.lit(": "), "__raw")
        )
    else:
        error = F.lit("Invalid format")
    bad = looked.where(~F.col("__ok")).select(item, error.alias("error"))
    return good, bad if mode != "skip" else bad.where(F.lit(False))


def bulk_response(
    good: DataFrame, bad: DataFrame, results: DataFrame, item: str = "query_index",
    fields=("doc_id", "skema", "section", "similarity_score"), sections=SECTIONS,
) -> DataFrame:
    """One JSON element per element of a batch: results and what was searched, or an error in its place.

    `good` and `bad` are the written outcome of `parse_query_batch`. An item without results has an empty list; the
    sections that an item searches are those it has a text for.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("row")))), lambda x: x["row"])
    found = results.groupBy(item).agg(ordered.alias("results"))
    none = F.array().cast(found.schema["results"].dataType)
    searched = F.array_compact(F.array(*[F.when(F.coalesce(F.col(s), F.lit("")) != "", F.lit(s)) for s in sections]))
    answered = good.select(item, F.col("skema").alias("skema_filter"), searched.alias("columns_searched")).join(found, item, "left")
    answered = answered.withColumn("results", F.coalesce("results", none))
    info = F.struct("skema_filter", "columns_searched", F.size("results").alias("total_results"))
    keep_nulls = {"ignoreNullFields": "false"}
    return answered.select(
        item, F.to_json(F.struct(item, "results", info.alias("query_info")), keep_nulls).alias("response")
    ).unionByName(bad.select(item, F.to_json(F.struct(item, "error")).alias("response")))


def results_to_json(results: DataFrame, item: str = "query_index", fields=("doc_id", "skema", "section", "similarity_score"), items: DataFrame | None = None) -> DataFrame:
    """One JSON response per batch item, its results in rank order. An item holds at most k results.

    Items named in `items` that have no result get an empty list.
    """
    row = F.struct(*fields)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))), lambda x: x["row"])
    found = results.groupBy(item).agg(ordered.alias("results"))
    if items is not None:
        none = F.array().cast(found.schema["results"].dataType)
        found = items.select(item).distinct().join(found, item, "left").withColumn("results", F.coalesce("results", none))
    return found.select(
        item, F.to_json(F.struct("results", F.size("results").alias("total_results"))).alias("response")
    )
