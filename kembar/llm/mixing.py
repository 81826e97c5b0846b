"""Mixing sources to target weights: whole copies first, Pareto order sampling for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kembar import runtime
from kembar.llm.words import text_or_empty, whole_rows, word_total

#: Classes of sampling rank in which sizes are summed before the cut is looked for.
RANK_CLASSES = 4096


def cycled_weights(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds `weight` to (source, source_size): the given ones in turn, sources by code point, null last.

    There is one row per source here, so one task may number them.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))


def shared_targets(totals: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Adds `target` to (source, source_size, weight): a share of all sizes, dealt by weight, at most `most` times a source.

    What a source cannot take is dealt again by weight among the others until none is above its limit. With the sources
    sorted by limit per weight, the full ones come first; if the first k are full, the others get `level` per weight, and
    the right k is the one with the highest level. `share` is (numerator, denominator); sums stay whole numbers.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    num, den = share
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = totals.select(
        "*", (num * F.sum("source_size").over(Window.partitionBy()) - den * most * before).alias("left"),
        (den * F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("among"),
    )
    level = F.max(F.struct((F.col("left") / F.col("among")).alias("level"), "left", "among")).over(Window.partitionBy())
    fair = F.col("weight") * F.col("best.left") / F.col("best.among")
    return rows.withColumn("best", level).select(
        "source", "source_size", "weight", F.least(F.lit(float(most)) * F.col("source_size"), fair).alias("target")
    )


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that a key and a seed fix."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def mix(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for rows (doc_id, source, size, tilt) and targets by source.

    A source whose target is r times its size takes every row floor(r) times. One more copy goes to a sample: row i has
    inclusion odds in proportion to its `tilt`, its rank is its random odds divided by those inclusion odds, and the rows of
    lowest rank are taken until their sizes fill the rest of the target (Pareto order sampling of a fixed size in
    words). The first row that would go over the target is left out; the one row whose size comes closest to what is
    then missing is taken in its place, if that brings the sum nearer.

    Sizes are summed per source and class of rank first, so only the rows of the one class in which the cut lies are
    put in order. Ties in rank go by id, size, then by place; null ids rank like any other key; a null source is a
    source; rows of size 0 take nothing. The same rows give the same mix. No rows: no rows.
    """
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    u = uniform(F.col("doc_id"), seed)
    rows = sized.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "source", key.alias("source_key"), "size",
        (u / (1 - u) / F.col("tilt")).alias("rank"),
    )
    rows = rows.withColumn("class", F.floor(F.col("rank") / (1 + F.col("rank")) * RANK_CLASSES))
    rows = runtime.written(rows, "mix-rows")

    goal = targets.select(
        key.alias("source_key"), "source_size", "target",
        F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).alias("copies"),
    ).withColumn("extra", F.col("target") - F.col("copies") * F.col("source_size"))
    goal = F.broadcast(goal) if runtime.fits_broadcast(goal) else goal

    up = Window.partitionBy("source_key").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("source_key", "class").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(up))
    crossed = sums.join(goal.select("source_key", "extra"), "source_key").where(F.col("upto") > F.col("extra"))
    cut = crossed.groupBy("source_key").agg(F.min_by(F.struct("class", (F.col("upto") - F.col("words")).alias("before")), "class").alias("cut"))
    cuts = runtime.written(
        goal.join(cut, "source_key", "left").select(
            "source_key", "source_size", "target", "copies", "extra", F.col("cut.class").alias("cut_class"), F.col("cut.before").alias("before")
        ), "mix-cuts",
    )
    cuts = runtime.broadcast_if_small(cuts)

    placed = rows.join(cuts, "source_key")
    order = Window.partitionBy("source_key").orderBy("rank", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(F.col("class") == F.col("cut_class")).withColumn("upto", F.col("before") + F.sum("size").over(order))
    edge = runtime.written(
        edge.select("source_key", "uid", "size", "upto", (F.col("upto") <= F.col("extra")).alias("fits")), "mix-edge"
    )
    filled = edge.where("fits").groupBy("source_key").agg(F.max("upto").alias("filled"))
    filled = cuts.where("cut_class is not null").join(filled, "source_key", "left").select(
        "source_key", "extra", "cut_class", F.coalesce("filled", "before").alias("filled")
    )
    filled = runtime.broadcast_if_small(runtime.written(filled, "mix-filled"))
    in_edge = edge.where("fits").select("uid", F.lit(True).alias("fits"))
    marked = rows.join(in_edge, "uid", "left")
    left_out = marked.where("fits is null").join(filled, "source_key").where(F.col("class") >= F.col("cut_class"))
    missing = F.col("extra") - F.col("filled")
    nearer = left_out.where(F.abs(F.col("size") - missing) < missing)
    closing = nearer.groupBy("source_key").agg(
        F.min(F.struct(F.abs(F.col("size") - missing).alias("off"), "rank", "doc_id", "size", "uid")).alias("c")
    ).select(F.col("c.uid").alias("uid"), F.lit(True).alias("closes"))

    extra_copy = (F.col("class") < F.coalesce("cut_class", F.lit(RANK_CLASSES + 1))) & (F.col("extra") > 0) | F.col("fits").isNotNull() | F.col("closes").isNotNull()
    taken = F.col("size") * (F.col("copies") + F.when(extra_copy, 1).otherwise(0))
    return marked.join(runtime.broadcast_if_small(closing), "uid", "left").join(cuts, "source_key").select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken")
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tilt): words of each whole text; longer texts get somewhat higher odds."""
    rows = docs.select("doc_id", "source", word_total(text_or_empty()).alias("size"))
    return rows.withColumn("tilt", F.log2(F.col("size") + 2))


def source_totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """`mix` over whole documents (doc_id, source, text), sources weighted in turn; null texts have size 0."""
    sized = runtime.written(sized_documents(docs), "sizes")
    return mix(sized, shared_targets(cycled_weights(source_totals(sized), weights), share, most), seed)


def mix_copies(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", copies_col: str = "copies",
) -> DataFrame:
    """Rows of `docs`, all columns, with `copies_col`: how often the mix takes each, whole; rows without words are never taken.

    Rows are matched by id, source and size; rows that agree in all three are numbered on both sides in any order, as
    each of them stands for the same number of words. `docs` must not have a column called `copies_col`.
    """
    if copies_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {copies_col}; name another one for the copies")
    mixed = mix_documents(docs, weights, share, most, seed)
    keys = ["id", "source", "size"]
    same = Window.partitionBy(*keys).orderBy(F.lit(0))
    found = mixed.select(
        F.col("doc_id").alias("id"), "source", "size", F.coalesce(F.try_divide("taken", "size"), F.lit(0)).cast("int").alias("copies"),
    ).withColumn("n", F.row_number().over(same)).alias("found")
    own = docs.select(whole_rows(docs), docs["doc_id"].alias("id"), docs["source"], word_total(text_or_empty()).alias("size"))
    own = own.withColumn("n", F.row_number().over(same)).alias("own")
    match = [F.col(f"own.{k}").eqNullSafe(F.col(f"found.{k}")) for k in [*keys, "n"]]
    return own.join(found, match).select("own.row.*", F.col("found.copies").alias(copies_col))
