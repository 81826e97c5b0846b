"""TF-IDF index as tables, and cosine search over it that stops early.

An index has four tables. `idf` holds one row per section and term. `vectors` holds one row per section and document with
its L2-normalised weights. `blocks` holds the same weights by term, for some thousand documents at a time: the postings of a
term are cut into layers of like weight, long layers into slices. `layers` sums the blocks up, with their greatest weights.
Weights are stored as tf, idf and the norm of the document, which repeat and so take a third of the room.

A search for scores from a bound on leaves out the lowest layers of its terms, as long as the greatest weights of what is
left out cannot add up to the bound: a document that stands in such layers only cannot reach it. Documents that do stand
in a layer that is read get the rest of their score from their vector, if their own bound still reaches.
"""

from __future__ import annotations

import weakref
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kembar import runtime
from kembar.functions import text as t
from kembar.functions.lists import STOP_WORDS
from kembar.operators.products import summed_products, wanted_weights
from kembar.operators.rows import own_limits, top_k, widest_limits
from kembar.operators.runs import listed, whole_runs

#: Postings of a term per slice; a block holds one layer of one slice.
SLICE_ROWS = 4096
BROADCAST_TERMS = 500_000
#: Bytes of text and postings that one task of a build takes, so that tasks grow in number and not in size.
TASK_BYTES, TASK_POSTINGS = 16 << 20, 1_000_000
#: Parts in which layers are summed up, one after the other, as all blocks of all tasks have rows that move.
LAYER_PARTS = 3
#: Stems that a task remembers.
KNOWN_STEMS = 300_000
TASK_PRODUCTS = 20_000_000
#: From so many products on, learning bounds and leaving layers out may cost less than multiplying everything. On 0.10 GB of
#: documents the early stop took 226 task seconds for the best ten, where multiplying took 50 for all scores above a bound.
STOP_FROM = 10_000_000_000
#: The part of the bound that layers left out may come to. More leaves out more layers, but settles fewer documents.
SPARED = 0.5
#: Postings and documents per wanted row that a first look at the heaviest layers takes, to learn the k-th score.
LOOK_POSTINGS, LOOK_DOCUMENTS = 50, 3
#: Categories up to which postings of a term are sorted out by category before they move.
ASKED = 64
#: What sums of doubles may be off by, and what rounding to six digits may hide.
SLACK, ROUNDING = 1e-9, 1e-6
ROWS_OF_A_SCORE = ["query_id", "section", "doc_id", "skema"]
#: A document's vector, where a null category is one of its own.
KEYS = ["section", "doc_id", "category"]
DOCUMENT = ["doc_id", "section", "skema"]


class TfidfIndex(NamedTuple):
    idf: DataFrame
    vectors: DataFrame
    blocks: DataFrame
    layers: DataFrame

    @property
    def postings(self) -> DataFrame:
        """One row per section, document and term."""
        rows = self.blocks.select("section", "term", "idf", F.explode("entries").alias("e"))
        return rows.select("section", "term", "e.doc_id", "e.skema", "e.tf", _weight().alias("w"))


def term_counts(df: DataFrame, keys: list[str], stop_words: bool = True, stem: bool = True) -> DataFrame:
    """How often each cleaned term occurs in each text.

    `explode_outer` keeps the optimizer from deriving a size filter that would clean every text a second time.
    """
    words = df.select(*keys, F.explode_outer(F.split(t.strip_noise(F.col("text")), f"[{t.SPACE}]+")).alias("word"))
    words = words.where(F.length("word") >= (1 if stem else 2))
    if stop_words:
        words = words.where(~t.is_stop_word(F.col("word")))
    terms = words.select(*keys, (t.stem(F.col("word")) if stem else F.col("word")).alias("term"))
    return terms.where(F.length("term") >= 2).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def counted_texts(df: DataFrame, keys: list[str], tasks: int, stop_words: bool = True, stem: bool = True) -> DataFrame:
    """The counts of `term_counts` as one row per key, in `terms`.

    Built-ins clean the texts. Each moves once, to the task of its key, where a word is stemmed once and no word is a row.
    """
    words = F.regexp_replace(t.strip_noise(F.col("text")), f"[{t.SPACE}]+", " ").alias("words")
    moved = df.select(*keys, words).repartition(tasks, *keys).sortWithinPartitions(*keys)
    least = 1 if stem else 2
    dropped = frozenset(STOP_WORDS) if stop_words else frozenset()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for table, starts in whole_runs(batches, keys):
            texts = table["words"].to_pylist()
            terms, numbers, lengths = [], [], []
            for start, end in zip(starts, [*starts[1:], len(texts)], strict=True):
                counts: dict[str, int] = {}
                for word, times in Counter(" ".join(texts[start:end]).split(" ")).items():
                    term = known.get(word)
                    if term is None:
                        term = "" if len(word) < least or word in dropped else t.stem_word(word) if stem else word
                        if len(known) >= KNOWN_STEMS:
                            known.clear()
                        known[word] = term
                    if len(term) >= 2:
                        counts[term] = counts.get(term, 0) + times
                terms.extend(counts)
                numbers.extend(counts.values())
                lengths.append(len(counts))
            counted = {"term": pa.array(terms, pa.string()), "tf": pa.array(numbers, pa.int64())}
            yield listed(table, starts, keys, "terms", counted, np.array(lengths))

    fields = [df.schema[k] for k in keys]
    return moved.mapInArrow(count, T.StructType(fields).add("terms", T.DataType.fromDDL("array<struct<term: string, tf: bigint>>")))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("section", "term").agg(F.count("*").alias("df"))


def smooth_idf(df_table: DataFrame, sizes: DataFrame) -> DataFrame:
    """ln((1 + n) / (1 + df)) + 1, where n counts blank texts too. `sizes` has one row per section."""
    return df_table.join(runtime.broadcast_if_small(sizes), "section").select(
        "section", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def with_idf(counts: DataFrame, idf: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Add df and idf to every posting without a hot join key.

    A small vocabulary is broadcast whole. Of a large one, only terms with more than total/limit postings are: there
    are fewer than `limit` of them, and they carry most rows. The rest, none of them hot, meet in a shuffle join.
    """
    on = ["section", "term"]
    terms, total = idf.agg(F.count("*"), F.sum("df")).first()
    if terms <= limit:
        return counts.join(runtime.broadcast_if_small(idf), on)
    floor = total / limit
    known = counts.join(runtime.broadcast_if_small(idf.where(F.col("df") > floor)), on, "left")
    hot = known.where(F.col("idf").isNotNull())
    cold = known.where(F.col("idf").isNull()).drop("df", "idf").join(idf.where(F.col("df") <= floor), on)
    return hot.unionByName(cold)


def layer_of(weight: Column) -> Column:
    """Two layers per halving of the weight, from 0 for the heaviest."""
    return F.floor(-2 * F.log2(F.greatest(F.round(weight, 6), F.lit(1e-6))) + 1e-6).cast("int")


def _weight() -> Column:
    """The weight of a posting `e`: of unit length over all terms of its document."""
    return F.col("e.tf") * F.col("idf") / F.col("e.norm")


class HotTerms(NamedTuple):
    """Terms with more than `floor` postings, for all tasks: numbers by section and term, and names and idf by number."""

    floor: float
    numbers: Broadcast
    values: Broadcast


def hot_terms(idf: DataFrame, limit: int = BROADCAST_TERMS) -> HotTerms:
    """A small vocabulary whole; of a large one, the terms that `with_idf` broadcasts."""
    context = idf.sparkSession.sparkContext
    terms, total = idf.agg(F.count("*"), F.sum("df")).first()
    floor = 0.0 if terms <= limit else total / limit
    hot = idf.where(F.col("df") > floor).orderBy(F.col("df").desc()).select("section", "term", "idf").toArrow()
    numbers: dict[str, dict[str, int]] = {}
    for number, (section, term) in enumerate(zip(hot["section"].to_pylist(), hot["term"].to_pylist(), strict=True)):
        numbers.setdefault(section, {})[term] = number
    return HotTerms(floor, context.broadcast(numbers), context.broadcast((hot["term"].combine_chunks(), hot["idf"].to_numpy())))


def known_terms(texts: DataFrame, hot: HotTerms) -> DataFrame:
    """Texts with the number of each hot term in place of it, and the other terms as they are, in `rare`."""
    numbers = hot.numbers

    def know(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            term, tf = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy()
            code, names = term.indices.to_numpy().astype(np.int64), term.dictionary.to_pylist()
            section = batch.column("section").dictionary_encode()
            sections = section.dictionary.to_pylist()
            cell = np.repeat(section.indices.to_numpy().astype(np.int64), lengths) * max(1, len(names)) + code
            cells, place = np.unique(cell, return_inverse=True)
            of_section = [numbers.value.get(s, {}) for s in sections]
            number = np.array([of_section[c // len(names)].get(names[c % len(names)], -1) for c in cells.tolist()], np.int32)[place]
            known = number >= 0
            ends = np.cumsum(lengths)
            many = np.diff(np.r_[0, np.r_[0, np.cumsum(known)][ends]])
            at = np.r_[0, np.cumsum(many)].tolist()
            number, times = number[known], tf[known].astype(np.int32)
            rare = pa.StructArray.from_arrays([flat.field("term").filter(pa.array(~known)), pa.array(tf[~known])], names=["term", "tf"])
            offsets = pa.array(np.r_[0, np.cumsum(lengths - many)].astype(np.int32))
            cut = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in DOCUMENT), pa.array([_planes(number[a:b]) for a, b in cut], pa.binary()),
                 pa.array([_planes(times[a:b]) for a, b in cut], pa.binary()), pa.ListArray.from_arrays(offsets, rare)],
                names=[*DOCUMENT, "numbers", "times", "rare"])

    fields = T.StructType([texts.schema[k] for k in DOCUMENT]).add("numbers", "binary").add("times", "binary")
    return texts.where(F.size("terms") > 0).mapInArrow(know, fields.add("rare", T.DataType.fromDDL("array<struct<term: string, tf: bigint>>")))


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def rare_postings(known: DataFrame, idf: DataFrame, hot: HotTerms) -> DataFrame:
    """Postings of terms that are not hot, with their idf."""
    rare = known.select(*DOCUMENT, F.explode("rare").alias("e")).select(*DOCUMENT, "e.*")
    return rare.join(idf.where(F.col("df") <= hot.floor).drop("df"), ["section", "term"]).select(*DOCUMENT, "term", "tf", "idf")


def document_vectors(known: DataFrame, rare: DataFrame, hot: HotTerms, tasks: int) -> DataFrame:
    """Terms of each section text with their idf, and in `norm` the length that their weights tf * idf are divided by.

    Known terms got their idf where the text lies; the long tail met it in a join. A text moves once, its known terms as
    numbers, to the task that puts both parts together.
    """
    values = hot.values
    rows = known.drop("rare").unionByName(rare, allowMissingColumns=True)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_terms, hot_idf = values.value
        for table, starts in whole_runs(batches, DOCUMENT):
            whole = np.flatnonzero(table["numbers"].is_valid().to_numpy())
            many = np.ones(table.num_rows, np.int64)
            found = [_numbers(x) for x in table["numbers"].drop_null().to_pylist()]
            many[whole] = [len(x) for x in found]
            is_hot = np.repeat(np.isin(np.arange(table.num_rows), whole), many)
            at, tf = np.empty(len(is_hot), np.int64), np.empty(len(is_hot), np.int64)
            at[is_hot] = np.concatenate([np.empty(0, np.int32), *found])
            tf[is_hot] = np.concatenate([np.empty(0, np.int32), *map(_numbers, table["times"].drop_null().to_pylist())])
            at[~is_hot] = len(hot_idf) + np.arange(table.num_rows - len(whole))
            tf[~is_hot] = table["tf"].drop_null().to_numpy()
            term = pa.concat_arrays([hot_terms, table["term"].drop_null().combine_chunks()]).take(pa.array(at))
            idf = np.concatenate([hot_idf, table["idf"].drop_null().to_numpy()])[at]
            lengths = np.add.reduceat(many, starts)
            raw = tf * idf
            norm = np.sqrt(np.add.reduceat(raw * raw, np.cumsum(lengths) - lengths))
            found = listed(table, starts, DOCUMENT, "terms", {"term": term, "tf": pa.array(tf), "idf": pa.array(idf)}, lengths)
            yield found.add_column(len(DOCUMENT), "norm", pa.array(norm))

    schema = T.StructType([known.schema[k] for k in DOCUMENT]).add("norm", "double")
    schema = schema.add("terms", T.DataType.fromDDL("array<struct<term: string, tf: bigint, idf: double>>"))
    return rows.repartition(tasks, *DOCUMENT).sortWithinPartitions(*DOCUMENT).mapInArrow(weigh, schema)


def posting_blocks(vectors: DataFrame, tasks: int) -> DataFrame:
    """Blocks (section, term, layer, slice) of the postings of TASK_POSTINGS or so at a time, made where the vectors lie.

    No posting moves, and documents of a block are few, so that their ids and norms take little room. A term has blocks in
    every such part of the documents that holds it; its postings there are cut into slices of SLICE_ROWS,
    numbered from the number of the task on, so that ranges can cut the blocks of one term. Vectors move only if they lie in
    so few pieces that most cores would wait.
    """
    pieces = vectors.rdd.getNumPartitions()
    if 3 * pieces < tasks and pieces < 4 * vectors.sparkSession.sparkContext.defaultParallelism:
        vectors = vectors.repartition(tasks, "doc_id")
    on = ["section", "term", "layer", "slice"]
    longest, held = SLICE_ROWS, TASK_POSTINGS

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        kept, many = [], 0
        for batch in batches:
            total = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0)
            start = 0
            while start < batch.num_rows:
                before = total[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(total, before + held - many, "right")))
                kept.append(batch.slice(start, end - start))
                many += total[end - 1] - before
                start = end
                if many >= held or start < batch.num_rows:
                    yield pa.Table.from_batches(kept)
                    kept, many = [], 0
        if kept:
            yield pa.Table.from_batches(kept)

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for table in parts(batches):
            table = table.combine_chunks()
            lists = table["terms"].combine_chunks()
            doc = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            tf, idf, norm = flat.field("tf").to_numpy(), flat.field("idf").to_numpy(), table["norm"].to_numpy()[doc]
            weight = np.maximum(np.floor(tf * idf / norm * 1e6 + 0.5) / 1e6, 1e-6)
            layer = np.floor(-2 * np.log2(weight) + 1e-6).astype(np.int64)  # as layer_of has it
            coded = flat.field("term").dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            section = table["section"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[doc]
            key = ((section + 1).astype(np.int64) * len(rank) + rank[coded.indices.to_numpy()]) * 64 + layer
            order = np.argsort(key, kind="stable")
            key = key[order]
            terms = np.flatnonzero(np.r_[True, key[1:] // 64 != key[:-1] // 64])
            slices = (np.arange(len(key)) - np.repeat(terms, np.diff(np.r_[terms, len(key)]))) // longest
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (slices[1:] != slices[:-1])])
            first, of_doc, by = pa.array(order[starts]), pa.array(doc[order]), pa.array(order)
            entries = pa.StructArray.from_arrays(
                [table["doc_id"].combine_chunks().take(of_doc), table["skema"].combine_chunks().take(of_doc), flat.field("tf").take(by), pa.array(norm[order])],
                names=["doc_id", "skema", "tf", "norm"])
            yield pa.RecordBatch.from_arrays(
                [table["section"].combine_chunks().take(pa.array(doc[order[starts]])), flat.field("term").take(first),
                 pa.array(layer[order[starts]].astype(np.int32)), pa.array((task + slices[starts]).astype(np.int32)), flat.field("idf").take(first),
                 pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), entries)],
                names=[*on, "idf", "entries"])

    entry = T.StructType([vectors.schema["doc_id"], vectors.schema["skema"]]).add("tf", "long").add("norm", "double")
    schema = T.StructType([vectors.schema["section"]]).add("term", "string").add("layer", "integer").add("slice", "integer").add("idf", "double")
    return vectors.mapInArrow(block, schema.add("entries", T.ArrayType(entry)))


def layer_table(blocks: DataFrame) -> DataFrame:
    heaviest = F.array_max(F.transform("entries", lambda e: e["tf"] * F.col("idf") / e["norm"]))
    return blocks.groupBy("section", "term", "layer").agg(
        F.max(heaviest).alias("top"), F.sum(F.size("entries")).cast("bigint").alias("n")
    )


def fit(sections: DataFrame, stop_words: bool = True, stem: bool = True) -> TfidfIndex:
    """Build the index of (doc_id, skema, section, text); its tables are written to the shared folder."""
    least = sections.sparkSession.sparkContext.defaultParallelism
    sizes = sections.groupBy("section").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = runtime.written(sizes, "section-sizes")
    tasks = max(least, (sizes.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES + 1)
    texts, drop_texts = runtime.passing(counted_texts(sections, DOCUMENT, tasks, stop_words, stem), "counted-texts")
    counts = texts.select(*DOCUMENT, F.explode("terms").alias("e")).select(*DOCUMENT, "e.*")
    idf = runtime.written(smooth_idf(document_frequency(counts), sizes.drop("bytes")), "idf")
    hot = hot_terms(idf)
    known, drop_known = runtime.passing(known_terms(texts, hot), "known-terms")
    drop_texts()
    rare, drop_rare = runtime.passing(rare_postings(known, idf, hot), "rare-postings")
    tasks = max(least, (idf.agg(F.sum("df")).first()[0] or 0) // TASK_POSTINGS + 1)
    weighed = document_vectors(known, rare, hot, tasks)
    for drop in (drop_known, drop_rare, hot.numbers.destroy, hot.values.destroy):
        weakref.finalize(weighed, drop).atexit = False  # what it reads goes with it
    vectors = runtime.written(weighed, "vectors")
    del weighed
    blocks = runtime.written(posting_blocks(vectors, tasks), "blocks")
    of_part = F.pmod(F.xxhash64("section", "term"), F.lit(LAYER_PARTS))
    layers = runtime.written_in_turn([layer_table(blocks.where(of_part == part)) for part in range(LAYER_PARTS)], "layers")
    return TfidfIndex(idf, vectors, blocks, layers)


_ORDER = {"idf": ["term"], "vectors": ["doc_id"], "blocks": ["term", "layer", "slice"], "layers": ["term", "layer"]}


def save(index: TfidfIndex, path: str) -> None:
    """Write the index laid out for look-ups: one folder per section, files sorted by term, vectors by document.

    Ranges cut a long posting list into several files, and row-group statistics let a search skip the files without its
    terms and layers.
    """
    for name, order in _ORDER.items():
        order = ["section", *order]
        table = getattr(index, name)
        with runtime.short_shuffles(table.sparkSession):
            rows = table.repartitionByRange(*order).sortWithinPartitions(*order)
            rows.write.option("compression", "zstd").partitionBy("section").parquet(f"{path}/{name}")


def load(spark, path: str) -> TfidfIndex:
    schemas = {
        "idf": "term string, df bigint, idf double",
        "vectors": "doc_id bigint, skema string, norm double, terms array<struct<term: string, tf: bigint, idf: double>>",
        "blocks": "term string, layer int, slice int, idf double, "
                  "entries array<struct<doc_id: bigint, skema: string, tf: bigint, norm: double>>",
        "layers": "term string, layer int, top double, n bigint",
    }
    return TfidfIndex(**{
        name: spark.read.schema(f"{schemas[name]}, section string").parquet(f"{path}/{name}") for name in TfidfIndex._fields
    })


def transform(
    index: TfidfIndex, queries: DataFrame, stop_words: bool = True, stem: bool = True
) -> DataFrame:
    """Unit-length query weights per (query_id, section); terms the corpus lacks vanish before normalising."""
    queries = queries.withColumn("skema", F.nullif(F.col("skema"), F.lit("")))
    counts = term_counts(queries, ["query_id", "section", "skema"], stop_words, stem)
    counts = runtime.written(counts, "query-counts")
    weighted = index.idf.join(runtime.broadcast_if_small(counts), ["section", "term"])
    norm = F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).over(Window.partitionBy("query_id", "section")))
    return weighted.select(
        "query_id", "section", "skema", "term", "df", (F.col("tf") * F.col("idf") / norm).alias("qw")
    )


def query_blocks(weights: DataFrame, limit: int = runtime.BROADCAST_BYTES) -> Iterator[DataFrame]:
    """Written query weights in parts that may be broadcast; the weights of one query stay together."""
    size = runtime.measured_bytes(weights)
    if size <= limit:
        yield weights
        return
    parts = 2 * size // max(1, limit) + 1
    for part in range(parts):
        block = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        if not block.isEmpty():
            yield block


def _category() -> Column:
    return F.concat_ws(":", F.col("skema").isNull().cast("string"), "skema")


def _united(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _wanted_terms(weights: DataFrame) -> DataFrame:
    """Per term of `weights`: the deepest layer wanted, and the categories asked for, if all of its queries ask for one of few."""
    any_skema = F.max(F.col("wanted_skema").isNull())
    asked = F.collect_set("wanted_skema")
    return weights.groupBy("section", "term").agg(
        F.max("upto").alias("deepest"), F.when(~any_skema & (F.size(asked) <= ASKED), asked).alias("asked")
    )


def _moved_postings(blocks: DataFrame, wanted: DataFrame, products: int, *names: str) -> DataFrame:
    """Wanted postings with `names` of their term, each moved once, to the task of its document.

    Blocks of other terms and of deeper layers are left out before their postings are unpacked, postings of other categories
    before they move. `products` says how many tasks that takes.
    """
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, products // TASK_PRODUCTS + 1)
    hits = blocks.join(F.broadcast(wanted), ["section", "term"]).where(F.col("layer") <= F.col("deepest"))
    kept = F.filter("entries", lambda e: F.col("asked").isNull() | F.array_contains("asked", e["skema"]))
    hits = hits.select(*names, "layer", "idf", F.explode(kept).alias("e"))
    hits = hits.select(*names, "layer", "e.doc_id", "e.skema", _weight().alias("w"))
    return hits.repartition(tasks, "doc_id")


def join_postings(blocks: DataFrame, weights: DataFrame, products: int) -> DataFrame:
    """Every wanted posting beside the weight of each query that wants it, in the task of its document.

    `weights` (query_id, section, wanted_skema, term, qw, deepest layer wanted in `upto`) is broadcast; each posting moves
    once, however many queries want it.
    """
    pairs = _moved_postings(blocks, _wanted_terms(weights), products, "section", "term").join(F.broadcast(weights), ["section", "term"])
    same = F.col("wanted_skema").isNull() | (F.col("wanted_skema") == F.col("skema"))
    return pairs.where((F.col("layer") <= F.col("upto")) & same)


def sum_products(
    blocks: DataFrame, weights: DataFrame, products: int, score: str, extra: Sequence[str] = (), least: float | None = None
) -> DataFrame:
    """The pairs of `join_postings` summed per query and document: w * qw as `score`, and `extra` columns of `weights`.

    `weights` has the size of a broadcast and goes to the tasks as arrays; terms travel as numbers. With `least`, smaller
    scores are left out.
    """
    on = ["section", "term"]
    number = F.row_number().over(Window.orderBy(*on)) - 1
    wanted = runtime.written(_wanted_terms(weights).withColumn("no", number), "wanted-terms")
    rows = weights.join(F.broadcast(wanted.select(*on, "no")), on).select("no", "query_id", "section", "wanted_skema", "qw", "upto", *extra).toArrow()
    postings = _moved_postings(blocks, wanted, products, "no").sortWithinPartitions("doc_id")
    return summed_products(postings, wanted_weights(rows, wanted.count(), extra), score, least)


def _weights(weights: DataFrame) -> DataFrame:
    return runtime.written(weights.withColumnRenamed("skema", "wanted_skema"), "query-weights")


def cosine(index: TfidfIndex, weights: DataFrame, limit: int = runtime.BROADCAST_BYTES) -> DataFrame:
    """Cosine of every query with every document of its section that shares a term (and the category, if asked).

    Nothing can be left out here; see `scores_from` for scores above a bound.
    """
    parts = []
    for block in query_blocks(_weights(weights), limit):
        parts.append(_all_products(index, block, block.agg(F.sum("df")).first()[0] or 0))
    return _united(parts)


def _all_products(index: TfidfIndex, block: DataFrame, products: int, least: float | None = None) -> DataFrame:
    return sum_products(index.blocks, block.drop("df").withColumn("upto", F.lit(1 << 30)), products, "similarity_score", least=least)


def choose_layers(layers: DataFrame, weights: DataFrame, needs: DataFrame) -> DataFrame:
    """Per query and term: the deepest layer to read (`upto`), and the most that a posting left out can add (`rest`).

    `needs` (query_id, section, need) is the score that matters from. Starting with the lightest layer of each term, layers
    are left out in order of postings saved per score given away, until the scores given away come to `need`. Also returns
    how many postings a term has (`n`), and how many of them are read (`n_read`).
    """
    on = ["query_id", "section"]
    rows = layers.join(F.broadcast(weights), ["section", "term"]).withColumn("bound", F.col("qw") * F.col("top"))
    upward = Window.partitionBy(*on, "term").orderBy(F.col("layer").desc())
    rows = rows.withColumn("cost", F.col("bound") - F.coalesce(F.lag("bound").over(upward), F.lit(0.0)))
    # A lighter layer can never be read without the heavier ones, so its rank is at least theirs.
    rows = rows.withColumn("gain", F.min(F.col("n") / F.greatest("cost", F.lit(1e-12))).over(upward))
    in_order = Window.partitionBy(*on).orderBy(F.col("gain").desc(), "term", F.col("layer").desc())
    rows = rows.withColumn("given", F.sum("cost").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(F.broadcast(needs), on).withColumn("skipped", F.col("given") < F.col("need") - SLACK)
    return rows.groupBy(*on, "wanted_skema", "term", "qw").agg(
        F.coalesce(F.max(F.when(~F.col("skipped"), F.col("layer"))), F.lit(-1)).alias("upto"),
        F.sum(F.when(F.col("skipped"), F.col("cost")).otherwise(0.0)).alias("rest"),
        F.sum("n").alias("n"), F.sum(F.when(F.col("skipped"), 0).otherwise(F.col("n"))).alias("n_read"),
    )


def _kth(scored: DataFrame, k: int, score: str) -> DataFrame:
    """The k-th greatest score per query and section, where there are k."""
    first = top_k(scored, ["query_id", "section"], [F.col(score).desc()], k)
    return first.groupBy("query_id", "section").agg(F.min(score).alias("kth"), F.count("*").alias("many")).where(F.col("many") == k).drop("many")


def _needs(weights: DataFrame, cutoff: float, kth: DataFrame | None = None) -> DataFrame:
    asked = weights.select("query_id", "section").distinct()
    if kth is None:
        return asked.withColumn("need", F.lit(float(cutoff)))
    need = F.greatest(F.lit(float(cutoff)), F.coalesce(F.col("kth") - ROUNDING, F.lit(0.0)))
    return asked.join(F.broadcast(kth), ["query_id", "section"], "left").select("query_id", "section", need.alias("need"))


def _first_look(index: TfidfIndex, weights: DataFrame, k: int, limit: int) -> DataFrame:
    """A lower bound of the k-th score per query and section.

    The heaviest layers name documents; the best few of those by what these layers alone give are scored in full.
    """
    rows = index.layers.join(F.broadcast(weights), ["section", "term"])
    heaviest = Window.partitionBy("query_id", "section").orderBy((F.col("qw") * F.col("top")).desc(), "term", "layer")
    before = F.coalesce(F.sum("n").over(heaviest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = rows.withColumn("before", before).where(F.col("before") < LOOK_POSTINGS * k)
    some = taken.groupBy("query_id", "section", "wanted_skema", "term", "qw").agg(F.max("layer").alias("upto"), F.sum("n").alias("n"))
    some = runtime.written(some, "first-look")
    partial = sum_products(index.blocks, some.drop("n"), some.agg(F.sum("n")).first()[0] or 0, "partial")
    best = top_k(partial, ["query_id", "section"], [F.col("partial").desc(), F.col("doc_id")], LOOK_DOCUMENTS * k)
    exact = _missing_parts(index, best, weights.withColumn("upto", F.lit(-1)), limit)
    return runtime.written(_kth(exact, k, "missing"), "kth-scores")


def _chosen(
    index: TfidfIndex, weights: DataFrame, cutoff: float, k: int | None, spared: float, limit: int = runtime.BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """What to read for each query, and from which score on documents matter to it."""
    kth = None if k is None else _first_look(index, weights, k, limit)
    needs = runtime.written(_needs(weights, cutoff, kth), "needs")
    budget = needs.withColumn("need", F.col("need") * spared)
    return runtime.written(choose_layers(index.layers, weights, budget), "chosen-layers"), needs


def postings_read(
    index: TfidfIndex, weights: DataFrame, cutoff: float = 0.1, k: int | None = None, spared: float = SPARED
) -> DataFrame:
    """(query_id, section, n, n_read): postings of the query's terms, and those that an early stop multiplies."""
    parts = [_chosen(index, block.drop("df"), cutoff, k, spared)[0] for block in query_blocks(_weights(weights))]
    return _united(parts).groupBy("query_id", "section").agg(F.sum("n").alias("n"), F.sum("n_read").alias("n_read"))


def scores_from(
    index: TfidfIndex, weights: DataFrame, cutoff: float, k: int | None = None, limit: int = runtime.BROADCAST_BYTES,
    stop_from: int = STOP_FROM, spared: float = SPARED,
) -> DataFrame:
    """Exact cosines of at least `cutoff`; with `k`, rows that cannot be among the first k of their query may be missing.

    Queries that do not fit a broadcast are taken in blocks, one after the other; the index never moves as a whole. A
    block whose terms have fewer than `stop_from` postings is multiplied in full, with the same result.
    """
    weights = _weights(weights)
    parts = []
    for block in query_blocks(weights, limit):
        products = block.agg(F.sum("df")).first()[0] or 0
        if products < stop_from:
            parts.append(_all_products(index, block, products, cutoff))
        else:
            parts.append(_scores_of_block(index, block.drop("df"), cutoff, k, limit, spared))
    return _united(parts)


def _scores_of_block(index: TfidfIndex, weights: DataFrame, cutoff: float, k: int | None, limit: int, spared: float) -> DataFrame:
    chosen, needs = _chosen(index, weights, cutoff, k, spared, limit)
    on = ["query_id", "section"]
    read = chosen.where(F.col("upto") >= 0)
    partial = sum_products(index.blocks, read.withColumn("seen", F.col("rest")), read.agg(F.sum("n_read")).first()[0] or 0, "partial", ["seen"])
    given = chosen.groupBy(*on).agg(F.sum("rest").alias("given")).join(F.broadcast(needs), on)
    open_part = F.greatest(F.col("given") - F.col("seen"), F.lit(0.0))
    left = partial.join(F.broadcast(given), on).withColumn("open", open_part)
    left = left.where(F.col("partial") + F.col("open") >= F.col("need") - SLACK).drop("given", "seen", "need")
    left = runtime.written(left, "partial-scores")
    rest = _missing_parts(index, left.where(F.col("open") > 0), chosen.where(F.col("rest") > 0), limit)
    whole = left.withColumn("category", _category()).join(rest, ["query_id", *KEYS], "left")
    score = F.col("partial") + F.coalesce("missing", F.lit(0.0))
    return whole.select(*ROWS_OF_A_SCORE, score.alias("similarity_score")).where(F.col("similarity_score") >= cutoff)


def _missing_parts(index: TfidfIndex, open_rows: DataFrame, skipped: DataFrame, limit: int) -> DataFrame:
    """What layers deeper than `upto` of `skipped` add to the score of open rows, from the documents' vectors.

    Vectors are fetched once per document, and of their terms only those go on that some query left out.
    """
    open_rows = runtime.written(open_rows.select("query_id", "section", "doc_id", _category().alias("category")), "open-scores")
    documents = runtime.broadcast_if_small(open_rows.select(*KEYS).distinct(), limit)
    found = index.vectors.withColumn("category", _category()).join(documents, KEYS, "left_semi")
    weight = F.col("e.tf") * F.col("e.idf") / F.col("norm")
    terms = found.select(*KEYS, "norm", F.explode("terms").alias("e")).select(*KEYS, "e.term", weight.alias("w"), layer_of(weight).alias("layer"))
    terms = terms.join(F.broadcast(skipped.select("section", "term").distinct()), ["section", "term"], "left_semi")
    pairs = terms.join(runtime.broadcast_if_small(open_rows, limit), KEYS)
    pairs = pairs.join(F.broadcast(skipped.select("query_id", "section", "term", "qw", "upto")), ["query_id", "section", "term"])
    added = pairs.where(F.col("layer") > F.col("upto")).groupBy("query_id", *KEYS)
    return added.agg(F.sum(F.col("w") * F.col("qw")).alias("missing"))


def search(
    index: TfidfIndex, queries: DataFrame, k: int = 10, cutoff: float = 0.1, stop_words: bool = True,
    stem: bool = True, **sizes,
) -> DataFrame:
    """Top k documents per (query_id, section) with a cosine of at least `cutoff`, which must be positive to stop early."""
    scored = scores_from(index, transform(index, queries, stop_words, stem), cutoff, k, **sizes)
    scored = scored.withColumn("similarity_score", F.round("similarity_score", 6))
    return top_k(scored, ["query_id", "section"], [F.col("similarity_score").desc(), F.col("doc_id")], k)


def search_requests(
    index: TfidfIndex, requests: DataFrame, k: int = 10, cutoff: float = 0.1, stop_words: bool = True, stem: bool = True, **sizes
) -> DataFrame:
    """A search in which each query may have its own `k` and `threshold`; nulls mean the given ones.

    One search with the widest limits answers all requests, and each then keeps what it asked for.
    """
    most, least = widest_limits(requests, k, cutoff)
    found = search(index, requests.drop("k", "threshold"), most, least, stop_words, stem, **sizes)
    return own_limits(found, requests.select(*[c for c in ("query_id", "k", "threshold") if c in requests.columns]).distinct(), k, cutoff)


def pair_cosine(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """TF-IDF cosine where each pair of texts is a corpus of its own (n = 2)."""
    sides = pairs.select(key, F.lit(0).alias("side"), F.col(a).alias("text")).unionByName(
        pairs.select(key, F.lit(1).alias("side"), F.col(b).alias("text"))
    )
    terms = sides.select(key, "side", F.explode_outer(t.tokenize_tfidf(F.col("text"))).alias("term"))
    per_term = terms.where(F.col("term").isNotNull()).groupBy(key, "term").agg(
        F.count_if(F.col("side") == 0).alias("ta"), F.count_if(F.col("side") == 1).alias("tb")
    )
    both = (F.col("ta") > 0) & (F.col("tb") > 0)
    weight = F.log(3.0 / F.when(both, F.lit(3.0)).otherwise(F.lit(2.0))) + 1
    sums = per_term.withColumns({"wa": F.col("ta") * weight, "wb": F.col("tb") * weight}).groupBy(key).agg(
        F.sum(F.col("wa") * F.col("wb")).alias("dot"),
        F.sum(F.col("wa") * F.col("wa")).alias("aa"), F.sum(F.col("wb") * F.col("wb")).alias("bb"),
    )
    score = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("dot") / F.sqrt(F.col("aa") * F.col("bb")))
    scored = sums.select(key, score.alias("tfidf_cosine"))
    return pairs.join(scored, key, "left").withColumn("tfidf_cosine", F.coalesce("tfidf_cosine", F.lit(0.0)))
