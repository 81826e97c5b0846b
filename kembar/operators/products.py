"""Sums of products of wanted postings, document by document on Arrow batches, with the weights of a block of queries as arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kembar.operators.runs import whole_runs

#: Products that are held at once; a document has at most one per weight of the block.
PRODUCTS = 1_000_000


class Wanted(NamedTuple):
    """Weights of a block of queries by number of the term, where `starts` says where a term starts.

    `ids` and `sections` hold the query of each number, `section` the number of each term's section. `skema` is the number
    of the only category that a weight is for, or -1.
    """

    starts: np.ndarray
    section: np.ndarray
    query: np.ndarray
    qw: np.ndarray
    upto: np.ndarray
    skema: np.ndarray
    extra: dict[str, np.ndarray]
    skemas: dict[str, int]
    ids: pa.Array
    sections: pa.Array


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of equal values from 0, a null having its own, and the values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def wanted_weights(rows: pa.Table, terms: int, extra: Iterable[str] = ()) -> Wanted:
    """`rows` (no, query_id, section, wanted_skema, qw, upto, and the columns of `extra`), with term numbers below `terms`."""
    no = rows["no"].to_numpy().astype(np.int64)
    rows = rows.take(pa.array(np.argsort(no, kind="stable")))
    no = np.sort(no, kind="stable")
    section, sections = _codes(rows["section"])
    query, ids = _codes(rows["query_id"])
    asked, at, number = np.unique(query * max(1, len(sections)) + section, return_index=True, return_inverse=True)
    of_term = np.zeros(terms, np.int64)
    of_term[no] = section
    skema = rows["wanted_skema"].combine_chunks().dictionary_encode()
    return Wanted(
        np.searchsorted(no, np.arange(terms + 1)), of_term, number.ravel(), rows["qw"].to_numpy(), rows["upto"].to_numpy(),
        skema.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), {name: rows[name].to_numpy() for name in extra},
        {name: code for code, name in enumerate(skema.dictionary.to_pylist())},
        ids.take(pa.array(query[at])), sections.take(pa.array(section[at])),
    )


def _document_rows(table: pa.Table, wanted: Wanted) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows in order of (doc_id, category, section), where each such document starts, and the wanted number of each category."""
    skema, names = _codes(table["skema"])
    doc, _ = _codes(table["doc_id"])
    section = wanted.section[table["no"].to_numpy()]
    key = (doc * (skema.max() + 1) + skema) * (section.max() + 1) + section
    number = np.array([wanted.skemas.get(name, -2) for name in names.to_pylist()], np.int64)[skema]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        table, key, number = table.take(pa.array(order)), key[order], number[order]
    return table, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), number


def _sums(cell: np.ndarray, cells: int, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cells that occur, and the sums of the values of each."""
    if cells <= 4 * len(cell) + 1000:
        found = np.flatnonzero(np.bincount(cell, minlength=cells))
        return found, [np.bincount(cell, value, minlength=cells)[found] for value in values]
    found, place = np.unique(cell, return_inverse=True)
    return found, [np.bincount(place, value, minlength=len(found)) for value in values]


def summed_products(postings: DataFrame, wanted: Wanted, score: str, least: float | None = None) -> DataFrame:
    """(query_id, section, doc_id, skema, `score`, and sums of the extra columns) of every query and document that share a term.

    `postings` (no, layer, doc_id, skema, w) has all rows of a document in one task and next to each other. A weight counts
    for layers up to its `upto` and for its category. With `least`, smaller scores are left out.
    """
    held = postings.sparkSession.sparkContext.broadcast(tuple(wanted))  # tasks may not be able to import the class

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Wanted(*held.value)
        per_term, queries = np.diff(own.starts), len(own.ids)
        for table, _ in whole_runs(batches, ["doc_id"]):
            table, starts, category = _document_rows(table, own)
            no, layer, w = (table[c].to_numpy() for c in ("no", "layer", "w"))
            many = per_term[no]
            part = (np.cumsum(np.add.reduceat(many, starts)) - 1) // PRODUCTS
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for first, last in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
                a, b = starts[first], starts[last] if last < len(starts) else len(no)
                n = many[a:b]
                row = np.repeat(np.arange(a, b), n)
                at = np.arange(len(row)) + np.repeat(own.starts[no[a:b]] - (np.cumsum(n) - n), n)
                keep = layer[row] <= own.upto[at]
                keep &= (own.skema[at] == -1) | (own.skema[at] == category[row])
                row, at = row[keep], at[keep]
                document = np.repeat(np.arange(last - first), np.diff([*starts[first:last], b]))
                cell, sums = _sums(document[row - a] * queries + own.query[at], (last - first) * queries,
                                   [w[row] * own.qw[at], *(x[at] for x in own.extra.values())])
                if least is not None:
                    enough = sums[0] >= least
                    cell, sums = cell[enough], [x[enough] for x in sums]
                query, document = pa.array(cell % queries), pa.array(starts[first + cell // queries])
                yield pa.RecordBatch.from_arrays(
                    [own.ids.take(query), own.sections.take(query), *(pc.take(table[c].combine_chunks(), document) for c in ("doc_id", "skema")),
                     *map(pa.array, sums)], names=["query_id", "section", "doc_id", "skema", score, *own.extra])

    fields = T.StructType([T.StructField("query_id", T.DataType.fromDDL(_ddl(wanted.ids.type))), T.StructField("section", T.StringType()),
                           *(postings.schema[c] for c in ("doc_id", "skema"))])
    for name in (score, *wanted.extra):
        fields = fields.add(name, "double")
    return postings.mapInArrow(multiply, fields)


def _ddl(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()
