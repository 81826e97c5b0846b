"""Runs of rows with equal keys, as Arrow batches of sorted partitions bring them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def run_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a run of equal keys starts; nulls are equal."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by `keys` in tables that end where a run ends, and the rows at which runs start."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and len(run_starts(pa.concat_tables([held[0].slice(0, 1), table]).select(keys), keys)) == 1:
            held.append(table)  # a run longer than a batch is put together once, at its end
            continue
        table = pa.concat_tables([*held, table]).combine_chunks()
        starts = run_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = [table.slice(starts[-1])]
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.zeros(1, dtype=np.int64)


def listed(
    table: pa.Table, starts: np.ndarray, keys: Sequence[str], name: str, fields: dict[str, pa.Array | pa.ChunkedArray], lengths: np.ndarray
) -> pa.RecordBatch:
    """One row per run: its keys, and a list of `lengths` rows made of `fields`."""
    flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in fields.values()]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=list(fields)))
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays([*(table[k].combine_chunks().take(first) for k in keys), lists], names=[*keys, name])
