"""What a task of encoding or scanning holds at once is bounded, however many rows a batch has."""

import numpy as np
import pyarrow as pa
import pytest

from kembar.functions import vectors
from kembar.operators import dense


@pytest.mark.parametrize("limit", [1, 3, 4, 1000])
def test_pieces_hold_about_as_many_tokens_as_asked(limit):
    lists = [["a", "b"], [], ["c"] * 7, ["a"], [], ["d", "e", "a"], []]
    tokens = pa.array([["x"], *lists], pa.list_(pa.string())).slice(1)
    parts = list(vectors.pieces(tokens, limit))
    assert [row for part in parts for row in part.to_pylist()] == lists
    assert all(len(part) == 1 or len(part.flatten()) <= limit for part in parts)
    counts = np.concatenate([vectors.hashed_counts(part, 16) for part in parts])
    assert (counts == vectors.hashed_counts(tokens, 16)).all() and counts.sum() == 13


def test_a_large_batch_is_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    rows, dim = 50, 4
    points = pa.table({
        "doc_id": pa.array(range(rows), pa.int64()), "skema": ["s"] * rows, "section": ["text"] * rows,
        "section_order": pa.array([0] * rows, pa.int32()), "embedding": [list(v) for v in rng.normal(size=(rows, dim))],
    })
    asked = pa.table({"query_id": pa.array([1, 2], pa.int64()), "section": pa.array([None, None], pa.string()),
                      "skema": pa.array([None, None], pa.string()), "embedding": [list(v) for v in rng.normal(size=(2, dim))]})
    queries = dense._Queries(asked)

    def found():
        hits = pa.Table.from_batches(dense._scan(queries, 3, None, False)(points.to_batches())).to_pylist()
        return sorted((h["query_id"], -h["similarity_score"], h["doc_id"]) for h in hits)

    whole, sizes = found(), []
    monkeypatch.setattr(dense, "BATCH_ROWS", 7)
    monkeypatch.setattr(dense, "_score", lambda batch, *a, f=dense._score: sizes.append(batch.num_rows) or f(batch, *a))
    assert found() == whole and len(whole) == 6
    assert max(sizes) == 7 and sum(sizes) == rows
