"""Whitening: bit-sliced products against plain integers, the contract against numpy, odd input."""

import numpy as np
import pyarrow as pa
import pytest

from kembar.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, component string, n int"


def plain_products(x):
    return [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(x.shape[1])] for i in range(x.shape[1])]


@pytest.mark.parametrize("top", [1, 2, 1000, 1 << 30, 1 << 45])
def test_cross_products(top):
    rng = np.random.default_rng(top % 97)
    x = rng.integers(0, top, (150, 5))
    x[:, 3] = 7 if top > 7 else 0
    got = whitening.cross_products(x - x.min(axis=0))
    y = x - x.min(axis=0)
    expected = plain_products(y)
    assert [[int(got[i, j]) for j in range(i, 5)] for i in range(5)] == [expected[i][i:] for i in range(5)]


def test_squared_lengths():
    rng = np.random.default_rng(3)
    small = rng.integers(-(1 << 47), 1 << 47, (50, 64))
    assert whitening.squared_lengths(small) == [sum(int(v) ** 2 for v in row) for row in small]
    wide = small.astype(object) * 10**6
    assert whitening.squared_lengths(wide) == [sum(v**2 for v in row) for row in wide]


def test_floor_of_sliced_lists():
    column = pa.array([[9.0], [0.5, -0.5], [1 / 3, -1e-9]], pa.list_(pa.float32()))[1:]
    assert whitening.integers(column, 2).tolist() == [[100512, 99488], [100341, 99999]]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((12, 12))
    rows = [(i, (rng.standard_normal(12) @ mix / 9).tolist(), "c", 1) for i in range(300)]
    rows += [(1000 + i, rows[0][1], "c", 1) for i in range(150)] + [(5, rows[5][1], "c", 1)]
    odd = [
        (2000, None, "c", 1), (2001, [float("nan")] + [0.1] * 11, "c", 1), (2002, [float("inf")] + [0.1] * 11, "c", 1),
        (2003, [None] + [0.1] * 11, "c", 1), (2004, [], "c", 1), (2005, [0.1] * 5, "c", 1), (2006, [1e30] * 12, "c", 1),
        (None, rows[2][1], "c", 1),
    ]
    return rows + odd


def expected(rows, dim=12):
    kept = [(i, np.float32(v).astype(float)) for i, v, *_ in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e12]
    x = np.array([np.floor(1024 * v).astype(int) + 100000 for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:8]
    return kept, n, deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_contract(spark, vectors):
    got = whitening.whiten(spark.createDataFrame(vectors, SCHEMA).repartition(4)).collect()
    kept, n, deviation, whitened, explained = expected(vectors)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert sorted((r.vec_id is None, r.vec_id, int(r.deviation)) for r in got if r.component == 1) == sorted((i is None, i, d) for (i, _), d in zip(kept, deviation, strict=True))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    place = {i: at for at, (i, _) in enumerate(kept)}
    for k in range(8):
        rows = [r for r in got if r.component == k + 1]
        mine = np.array([r.whitened for r in rows])
        theirs = np.array([whitened[place[r.vec_id], k] for r in rows])
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < 1e-8
        assert rows[0].explained == pytest.approx(explained[k], rel=1e-9)


def test_few_dimensions_and_no_variance(spark):
    rows = [(i, [float(i % 3), 0.25], "c", 1) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted({(r.component, r.whitened is None) for r in got}) == [(1, False), (2, True)]
    assert {round(r.explained, 9) for r in got} == {1.0, 0.0} and got[0].identity_error < 1e-9
    same = whitening.whiten(spark.createDataFrame(rows[:1] * 4, SCHEMA)).collect()
    assert len(same) == 8 and all(r.whitened is None and r.deviation == 0 for r in same)


def test_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "c", 1), (2, [], "c", 1)], SCHEMA)).count() == 0
    assert "identity_error" in whitening.whiten(spark.createDataFrame([], SCHEMA)).columns
