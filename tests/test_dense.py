import numpy as np
import pytest
from pyspark.sql import functions as F

from kembar.functions import vectors as v
from kembar.operators import cache, dense, neighbours
from kembar.schema import SECTIONS


@pytest.fixture(scope="module")
def points(spark):
    """A third of the points share one vector, and one is all zeros."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        vector = [1.0, 0.0, 0.0, 0.5] if i % 3 == 0 else [0.0] * 4 if i == 7 else rng.standard_normal(4).tolist()
        rows.append((i // 2, f"s{i % 5}", SECTIONS[i % 2], vector))
    return rows


@pytest.fixture(scope="module")
def queries():
    rng = np.random.default_rng(2)
    rows = [(q, SECTIONS[q % 2] if q % 3 else None, f"s{q % 5}" if q % 4 == 0 else None, rng.standard_normal(4).tolist()) for q in range(12)]
    return rows + [(50, None, None, [1.0, 0.0, 0.0, 0.5]), (51, None, "none", [1.0, 0.0, 0.0, 0.0]), (52, None, None, [0.0] * 4)]


def plain(points, queries, k, keep=lambda s: True):
    hits = []
    for query, section, skema, qv in queries:
        scored = []
        for doc, s, sec, pv in points:
            if (section and sec != section) or (skema and s != skema):
                continue
            size = np.linalg.norm(pv) * np.linalg.norm(qv)
            score = float(np.dot(pv, qv) / size) if size else 0.0
            if keep(score):
                scored.append((-round(score, 6), SECTIONS.index(sec), doc, sec))
        hits += [(query, rank + 1, doc, sec, -score) for rank, (score, _, doc, sec) in enumerate(sorted(scored)[:k])]
    return sorted(hits)


@pytest.fixture(scope="module")
def frames(spark, points, queries):
    return (
        spark.createDataFrame(points, "doc_id bigint, skema string, section string, embedding array<float>").repartition(5),
        spark.createDataFrame(queries, "query_id bigint, section string, skema string, embedding array<double>"),
    )


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.section, pytest.approx(r.similarity_score, abs=2e-6)) for r in df.collect())


def same(got, expected):
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert [e[4] for e in expected] == [g[4] for g in got]


@pytest.mark.parametrize("sizes", [{}, {"block": 5}, {"bytes_limit": 600}])
def test_nearest_equals_brute_force(frames, points, queries, sizes):
    p, q = frames
    same(rows_of(dense.nearest(p, q, 7, **sizes)), plain(points, queries, 7))
    same(rows_of(dense.nearest(p, q, 7, threshold=0.5, **sizes)), plain(points, queries, 7, lambda s: s >= 0.5))
    same(rows_of(dense.nearest(p, q, 200, cutoff=0.1, **sizes)), plain(points, queries, 200, lambda s: s > 0.1))


@pytest.mark.parametrize("sizes", [{}, {"block": 5}])
def test_theta_join_keeps_every_pair(frames, points, queries, sizes):
    p, q = frames
    got = sorted((r.query_id, r.doc_id, r.section) for r in dense.theta_join(p, q, **sizes).collect())
    assert got == sorted((h[0], h[2], h[3]) for h in plain(points, queries, 1000, lambda s: s > 0.1))


@pytest.fixture(scope="module")
def index(frames):
    return dense.build_point_index(frames[0])


@pytest.mark.parametrize("sizes", [{}, {"block": 5}])
def test_pruned_search_equals_brute_force(index, frames, points, queries, sizes):
    q = frames[1]
    same(rows_of(dense.nearest(index, q, 7, **sizes)), plain(points, queries, 7))
    same(rows_of(dense.nearest(index, q, 3, threshold=0.5, **sizes)), plain(points, queries, 3, lambda s: s >= 0.5))
    got = sorted((r.query_id, r.doc_id, r.section) for r in dense.theta_join(index, q, **sizes).collect())
    assert got == sorted((h[0], h[2], h[3]) for h in plain(points, queries, 1000, lambda s: s > 0.1))


def test_clustered_points_leave_tiles_out(spark):
    """Vectors around few directions, a third of them equal: most tiles are not read, and the result is exact."""
    rng = np.random.default_rng(6)
    heads = rng.standard_normal((12, 16))
    rows = [(i, "s", "judul", heads[0].tolist() if i % 3 == 0 else (heads[i % 12] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(900)]
    asked = [(q, None, None, (heads[q] + 0.05 * rng.standard_normal(16)).tolist()) for q in range(1, 4)]
    p = spark.createDataFrame(rows, "doc_id bigint, skema string, section string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "query_id bigint, section string, skema string, embedding array<double>")
    index = dense.build_point_index(p)
    same(rows_of(dense.nearest(index, q, 5)), plain(rows, asked, 5))
    read = dense.tiles_scored(index, q, 5).first()
    assert read.points == 900 and read.pairs == 2700
    assert read.tiles_read < read.tiles / 2 and read.pairs_scored < read.pairs / 3
    assert dense.tiles_scored(index, q, bound=0.95).first().pairs_scored < read.pairs / 3


def test_query_blocks_do_not_move_points(frames):
    """Three blocks of queries: the points of each are scanned where they lie."""
    p, q = frames
    found = dense.score_points(p, q, 3, block=5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    one = dense.score_points(p, q, 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == p._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_small_chunks_give_the_same(frames, points, queries, monkeypatch):
    p, q = frames
    monkeypatch.setattr(dense, "CELLS", 30)
    same(rows_of(dense.nearest(p, q, 5)), plain(points, queries, 5))


def test_no_queries(frames):
    p, q = frames
    assert dense.nearest(p, q.where("false")).count() == 0


def test_lengths_must_agree(spark):
    p = spark.createDataFrame([(1, "s", "judul", [1.0]), (2, "s", "judul", [1.0, 2.0])], "doc_id bigint, skema string, section string, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, None, None, [1.0])], "query_id bigint, section string, skema string, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        dense.nearest(p, q).collect()


def test_dense_cosine(evaluate):
    cosine = v.dense_cosine(F.col("a"), F.col("b"))
    assert evaluate(cosine, a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert evaluate(cosine, a=[1.0, 1.0], b=[2.0, 2.0]) == pytest.approx(1.0)
    assert evaluate(cosine, a=[1e-9, 0.0], b=[1.0, 0.0]) == 0.0


def test_hashed_encoder(spark):
    df = spark.createDataFrame([(1, "Satu dua dua"), (2, ""), (3, None), (4, "été")], "id bigint, text string").coalesce(1)
    got = {r.id: np.array(r.embedding) for r in v.encode(df, "text", v.HashedEncoder(64)).collect()}
    assert all(len(x) == 64 for x in got.values())
    assert got[1].sum() == 3 and got[1].max() >= 2 and got[2].sum() == got[3].sum() == 0
    spot = df.where("id = 4").select(v.bucket(F.lit("été"), 64).alias("b")).first().b
    assert got[4][spot] == 1 and got[4].sum() == 1


def test_model_encoder_loads_once_per_worker(spark):
    def load():
        loaded = np.random.default_rng().integers(1, 1 << 30)
        return lambda texts: np.array([[len(t), loaded % 1000003] for t in texts])

    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id bigint, text string").coalesce(1)
    rows = v.encode(df, "text", v.ModelEncoder(load, 2)).collect()
    assert all(r.embedding[0] == r.id for r in rows) and len({r.embedding[1] for r in rows}) == 1


def test_cache(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",), (" ",), (None,), ("d",)], "text string")
    known = cache.embedding_cache_refresh(texts.where("text = 'c'"), spark.createDataFrame([], "text_md5 string, embedding array<float>"))
    fresh = cache.embedding_cache_refresh(texts, known)
    assert fresh.count() == 2
    assert sorted(r.text for r in cache.cache_misses(texts, known).collect()) == ["a b", "d"]
    assert [r.text for r in cache.cache_hits(texts, known).collect()] == ["c"]
    assert cache.embedding_cache_refresh(texts, known.unionByName(fresh)).count() == 0


def test_forest_finds_nine_tenths_of_the_exact(spark):
    """Vectors around many directions, a third of them equal; a query reads a small part of each tree."""
    rng = np.random.default_rng(12)
    heads = rng.standard_normal((60, 24))
    rows = [(i, "s", "judul", (heads[0] if i % 3 == 0 else heads[i % 60] + 0.4 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    asked = [(q, (heads[q] + 0.4 * rng.standard_normal(24)).tolist()) for q in range(1, 31)]
    p = spark.createDataFrame(rows, "doc_id bigint, skema string, section string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    forest = neighbours.build_forest(p, 24, page=16)
    assert forest.pages.agg(F.max(F.size("entries"))).first()[0] == 16
    assert forest.pages.agg(F.sum(F.size("entries"))).first()[0] == 3000 * neighbours.TREES
    near = {(r.query_id, r.doc_id) for r in neighbours.ann_candidates(forest, q, 24, 10).collect()}
    both = q.selectExpr("query_id", "cast(null as string) AS section", "cast(null as string) AS skema", "embedding")
    exact = {(r.query_id, r.doc_id) for r in dense.nearest(p, both, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    blocks = {(r.query_id, r.doc_id) for r in neighbours.ann_candidates(forest, q, 24, 10, block=12).collect()}
    assert blocks == near
    assert neighbours.ann_candidates(forest, q.where("false"), 24).count() == 0


def test_places_of_queries_in_a_forest(spark):
    """Each query's page is the last that starts at or before it, found by looking at all pages."""
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, "s", "judul", rng.standard_normal(6).tolist()) for i in range(200)], "doc_id bigint, skema string, section string, embedding array<float>")
    forest = neighbours.build_forest(p, 6, trees=3, page=7)
    vectors = rng.standard_normal((9, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id bigint, embedding array<double>").toArrow()
    heads = sorted((r.page, r.tree, r.signature) for r in forest.pages.collect())
    signatures = neighbours.signature_numbers(vectors, neighbours._planes(6, 3, 7), 3)
    expected = {(q, t): max((page for page, tree, head in heads if (tree, head) <= (t, signatures[q, t])), default=None) for q in range(9) for t in range(3)}
    got = {(r.query, r.tree): r.page for r in neighbours._places(forest, table).collect()}
    assert got == {key: page for key, page in expected.items() if page is not None}
