"""Rows that must not be lost: odd requests, texts without sentences, items without hits, doubled keys."""

import json

import pytest
from pyspark.sql import functions as F

from kembar.functions import text as t
from kembar.operators import dense, summaries
from kembar.plans import detect, search
from kembar.sources import batches
from kembar.sources.proposals import upload_points

POINTS = [(1, "A", "aturan main permainan desa"), (2, "B", "sistem informasi sekolah dasar")]


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.createDataFrame(POINTS, "doc_id bigint, skema string, text string")
    return upload_points(rows, sections=("text",))


def test_texts_without_sentences_get_a_verdict(spark, points):
    rows = [(1, "text", None, "..."), (2, "text", None, "aturan main permainan desa"), (3, "text", None, "satu. dua tiga")]
    queries = spark.createDataFrame(rows, "query_id bigint, section string, skema string, text string")
    for forced in (True, False):
        got = {r.query_id: r.total_segments for r in detect.detect_segmented(points, queries, forced, 1).collect()}
        assert set(got) == {1, 2, 3} and got[1] == 1


def test_null_section_keeps_its_category(spark, points):
    queries = spark.createDataFrame([(1, None, "B"), (2, "text", "B"), (3, None, "C"), (4, "judul", "B")], "query_id bigint, section string, skema string")
    got = {r.query_id: (r.skema, r.fallback_used) for r in detect.join_skema_fallback(queries, points).collect()}
    assert got == {1: ("B", False), 2: ("B", False), 3: (None, True), 4: (None, True)}


def test_items_without_hits_are_answered(spark):
    items = spark.createDataFrame([(0,), (1,)], "query_index int")
    hits = spark.createDataFrame([(1, 1, 7, "A", "judul", 0.5)], "query_index int, rank int, doc_id bigint, skema string, section string, similarity_score double")
    got = {r.query_index: json.loads(r.response) for r in batches.results_to_json(hits, items=items).collect()}
    assert got[0] == {"results": [], "total_results": 0} and got[1]["total_results"] == 1
    batch = spark.createDataFrame([(1, "judul")], "query_index int, section string")
    searched = {r.query_index: (r.columns_searched, r.total_results) for r in summaries.agg_columns_searched(batch, hits, items=items).collect()}
    assert searched == {0: ([], 0), 1: (["judul"], 1)}


def test_malformed_requests_leave_a_row(spark):
    rows = [(1, '{"texts": [{"judul": "a"}], "top_k": 3}'), (2, "{nonsense"), (3, '{"texts": []}'), (4, None)]
    got = {r.id: (r.element, r.error) for r in batches.explode_request(spark.createDataFrame(rows, "id int, body string"), "body", ["id"]).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1][1] is None and got[3] == (None, None) and got[2][1] == got[4][1] == "Invalid request"


def test_elements_that_only_look_like_objects(spark):
    rows = [(0, '{"judul": "a"}'), (1, '["{\\"judul\\": 1}"]'), (2, "{broken"), (3, '[{"judul": "b"}]'), (4, "7"), (5, "1.5"), (6, '"x"'), (7, "[{broken]")]
    good, bad = batches.parse_query_batch(spark.createDataFrame(rows, "query_index int, element string"))
    assert {r.query_index: r.judul for r in good.collect()} == {0: "a", 3: "b"}
    errors = {r.query_index: r.error for r in bad.collect()}
    assert set(errors) == {1, 2, 4, 5, 6, 7}
    assert "got int: 7" in errors[4] and "got float: 1.5" in errors[5] and "got str" in errors[6]


def test_doubled_keys_do_not_multiply_hits(spark):
    hits = spark.createDataFrame([(1, 5, "text")], "query_id bigint, doc_id bigint, section string")
    texts = spark.createDataFrame([(5, "text", "b"), (5, "text", "a")], "doc_id bigint, section string, text string")
    assert [r.matched_text for r in search.join_matched_text(hits, texts).collect()] == ["a"]


def test_vectors_of_mixed_lengths_are_refused(spark):
    rows = [(1, "A", "text", 0, [1.0, 0.0]), (2, "A", "text", 0, [1.0, 0.0, 0.0, 0.0])]
    stored = spark.createDataFrame(rows, "doc_id bigint, skema string, section string, section_order int, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, None, None, [1.0, 0.0])], "query_id bigint, section string, skema string, embedding array<float>")
    with pytest.raises(Exception, match="differ in length"):
        dense.nearest(stored, asked, 1).collect()


def test_any_number_of_phrases(evaluate):
    phrases = tuple(f"frasa {i}x" for i in range(70))
    text = " ".join(phrases)
    assert evaluate(t.phrase_overlap(F.lit(text), F.lit(" ".join(phrases[:35])), phrases)) == pytest.approx(0.5)


def test_points_of_other_sections_are_not_read(spark, tmp_path):
    rows = [(1, "A", "judul", [1.0, 0.0]), (2, "B", "metode", [0.0, 1.0]), (3, "A", "metode", [1.0, 1.0])]
    spark.createDataFrame(rows, "doc_id bigint, skema string, section string, embedding array<float>").write.partitionBy("section").parquet(f"{tmp_path}/points")
    stored = spark.read.parquet(f"{tmp_path}/points")
    asked = spark.createDataFrame([(1, "metode", None, [1.0, 0.0])], "query_id bigint, section string, skema string, embedding array<float>")
    found = dense.score_points(stored, asked, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "section" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r.doc_id for r in found.collect()} == {2, 3}
