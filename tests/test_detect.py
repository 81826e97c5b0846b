from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kembar.functions.lists import STOP_WORDS
from kembar.plans import detect as d
from kembar.plans import search
from kembar.schema import SECTIONS

COPY = "Penelitian ini membahas data besar untuk desa mandiri. Metode yang dipakai adalah survei lapangan"
DOCS = [
    (1, "A", "judul", COPY), (2, "A", "judul", "Panen padi organik di lahan kering"), (3, "B", "judul", "Aplikasi seluler untuk guru sekolah dasar"),
    (4, "B", "metode", "Wawancara dengan petani dan nelayan di pesisir"),
]
QUERIES = [
    (10, "judul", None, COPY + ". " + COPY.split(".")[0]), (11, "judul", "B", COPY), (12, "judul", "Z", "Panen padi organik"),
    (13, "solusi", None, "tidak ada titik di bagian ini"), (14, "judul", "", "  "), (15, "metode", "A", "wawancara dengan petani"),
]


@pytest.fixture(scope="module")
def points(spark):
    from kembar.functions.vectors import encode

    docs = spark.createDataFrame(DOCS, "doc_id bigint, skema string, section string, text string")
    return encode(docs, "text")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id bigint, section string, skema string, text string")


def lexical(a, b):
    import re

    def clean(x):
        words = re.sub(r"[^\w\s]", " ", x.lower()).split()
        return [w for w in words if w not in STOP_WORDS]

    x, y = clean(a), clean(b)
    both = len(set(x) & set(y))
    return (round(both / len(set(x) | set(y)), 4), round(both / min(len(set(x)), len(set(y))), 4),
            round(SequenceMatcher(None, " ".join(x), " ".join(y)).ratio(), 4))


def test_single_verdicts(points, queries):
    got = {r.query_id: r for r in d.detect(points, queries).collect()}
    assert set(got) == {10, 11, 12, 13, 15}
    copy = got[10]
    assert copy.most_similar_article_id == 1 and copy.verdict.classification == "Direct Plagiarism" and copy.is_plagiarism
    assert copy.semantic_similarity == 1.0 and copy.similarity_score == pytest.approx(1.0) and copy.legacy_threshold_result
    assert copy.text_length_words == len(COPY.split()) and copy.threshold_used == 0.75
    assert (got[11].most_similar_article_id, got[11].result_skema, got[11].fallback_used) == (3, "B", False)
    assert (got[12].most_similar_article_id, got[12].fallback_used, got[12].search_skema) == (2, True, "Z")
    assert (got[13].analysis_type, got[13].similarity_score, got[13].is_plagiarism, got[13].verdict) == ("basic", 0.0, False, None)
    assert got[15].fallback_used and got[15].most_similar_article_id == 4
    for query, text in ((11, COPY), (12, "Panen padi organik"), (15, "wawancara dengan petani")):
        r = got[query]
        assert (r.lexical.jaccard, r.lexical.word_overlap, r.lexical.sequence) == lexical(text, r.most_similar_article)


def test_k_verdicts(points, queries):
    got = d.detect(points, queries.where("query_id = 10"), k=3).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3] and len({r.most_similar_article_id for r in got}) == 3


def test_explicit_thresholds(points, queries):
    own = queries.withColumn("threshold", F.when(F.col("query_id") == 12, 0.0))
    got = {r.query_id: r for r in d.detect(points, own).collect()}
    assert got[12].threshold_used == 0.0 and got[12].legacy_threshold_result and got[10].threshold_used == 0.75


def test_standard_metrics(points, queries):
    row = d.detect(points, queries.where("query_id = 10"), academic=False).first()
    assert row.analysis_type == "single_text" and row.lexical.academic == 0.0 and row.lexical.jaccard == 1.0


def test_segments(points, queries):
    whole = {r.query_id: r for r in d.detect(points, queries).collect()}
    single = {r.query_id: r for r in d.detect_segmented(points, queries).collect()}
    assert set(single) == set(whole)
    for query, row in single.items():
        assert not row.segmentation_used and row.total_segments == 1
        assert (row.similarity_score, row.is_plagiarism, row.most_similar_article_id) == (
            whole[query].similarity_score, whole[query].is_plagiarism, whole[query].most_similar_article_id)
    cut = {r.query_id: r for r in d.detect_segmented(points, queries, True, 5).collect()}
    assert cut[10].analysis_type == "segmented" and cut[10].total_segments == 2
    scores = [x.similarity_score for x in cut[10].detailed_segments]
    assert cut[10].max_similarity == max(scores) and cut[10].avg_similarity == pytest.approx(sum(scores) / 2)
    assert cut[12].total_segments == 1


def test_long_texts_are_cut_without_force(spark, points):
    long_text = ". ".join(f"kalimat nomor {i} " + "kata " * 20 for i in range(20))
    queries = spark.createDataFrame([(1, "judul", None, long_text)], "query_id bigint, section string, skema string, text string")
    row = d.detect_segmented(points, queries).first()
    assert row.segmentation_used and row.total_segments > 3
    assert not d.detect_segmented(points, queries, False).first().segmentation_used


def batch(spark, rows):
    full = [(i, skema, *[texts.get(s) for s in SECTIONS]) for i, skema, texts in rows]
    fields = ", ".join(f"{s} string" for s in SECTIONS)
    return spark.createDataFrame(full, f"query_index bigint, skema string, {fields}")


def test_bulk(spark, points):
    items = batch(spark, [(0, None, {"judul": COPY, "metode": "wawancara dengan petani"}), (1, "B", {"judul": "guru sekolah"}), (2, None, {})])
    verdicts, summary = d.detect_bulk(points, items)
    found = {(r.query_index, r.section): r for r in verdicts.collect()}
    assert set(found) == {(0, "judul"), (0, "metode"), (1, "judul")}
    totals = {r.query_index: r for r in summary.collect()}
    assert totals[0].columns_processed == 2 and totals[0].is_plagiarism and totals[0].max_similarity_score == found[0, "judul"].similarity_score
    assert totals[2].columns_processed == 0 and totals[2].max_similarity_score == 0.0 and not totals[2].is_plagiarism


def test_bulk_of_one_equals_single_search(spark, points):
    items = batch(spark, [(0, None, {"judul": COPY})])
    one = [(r.rank, r.doc_id, r.similarity_score) for r in search.search_bulk_dense(points, items, 3).orderBy("rank").collect()]
    query = spark.createDataFrame([(0, "judul", None, COPY)], "query_id bigint, section string, skema string, text string")
    assert one == [(r.rank, r.doc_id, r.similarity_score) for r in search.search_dense(points, query, 3).orderBy("rank").collect()]
    assert one[0][1:] == (1, 1.0)


def test_no_fallback_gives_error_rows(points, queries):
    got = {r.query_id: r for r in d.detect_by_skema(points, queries, fallback=False).collect()}
    assert sorted(got) == [11, 12, 15] and got[11].error is None and got[11].most_similar_article_id == 3
    assert got[12].error == "No points of category Z in section judul" and got[12].most_similar_article_id is None
    assert got[15].analysis_type == "error" and got[15].verdict is None


def test_titles_and_explanations(spark, points, queries):
    titles = spark.createDataFrame([(1, "Judul satu"), (1, "Judul satu"), (3, None)], "doc_id bigint, judul string")
    got = {r.query_id: r for r in d.detect(points, queries, titles=titles).collect()}
    assert got[10].most_similar_article_judul == "Judul satu" and got[11].most_similar_article_judul is None
    assert d.detect(points, queries).first().most_similar_article_judul is None
    cut = {r.query_id: r for r in d.detect_segmented(points, queries, True, 5, titles=titles).collect()}
    assert cut[10].explanation == ["Analyzed 2 segments", f"Found {cut[10].plagiarism_segments} potentially plagiarized segments", "Aggregation strategy: top_k_average"]
    parts = {(r.query_id, r.segment_index): r for r in d.detect_segments(points, queries, True, 5).collect()}
    best = max((parts[10, i] for i in (0, 1)), key=lambda r: r.similarity_score)
    assert cut[10].classification == best.verdict.classification and cut[10].most_similar_article_judul == "Judul satu"
    assert cut[12].explanation == got[12].verdict.explanation and cut[13].classification is None


def test_requests_with_their_own_limits(spark, points):
    """One batch with k of 1 and 3 and two thresholds equals single runs."""
    rows = [(1, "judul", None, COPY, 1, None), (2, "judul", None, COPY, 3, 0.0), (3, "judul", None, COPY, None, 0.99), (4, None, None, COPY, 4, None)]
    asked = spark.createDataFrame(rows, "query_id bigint, section string, skema string, text string, k int, threshold double")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in search.search_dense(points, asked, 2).collect())
    single = []
    for query, section, _, text, k, threshold in rows:
        one = spark.createDataFrame([(query, section, None, text)], "query_id bigint, section string, skema string, text string")
        single += [(r.query_id, r.rank, r.doc_id) for r in search.search_dense(points, one, k or 2, threshold).collect()]
    assert got == sorted(single) and len({q for q, *_ in got}) == 4


def test_by_skema_needs_a_category(points, queries):
    assert sorted(r.query_id for r in d.detect_by_skema(points, queries).collect()) == [11, 12, 15]


def test_short_queries_give_no_rows(spark, points):
    query = spark.createDataFrame([(0, "judul", None, " ab "), (1, None, None, "padi")], "query_id bigint, section string, skema string, text string")
    assert {r.query_id for r in search.search_dense(points, query).collect()} == {1}
