import json

import pytest
from pyspark.sql import functions as F

from kembar import runtime
from kembar.operators import passages, rows, summaries
from kembar.schema import PROPOSAL, SECTIONS
from kembar.sources import batches
from kembar.sources import proposals as src

WIDE = [
    (21, "Penelitian Dasar (PD)", 'Judul, "satu"', "baris satu\nbaris dua", None, "  ", "metode yang cukup panjang", "x"),
    (24, "Program Kemitraan (PKM)", "", "ringkasan kedua panjang", "pendahuluan juga panjang", "masalah a b c", "\\n bukan baris", None),
    (29, "Penelitian Dasar (PD)", "judul ketiga panjang", None, None, None, None, "solusi ketiga panjang sekali"),
]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(WIDE, PROPOSAL)


def test_csv_round_trip_keeps_lines_quotes_and_nulls(spark, wide, tmp_path):
    path = str(tmp_path / "csv")
    src.write_proposals(wide, path)
    got = sorted(tuple(r) for r in src.read_proposals(spark, path).collect())
    assert [[x or None for x in r] for r in got] == [[x or None for x in r] for r in WIDE]


def test_parquet_source(spark, wide, tmp_path):
    path = str(tmp_path / "parquet")
    src.write_proposals(wide, path, "parquet")
    assert sorted(tuple(r) for r in src.read_proposals(spark, path, fmt="parquet").collect()) == WIDE
    plan = src.metadata(src.read_proposals(spark, path, fmt="parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,skema:string>" in plan


def test_points_are_numbered_in_order(spark, wide, tmp_path):
    expected = [
        (r[0], s) for r in WIDE for s, text in zip(SECTIONS, r[2:], strict=True) if text and len(text.strip()) > 10
    ]
    for path in (None, str(tmp_path / "points")):
        points = src.upload_points(wide, path)
        got = [(r.point_id, r.doc_id, r.section) for r in points.orderBy("point_id").collect()]
        assert got == [(i, *e) for i, e in enumerate(expected)]


def test_numbers_have_no_gaps_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = src.numbered(df, [F.col("x")], "n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(5000))


def test_vector_store_is_pruned(spark, wide, tmp_path):
    path = str(tmp_path / "store")
    src.write_vector_store(src.upload_points(wide).drop("point_id"), path)
    pair = src.read_vector_store(spark, path, "judul", "Penelitian Dasar (PD)")
    assert sorted(r.doc_id for r in pair.collect()) == [21, 29]
    assert "PartitionFilters: [isnotnull(skema" in pair._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark, wide, tmp_path):
    path = str(tmp_path / "long")
    rows.unpivot_sections(wide).write.parquet(path)
    plan = rows.filter_section_skema(spark.read.parquet(path), "judul", "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(section,judul)" in plan and "EqualTo(skema,x)" in plan


def test_sections_from_lines(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "\n".join("abcdefgh"))], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in src.sections_from_lines(df, "text", ["doc_id"]).collect()}
    assert got == {1: ("a", "b", None, None, None, None), 2: ("a", "b", "c", "d", "e", "f\ng\nh")}


BATCH = [
    (0, '{"judul": "x", "skema": "s", "metode": "", "lain": "y"}'), (1, '[{"judul": "y"}]'), (2, '["text1", "column1"]'),
    (3, '"text"'), (4, "12"), (5, "null"), (6, "[]"), (7, '{"text": "t", "column": "judul"}'),
]


def test_batches(spark):
    df = spark.createDataFrame(BATCH, "query_index bigint, element string")
    good, bad = batches.parse_query_batch(df)
    assert {r.query_index: (r.skema, r.judul, r.metode) for r in good.collect()} == {
        0: ("s", "x", ""), 1: (None, "y", None), 7: (None, None, None)}
    errors = {r.query_index: r.error for r in bad.collect()}
    assert set(errors) == {2, 3, 4, 5, 6}
    assert errors[2] == 'Invalid list format: ["text1", "column1"]' and errors[3] == 'Expected dict but got str: "text"'
    assert {r.error for r in batches.parse_query_batch(df, mode="plain")[1].collect()} == {"Invalid format"}
    good, bad = batches.parse_query_batch(df, mode="skip")
    assert sorted(r.query_index for r in good.collect()) == [0, 7] and bad.count() == 0
    assert [(r.query_index, r.section) for r in summaries.batch_rows(batches.parse_query_batch(df)[0]).orderBy("query_index").collect()] == [(0, "judul"), (1, "judul")]


def test_request(spark):
    request = json.dumps({"texts": [{"judul": "x"}, ["a"]], "top_k": 3, "threshold": 0.5})
    got = batches.explode_request(spark.createDataFrame([(9, request)], "request_id bigint, body string"), "body", ["request_id"]).collect()
    assert [(r.query_index, r.top_k, r.threshold) for r in got] == [(0, 3, 0.5), (1, 3, 0.5)]
    assert json.loads(got[0].element) == {"judul": "x"} and json.loads(got[1].element) == ["a"]


def test_responses_keep_rank_order(spark):
    df = spark.createDataFrame([(0, 2, 5, 0.5), (0, 1, 9, 0.7), (1, 1, 3, 0.2)], "query_index bigint, rank int, doc_id bigint, similarity_score double")
    got = {r.query_index: json.loads(r.response) for r in batches.results_to_json(df, fields=("doc_id", "similarity_score")).collect()}
    assert [x["doc_id"] for x in got[0]["results"]] == [9, 5] and got[0]["total_results"] == 2 and got[1]["total_results"] == 1


def test_sample_per_section(spark):
    df = spark.createDataFrame([(i, "judul", f" t{i} ") for i in range(30)] + [(1, "metode", None), (2, "metode", " ")], "doc_id bigint, section string, text string")
    got = rows.sample_per_section(df).collect()
    assert sorted(r.text for r in got if r.section == "judul") == sorted(f"t{i}" for i in range(10))
    assert sum(r.section == "query" for r in got) == 10 and not any(r.section == "metode" for r in got)


def test_passages(spark):
    docs = spark.createDataFrame(
        [(1, "Kalimat pertama yang panjang. Kalimat kedua yang panjang. Lain lagi di sini saja. Kalimat keempat yang panjang"), (2, "tidak ada")],
        "doc_id bigint, text string")
    queries = spark.createDataFrame([(5, "Kalimat pertama yang panjang. kalimat kedua yang panjang. Baru sama sekali ini. Kalimat keempat yang panjang")], "query_id bigint, text string")
    runs = sorted(tuple(r) for r in passages.matched_passages(queries, docs).collect())
    assert [(r[0], r[1], r[2], r[3]) for r in runs] == [(5, 1, 0, 1), (5, 1, 3, 3)]
    held = passages.ngram_containment(queries, docs).collect()
    assert len(held) == 1 and 0 < held[0].containment < 1
    grams = passages.ngram_rows(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10)), ["doc_id"])
    assert passages.drop_boilerplate(grams, 2).count() == grams.count() and passages.drop_boilerplate(grams, 1).count() == 0


class Named:
    """Stands in for a session with and without a named folder, on a cluster and locally."""

    def __init__(self, named, master):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{named}-{master}"

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_the_one_the_cluster_names():
    assert runtime.shared_folder(Named("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Named(None, "spark://host:7077"))
    assert runtime.shared_folder(Named(None, "local[4]"))


def test_written_tables_live_in_the_session_folder(spark):
    table = runtime.written(spark.range(3), "t")
    assert table.count() == 3 and runtime.session_folder(spark) in table.inputFiles()[0]


def test_size_check(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 100, "t string")
    assert runtime.fits_broadcast(df) and not runtime.fits_broadcast(df, 50_000)
