"""The build of a TF-IDF index: counts per text, runs over batches, tasks by size."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kembar.operators import runs, tfidf

ODD = [
    (1, "s", "judul", "Membaca, MEMBACA bacaan-bacaan 123 dan http://a.b/c di www.x.y ruang kerja kerjanya"),
    (1, "s", "judul", "kerja kerjanya lagi"), (1, None, "judul", "kerja"), (None, "s", "judul", "İstanbul ΣΑΣ straße ١٢٣ x_y"),
    (None, "s", "judul", "x_y berkan mekan 𝒜𝒷𝒸𝒹kan"), (2, "s", "metode", None), (3, "s", "metode", " \t"), (4, "s", "metode", "a i an dan"),
    (5, "s", "metode", "pertanyaannya\x0bketerangan\x1cmu\x85diberikan ter seku dii"),
]


@pytest.mark.parametrize("stop_words, stem", [(True, True), (False, True), (True, False), (False, False)])
def test_counts_by_text_equal_counts_by_word(spark, stop_words, stem):
    docs = spark.createDataFrame(ODD, "doc_id bigint, skema string, section string, text string")
    counted = tfidf.counted_texts(docs, tfidf.DOCUMENT, 3, stop_words, stem)
    assert counted.groupBy(*tfidf.DOCUMENT).count().where("count > 1").isEmpty()
    got = counted.select(*tfidf.DOCUMENT, F.explode("terms").alias("e")).select(*tfidf.DOCUMENT, "e.*")
    wanted = tfidf.term_counts(docs, tfidf.DOCUMENT, stop_words, stem)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_runs_go_on_over_batches(size):
    keys = [None] * 5 + ["a"] * 1 + ["b"] * 9 + ["c"] * 2
    table = pa.table({"k": pa.array(keys, pa.string()), "x": list(range(len(keys)))})
    found = []
    for part, starts in runs.whole_runs(table.to_batches(max_chunksize=size), ["k"]):
        ends = [*starts[1:], part.num_rows]
        found += [(part["k"][int(a)].as_py(), part["x"].to_pylist()[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert found == [(None, [0, 1, 2, 3, 4]), ("a", [5]), ("b", list(range(6, 15))), ("c", [15, 16])]


def test_tasks_of_a_build_grow_with_its_input(spark, monkeypatch):
    """Before, a build had as many tasks as the scan had pieces, so they grew with the input and spilled."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("skema"), F.lit("judul").alias("section"),
                                   F.concat_ws(" ", F.lit("inti"), F.concat(F.lit("kata"), F.md5(F.col("id").cast("string")))).alias("text"))
    given = {}
    for name in ("counted_texts", "document_vectors", "posting_blocks"):
        monkeypatch.setattr(tfidf, name, lambda *a, f=getattr(tfidf, name), n=name: given.setdefault(n, f(*a)))
    monkeypatch.setattr(tfidf, "TASK_BYTES", 1000)
    monkeypatch.setattr(tfidf, "TASK_POSTINGS", 30)
    index = tfidf.fit(docs, True, False)
    assert all(df.rdd.getNumPartitions() > 10 for df in given.values()) and len(given) == 3
    assert index.idf.where("term = 'inti'").first()["df"] == 400 and index.vectors.count() == 400
