"""What stays on disk: shuffles of a finished write, and tables that nothing reads any more."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from kembar import runtime
from kembar.operators import tfidf

DOCS = [(d, f"s{d % 3}" if d % 7 else None, "judul" if d % 4 else "metode", f"inti inti kata{d % 7} kata{d % 3} sisa{d}".replace("1", "b").replace("2", "c"))
        for d in range(60)] + [(None, "s1", "judul", "inti kata"), (5, "s1", "judul", "inti"), (70, "s1", "judul", None)]


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_write_leaves_no_shuffle_files(spark):
    """Before, they stayed until the driver happened to collect its garbage."""
    before = shuffle_files(spark)
    moved = spark.range(20_000).withColumn("k", F.col("id") % 997).groupBy("k").count()
    table = runtime.written(moved, "shuffled")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and table.count() == 997
    assert spark.conf.get(runtime.CLEAN_UP) == "false" and moved.count() == 997


def tables_of(spark):
    folder = runtime.session_folder(spark).removeprefix("file://")
    return {name.rsplit("-", 1)[0] for name in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_an_index_keeps_only_its_tables(spark, monkeypatch):
    """Before, counted texts stayed, and each weight was stored twice as a double."""
    docs = spark.createDataFrame(DOCS, "doc_id bigint, skema string, section string, text string")
    made = []
    monkeypatch.setattr(runtime, "table_path", lambda s, name, f=runtime.table_path: made.append((name, f(s, name))) or made[-1][1])
    index = tfidf.fit(docs, False, False)
    kept = {name for name, path in made if os.path.isdir(path.removeprefix("file://"))}
    assert kept == {"section-sizes", "idf", "vectors", "blocks", "layers"} < {name for name, _ in made}
    assert not any(x in index.vectors.schema.simpleString() + index.blocks.schema.simpleString() for x in ("w:double", "top:double"))


def test_rare_and_hot_terms_make_the_same_index(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, skema string, section string, text string")

    def cells():
        index = tfidf.fit(docs, False, False)
        vectors = index.vectors.select("section", "doc_id", "skema", "norm", F.explode("terms").alias("e")).select("section", "doc_id", "skema", "norm", "e.*")
        rows = [sorted(map(str, df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"}).collect()))
                for df in (index.idf, index.postings, vectors, index.layers)]
        layers = index.vectors.select("section", F.explode("terms").alias("e"), "norm").select(
            "section", "e.term", tfidf.layer_of(F.col("e.tf") * F.col("e.idf") / F.col("norm")).alias("layer")).groupBy("section", "term", "layer").count()
        assert sorted(map(str, layers.select("section", "term", "layer", F.col("count").alias("n")).collect())) == sorted(map(str, index.layers.select("section", "term", "layer", "n").collect()))
        return rows

    whole = cells()
    monkeypatch.setattr(tfidf.hot_terms, "__defaults__", (3,))
    monkeypatch.setattr(tfidf, "SLICE_ROWS", 2)
    monkeypatch.setattr(tfidf, "TASK_POSTINGS", 5)
    assert cells() == whole and len(whole[1]) == len(whole[2]) > 200
    counts = tfidf.term_counts(docs, ["section", "doc_id", "skema"], False, False)
    assert len(whole[1]) == counts.count()


def test_numbers_come_back_from_their_planes():
    values = np.array([0, 1, 255, 256, 70_000, 2**31 - 1], np.int32)
    assert (tfidf._numbers(tfidf._planes(values)) == values).all() and len(tfidf._numbers(b"")) == 0
