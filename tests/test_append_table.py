import pytest

from kembar.operators import cache
from kembar.sources.append_table import AppendTable, ConcurrentAppend


def rows(spark, *values):
    return spark.createDataFrame([(v, "x") for v in values], "a string, b string")


@pytest.fixture
def table(spark, tmp_path):
    return AppendTable(spark, str(tmp_path / "table"), "a string, b string")


def values(df):
    return sorted(r.a for r in df.collect())


def test_generations(spark, table):
    assert table.generation() == 0 and table.read().count() == 0
    assert table.append(rows(spark, "1", "2")) == 1 and table.append(rows(spark, "3")) == 2
    assert values(table.read()) == ["1", "2", "3"] and values(table.read(1)) == ["1", "2"]
    assert table.compact() == 3 and len(table.folders()) == 1 and values(table.read()) == ["1", "2", "3"]
    assert values(AppendTable(spark, table.path, "a string, b string").read()) == ["1", "2", "3"]


def test_failure_between_write_and_commit_changes_nothing(spark, table, monkeypatch):
    table.append(rows(spark, "1"))

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(table, "_commit", fails)
    with pytest.raises(OSError, match="lost"):
        table.append(rows(spark, "2"))
    monkeypatch.undo()
    assert values(table.read()) == ["1"] and table.generation() == 1
    table.append(rows(spark, "2"))
    assert values(table.read()) == ["1", "2"]


def test_two_writers(spark, table):
    table.append(rows(spark, "1"))
    other = AppendTable(spark, table.path, "a string, b string")
    since = other.generation()
    table.append(rows(spark, "2"))
    with pytest.raises(ConcurrentAppend):
        other.append(rows(spark, "2"), since)
    assert values(other.read()) == ["1", "2"]


def test_cache_is_filled_once(spark, tmp_path):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",), (" ",), (None,), ("d",)], "text string")
    stored = AppendTable(spark, str(tmp_path / "cache"), cache.CACHE)
    assert cache.refresh_cache(texts.where("text = 'c'"), stored).count() == 1
    assert cache.refresh_cache(texts, stored).count() == 3 and stored.generation() == 2
    assert cache.refresh_cache(texts, stored).count() == 3 and stored.generation() == 2
    more = spark.createDataFrame([("e",)], "text string")
    assert cache.refresh_cache(more, stored, folders=2).count() == 4 and len(stored.folders()) == 1
