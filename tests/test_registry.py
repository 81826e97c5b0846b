"""Every registered query against its SQL on the smallest tables."""

import sys
import subprocess
import os

import pytest

import __spark_entry__ as entry

SF = entry.SMOKE
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS FROM '{SF}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def cells(rows, order):
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = cells(cursor.fetchall(), [columns.index(c) for c in df.columns])
    assert cells(rows, range(len(df.columns))) == expected
    assert expected


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_stay_without_a_package_of_the_optional_ones():
    code = "import sys; sys.modules['tiktoken'] = sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, optional = done.stdout.split()
    assert int(count) > 90 and optional == "False"
