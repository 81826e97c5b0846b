import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from kembar import runtime

    runtime.release(session)
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """The value of an expression over one row of named values."""
    def run(expression, **values):
        names = list(values) or ["nothing"]
        row = tuple(values.values()) or (0,)
        schema = ", ".join(f"{n} {kind(v)}" for n, v in zip(names, row, strict=True))
        return spark.createDataFrame([row], schema).select(expression.alias("x")).first()["x"]

    def kind(value):
        if isinstance(value, bool):
            return "boolean"
        if isinstance(value, int):
            return "bigint"
        if isinstance(value, float):
            return "double"
        if isinstance(value, list):
            return "array<double>" if all(isinstance(v, float) for v in value) else "array<string>"
        return "string"

    return run
