import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from logfathom import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("logfathom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Apply one column function to a list of texts, in order."""

    def run(values, fn, schema="i int, t string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)
        return [row["r"] for row in df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]

    return run


@pytest.fixture(scope="session")
def make_logs(spark):
    """Log rows a second apart: (line, labels) pairs, or plain lines."""

    def build(rows, start=datetime(2024, 1, 1), gap=timedelta(seconds=1)):
        shaped = []
        for i, row in enumerate(rows):
            line, labels = row if isinstance(row, tuple) else (row, {"app": "a"})
            shaped.append((i, start + gap * i, line, labels))
        return spark.createDataFrame(shaped, "id bigint, ts timestamp_ntz, line string, labels map<string,string>")

    return build


@pytest.fixture(scope="session")
def make_points(spark):
    """Series points: key -> list of values, five minutes apart, values as text or numbers."""

    def build(series, kind="string"):
        first = datetime(2024, 1, 1)
        rows = [
            (key, first + timedelta(minutes=5 * i), v) for key, values in series.items() for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"key string, ts timestamp_ntz, value {kind}")

    return build
