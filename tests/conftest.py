import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from noticeworks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def evaluate(spark):
    """Evaluate an expression of one string column for several inputs."""

    def run(expr, *values):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        out = rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()
        return [r["out"] for r in out]

    return run
