import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def col(spark):
    """Evaluates a column function over a list of values."""

    def run(fn, values, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]

    return run
