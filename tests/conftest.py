import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from termloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def column(spark):
    """Evaluate a column function over texts, in order."""

    def evaluate(values, build, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        found = rows.select("i", build.alias("out")).collect()
        return [row.out for row in sorted(found, key=lambda row: row.i)]

    return evaluate
