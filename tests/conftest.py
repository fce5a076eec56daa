import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from memlake.session import local_session

    session = local_session(8, app="memlake-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def one(spark):
    """Value of a Column expression over a single text column ``t``."""
    def run(text, expression):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(expression("t").alias("v")).first()["v"]

    return run
