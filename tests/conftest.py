import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SF = os.environ.get("PARLEO_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from parleo.session import make_session
    s = make_session("tests", 4, shuffle=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture()
def small_chunks(spark):
    """Chunks of two rows, so that every carry between chunks is used."""
    spark.conf.set("parleo.chunk.rows", "2")
    yield spark
    spark.conf.unset("parleo.chunk.rows")
