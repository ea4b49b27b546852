import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from aerogrid.session import local_session

    session = local_session(4, "aerogrid-tests", "4g")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Limits so low that every skew-safe path is taken on a few hundred rows."""
    spark.conf.set("spark.aerogrid.maxGroupRows", "40")
    spark.conf.set("spark.aerogrid.blockRows", "64")
    yield
    spark.conf.unset("spark.aerogrid.maxGroupRows")
    spark.conf.unset("spark.aerogrid.blockRows")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
