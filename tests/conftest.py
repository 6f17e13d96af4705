import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("bidflow-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["small", "large"])
def form(request, spark):
    """Runs a test with the plain plans and again with the skew-proof ones."""
    from bidflow.operators.sizing import SLICE_CONF, SMALL_INPUT_CONF

    spark.conf.set(SMALL_INPUT_CONF, str(10**30) if request.param == "small" else "0")
    spark.conf.set(SLICE_CONF, str(10**15) if request.param == "small" else "4000")
    yield request.param
    spark.conf.unset(SMALL_INPUT_CONF)
    spark.conf.unset(SLICE_CONF)


@pytest.fixture
def small(spark):
    from bidflow.operators.sizing import SMALL_INPUT_CONF

    spark.conf.set(SMALL_INPUT_CONF, str(10**30))
    yield
    spark.conf.unset(SMALL_INPUT_CONF)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    from oracle_check import connect

    return connect(sf_dir)
