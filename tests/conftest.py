"""One small session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(at / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(at / "warehouse"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _sf(name: str) -> str:
    at = DATA / name
    if not at.exists():
        pytest.skip(f"{at} isn't there")
    return str(at)


@pytest.fixture(scope="session")
def tiny() -> str:
    return _sf("sf0.001")


@pytest.fixture(scope="session")
def small() -> str:
    return _sf("sf0.01")
