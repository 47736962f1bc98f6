import pytest
from pyspark.sql import SparkSession

from shoalkv.config import Config
from shoalkv.plans.engine import Engine, bootstrap


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings(tmp_path):
    """A lake of its own for each test, and memtables that don't freeze by themselves."""
    return Config(root=str(tmp_path / "lake"), wal_dir=str(tmp_path / "wal"), memtable_max_bytes=1 << 30, max_frozen=4, cache_bytes=8 << 20)


@pytest.fixture
def opened(spark, settings):
    bootstrap(spark, settings)
    held = []

    def again() -> Engine:
        """A reopened engine: what was in memory is gone."""
        while held:
            held.pop().close()
        held.append(Engine.open(spark, settings))
        return held[-1]

    yield again
    while held:
        held.pop().close()
