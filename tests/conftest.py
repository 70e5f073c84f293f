import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("spectrafdr-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Force every scaling path: many buckets, no broadcasts, salted keys."""
    from spectrafdr.operators import proteome, scale

    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(scale, "HOT_KEY_ROWS", 4)
    monkeypatch.setattr(proteome, "MAX_SEED_ROWS", 2)
