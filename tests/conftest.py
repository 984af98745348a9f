"""A local session for all tests."""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    built = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", top).config("spark.checkpoint.dir", f"file://{top}/shared")
        .config("spark.sql.warehouse.dir", f"{top}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
