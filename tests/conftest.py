from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from footfall.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def log(spark):
    """Build an event log from ``(id, name, seconds after the start)`` rows."""

    def build(rows):
        data = [(i, n, START + timedelta(seconds=s), k) for k, (i, n, s) in enumerate(rows)]
        return spark.createDataFrame(data, "id string, event_name string, event_timestamp timestamp, event_id long")

    return build


def records(df, *keys):
    """Rows as dictionaries, ordered by the given columns."""
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(r[k] for k in keys)) if keys else rows
