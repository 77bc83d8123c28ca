import os
import sys
from datetime import timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helpers import BASE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()


EVENT = (
    "event_id string, source_system string, origin string, ts timestamp, level string, message string, "
    "identifiers map<string,string>, host string"
)


@pytest.fixture
def events(spark):
    """events([(id, offset seconds, identifiers, source, message, level), ...]); trailing parts may be left out."""

    def make(rows):
        full = []
        for row in rows:
            name, offset, ids, source, message, level = (list(row) + [None] * 6)[:6]
            ts = BASE + timedelta(microseconds=round(offset * 1_000_000))
            full.append((name, source or "tomcat", "o", ts, level, message or "something happened", ids or {}, None))
        return spark.createDataFrame(full, EVENT)

    return make
