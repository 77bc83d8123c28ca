"""The registered queries next to their SQL at the smallest size; `python tests/oracle.py SF` runs them at any size."""
import oracle
import pytest

import __spark_entry__ as entry
from queries.registry import ORACLES

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(name for name in ORACLES if not name.startswith("op") and name != "pipeline")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, text = oracle.compare(spark, oracle.connect(SF_DIR), name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["incident_id", "event_count", "sources_involved", "start_us", "end_us"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
