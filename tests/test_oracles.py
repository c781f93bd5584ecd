"""Every registered query against its SQL oracle on the benchmark tables."""

import os

import __spark_entry__ as entry
import pytest
from differential import connect, differences

from bookpulse.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(catalog.QUERIES)))
def test_oracle(spark, con, name):
    assert differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == []


def test_approximate_latency_is_close(spark):
    exact = entry.queries()["ingest_latency_exact"](spark, SF_DIR).first()
    approx = entry.queries()["ingest_latency_approx"](spark, SF_DIR).first()
    assert approx.event_count == exact.event_count
    assert abs(approx.p50_ms - exact.p50_ms) <= 5


def test_entry(spark):
    assert entry.entry(spark).count() > 0
