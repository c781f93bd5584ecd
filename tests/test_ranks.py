import math
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookpulse.operators.ranks import exact_percentiles, p95_or_max, upper_median, values_at_ranks


def nearest(values):
    values = sorted(values)
    n = len(values)
    return values[n // 2], values[int(n * 0.95)] if n >= 20 else values[-1]


def test_groups_of_all_sizes(spark):
    rng = random.Random(5)
    data = {"one": [3.0], "nineteen": list(range(19)), "twenty": list(range(20)), "even": [1.0, 2.0]}
    data["hot"] = [rng.choice([7.0, rng.random() * 100]) for _ in range(5000)]
    data[None] = [4.0, 4.0, 5.0]
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {
        r.k: (r.p50, r.p95)
        for r in values_at_ranks(df, ["k"], "v", {"p50": upper_median, "p95": p95_or_max}, side=4).collect()
    }
    assert got == {k: nearest(map(float, vs)) for k, vs in data.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    row = values_at_ranks(df, [], "v", {"p50": upper_median, "p95": p95_or_max}, side=3).first()
    assert (row.p50, row.p95) == nearest(values) and row.total == len(values)


def test_interpolated(spark):
    df = spark.range(0, 1001).select((F.col("id") * F.col("id")).alias("v"))
    row = exact_percentiles(df, [], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (row.p50, row.p99) == (250000.0, 980100.0)
    pair = spark.createDataFrame([(10,), (20,)], "v bigint")
    assert exact_percentiles(pair, [], "v", {"q": 0.25}).first().q == pytest.approx(12.5)


def test_ranks_of_decimals(spark):
    df = spark.createDataFrame([(Decimal(i) / 10,) for i in range(7)], "v decimal(10,1)")
    row = values_at_ranks(df, [], "v", {"m": upper_median}).first()
    assert row.m == Decimal("0.3")
    assert math.isclose(row.total, 7)
