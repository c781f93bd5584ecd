from datetime import datetime, timedelta

import pytest
from fixtures import CLOCK, NOW, ago
from pyspark.sql import functions as F

from bookpulse.functions import text
from bookpulse.functions.time import bin_start, millis_between, seconds_between
from bookpulse.operators import latency, series


def points(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, metric string, issuer string, value double")


def test_observations_are_typed(spark):
    df = spark.createDataFrame(
        [
            (NOW, "http", '{"metric_name":"m","issuer":"i"}', '{"value":1.5}'),
            (NOW, "http", '{"metric_name":"m"}', '{"value":"bad"}'),
            (NOW, "http", "{broken", '{"value":2}'),
            (NOW, "span", '{"metric_name":"m"}', '{"value":3}'),
            (NOW, "http", '{"metric_name":"other"}', '{"value":4}'),
        ],
        "ts timestamp_ntz, observation_kind string, extra string, fields string",
    )
    rows = series.metric_points(df, "http", ["m"]).collect()
    assert [(r.metric, r.issuer, r.value) for r in rows] == [("m", "i", 1.5), ("m", None, None)]
    variant = df.withColumn("extra", F.try_parse_json("extra")).withColumn("fields", F.try_parse_json("fields"))
    assert series.metric_points(variant, "http", ["m"]).collect() == rows


def test_empty_bins(spark):
    df = points(spark, [
        (ago(hours=2, minutes=10), "a", "", 1.0), (ago(hours=2, minutes=20), "a", "", 4.0),
        (ago(minutes=5), "a", "", 7.0), (ago(hours=30), "a", "", 99.0), (ago(hours=1), "b", "", 5.0),
    ])
    chart = series.average_chart(df, CLOCK, hours=3).where("metric = 'a'").orderBy("bin").collect()
    assert [(r.value, r.points) for r in chart] == [(2.5, 2), (None, 0), (7.0, 1), (None, 0)]
    assert chart[0].bin == NOW - timedelta(hours=3)
    total = series.total_chart(df, CLOCK, hours=3).where("metric = 'a'").orderBy("bin").collect()
    assert [r.value for r in total] == [5.0, 0.0, 7.0, 0.0]
    assert series.average_chart(df, CLOCK, hours=3).count() == 8


def test_top_issuers(spark):
    rows = [(NOW, "m", f"i{n}", float(n % 7)) for n in range(20)]
    top = series.top_issuers(points(spark, rows), CLOCK, 3).collect()
    assert [(r.issuer, r["count"]) for r in top] == [("i13", 6), ("i6", 6), ("i12", 5)]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_summary_ranks(spark, n):
    df = points(spark, [(ago(seconds=n - i), "m", "", float(i)) for i in range(n)])
    asked = spark.createDataFrame([("m",), ("none",)], "metric string")
    rows = {r.metric: r for r in series.metric_summary(df, CLOCK, asked).collect()}
    expect_95 = float(int(n * 0.95)) if n >= 20 else float(n - 1)
    assert (rows["m"]["count"], rows["m"].p50, rows["m"].p95, rows["m"].max) == (n, float(n // 2), expect_95, n - 1.0)
    assert rows["m"].avg == round(sum(range(n)) / n, 1)
    assert tuple(rows["none"])[1:] == (0, 0.0, 0.0, 0.0, 0.0)


def test_summary_window(spark):
    df = points(spark, [(ago(seconds=400), "m", "", 9.0), (ago(seconds=300), "m", "", 1.0), (ago(seconds=1), "m", "", 2.0)])
    asked = spark.createDataFrame([("m",)], "metric string")
    assert series.metric_summary(df, CLOCK, asked).first()["count"] == 2


def test_summary_of_many_points_of_one_instant(spark):
    df = points(spark, [(ago(seconds=1), "m", "", float(i)) for i in range(5000)])
    row = series.metric_summary(df, CLOCK, spark.createDataFrame([("m",)], "metric string")).first()
    assert (row["count"], row.p50, row.p95, row.max, row.avg) == (5000, 2500.0, 4750.0, 4999.0, 2499.5)


def test_small_and_large_values_are_charted(spark):
    df = points(spark, [(ago(minutes=1), "m", "", 4e-7), (ago(minutes=2), "m", "", 4e-7), (ago(minutes=1), "n", "", 1e23)])
    values = {r.metric: r.value for r in series.average_chart(df, CLOCK, hours=1).where("points > 0").collect()}
    assert values == {"m": 4e-7, "n": 1e23}


def test_a_past_moment_sees_nothing_after_it(spark):
    df = points(spark, [(ago(minutes=5), "m", "i", 1.0), (ago(hours=-3), "m", "i", 9.0)])
    chart = series.total_chart(df, CLOCK, hours=1).collect()
    assert sum(r.value for r in chart) == 1.0 and max(r.bin for r in chart) <= NOW
    assert series.top_issuers(df, CLOCK).first()["count"] == 1


def test_series_name(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({},), (None,)], "l map<string,string>")
    names = [r[0] for r in df.select(text.series_name(F.lit("m"), F.col("l"))).collect()]
    assert names == ["m{a=1,b=2}", "m", "m"]


def test_boundary_counts(spark):
    a, b = datetime(2026, 1, 1, 0, 0, 0, 999), datetime(2026, 1, 1, 0, 0, 0, 1001)
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    row = df.select(
        millis_between(F.col("a"), F.col("b")), seconds_between(F.col("a"), F.col("b")), bin_start(F.col("b"), 3600)
    ).first()
    assert tuple(row) == (1, 0, datetime(2026, 1, 1))


TRACE = (
    "event_id int, event_ts timestamp_ntz, session string, event_type string, sdk_appended_ms double, "
    "flush_committed_ms double, total_handler_ms double, roundtrip_ms double, visible_ms double, error string"
)


def traces(spark):
    return spark.createDataFrame(
        [
            (1, ago(seconds=9), "s", "TRADE", 0.5, 30.0, 40.0, 100.0, 250.0, None),
            (2, ago(seconds=8), "s", "CREDIT_EVENT", 0.5, 32.0, 40.0, 120.0, 110.0, None),
            (3, ago(seconds=7), "s", "MARK", None, None, None, 90.0, None, "timeout"),
        ],
        TRACE,
    )


def test_segments(spark):
    rows = latency.segments(traces(spark), "session").collect()
    by_event = {}
    for r in rows:
        by_event.setdefault(r.event, {})[r.step] = r.ms
    assert by_event["#1 TRADE"] == {"1 network": 60.0, "2 append": 0.5, "3 flush": 30.0, "4 poll": 150.0}
    assert by_event["#2 CREDIT"]["4 poll"] == 0.0
    assert by_event["#3 MARK"] == {"1 network": 90.0, "2 append": 0.0, "3 flush": 0.0, "4 poll": 0.0}
    many = spark.range(60).join(traces(spark).where("event_id = 1").drop("event_id")).withColumnRenamed("id", "event_id")
    assert latency.segments(many, "session").count() == 240
    kept = latency.segments(traces(spark), "session", history=1).select("event").distinct().collect()
    assert [r.event for r in kept] == ["#1 MARK"]


def test_latency_summary(spark):
    row = latency.summary(traces(spark), ["session"]).first()
    assert (row.fired, row.completed) == (3, 2)
    assert (row.median_visible_ms, row.min_visible_ms, row.max_visible_ms) == (250.0, 110.0, 250.0)
    assert (row.median_flush_ms, row.avg_roundtrip_ms, row.grade) == (32.0, 110.0, "fast")


def test_buckets(spark):
    df = spark.createDataFrame([(299.9,), (300.0,), (999.9,), (1000.0,)], "ms double")
    assert [r[0] for r in df.select(latency.bucket(F.col("ms"))).collect()] == ["fast", "slow", "slow", "stalled"]
