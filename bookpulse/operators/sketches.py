"""Latency percentiles from mergeable sketches, one a minute.

A minute's sketch holds at most a few hundred values whatever it has seen, and sketches merge: any
window's percentiles come from the minutes in it, without reading events again. Ranks are off by
``RANK_ERROR`` of the values at most (with 99% confidence for ``K``); up to ``K`` values are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.functions.time import millis_between

K, RANK_ERROR = 400, 0.01
POINTS = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def minute_sketches(events: DataFrame) -> DataFrame:
    """(minute, n, sketch) of the ingest latency. Events without either time aren't measured."""
    millis = millis_between(F.col("event_ts"), F.col("ingested_ts")).cast("long")
    timed = events.select(minute_of(F.col("event_ts")).alias("minute"), millis.alias("ms")).where("ms is not null")
    return timed.groupBy("minute").agg(
        F.count("*").alias("n"), F.kll_sketch_agg_bigint("ms", F.lit(K)).alias("sketch")
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Rows of (n, sketch) merged by key."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(K)).alias("sketch"))


def sliding(sketches: DataFrame, minutes: int = 5) -> DataFrame:
    """(window_start, n, sketch) of every window of so many minutes that has an event; one starts each minute."""
    back = F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("back")
    starts = sketches.select("*", back).withColumn("window_start", F.col("minute") - F.make_dt_interval(mins="back"))
    return merged(starts, "window_start")


def trailing(sketches: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """(n, sketch) of the last whole minutes up to now's own, for a live tile."""
    last = minute_of(now)
    return merged(sketches.where((F.col("minute") <= last) & (F.col("minute") > last - F.make_dt_interval(mins=F.lit(minutes)))))


def percentiles(sketches: DataFrame) -> DataFrame:
    """The sketch replaced by the values at POINTS."""
    values = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(name) for name, q in POINTS.items()]
    return sketches.select("*", *values).drop("sketch")


def rank_errors(found: DataFrame, events: DataFrame, minutes: int = 5) -> DataFrame:
    """Windows of percentiles with how far each value's rank is from the one asked for, as a share.

    Exact, by reading all events: for tests and for watching the sketches.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("back")
    millis = millis_between(F.col("event_ts"), F.col("ingested_ts"))
    each = events.select(minute_of(F.col("event_ts")).alias("minute"), millis.alias("ms"), back)
    each = each.where("ms is not null").select((F.col("minute") - F.make_dt_interval(mins="back")).alias("window_start"), "ms")
    counts = []
    for name in POINTS:
        counts += [F.count_if(F.col("ms") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("ms") <= F.col(name)).alias(f"{name}_upto")]
    ranked = each.join(found, "window_start").groupBy("window_start", "n", *POINTS).agg(*counts)
    errors = [
        F.greatest(F.col(f"{name}_below") / F.col("n") - q, q - F.col(f"{name}_upto") / F.col("n"), F.lit(0.0)).alias(name.replace("_ms", "_error"))
        for name, q in POINTS.items()
    ]
    return ranked.select("window_start", "n", *POINTS, *errors)
