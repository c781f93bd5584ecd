"""Metric time series: counts, rates, charts with empty bins, point summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions.text import as_variant
from bookpulse.functions.time import Clock, bin_start, since
from bookpulse.operators.joins import join_groups
from bookpulse.operators.ranks import p95_or_max, upper_median, values_at_ranks


def metric_points(observations: DataFrame, kind: str, metrics: list[str]) -> DataFrame:
    """Typed points out of semi-structured observations of one kind."""
    name = F.variant_get("_extra", "$.metric_name", "string")
    return (
        observations.where(F.col("observation_kind") == kind)
        .withColumn("_extra", as_variant(observations, "extra"))
        .withColumn("_fields", as_variant(observations, "fields"))
        .withColumn("metric", name)
        .where(F.col("metric").isin(metrics))
        .select(
            "ts",
            "metric",
            F.try_variant_get("_extra", "$.issuer", "string").alias("issuer"),
            F.try_variant_get("_fields", "$.value", "double").alias("value"),
        )
    )


def timechart(
    points: DataFrame,
    clock: Clock,
    hours: float,
    step_seconds: int,
    keys: list[str],
    value: Column,
) -> DataFrame:
    """One row per key and bin over the trailing range, bins without points included.

    Points are aggregated per bin first. Each bin then also stands for the empty ones up to the
    next, and the first for those before it, so the gaps are filled without a second pass.
    """
    recent = since(points, clock, ts="ts", hours=hours)
    binned = recent.groupBy(*keys, bin_start(F.col("ts"), step_seconds).alias("_bin")).agg(
        value.alias("_value"), F.count("*").alias("_points")
    )
    step = F.make_dt_interval(secs=F.lit(step_seconds))
    start = bin_start(clock.ago(hours=hours), step_seconds)
    end = bin_start(clock.now(), step_seconds)
    in_time = Window.partitionBy(*keys).orderBy("_bin")
    placed = binned.withColumns({
        "_from": F.when(F.lag("_bin").over(in_time).isNull(), start).otherwise(F.col("_bin")),
        "_to": F.coalesce(F.lead("_bin").over(in_time) - step, end),
    })
    bins = placed.withColumn("bin", F.explode(F.sequence("_from", "_to", step)))
    own = F.col("bin") == F.col("_bin")
    return bins.select(
        *keys,
        "bin",
        F.when(own, F.col("_value")).alias("value"),
        F.when(own, F.col("_points")).otherwise(0).alias("points"),
    )


def average_chart(points: DataFrame, clock: Clock, hours: float = 24, step_seconds: int = 3600):
    """Average per metric and bin; NULL where a bin is empty."""
    return timechart(points, clock, hours, step_seconds, ["metric"], F.avg("value"))


def total_chart(points: DataFrame, clock: Clock, hours: float = 24, step_seconds: int = 3600):
    """Sum per metric and bin; zero where a bin is empty."""
    chart = timechart(points, clock, hours, step_seconds, ["metric"], F.sum("value"))
    return chart.withColumn("value", F.coalesce("value", F.lit(0.0)))


def top_issuers(points: DataFrame, clock: Clock, n: int = 10, hours: float = 24) -> DataFrame:
    """The n largest issuer counts of the trailing range, largest first."""
    recent = since(points, clock, ts="ts", hours=hours)
    counted = recent.select("issuer", F.col("value").cast("bigint").alias("count"))
    return counted.orderBy(F.desc_nulls_last("count"), "issuer").limit(n)


def metric_summary(
    points: DataFrame, clock: Clock, metrics: DataFrame, window_seconds: int = 300
) -> DataFrame:
    """Count, median, p95, mean and maximum per requested metric, zeros without points.

    All points of the window count. The ranks are found slab by slab, so a hot series is split.
    """
    recent = since(points, clock, ts="ts", seconds=window_seconds)
    ranks = values_at_ranks(recent, ["metric"], "value", {"p50": upper_median, "p95": p95_or_max})
    totals = recent.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.bround(F.avg("value"), 1).alias("avg"),
        F.max("value").alias("max"),
    )
    summary = join_groups(totals, ranks.drop("total"), ["metric"], "left")
    zero = F.lit(0.0)
    return (
        metrics.join(summary, "metric", "left")
        .select(
            "metric",
            F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
            *[F.coalesce(name, zero).alias(name) for name in ("p50", "p95", "avg", "max")],
        )
    )
