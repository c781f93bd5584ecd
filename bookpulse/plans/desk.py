"""The dashboard queries of the desk. All take DataFrames and return DataFrames.

``live`` is the snapshot of ``operators.snapshot.portfolio_live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas as S
from bookpulse.functions.money import rounded, share
from bookpulse.functions.time import Clock, hour_of, millis_between, seconds_between, since
from bookpulse.operators.latest import top_n
from bookpulse.operators.ranks import exact_percentiles

TAPE_DISPLAY = [
    "ingested_ts", "event_type", "position_id", "issuer", "sector", "side", "qty", "price",
    "prev_mark", "new_mark", "from_rating", "to_rating", "counterparty", "latency_ms", "partition",
]


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("event_ts"), F.desc("event_id")]


def not_warmup() -> Column:
    return ~F.col("source_app").eqNullSafe(S.WARMUP_SOURCE)


def enrich(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Events with issuer, sector and latency; also serves streams."""
    blank, none = F.lit(""), F.lit(0).cast("decimal(18,2)")
    return events.join(
        positions.select("position_id", "issuer", "sector"), "position_id", "left"
    ).select(
        "event_id",
        "event_ts",
        "ingested_ts",
        "event_type",
        "position_id",
        "issuer",
        "sector",
        millis_between(F.col("event_ts"), F.col("ingested_ts")).alias("latency_ms"),
        F.coalesce("side", blank).alias("side"),
        F.coalesce("qty", none).alias("qty"),
        "price",
        "prev_mark",
        "new_mark",
        F.coalesce("from_rating", blank).alias("from_rating"),
        F.coalesce("to_rating", blank).alias("to_rating"),
        F.coalesce("counterparty", blank).alias("counterparty"),
        F.coalesce("source_app", blank).alias("source_app"),
    )


def tape(events: DataFrame, positions: DataFrame, limit: int = 30) -> DataFrame:
    """The newest events. The limit comes before the join, so n rows are enriched, not the fact."""
    newest = top_n(events.where(not_warmup()), limit, *newest_first())
    return top_n(enrich(newest, positions), limit, *newest_first())


def pnl_today(live: DataFrame) -> DataFrame:
    pnl = F.col("pnl_today")
    return live.agg(
        rounded(F.sum(pnl), 2).alias("total_pnl"),
        F.count("*").alias("position_count"),
        F.sum(F.when(pnl > 0, 1).otherwise(0)).alias("gainers"),
        F.sum(F.when(pnl < 0, 1).otherwise(0)).alias("losers"),
    )


def exposure(live: DataFrame, by: str) -> DataFrame:
    """Par and share of total par per group. The total is one value, not a window over all groups."""
    per_group = live.groupBy(by).agg(F.sum("par_amount").alias("par"))
    total = live.agg(F.sum("par_amount")).scalar()
    return per_group.select(
        by, rounded(F.col("par")).alias("total_par"), share(F.col("par"), total).alias("pct")
    ).orderBy(F.desc("total_par"), by)


def sector_exposure(positions: DataFrame) -> DataFrame:
    """Par needs no events: any frame with sector and par will do, the dimension is cheapest."""
    return exposure(positions, "sector")


def top_marks(live: DataFrame, n: int = 10) -> DataFrame:
    biggest = F.abs("mark_change_bps").desc_nulls_last()
    return top_n(live, n, biggest, F.col("position_id")).select(
        "position_id",
        "issuer",
        "sector",
        "tranche",
        F.col("current_mark").cast("double").alias("current_mark"),
        rounded(F.col("mark_change_bps"), 1).alias("mark_change_bps"),
        rounded(F.col("pnl_today")).alias("pnl_today"),
        "fund",
    )


def watchlist(live: DataFrame) -> DataFrame:
    return (
        live.where("watchlist")
        .orderBy(F.asc_nulls_last("pnl_today"), "position_id")
        .select(
            "position_id",
            "issuer",
            "rating",
            "sector",
            rounded(F.col("par_amount")).alias("par_amount"),
            F.col("current_mark").cast("double").alias("current_mark"),
            rounded(F.col("pnl_today")).alias("pnl_today"),
        )
    )


def watchlist_count(positions: DataFrame) -> DataFrame:
    return positions.where("watchlist").agg(F.count("*").alias("watchlisted"))


def hourly_trades(events: DataFrame, clock: Clock, hours: float = 24) -> DataFrame:
    """Trades per hour."""
    trades = since(events, clock, hours=hours).where(F.col("event_type") == S.TRADE)
    return (
        trades.groupBy(hour_of(F.col("event_ts")).alias("hour"))
        .agg(F.count("*").alias("trade_count"))
        .orderBy("hour")
    )


def event_count(events: DataFrame, clock: Clock, hours: float = 24) -> DataFrame:
    return since(events, clock, hours=hours).agg(F.count("*").alias("cnt"))


_POINTS = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def _latencies(events: DataFrame, clock: Clock, window_min: float) -> DataFrame:
    latency = millis_between(F.col("event_ts"), F.col("ingested_ts"))
    return since(events, clock, minutes=window_min).select(latency.alias("latency_ms"))


def ingest_latency(events: DataFrame, clock: Clock, window_min: float = 5) -> DataFrame:
    """Sketched percentiles, the form for a live tile: one scan, a fixed-size partial per task."""
    sketch = F.percentile_approx("latency_ms", list(_POINTS.values()), 10000)
    return (
        _latencies(events, clock, window_min)
        .agg(F.count("*").alias("event_count"), sketch.alias("p"))
        .select(
            "event_count",
            *[F.col("p")[i].cast("double").alias(name) for i, name in enumerate(_POINTS)],
        )
    )


def ingest_latency_exact(events: DataFrame, clock: Clock, window_min: float = 5) -> DataFrame:
    """The same with exact interpolated percentiles."""
    rows = _latencies(events, clock, window_min)
    found = exact_percentiles(rows, [], "latency_ms", _POINTS)
    return found.select(
        F.coalesce("total", F.lit(0).cast("bigint")).alias("event_count"),
        *[F.round(name, 0).alias(name) for name in _POINTS],
    )


def refresh_lag(live: DataFrame, clock: Clock) -> DataFrame:
    """Seconds between now and the newest event in the snapshot."""
    newest = live.agg(F.max("latest_event_ts").alias("newest"))
    return newest.select(seconds_between(F.col("newest"), clock.now()).alias("lag_seconds"))


def throughput(events: DataFrame, clock: Clock, window_min: int = 5) -> DataFrame:
    """Events per minute over the trailing window."""
    minutes = F.greatest(F.lit(window_min), F.lit(1))
    return since(events, clock, minutes=window_min).agg(
        F.round(F.count("*") / minutes, 1).alias("events_per_min")
    )
