"""Streaming forms of the desk queries, and how to run them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from bookpulse import schemas as S
from bookpulse.functions.time import Clock, millis_between
from bookpulse.operators.snapshot import state_aggregates


def start(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Run a stream into a micro-batch writer, at an interval or once over what is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(sink)
        .start()
    )


def start_append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Run a stateless stream into a Parquet folder; the file sink commits each batch once."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def latest_state(events: DataFrame) -> DataFrame:
    """Per position the newest mark, rating and trade. State is one row per position."""
    return (
        events.where(F.col("position_id").isNotNull())
        .groupBy("position_id")
        .agg(*state_aggregates())
    )


def live_state(state: DataFrame, clock: Clock, hours: float = 24) -> DataFrame:
    """The state as of a moment: what is older than the window has expired, as in the snapshot.

    Expiry happens when the state is read, so it needs no event to come. ``n`` counts all events.
    """
    bound = clock.ago(hours=hours)
    fresh = {k: F.when(F.col(f"{k}.event_ts") >= bound, F.col(k)) for k in ("mark", "rating", "trade")}
    return state.where(F.col("latest_event_ts") >= bound).withColumns(fresh)


def hourly_trades(events: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Trades per hour. Hours behind the watermark leave the state; what comes that late is in the event table."""
    counted = _windowed(events.where(F.col("event_type") == S.TRADE), watermark, "1 hour", None)
    return counted.agg(F.count("*").alias("trade_count")).select(
        F.col("window.start").cast("timestamp_ntz").alias("hour"), "trade_count"
    )


def _windowed(events: DataFrame, watermark: str, length: str, slide: str | None):
    timed = events.withColumn("at", F.col("event_ts").cast("timestamp"))
    window = F.window("at", length, slide) if slide else F.window("at", length)
    return timed.withWatermark("at", watermark).groupBy(window)


def throughput(
    events: DataFrame, minutes: int = 5, slide: str = "1 minute", watermark: str = "1 day"
) -> DataFrame:
    """Events per minute over sliding windows.

    The watermark only bounds the state of this live figure; rows behind it stay in the event
    table, flagged late.
    """
    counted = _windowed(events, watermark, f"{minutes} minutes", slide).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        "n",
        F.round(F.col("n") / F.greatest(F.lit(minutes), F.lit(1)), 1).alias("events_per_min"),
    )


def latency(events: DataFrame, length: str = "5 minutes", watermark: str = "1 day") -> DataFrame:
    """Sketched latency percentiles per tumbling window."""
    millis = millis_between(F.col("event_ts"), F.col("ingested_ts"))
    sketch = F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 1000)
    summed = _windowed(events.withColumn("latency_ms", millis), watermark, length, None).agg(
        F.count("*").alias("event_count"), sketch.alias("p")
    )
    return summed.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        "event_count",
        F.col("p")[0].alias("p50_ms"),
        F.col("p")[1].alias("p95_ms"),
        F.col("p")[2].alias("p99_ms"),
    )


#: The name of the metrics that ``observed`` counts, and those of them that add up over batches.
OBSERVED, ADDED = "ingest", ("rows", "quarantined", "errors")


def observed(events: DataFrame, problems: Column, is_error: Column) -> DataFrame:
    """The stream itself, counting as it runs by: rows, rows with problems, errors, greatest lag and newest time.

    The counts of a batch come with its progress; nothing is read twice for them. A batch writer that
    reads its batch more than once must keep it, as ``chained`` does, or it is counted each time.
    """
    lag = millis_between(F.col("event_ts"), F.col("ingested_ts"))
    return events.observe(
        OBSERVED,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size(problems) > 0).alias("quarantined"),
        F.count_if(is_error).alias("errors"),
        F.max(lag).alias("lag_ms"),
        F.max(F.unix_millis(F.col("event_ts").cast("timestamp"))).alias("newest_ms"),
    )


POINTS = "at string, metric string, labels map<string,string>, value double"


def points_of(progress, name: str) -> list[tuple]:
    """A progress update as metric points; the sum of durations tells where a batch's time went."""
    values = {
        "input_rows": progress.numInputRows,
        "rows_per_second": progress.processedRowsPerSecond,
        "batch_ms": progress.batchDuration,
        "state_rows": sum(s.numRowsTotal for s in progress.stateOperators),
        "dropped_late_rows": sum(s.numRowsDroppedByWatermark for s in progress.stateOperators),
    }
    for observation, row in (progress.observedMetrics or {}).items():
        values |= {f"{observation}.{metric}": value for metric, value in row.asDict().items() if value is not None}
    return [(progress.timestamp, metric, {"query": name}, float(value)) for metric, value in values.items()]


def typed_points(points: DataFrame) -> DataFrame:
    return points.select(F.to_timestamp("at").cast("timestamp_ntz").alias("ts"), "metric", "labels", "value")


def health_points(query: StreamingQuery, name: str, spark: SparkSession) -> DataFrame:
    """The progress a query still remembers as metric points. ``ProgressLog`` keeps all of it."""
    rows = [row for progress in query.recentProgress for row in points_of(progress, name)]
    return typed_points(spark.createDataFrame(rows, POINTS))


class ProgressLog(StreamingQueryListener):
    """Keeps every progress update of a session's streams in a folder, as metric points.

    Register it with ``spark.streams.addListener``. A query that fails leaves a point ``failed``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._append(points_of(event.progress, event.progress.name or str(event.progress.id)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception is not None:
            now = datetime.now(timezone.utc).isoformat()
            self._append([(now, "failed", {"query": str(event.id)}, 1.0)])

    def read(self) -> DataFrame:
        return typed_points(self.spark.read.schema(POINTS).parquet(self.path))
