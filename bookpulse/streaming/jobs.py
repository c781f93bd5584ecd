"""The streams over the benchmark tables, run to the end of what is there."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse import schemas as S
from bookpulse.functions.time import Clock
from bookpulse.operators import sketches
from bookpulse.operators.snapshot import portfolio_live, portfolio_table
from bookpulse.plans import desk, questions
from bookpulse.session import work_dir
from bookpulse.sources import book
from bookpulse.streaming import streams
from bookpulse.streaming.keyed import LiveSnapshot, OffsetLedger
from bookpulse.streaming.sinks import ChangeSink, EventSink, RequestSink, SketchSink, SnapshotSink, problems


def _finish(query) -> None:
    query.awaitTermination()


def _ingested(spark: SparkSession, stream: DataFrame, name: str) -> EventSink:
    base = work_dir(spark, name)
    sink = EventSink(base)
    _finish(streams.start(stream, sink, f"{base}/checkpoint"))
    return sink


def run_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = _ingested(spark, book.stream_events(spark, sf_dir), "ingest")
    return sink.read(spark).select("event_id", "event_ts", "event_type", "position_id", "late")


def _requested(spark: SparkSession, sf_dir: str, name: str) -> RequestSink:
    """All request bodies through one stream."""
    base = work_dir(spark, name)
    sink = RequestSink(base)
    # Parsing costs far more than reading, so a large file must not be one task's.
    bodies = book.bodies_of(book.stream_events(spark, sf_dir, spread=True)).withColumnRenamed("event_id", "body_id")
    _finish(streams.start(bodies, sink, f"{base}/checkpoint"))
    return sink


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _requested(spark, sf_dir, "requests").events.read(spark)
    return stored.select(
        "event_id", "event_ts", "event_type", "position_id", "side",
        F.col("qty").cast("double").alias("qty"), "to_rating",
    )


def run_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = spark.read.parquet(_requested(spark, sf_dir, "quarantine").rejected)
    return rejected.select("body_id", F.array_join("reasons", "; ").alias("reasons"))


def run_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice."""
    once, again = book.stream_events(spark, sf_dir), book.stream_events(spark, sf_dir)
    sink = _ingested(spark, once.unionByName(again), "dedupe")
    return sink.read(spark).groupBy("event_type").agg(
        F.count("*").alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = _ingested(spark, book.stream_events(spark, sf_dir), "health")
    return sink.read_progress(spark).agg(
        F.sum("received").alias("received"),
        F.sum("quarantined").alias("quarantined"),
        F.max("newest_event_ts").alias("newest_event_ts"),
    )


def _changes(spark: SparkSession, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    base = work_dir(spark, name)
    sink = ChangeSink(f"{base}/changes", keys)
    _finish(streams.start(stream, sink, f"{base}/checkpoint", mode="update"))
    return sink.read(spark)


def run_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.latest_state(book.stream_events(spark, sf_dir))
    state = _changes(spark, stream, "latest-state", ["position_id"])
    return state.select(
        "position_id",
        F.col("mark.new_mark").cast("double").alias("new_mark"),
        F.col("rating.to_rating").alias("to_rating"),
        F.col("trade.side").alias("side"),
        F.col("n").alias("events"),
        "latest_event_ts",
    )


def run_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.latest_state(book.stream_events(spark, sf_dir))
    state = _changes(spark, stream, "live-state", ["position_id"])
    live = streams.live_state(state, Clock.latest(book.table(spark, sf_dir, "events"), "ts"))
    return live.select(
        "position_id",
        F.col("mark.new_mark").cast("double").alias("new_mark"),
        F.col("rating.to_rating").alias("to_rating"),
        F.col("trade.side").alias("side"),
        "latest_event_ts",
    )


def run_hourly_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.hourly_trades(book.stream_events(spark, sf_dir))
    return _changes(spark, stream, "hourly-trades", ["hour"])


def run_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.throughput(book.stream_events(spark, sf_dir))
    return _changes(spark, stream, "throughput", ["window_start"])


def run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.latency(book.stream_events(spark, sf_dir))
    return _changes(spark, stream, "latency", ["window_start"])


def _appended(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    base = work_dir(spark, name)
    _finish(streams.start_append(stream, f"{base}/rows", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/rows")


def run_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live tape as a stream."""
    events = book.stream_events(spark, sf_dir).where(desk.not_warmup())
    stream = desk.enrich(events, book.load_positions(spark, sf_dir))
    return _appended(spark, stream, "enrich").select(
        "event_id", "event_ts", "event_type", "issuer", "sector", "latency_ms",
        F.col("price").cast("double").alias("price"),
    )


def run_downgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = questions.downgrades(
        book.stream_events(spark, sf_dir), book.load_positions(spark, sf_dir)
    )
    return _appended(spark, stream, "downgrades")


def run_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = book.load_positions(spark, sf_dir)

    def snapshot(events: DataFrame, clock: Clock) -> DataFrame:
        return portfolio_table(portfolio_live(events, positions, clock), clock)

    base = work_dir(spark, "portfolio")
    sink = SnapshotSink(f"{base}/portfolio", EventSink(base), snapshot)
    _finish(streams.start(book.stream_events(spark, sf_dir), sink, f"{base}/checkpoint"))
    return sink.read(spark).select(
        "position_id",
        "sector",
        "current_rating",
        F.col("latest_mark").cast("double").alias("latest_mark"),
        F.col("pnl_today").cast("double").alias("pnl_today"),
        "latest_event_ts",
    )


#: Streams are fed in so many parts by event id, so that later batches bring older events.
PARTS = 3


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = book.stream_events(spark, sf_dir)
    return [events.where(F.pmod("event_id", F.lit(PARTS)) == part) for part in range(PARTS)]


def _live_snapshot(spark: SparkSession, sf_dir: str, name: str) -> LiveSnapshot:
    base, parts = work_dir(spark, name), _parts(spark, sf_dir)
    live = LiveSnapshot(base, book.load_positions(spark, sf_dir), parts[0].schema)
    for k, part in enumerate(parts):
        _finish(streams.start(part, live, f"{base}/checkpoint-{k}"))
    return live


def run_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot kept by change over several batches."""
    return _live_snapshot(spark, sf_dir, "live-snapshot").read(spark)


#: Hours after the newest event at which the state is looked at again, without events.
LATER = (8, 16, 23.5)


def run_state_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions have a live mark, rating and trade at clocks that go on without events."""
    live = _live_snapshot(spark, sf_dir, "state-expiry")
    newest = live.sequence.clock(spark).fixed_at()
    none = book.load_events(spark, sf_dir).limit(0)
    found = []
    for hours in (0, *LATER):
        if hours:
            live.refresh(none, f"clock+{hours}", newest + timedelta(hours=hours))
        kinds = live.state.read(spark).select("position_id", F.expr("transform(events, e -> e.event_type)").alias("kinds"))
        held = {name: F.count_if(F.array_contains("kinds", kind)) for name, kind in (("marks", S.MARK), ("ratings", S.CREDIT_EVENT), ("trades", S.TRADE))}
        counted = kinds.agg(F.lit(float(hours)).alias("hours"), F.count("*").alias("positions"), *[c.alias(n) for n, c in held.items()])
        found.append(counted.first())  # now: the table goes on to change
    return spark.createDataFrame(found, counted.schema)


def run_end_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets per position over several batches."""
    base, parts = work_dir(spark, "end-offsets"), _parts(spark, sf_dir)
    ledger = OffsetLedger(base, parts[0].schema)
    for k, part in enumerate(parts):
        _finish(streams.start(part, ledger, f"{base}/checkpoint-{k}"))
    return ledger.read(spark).select("position_id", "rows", "end_offset")


def run_latency_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over windows of five minutes, one each minute, from stored sketches; are they near the exact ones?"""
    base, parts = work_dir(spark, "latency-sliding"), _parts(spark, sf_dir)
    sink = SketchSink(f"{base}/sketches")
    for k, part in enumerate(parts):
        _finish(streams.start(part, sink, f"{base}/checkpoint-{k}"))
    found = sketches.percentiles(sketches.sliding(sink.read(spark)))
    checked = sketches.rank_errors(found, book.load_events(spark, sf_dir))
    near = F.greatest("p50_error", "p95_error", "p99_error") <= sketches.RANK_ERROR
    return checked.select("window_start", F.col("n").alias("event_count"), *sketches.POINTS, near.alias("near_exact"))


def run_observed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, quarantined rows, errors and lag of all batches, from the metrics that the stream observes."""
    base = work_dir(spark, "observed")
    events = book.stream_events(spark, sf_dir)
    watched = streams.observed(events, problems(), F.col("event_type") == S.CREDIT_EVENT)
    query = streams.start_append(watched.select("event_id", "event_ts"), f"{base}/rows", f"{base}/checkpoint")
    _finish(query)
    points = streams.health_points(query, "ingest", spark).where(F.col("metric").startswith(f"{streams.OBSERVED}."))
    adds = F.col("metric").isin([f"{streams.OBSERVED}.{name}" for name in streams.ADDED])
    return points.groupBy("metric").agg(F.sum("value").alias("total"), F.max("value").alias("most")).select(
        "metric", F.when(adds, F.col("total")).otherwise(F.col("most")).alias("value")
    )
