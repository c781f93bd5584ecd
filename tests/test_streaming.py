import time
from datetime import timedelta
from decimal import Decimal

import pytest
from fixtures import CLOCK, ago, event, frames
from pyspark.sql import functions as F

from bookpulse.operators.snapshot import portfolio_live, portfolio_table, position_state
from bookpulse.plans import desk
from bookpulse.sources import tables
from bookpulse.streaming import streams
from bookpulse.streaming.sinks import ChangeSink, EventSink, SnapshotSink, read_if_there


@pytest.fixture
def source(spark, tmp_path):
    """The events split over micro-batches, out of order and with repeats."""
    events, _ = frames(spark)
    schema = events.schema
    rows = events.orderBy(F.rand(4)).collect()
    path = str(tmp_path / "in")
    for part in (rows[:6], rows[4:11], rows[9:], rows[:3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    return stream


def run(stream, sink, checkpoint, mode="append"):
    query = streams.start(stream, sink, str(checkpoint), mode)
    query.awaitTermination()
    return query


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_every_event_once(spark, source, tmp_path):
    events, _ = frames(spark)
    sink = EventSink(str(tmp_path / "out"))
    run(source(), sink, tmp_path / "cp")
    assert ids(sink.read(spark)) == ids(events)
    # Restarting from the checkpoint, or without one, adds nothing and replaces no progress.
    run(source(), sink, tmp_path / "cp")
    assert sink.read_progress(spark).count() == 4
    run(source(), sink, tmp_path / "cp2")
    assert ids(sink.read(spark)) == ids(events)
    assert sink.read_progress(spark).count() == 8


def test_rows_without_keys_are_quarantined(spark, tmp_path):
    schema = frames(spark)[0].schema
    nullable = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
    bad = [tuple(event(None, "MARK", "P1", ago(minutes=1))) for _ in range(3)]
    bad += [tuple(event("x", None, "P1", ago(minutes=1))), tuple(event("y", "MARK", "P1", None))]
    good = tuple(event("z", "MARK", "P1", ago(minutes=1), new_mark="1.0000"))
    sink = EventSink(str(tmp_path / "out"))
    for batch_id in range(2):
        sink(spark.createDataFrame([*bad, good], nullable), batch_id)
    assert ids(sink.read(spark)) == ["z"]
    rows = spark.read.parquet(sink.quarantine)
    assert rows.count() == 10
    assert {r[0] for r in rows.select(F.explode("reasons")).collect()} == {
        "missing event_id", "missing event_type", "missing event_ts"
    }


def test_one_id_on_two_days_is_one_event_however_batched(spark, tmp_path):
    schema = frames(spark)[0].schema
    first = tuple(event("a", "MARK", "P1", ago(hours=30), new_mark="1.0000"))
    again = tuple(event("a", "MARK", "P1", ago(hours=1), new_mark="2.0000"))
    together, apart = EventSink(str(tmp_path / "one")), EventSink(str(tmp_path / "two"))
    together(spark.createDataFrame([again, first], schema), 0)
    apart(spark.createDataFrame([first], schema), 0)
    apart(spark.createDataFrame([again], schema), 1)
    for sink in (together, apart):
        assert [(r.event_id, r.new_mark) for r in sink.read(spark).collect()] == [("a", Decimal("1.0000"))]


def test_only_a_missing_table_counts_as_missing(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    assert read_if_there(spark, str(tmp_path / "none"), "a int") is None
    with pytest.raises(Exception):
        read_if_there(spark, str(tmp_path / "broken"), "a int").collect()


def test_changes_are_compacted(spark, tmp_path):
    sink = ChangeSink(str(tmp_path / "changes"), ["k"], compact=3)
    for batch_id in range(8):
        sink(spark.createDataFrame([(batch_id % 2, batch_id), (9, batch_id)], "k int, v int"), batch_id)
    assert sorted(map(tuple, sink.read(spark).collect())) == [(0, 6), (1, 7), (9, 7)]
    # Bases hold what came before; a reader needs no older change.
    assert {r.upto for r in spark.read.parquet(f"{sink.path}/base").select("upto").distinct().collect()} == {2, 5}


def test_a_batch_may_run_twice(spark, tmp_path):
    events, _ = frames(spark)
    sink = EventSink(str(tmp_path / "out"))
    for _ in range(2):
        sink(events, 0)
    assert ids(sink.read(spark)) == ids(events)
    assert sink.read_progress(spark).agg(F.sum("received")).first()[0] == events.count()


def test_late_and_unknown_rows_are_kept(spark, tmp_path):
    events, _ = frames(spark)
    sink = EventSink(str(tmp_path / "out"), lateness=timedelta(minutes=10))
    first = spark.createDataFrame([
        tuple(event("a", "MARK", "P1", ago(hours=1), new_mark="1.0000")),
        tuple(event("b", "QUOTE", "P1", ago(minutes=1))),
    ], events.schema)
    second = spark.createDataFrame([
        tuple(event("c", "MARK", "P1", ago(hours=1, minutes=10), new_mark="1.0000")),
        tuple(event("d", "MARK", "P1", ago(hours=1, minutes=11), new_mark="1.0000")),
        tuple(event("e", "MARK", "P1", ago(minutes=30), new_mark="1.0000")),
    ], events.schema)
    third = spark.createDataFrame([
        tuple(event("f", "MARK", "P1", ago(minutes=41), new_mark="1.0000")),
    ], events.schema)
    for batch_id, batch in enumerate((first, second, third)):
        sink(batch, batch_id)
    late = {r.event_id: r.late for r in sink.read(spark).collect()}
    assert late == {"a": False, "c": False, "d": True, "e": False, "f": True}
    assert ids(spark.read.parquet(sink.quarantine)) == ["b"]
    assert sink.read_progress(spark).agg(F.sum("quarantined")).first()[0] == 1


def test_latest_state_equals_batch(spark, source, tmp_path):
    events, _ = frames(spark)
    sink = ChangeSink(str(tmp_path / "changes"), ["position_id"])
    deduped = source().dropDuplicates(["event_id"])
    run(streams.latest_state(deduped), sink, tmp_path / "cp", "update")
    batch = position_state(events, CLOCK, hours=1e6)
    assert sorted(map(str, sink.read(spark).select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_hourly_trades_equal_batch(spark, source, tmp_path):
    events, _ = frames(spark)
    sink = ChangeSink(str(tmp_path / "changes"), ["hour"])
    run(streams.hourly_trades(source().dropDuplicates(["event_id"])), sink, tmp_path / "cp", "update")
    batch = desk.hourly_trades(events, CLOCK, hours=1e5)
    assert sorted(map(tuple, sink.read(spark).collect())) == sorted(map(tuple, batch.collect()))


def test_windows(spark, tmp_path, source):
    sink = ChangeSink(str(tmp_path / "changes"), ["window_start"])
    stream = streams.throughput(source().dropDuplicates(["event_id"]))
    run(stream, sink, tmp_path / "cp", "update")
    windows = {r.window_start: r.n for r in sink.read(spark).collect()}
    assert windows[ago(minutes=5)] == 3
    tumbling = ChangeSink(str(tmp_path / "latency"), ["window_start"])
    run(streams.latency(source()), tumbling, tmp_path / "cp2", "update")
    assert {r.p95_ms for r in tumbling.read(spark).collect()} == {0}


def test_enriched_stream_equals_batch(spark, source, tmp_path):
    events, positions = frames(spark)
    stream = desk.enrich(source().where(desk.not_warmup()), positions)
    query = streams.start_append(stream, str(tmp_path / "rows"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "rows")).dropDuplicates(["event_id"])
    assert ids(got) == ids(events.where(desk.not_warmup()))
    health = streams.health_points(query, "tape", spark)
    assert health.where("metric = 'input_rows'").agg(F.sum("value")).first()[0] == 23


def test_all_progress_is_logged(spark, source, tmp_path):
    log = streams.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        run(source(), EventSink(str(tmp_path / "out")), tmp_path / "cp")
        for _ in range(60):  # updates come in a thread of their own
            found = read_if_there(spark, log.path, streams.POINTS)
            if found is not None and found.where("metric = 'input_rows'").agg(F.sum("value")).first()[0] == 23:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    assert log.read().where("metric = 'input_rows'").agg(F.sum("value")).first()[0] == 23


def test_state_expires_when_read(spark, source, tmp_path):
    sink = ChangeSink(str(tmp_path / "changes"), ["position_id"])
    run(streams.latest_state(source().dropDuplicates(["event_id"])), sink, tmp_path / "cp", "update")
    state = sink.read(spark)
    now = streams.live_state(state, CLOCK)
    assert now.where("mark is not null").count() > 0
    assert now.where(F.col("mark.event_ts") < F.lit(ago(hours=24))).count() == 0
    assert streams.live_state(state, type(CLOCK).fixed(ago(hours=-48))).count() == 0


def test_snapshot_refresh_and_expiry(spark, source, tmp_path):
    events, positions = frames(spark)

    def snapshot(stored, clock):
        return portfolio_table(portfolio_live(stored, positions, clock), clock)

    store = EventSink(str(tmp_path / "out"))
    sink = SnapshotSink(str(tmp_path / "portfolio"), store, lambda stored, _: snapshot(stored, CLOCK))
    run(source(), sink, tmp_path / "cp")
    expected = portfolio_table(portfolio_live(events, positions, CLOCK), CLOCK)
    assert sorted(map(tuple, sink.read(spark).select(expected.columns).collect())) == sorted(
        map(tuple, expected.collect())
    )
    # No new event, a later clock: marks fall back to the baseline.
    later = SnapshotSink(sink.path, store, snapshot)
    later.refresh(spark, "later", type(CLOCK).fixed(ago(hours=-25)))
    assert {r.latest_mark for r in later.read(spark).where("position_id = 'P2'").collect()} == {Decimal("100.0000")}


def test_event_table_layout(spark, tmp_path):
    events, positions = frames(spark)
    path = str(tmp_path / "events")
    tables.write_events(events.withColumn("payload", F.try_parse_json(F.lit('{"a":1}'))), path)
    back = tables.read_events(spark, path)
    assert ids(back) == ids(events)
    assert back.select(F.variant_get("payload", "$.a", "int")).distinct().first()[0] == 1
    plan = portfolio_live(back, positions, CLOCK)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(event_ts" in plan
    assert tables.find_event(back, "e13").count() == 1 and tables.find_event(back, "zz").count() == 0

    clustered = str(tmp_path / "clustered")
    tables.write_clustered(positions, clustered, ["sector", "issuer"])
    rows = spark.read.schema(positions.schema).parquet(clustered)
    ranges = rows.groupBy(F.input_file_name().alias("f")).agg(F.min("sector").alias("lo"), F.max("sector").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in ranges.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))

    flat = str(tmp_path / "csv")
    positions.write.option("header", True).csv(flat)
    assert sorted(map(tuple, tables.read_positions_csv(spark, flat).collect())) == sorted(map(tuple, positions.collect()))


def test_requests_of_one_row_group_are_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    from bookpulse.streaming import jobs
    from bookpulse.streaming.sinks import RequestSink

    rows = spark.range(500).selectExpr(
        "id AS event_id", "make_timestamp_ntz(2024, 1, 1, 0, 0, 0) AS ts", "id % 7 AS user_id",
        "element_at(array('view', 'click', 'purchase', 'signup', 'error'), int(id % 5) + 1) AS event_type",
        "double(id) AS value", """concat('{"k": ', id % 100, '}') AS props""",
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sizes, stored = [], RequestSink.__call__

    def seen(self, batch, batch_id):
        sizes.append([r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect()])
        stored(self, batch, batch_id)

    monkeypatch.setattr(RequestSink, "__call__", seen)
    got = {r.body_id for r in jobs.run_quarantine(spark, str(tmp_path)).collect()}
    assert got == {k for k in range(500) if k % 5 in (0, 3)}
    assert len(sizes) == 1 and len(sizes[0]) == 4 and sum(sizes[0]) == 500
