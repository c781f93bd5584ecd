"""Tables kept by change: the snapshot, its expiry, the offset ledger; sketches and observed metrics."""

import json
import random
import re
from collections import Counter
from datetime import timedelta
from decimal import Decimal

import pytest
from fixtures import NOW, ago, event, frames
from pyspark.sql import functions as F

from bookpulse.functions.time import Clock
from bookpulse.operators import chat, ingest, sketches
from bookpulse.operators.snapshot import portfolio_live, portfolio_table
from bookpulse.streaming import streams
from bookpulse.streaming.keyed import KeyedTable, LiveSnapshot, OffsetLedger, chained
from bookpulse.streaming.sinks import EventSink, SketchSink


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(events, positions, clock):
    return rows_of(portfolio_table(portfolio_live(events, positions, clock), clock))


def test_changes_over_a_base(spark, tmp_path):
    table = KeyedTable(str(tmp_path), "k", "k long, v string", folders=4, compact=3)
    want, rng = {}, random.Random(1)
    for seq in range(8):
        touched = {k: None if rng.random() < 0.2 else f"{seq}-{k}" for k in rng.sample(range(30), 9)}
        df = spark.createDataFrame([(k, v, v is None) for k, v in touched.items()], "k long, v string, gone boolean")
        table.change(df, seq)
        if seq == 5:  # the same change again
            table.change(df, seq)
        want = {k: v for k, v in {**want, **touched}.items() if v is not None}
        assert {r.k: r.v for r in table.read(spark).collect()} == want
    before = {r.k: r.v for r in table.read(spark, 7).collect()}
    assert before != want
    keys = spark.createDataFrame([(3,), (7,), (999,)], "k long")
    found = table.lookup(keys)
    assert {r.k: r.v for r in found.collect()} == {k: want[k] for k in (3, 7) if k in want}
    assert 1 <= folders_read(found) <= 3


def folders_read(df):
    """How many base folders the filter on the folder column, which prunes them, leaves."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    several = re.search(r"folder#\d+ (?:IN|INSET) \(?([\d,\s]+)", plan)
    return len(several[1].split(",")) if several else len(set(re.findall(r"folder#\d+ = (\d+)", plan)))


def test_snapshot_equals_the_batch_form_after_every_batch(spark, tmp_path):
    events, positions = frames(spark)
    rows = events.orderBy(F.rand(7)).collect()
    live = LiveSnapshot(str(tmp_path), positions, events.schema, compact=3)
    seen = []
    for k, part in enumerate((rows[:5], rows[5:6], rows[6:12], rows[12:])):
        batch = spark.createDataFrame(part, events.schema)
        seen += part
        live(batch, k)
        so_far = spark.createDataFrame(seen, events.schema)
        now = so_far.agg(F.max("event_ts")).first()[0]
        assert rows_of(live.read(spark)) == expected(so_far, positions, Clock.fixed(now))
        live(batch, k)  # a batch that runs again
        assert rows_of(live.read(spark)) == expected(so_far, positions, Clock.fixed(now))
    live(batch.limit(0), 9)
    assert rows_of(live.read(spark)) == expected(so_far, positions, Clock.fixed(now))


def test_a_mark_expires_without_an_event(spark, tmp_path):
    events, positions = frames(spark)
    live = LiveSnapshot(str(tmp_path), positions, events.schema)
    live.refresh(events, "all")
    for k, hours in enumerate((0.5, 19, 21, 22.5, 23.9, 25)):
        clock = NOW + timedelta(hours=hours)
        live.refresh(events.limit(0), f"clock {hours}", clock)
        assert rows_of(live.read(spark)) == expected(events, positions, Clock.fixed(clock))
        touched = {r.position_id for r in live.rows.changed(spark, k + 1).select("position_id").collect()}
        if hours == 0.5:
            assert touched == {"P4", "P5"}  # their marks turned a day old
        if hours == 19:
            assert touched == set()
    assert live.state.read(spark).count() == 0


def test_a_small_batch_writes_few_rows(spark, tmp_path):
    events, _ = frames(spark)
    _, positions = frames(spark)
    many = positions.limit(1).withColumn("position_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("Q"), i.cast("string")))))
    marks = [event(f"m{k}", "MARK", f"Q{k}", ago(minutes=k % 60), new_mark="99.0000") for k in range(1, 2001)]
    live = LiveSnapshot(str(tmp_path), many, events.schema, compact=1)
    live.refresh(spark.createDataFrame(marks, events.schema), "first")
    one = spark.createDataFrame([event("n", "MARK", "Q7", NOW, new_mark="98.0000")], events.schema)
    live.refresh(one, "second")
    assert live.rows.changed(spark, 1).count() == 1 and live.state.changed(spark, 1).count() == 1
    assert folders_read(live.state.lookup(one.select("position_id"), 1)) == 1  # of 64
    assert live.read(spark).where("position_id = 'Q7'").first().latest_mark == Decimal("98.0000")


def test_offsets_over_batches(spark, tmp_path):
    events, _ = frames(spark)
    rows = events.orderBy("event_ts", "event_id").collect()
    ledger = OffsetLedger(str(tmp_path), events.schema, compact=2)
    for k, part in enumerate((rows[:7], rows[7:], rows[2:4])):  # the last is delivered late
        batch = spark.createDataFrame(part, events.schema)
        ledger(batch, k)
        ledger(batch, k)
    got = {r.position_id: (r.rows, r.end_offset, r.behind) for r in ledger.read(spark).collect()}
    again = Counter(r.position_id for r in rows[2:4])
    want = {r.position_id: (r.rows + again[r.position_id], r.end_offset, again[r.position_id]) for r in ingest.end_offsets(events).collect() if r.position_id}
    assert got == want


def test_sinks_in_one_stream(spark, tmp_path):
    events, positions = frames(spark)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    live, ledger = LiveSnapshot(str(tmp_path / "live"), positions, events.schema), OffsetLedger(str(tmp_path / "offsets"), events.schema)
    watched = streams.observed(stream, F.array(), F.col("event_type") == "CREDIT_EVENT")
    sink = EventSink(str(tmp_path / "events"))
    query = streams.start(watched, chained(sink, live, ledger), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sink.read(spark).count() == events.count() and ledger.read(spark).count() == 6
    values = {r.metric: r.value for r in streams.health_points(query, "q", spark).where("metric like 'ingest.%'").collect()}
    assert values["ingest.rows"] == events.count() and values["ingest.errors"] == 3 and values["ingest.lag_ms"] == 0


def test_sketched_windows_near_the_exact(spark, tmp_path):
    rng = random.Random(2)
    rows = [(NOW + timedelta(seconds=rng.random() * 600), rng.choice([rng.randint(0, 50), rng.randint(0, 90_000)])) for _ in range(20_000)]
    events = spark.createDataFrame([(t, t + timedelta(milliseconds=ms)) for t, ms in rows], "event_ts timestamp_ntz, ingested_ts timestamp_ntz")
    sink = SketchSink(str(tmp_path))
    for k, part in enumerate(events.randomSplit([0.3, 0.3, 0.4], 5)):
        part = part.persist()
        sink(part, k)
        sink(part, k)  # runs again
    stored = sink.read(spark)
    found = sketches.rank_errors(sketches.percentiles(sketches.sliding(stored)), events).collect()
    assert len(found) == 14 and sum(r.n for r in found) == 5 * len(rows)
    assert max(max(r.p50_error, r.p95_error, r.p99_error) for r in found) <= sketches.RANK_ERROR
    tile = sketches.trailing(stored, Clock.fixed(NOW + timedelta(minutes=5, seconds=30)).now()).first()
    assert tile.n == sum(60 <= (t - NOW).total_seconds() < 360 for t, _ in rows)


def test_parts_make_the_message_array(spark):
    turns = [(1, 2, "user", 'say "hi"'), (1, 1, "system", ""), (1, 10, "assistant", "hi\n"), (2, 1, "user", None), (2, 1, "user", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    parts = sorted((r.conv_id, r.position, r.part) for r in chat.history_parts(df).collect())
    whole = {c: json.loads("".join(p for conv, _, p in parts if conv == c)) for c in (1, 2)}
    assert [m["role"] for m in whole[1]] == ["system", "user", "assistant"] and len(whole[2]) == 2
    assert whole[1][1]["content"] == [{"type": "text", "text": 'say "hi"'}]


@pytest.mark.parametrize("body, reason", [
    ('[{"event_type": 5}]', "event_type is not a string"),
    ('[{"event_type": "MARK", "new_mark": "x"}]', "new_mark is not a number"),
    ('[{"event_type": "MARK", "new_mark": 1e300}]', "new_mark is out of range"),
])
def test_types_of_requests(spark, body, reason):
    checked = ingest.validate(ingest.explode_batches(spark.createDataFrame([(1, body)], "body_id long, body string")))
    assert reason in checked.first().reasons


def test_a_request_is_parsed_once_for_values_and_once_for_types(spark):
    bodies = spark.createDataFrame([(1, '[{"event_type": "MARK", "new_mark": 1}]')], "body_id long, body string")
    good = ingest.accepted(ingest.validate(ingest.explode_batches(bodies)))
    plan = ingest.normalise(good, F.current_timestamp().cast("timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 3
