import json
from collections import Counter
from datetime import datetime
from decimal import Decimal

from fixtures import frames
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookpulse import schemas as S
from bookpulse.functions import ratings, text
from bookpulse.operators import ingest, profile, quality, upsert

STAMP = datetime(2026, 5, 13, 12, 0)


def requests(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return ingest.explode_batches(spark.createDataFrame(rows, "body_id int, body string"))


def test_batch_bodies(spark):
    rows = requests(
        spark,
        [{"event_type": "TRADE", "position_id": "P1"}, {"event_type": "MARK", "position_id": "P2"}],
        {"event_type": "TRADE"},
        "not json",
        [],
    ).collect()
    assert [(r.body_id, r.seq, r.event_type) for r in rows] == [
        (0, 0, "TRADE"), (0, 1, "MARK"), (1, None, None), (2, None, None), (3, None, None),
    ]


def test_validation_splits_everything(spark):
    df = requests(
        spark,
        [{"event_type": "TRADE"}, {"event_type": "QUOTE"}, {"position_id": "P1"},
         {"event_type": "TRADES"}, {"event_type": "MARK", "payload": "[1]"},
         {"event_type": "MARK", "payload": '{"a": 1}'}],
    )
    checked = ingest.validate(df)
    good, bad = ingest.accepted(checked), ingest.quarantined(checked)
    assert [r.seq for r in good.collect()] == [0, 5]
    assert {r.seq: r.reasons for r in bad.collect()} == {
        1: ["unknown event_type"], 2: ["missing event_type"], 3: ["unknown event_type"],
        4: ["payload is not an object"],
    }


def test_wrong_types_and_ranges_are_quarantined(spark):
    df = requests(
        spark,
        [{"event_type": "TRADE", "qty": "abc"}, {"event_type": "MARK", "new_mark": "x"},
         {"event_type": "TRADE\n"}, {"event_type": "TRADE", "qty": 1e30}, {"event_type": "TRADE", "side": 5},
         {"event_type": "TRADE", "qty": None, "price": 3}],
    )
    checked = ingest.validate(df)
    assert {r.seq: r.reasons for r in ingest.quarantined(checked).collect()} == {
        0: ["qty is not a number"], 1: ["new_mark is not a number"], 2: ["unknown event_type"],
        3: ["qty is out of range"], 4: ["side is not a string"],
    }
    assert [r.seq for r in ingest.accepted(checked).collect()] == [5]
    rows = ingest.normalise(df, F.lit(STAMP).cast("timestamp_ntz"))
    assert rows.where("event_type = 'TRADE'").count() == 4  # nothing stops the job


def test_ids_are_full_digests(spark):
    one = requests(spark, [{"event_type": "TRADE"}, {"event_type": "TRADE"}])
    rows = ingest.normalise(one, F.lit(STAMP).cast("timestamp_ntz")).select("event_id").collect()
    assert len({r[0] for r in rows}) == 2 and all(len(r[0]) == 64 for r in rows)


def test_upsert_takes_one_row_per_key(spark):
    target = spark.createDataFrame([("a", "old", None)], "key string, value string, updated timestamp_ntz")
    source = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "key string, value string")
    got = upsert.merge_upsert(target, source, "key", F.lit(STAMP).cast("timestamp_ntz"))
    assert sorted((r.key, r.value) for r in got.collect()) == [("a", "y"), ("b", "z")]


def test_normalise_masks_rounds_and_fills(spark):
    df = requests(
        spark,
        [{"event_type": "TRADE", "position_id": "P1", "qty": 10.005, "price": 99.99995, "new_mark": 5},
         {"event_type": "MARK", "new_mark": 98.25, "side": "BUY", "payload": '{"desk": "x"}'},
         {"event_type": "CREDIT_EVENT", "from_rating": "B+"},
         {"event_type": "CREDIT_EVENT", "from_rating": "D"},
         {"event_type": "CREDIT_EVENT", "from_rating": "B", "to_rating": "AAA"}],
    )
    out = ingest.normalise(df, F.lit(STAMP).cast("timestamp_ntz"))
    assert out.columns == S.EVENT_SCHEMA.fieldNames()
    assert [f.dataType for f in out.schema] == [f.dataType for f in S.EVENT_SCHEMA]
    rows = out.withColumn("payload", F.to_json("payload")).collect()
    assert rows[0].qty == Decimal("10.01") and rows[0].price == Decimal("100.0000")
    assert rows[0].new_mark is None and rows[1].side is None
    assert rows[1].payload == '{"desk":"x"}' and rows[0].payload is None
    assert [r.to_rating for r in rows[2:]] == ["B", "D", "AAA"]
    assert rows[0].event_ts == STAMP and rows[0].source_app == "app"
    again = ingest.normalise(df, F.lit(STAMP).cast("timestamp_ntz")).collect()
    assert [r.event_id for r in again] == [r.event_id for r in rows]
    assert len({r.event_id for r in rows}) == 5 and all(len(r.event_id) == 64 for r in rows)


def fold(key: str, n: int) -> int:
    h = 0
    for c in key:
        h = h * 31 + ord(c)
    return h % n


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="ascii", min_codepoint=33), max_size=12), min_size=1))
def test_channel_hash(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.select(text.channel_of(F.col("k"), 4)).collect()]
    assert got == [fold(k, 4) for k in keys]


def test_channels_of_ids_are_even(spark):
    ids = spark.range(1, 63).select(F.format_string("POS-%04d", "id").alias("position_id"))
    counts = {r.channel: r.events for r in ingest.channel_counts(ids).collect()}
    assert sorted(counts.values()) == [15, 15, 16, 16]
    assert counts == Counter(fold(f"POS-{i:04d}", 4) for i in range(1, 63))


def test_offsets_and_order(spark):
    events, _ = frames(spark)
    rows = {r.position_id: (r.rows, r.end_offset) for r in ingest.end_offsets(events).collect()}
    assert rows["P1"] == (6, "e16") and rows[None] == (1, "e14")
    ordered = ingest.in_key_order(events.repartition(4))
    parts = ordered.select(F.spark_partition_id().alias("p"), "position_id", "event_ts").collect()
    assert len(parts) == events.count()
    seen = [(r.position_id or "", r.event_ts) for r in sorted(parts, key=lambda r: r.p)]
    assert seen == sorted(seen)


def test_recoverable_errors(spark):
    df = spark.createDataFrame(
        [("Token has expired",), ("INVALID STATE",), ("xInvalidChannelErrorx",), ("Unauthorized",), ("reset",), (None,)],
        "e string",
    )
    flags = [r[0] for r in df.select(text.is_recoverable(F.col("e"))).collect()]
    assert flags == [True] * 4 + [False] * 2


def test_ladder(spark):
    df = spark.createDataFrame([("AAA",), ("D",), ("NR",), ("B+",), (None,)], "r string")
    r = F.col("r")
    rows = df.select(ratings.ordinal(r), ratings.notch(r, 1), ratings.notch(r, -1)).collect()
    assert [tuple(x) for x in rows] == [
        (1, "AA+", "AAA"), (22, "D", "C"), (None, None, None), (14, "B", "BB-"), (None, None, None),
    ]


def config(spark, *rows):
    return spark.createDataFrame(rows, S.CONFIG_SCHEMA)


def test_upserts(spark):
    old, new = datetime(2026, 1, 1), F.lit(STAMP).cast("timestamp_ntz")
    target = config(spark, ("a", "1", old), ("b", "2", old))
    source = spark.createDataFrame([("b", None), ("c", "3")], "key string, value string")
    once = upsert.merge_upsert(target, source, "key", new)
    assert sorted(map(tuple, once.collect())) == [("a", "1", old), ("b", None, STAMP), ("c", "3", STAMP)]
    twice = upsert.merge_upsert(once, source, "key", new)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))

    seed = config(spark, ("b", "9", old), ("d", "4", old), ("d", "5", old))
    added = upsert.merge_insert_only(target, seed, "key")
    assert sorted((r.key, r.value) for r in added.collect()) == [("a", "1"), ("b", "2"), ("d", "5")]
    assert upsert.merge_insert_only(added, seed, "key").count() == 3

    changed = upsert.update_where(once, F.col("value") == "1", {"value": F.lit("x"), "updated": new})
    assert sorted((r.key, r.value) for r in changed.collect()) == [("a", "x"), ("b", None), ("c", "3")]


def test_quality_report(spark):
    events, positions = frames(spark)
    twice = events.unionByName(events.where("event_id = 'e01'"))
    found = {r.check_name: r.failures for r in quality.dq_report(twice, positions).collect()}
    broken = {k: v for k, v in found.items() if v}
    assert broken == {"not_null:position_id": 1, "unique:event_id": 1, "reference:position_id": 1}


def test_profile(spark):
    events, _ = frames(spark)
    rows = profile.sample_values(events, ["event_type", "side"], 2).orderBy("column_name", "rank").collect()
    assert [(r.column_name, r.value, r["count"]) for r in rows] == [
        ("event_type", "MARK", 8), ("event_type", "TRADE", 4), ("side", "BUY", 3), ("side", "SELL", 1),
    ]
    summary = {r.column_name: r for r in profile.column_summary(events, ["side", "position_id"]).collect()}
    assert summary["side"].nulls == 12 and summary["position_id"].max_value == "P9"
