"""A small hand-written book with the cases that matter."""

from datetime import datetime, timedelta
from decimal import Decimal

from bookpulse import schemas as S
from bookpulse.functions.time import Clock

NOW = datetime(2026, 5, 13, 12, 0, 0)
CLOCK = Clock.fixed(NOW)


def ago(**span) -> datetime:
    return NOW - timedelta(**span)


def position(pid, issuer, sector, par, rating="B", watchlist=False, baseline="100.0000", fund="Fund A"):
    return (
        pid, issuer, sector, "1L", Decimal(par), Decimal("500.0"), 2024, fund, watchlist, rating,
        Decimal(baseline),
    )


POSITIONS = [
    # The first is a published worked example.
    position("P1", "Mirabel Clinics", "Health", "42292121.76", baseline="99.8696"),
    position("P2", "Mirabel Clinics", "Health", "1000000.00", watchlist=True, fund="Fund B"),
    position("P3", "Halden Freight Lines", "Energy", "2000000.00", rating="NR", watchlist=True),
    position("P4", "Halden Glassworks", "Industrials", "3000000.00"),
    position("P5", "Halden Savings Bank", "Finance", "4000000.00"),
]


def event(eid, kind, pid, ts, **values):
    row = {f.name: None for f in S.EVENT_SCHEMA if f.name != "payload"}
    row.update(event_id=eid, event_ts=ts, ingested_ts=ts, event_type=kind, position_id=pid,
               source_app="app", **values)
    for name in ("qty", "price", "prev_mark", "new_mark"):
        if row[name] is not None:
            row[name] = Decimal(row[name])
    return tuple(row.values())


EVENTS = [
    event("e01", "MARK", "P1", ago(hours=2), new_mark="97.0000"),
    event("e02", "MARK", "P1", ago(hours=1), new_mark="98.2500"),
    # Same time: the greater id wins.
    event("e03", "MARK", "P2", ago(hours=3), new_mark="101.0000"),
    event("e04", "MARK", "P2", ago(hours=3), new_mark="102.0000"),
    # The latest mark is NULL: back to baseline, not to the one before.
    event("e05", "MARK", "P3", ago(hours=5), new_mark="90.0000"),
    event("e06", "MARK", "P3", ago(hours=4)),
    # Exactly one day old counts, a microsecond more does not.
    event("e07", "MARK", "P4", ago(days=1), new_mark="101.5000"),
    event("e08", "MARK", "P5", ago(days=1, microseconds=1), new_mark="50.0000"),
    event("e09", "CREDIT_EVENT", "P2", ago(hours=2), from_rating="B+", to_rating="B"),
    event("e10", "CREDIT_EVENT", "P3", ago(hours=2), from_rating="NR", to_rating="B-"),
    event("e11", "CREDIT_EVENT", "P1", ago(minutes=30), from_rating="B", to_rating="B+"),
    event("e12", "TRADE", "P1", ago(minutes=90), side="BUY", qty="100.00", price="99.0000", counterparty="X"),
    event("e13", "TRADE", "P1", ago(minutes=10), side="SELL", qty="50.00", price="98.0000", counterparty="Y"),
    event("e14", "TRADE", None, ago(minutes=5), side="BUY", qty="1.00", price="1.0000"),
    event("e15", "TRADE", "P9", ago(minutes=4), side="BUY", qty="2.00", price="1.0000"),
    event("e16", "WARMUP", "P1", ago(minutes=1)),
]
EVENTS[-1] = EVENTS[-1][:-1] + ("warmup",)


def frames(spark):
    schema = type(S.EVENT_SCHEMA)([f for f in S.EVENT_SCHEMA if f.name != "payload"])
    return spark.createDataFrame(EVENTS, schema), spark.createDataFrame(POSITIONS, S.POSITION_SCHEMA)
