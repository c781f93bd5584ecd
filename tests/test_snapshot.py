from decimal import Decimal

import pytest
from fixtures import CLOCK, NOW, ago, frames
from pyspark.sql import Window
from pyspark.sql import functions as F

from bookpulse.operators.latest import latest_by, pick_random, retain_newest
from bookpulse.operators.snapshot import portfolio_live, portfolio_table, portfolio_view
from bookpulse.plans import desk, questions


@pytest.fixture(scope="module")
def live(spark):
    events, positions = frames(spark)
    return portfolio_live(events, positions, CLOCK)


@pytest.fixture(scope="module")
def by_position(live):
    return {r.position_id: r for r in live.collect()}


def test_worked_example(by_position):
    row = by_position["P1"]
    assert row.mark_change_bps == Decimal("-161.9600")
    assert row.pnl_today == Decimal("-684963.20402496")


def test_table_rounds_and_stamps(live):
    rows = {r.position_id: r for r in portfolio_table(live, CLOCK).collect()}
    assert rows["P1"].pnl_today == Decimal("-684963.20")
    assert rows["P5"].latest_event_ts == NOW
    assert rows["P1"].last_trade_ts == ago(minutes=10)
    assert "events_today" not in rows["P1"].asDict()


def test_every_position_appears(by_position):
    assert sorted(by_position) == ["P1", "P2", "P3", "P4", "P5"]
    quiet = by_position["P5"]
    assert quiet.events_today == 0 and quiet.latest_event_ts is None
    assert quiet.current_mark == quiet.opening_mark


def test_ties_nulls_and_bounds(by_position):
    assert by_position["P2"].current_mark == Decimal("102.0000")
    assert by_position["P3"].current_mark == Decimal("100.0000")
    assert by_position["P4"].current_mark == Decimal("101.5000")
    assert by_position["P2"].rating == "B" and by_position["P3"].rating == "B-"
    assert by_position["P4"].rating == "B"


def test_last_trade_and_counts(by_position):
    row = by_position["P1"]
    assert (row.last_trade_side, row.last_trade_qty, row.last_trade_cpty) == ("SELL", Decimal("50.00"), "Y")
    assert row.events_today == 6  # warm-up rows count


def test_warmup_can_be_left_out(spark):
    events, positions = frames(spark)
    rows = portfolio_live(events, positions, CLOCK, exclude_system=True).collect()
    assert {r.position_id: r.events_today for r in rows}["P1"] == 5


def test_max_by_equals_row_number(spark):
    events, _ = frames(spark)
    by_rank = Window.partitionBy("position_id", "event_type").orderBy(F.desc("event_ts"), F.desc("event_id"))
    expected = events.withColumn("r", F.row_number().over(by_rank)).where("r = 1")
    got = latest_by(events, ["position_id", "event_type"], ["event_id"])
    columns = ["position_id", "event_type", "event_id"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    shuffled = latest_by(events.orderBy(F.rand(1)), ["position_id", "event_type"], ["event_id"])
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.collect()))


def test_tape_keeps_unknown_positions_and_drops_warmup(spark):
    events, positions = frames(spark)
    rows = desk.tape(events, positions, 5).collect()
    assert [r.event_id for r in rows] == ["e15", "e14", "e13", "e11", "e02"]
    assert rows[0].issuer is None and rows[2].issuer == "Mirabel Clinics"
    assert rows[3].side == "" and rows[3].qty == 0


def test_kpis(live, spark):
    row = desk.pnl_today(live).first()
    assert (row.position_count, row.gainers, row.losers) == (5, 2, 1)
    assert row.total_pnl == pytest.approx(-684963.20 + 20000 + 45000, abs=0.01)
    empty = desk.pnl_today(live.limit(0)).first()
    assert empty.position_count == 0 and empty.total_pnl is None


def test_exposure_adds_up(spark):
    _, positions = frames(spark)
    rows = desk.sector_exposure(positions).collect()
    assert sum(r.pct for r in rows) == pytest.approx(100, abs=0.3)
    assert rows[0].sector == "Health"


def test_watchlist_and_downgrades(live, spark):
    events, positions = frames(spark)
    assert [r.position_id for r in desk.watchlist(live).collect()] == ["P3", "P2"]
    assert desk.watchlist_count(positions).first()[0] == 2
    # NR has no place on the ladder, an upgrade is no downgrade.
    assert [r.event_id for r in questions.downgrades(events, positions).collect()] == ["e09"]
    found = questions.watchlist_downgrades(events, positions).collect()
    assert [(r.position_id, r.downgrades) for r in found] == [("P2", 1)]


def test_top_marks_order(live):
    rows = desk.top_marks(live, 3).collect()
    assert [r.position_id for r in rows] == ["P2", "P1", "P4"]


def test_hourly_and_counts(spark):
    events, _ = frames(spark)
    assert sum(r.trade_count for r in desk.hourly_trades(events, CLOCK).collect()) == 4
    assert desk.event_count(events, CLOCK).first().cnt == 15
    assert desk.throughput(events, CLOCK, 5).first().events_per_min == pytest.approx(0.6)
    assert desk.throughput(events, CLOCK, 0).first().events_per_min == 0.0


def test_issuer_questions(live, spark):
    events, positions = frames(spark)
    row = questions.issuer_exposure(live, positions, "Mirabl Clinix").first()
    assert row.issuer == "Mirabel Clinics" and row.positions == 2
    marks = questions.recent_marks_for_issuer(events, positions, CLOCK, "mirabel")
    assert [r.event_id for r in marks.collect()] == ["e02", "e01", "e04", "e03"]
    latest = {r.issuer: r.new_mark for r in questions.latest_mark_per_issuer(events, positions).collect()}
    assert latest["Mirabel Clinics"] == 98.25


def test_changed_since(spark):
    events, _ = frames(spark)
    rows = {r.position_id: r for r in questions.changed_since(events, CLOCK, 1).collect()}
    assert set(rows) == {"P1", "P9"}
    assert (rows["P1"].events, rows["P1"].marks, rows["P1"].mark_move) == (4, 1, 0.0)


def test_view_columns(live):
    assert portfolio_view(live).columns[0] == "position_id"
    assert "last_trade_ts" not in portfolio_view(live).columns


def test_retain_and_pick(spark):
    events, positions = frames(spark)
    kept = retain_newest(events, ["position_id"], 2).where("position_id = 'P1'").orderBy("seq").collect()
    assert [(r.event_id, r.seq) for r in kept] == [("e13", 1), ("e16", 2)]
    once, again = (pick_random(positions, "position_id", 2, 3).collect() for _ in range(2))
    assert once == again and len(once) == 2
