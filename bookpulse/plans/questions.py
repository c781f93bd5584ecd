"""Named desk questions as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas as S
from bookpulse.functions.money import rounded
from bookpulse.functions.ratings import is_downgrade
from bookpulse.functions.time import Clock, since
from bookpulse.operators.latest import latest_by, top_n
from bookpulse.operators.search import positions_of
from bookpulse.plans.desk import newest_first


def of_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def _pnl_by(live: DataFrame, by: str) -> DataFrame:
    return (
        live.groupBy(by)
        .agg(rounded(F.sum("pnl_today"), 2).alias("pnl"), F.count("*").alias("positions"))
        .orderBy(F.desc("pnl"), by)
    )


def pnl_by_sector(live: DataFrame) -> DataFrame:
    return _pnl_by(live, "sector")


def fund_pnl(live: DataFrame) -> DataFrame:
    return _pnl_by(live, "fund")


def top_sectors_by_par(positions: DataFrame, n: int = 5) -> DataFrame:
    par = positions.groupBy("sector").agg(F.sum("par_amount").alias("par"))
    return top_n(par, n, F.desc("par"), F.col("sector")).select(
        "sector", rounded(F.col("par"), 2).alias("total_par")
    )


def latest_trades(events: DataFrame, positions: DataFrame, n: int = 10) -> DataFrame:
    newest = top_n(of_type(events, S.TRADE), n, *newest_first())
    names = positions.select("position_id", "issuer", "fund")
    named = newest.join(names, "position_id", "left")
    return top_n(named, n, *newest_first()).select(
        "event_id", "event_ts", "position_id", "issuer", "fund", "side",
        F.col("qty").cast("double").alias("qty"),
        F.col("price").cast("double").alias("price"),
        "counterparty",
    )


def downgrades(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Every credit event that moved down the ladder, with its position; also serves streams."""
    moved = of_type(events, S.CREDIT_EVENT).where(
        is_downgrade(F.col("from_rating"), F.col("to_rating"))
    )
    names = positions.select("position_id", "issuer", "fund", "watchlist")
    return moved.select(
        "event_id", "event_ts", "position_id", "from_rating", "to_rating", "agency"
    ).join(names, "position_id", "left")


def watchlist_downgrades(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Watchlisted positions with a downgrade: how many and the latest.

    Downgrades shrink to one row per position before the join.
    """
    moved = of_type(events, S.CREDIT_EVENT).where(
        is_downgrade(F.col("from_rating"), F.col("to_rating"))
    )
    latest = F.max_by(F.struct("event_ts", "from_rating", "to_rating"), F.struct("event_ts", "event_id"))
    per_position = moved.groupBy("position_id").agg(
        F.count("*").alias("downgrades"), latest.alias("last")
    )
    watched = positions.where("watchlist").select("position_id", "issuer")
    return watched.join(per_position, "position_id").select(
        "position_id",
        "issuer",
        "downgrades",
        F.col("last.event_ts").alias("last_ts"),
        F.col("last.from_rating").alias("from_rating"),
        F.col("last.to_rating").alias("to_rating"),
    )


def issuer_exposure(live: DataFrame, positions: DataFrame, term: str) -> DataFrame:
    """Par and P&L of the issuer a fuzzy term names."""
    found = positions_of(positions, term).select("position_id")
    return (
        live.join(found, "position_id", "left_semi")
        .groupBy("issuer")
        .agg(
            rounded(F.sum("par_amount"), 2).alias("total_par"),
            rounded(F.sum("pnl_today"), 2).alias("pnl"),
            F.count("*").alias("positions"),
        )
    )


def recent_marks_for_issuer(
    events: DataFrame, positions: DataFrame, clock: Clock, term: str, hours: float = 24
) -> DataFrame:
    """Marks of the named issuer in the trailing window, newest first."""
    found = positions_of(positions, term).select("position_id", "issuer")
    marks = of_type(since(events, clock, hours=hours), S.MARK)
    return (
        marks.join(found, "position_id")
        .orderBy(*newest_first())
        .select(
            "event_id", "event_ts", "position_id", "issuer",
            F.col("new_mark").cast("double").alias("new_mark"),
        )
    )


def latest_mark_per_issuer(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Latest mark over all positions of each issuer: first per position, then per issuer."""
    marks = latest_by(
        events, ["position_id"], ["event_ts", "event_id", "new_mark"],
        where=F.col("event_type") == S.MARK,
    )
    named = marks.join(positions.select("position_id", "issuer"), "position_id")
    return latest_by(named, ["issuer"], ["position_id", "event_ts", "new_mark"]).select(
        "issuer", "position_id", "event_ts", F.col("new_mark").cast("double").alias("new_mark")
    )


def changed_since(events: DataFrame, clock: Clock, hours: float = 1) -> DataFrame:
    """Per position, events by type and the move between first and last mark in the window."""
    order = F.struct("event_ts", "event_id")

    def kind(event_type: str) -> Column:
        return F.col("event_type") == event_type

    mark_order = F.when(kind(S.MARK), order)
    move = F.max_by("new_mark", mark_order) - F.min_by("new_mark", mark_order)
    return (
        since(events, clock, hours=hours)
        .where(F.col("position_id").isNotNull())
        .groupBy("position_id")
        .agg(
            F.count("*").alias("events"),
            F.count_if(kind(S.TRADE)).alias("trades"),
            F.count_if(kind(S.MARK)).alias("marks"),
            F.count_if(kind(S.CREDIT_EVENT)).alias("credit_events"),
            move.cast("double").alias("mark_move"),
            F.max("event_ts").alias("latest_event_ts"),
        )
    )
