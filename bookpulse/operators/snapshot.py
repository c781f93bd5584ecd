"""Portfolio snapshots: the state of every position over the trailing day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas as S
from bookpulse.functions import money
from bookpulse.functions.time import Clock, since

_STATE = {
    "mark": (S.MARK, ["event_ts", "new_mark"]),
    "rating": (S.CREDIT_EVENT, ["event_ts", "to_rating"]),
    "trade": (S.TRADE, ["event_ts", "side", "qty", "price", "counterparty"]),
}


def state_aggregates() -> list[Column]:
    """The states as aggregates of one grouping.

    The type filter sits in the ordering key: rows of another type have a NULL key and never win.
    """
    when = F.struct("event_ts", "event_id")

    def newest(event_type: str, columns: list[str]) -> Column:
        return F.max_by(F.struct(*columns), F.when(F.col("event_type") == event_type, when))

    return [
        *[newest(kind, columns).alias(name) for name, (kind, columns) in _STATE.items()],
        F.count("*").alias("n"),
        F.max("event_ts").alias("latest_event_ts"),
    ]


def position_state(
    events: DataFrame, clock: Clock, hours: float = 24, exclude_system: bool = False
) -> DataFrame:
    """Latest mark, rating and trade with event count and time, one row per position.

    All of it comes out of one scan and one shuffle of one row per position and task.
    """
    rows = since(events, clock, hours=hours).where(F.col("position_id").isNotNull())
    if exclude_system:
        rows = rows.where(F.col("event_type") != S.WARMUP)
    return rows.groupBy("position_id").agg(*state_aggregates())


def portfolio_live(
    events: DataFrame,
    positions: DataFrame,
    clock: Clock,
    hours: float = 24,
    exclude_system: bool = False,
) -> DataFrame:
    """The live view. Every position appears; marks older than the window fall back to baseline."""
    state = position_state(events, clock, hours, exclude_system)
    mark = F.coalesce("mark.new_mark", "baseline_mark")
    return positions.join(state, "position_id", "left").select(
        "position_id",
        "issuer",
        "sector",
        "tranche",
        "par_amount",
        "fund",
        "watchlist",
        mark.alias("current_mark"),
        F.col("baseline_mark").alias("opening_mark"),
        money.mark_change_bps(mark, F.col("baseline_mark")).alias("mark_change_bps"),
        money.pnl(mark, F.col("baseline_mark"), F.col("par_amount")).alias("pnl_today"),
        F.coalesce("rating.to_rating", "current_rating").alias("rating"),
        F.col("trade.side").alias("last_trade_side"),
        F.col("trade.qty").alias("last_trade_qty"),
        F.col("trade.price").alias("last_trade_price"),
        F.col("trade.counterparty").alias("last_trade_cpty"),
        F.col("trade.event_ts").alias("last_trade_ts"),
        "latest_event_ts",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("events_today"),
    )


VIEW_COLUMNS = [
    "position_id", "issuer", "sector", "tranche", "par_amount", "fund", "watchlist",
    "current_mark", "opening_mark", "mark_change_bps", "pnl_today", "rating",
    "last_trade_side", "last_trade_qty", "last_trade_price", "last_trade_cpty",
    "latest_event_ts", "events_today",
]


def portfolio_view(live: DataFrame) -> DataFrame:
    return live.select(*VIEW_COLUMNS)


def portfolio_table(live: DataFrame, clock: Clock) -> DataFrame:
    """The serving-table projection of the live view: rounded P&L, quiet positions stamped now."""
    return live.select(
        "position_id",
        "issuer",
        "sector",
        "tranche",
        "par_amount",
        "fund",
        F.col("current_mark").alias("latest_mark"),
        "mark_change_bps",
        "last_trade_ts",
        "last_trade_side",
        "last_trade_qty",
        "last_trade_price",
        F.col("rating").alias("current_rating"),
        "watchlist",
        F.round("pnl_today", 2).alias("pnl_today"),
        F.coalesce("latest_event_ts", clock.now()).alias("latest_event_ts"),
    )
