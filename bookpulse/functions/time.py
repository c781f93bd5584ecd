"""Time helpers: an explicit clock, elapsed milliseconds, bins."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Clock:
    """The "as of" moment of a query.

    A fixed clock turns every bound into a literal, so bounds reach the file scan and prune
    partitions at planning time. A clock read off a table is a scalar subquery: each bound is
    computed inside it, so the scan compares a bare column with one value.
    """

    def __init__(self, at: datetime | None = None, latest: tuple[DataFrame, str] | None = None):
        self._at, self._latest = at, latest

    @classmethod
    def fixed(cls, at: datetime) -> Clock:
        if at.tzinfo is not None:
            at = at.astimezone(timezone.utc).replace(tzinfo=None)
        return cls(at=at)

    @classmethod
    def wall(cls) -> Clock:
        return cls.fixed(datetime.now(timezone.utc))

    @classmethod
    def latest(cls, events: DataFrame, ts: str = "event_ts") -> Clock:
        return cls(latest=(events, ts))

    def fixed_at(self) -> datetime | None:
        """The moment of a fixed clock."""
        return self._at

    def ago(self, **span: float) -> Column:
        """The moment ``timedelta(**span)`` before now."""
        delta = timedelta(**span)
        if self._at is not None:
            return F.lit(self._at - delta).cast("timestamp_ntz")
        events, ts = self._latest
        bound = F.max(ts).cast("timestamp_ntz") - F.lit(delta)
        return events.agg(bound.alias("bound")).scalar()

    def now(self) -> Column:
        return self.ago()


def since(df: DataFrame, clock: Clock, ts: str = "event_ts", **span: float) -> DataFrame:
    """Rows of the trailing window, both bounds included: a past moment sees nothing after it.

    On tables partitioned by ``event_date`` the bounds also prune folders.
    """
    first, last = clock.ago(**span), clock.now()
    df = df.where((F.col(ts) >= first) & (F.col(ts) <= last))
    if "event_date" in df.columns and ts == "event_ts":
        day = F.col("event_date")
        df = df.where((day >= first.cast("date")) & (day <= last.cast("date")))
    return df


def millis_between(start: Column, end: Column) -> Column:
    """Millisecond boundaries crossed from start to end."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed from start to end."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def bin_start(ts: Column, step_seconds: int) -> Column:
    """Start of the bin of the given width, counted from the epoch."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(step_seconds))).cast("timestamp_ntz")
