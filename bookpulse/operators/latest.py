"""Latest row per key, and the newest rows per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.operators.joins import join_groups

NEWEST = ("event_ts", "event_id")


def latest_by(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    order: tuple[str, ...] = NEWEST,
    where: Column | None = None,
) -> DataFrame:
    """The newest row of every key.

    ``max_by`` merges on the map side, so a key that holds much of the table costs one row per
    task in the shuffle. It also runs unchanged on streams, where row numbers are refused.
    """
    if where is not None:
        df = df.where(where)
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[f"_newest.{c}" for c in columns])


def retain_newest(
    df: DataFrame, keys: list[str], n: int, order: tuple[str, ...] = NEWEST
) -> DataFrame:
    """The newest n rows of every series, numbered oldest first in ``seq``; order starts with a time.

    Rows are counted per series and day first, which tells the day on which a series' last n rows
    begin. Only rows from that day on are ranked, so the task of a hot series gets no more than n
    rows from each of the tasks that read those days: Catalyst turns the rank filter into a group
    limit before the exchange.
    """
    day = F.coalesce(F.to_date(order[0]), F.lit("0001-01-01").cast("date"))
    per_day = df.groupBy(*keys, day.alias("_day")).agg(F.count("*").alias("_rows"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    needed = per_day.withColumn("_later", F.coalesce(F.sum("_rows").over(later), F.lit(0))).where(F.col("_later") < n)
    first_day = needed.groupBy(*keys).agg(F.min("_day").alias("_first_day"))
    df = join_groups(df, first_day, keys).where(day >= F.col("_first_day")).drop("_first_day")
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    oldest_first = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= n)
    return kept.drop("_rank").withColumn("seq", F.row_number().over(oldest_first))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Ordered limit; each task keeps n rows."""
    return df.orderBy(*order).limit(n)


def pick_random(df: DataFrame, key: str, n: int = 1, seed: int = 0) -> DataFrame:
    """A seeded sample of n rows, the same on every run and retry."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("draw", draw).orderBy("draw", key).limit(n)


def numbered(df: DataFrame, keys: list[str], order: tuple[str, ...] = NEWEST) -> DataFrame:
    """Every row with ``seq``, its place in its series, oldest first; order starts with a time.

    Rows are numbered within a day, and each day begins after the rows of the days before, so a
    series that holds much of the table is ranked a day at a time by as many tasks.
    """
    dated = df.withColumn("_day", F.col(order[0]).cast("date"))
    days = dated.groupBy(*keys, "_day").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(*keys, "_day", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order))
    found = join_groups(dated.withColumn("_place", place), starts, [*keys, "_day"])
    return found.withColumn("seq", F.col("_start") + F.col("_place")).drop("_day", "_start", "_place")
