"""Column profiles: sample values, NULLs and extremes; and profiles kept as mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column.

    Values are counted per task before they move, and the ranking keeps k rows per column and
    task, so a column of many distinct values does not pile up anywhere.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    counted = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").count()
    frequent = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")
    return counted.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= k)


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, NULLs, minimum and maximum per column out of one pass."""
    measures = []
    for c in columns:
        text = F.col(c).cast("string")
        measures.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count("*").alias("rows"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.min(text).alias("min_value"),
                F.max(text).alias("max_value"),
            ).alias(c)
        )
    return df.agg(*measures).select(F.inline(F.array(*columns)))


#: Values that a day's sketch of frequent values follows. Counts are exact up to three quarters of
#: them; beyond, a count is off by 3.5 / TRACKED of the rows at most.
TRACKED = 1024


def day_sketches(df: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """(day, column_name, rows, nulls, distinct, frequent) of each day: a few kilobytes a column.

    Values meet in sketches where they are read, so only sketches move, however many values there are.
    """
    long = df.select(day.alias("day"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        ["day"], columns, "column_name", "value"
    )
    return long.groupBy("day", "column_name").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.hll_sketch_agg("value", F.lit(14)).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED}) FILTER (WHERE value IS NOT NULL)").alias("frequent"),
    )


def merged_profile(sketches: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, distinct_values, frequent) over all days of ``sketches``, from sketches alone."""
    frequent = F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {TRACKED}), {TRACKED})")
    return sketches.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_values"),
        frequent.alias("frequent"),
    )


def frequent_values(merged: DataFrame, k: int = 5) -> DataFrame:
    """(column_name, value, count, rank) of the k most frequent values of a merged profile."""
    each = merged.select("column_name", F.inline("frequent")).withColumnRenamed("item", "value")
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")  # over TRACKED rows a column
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
