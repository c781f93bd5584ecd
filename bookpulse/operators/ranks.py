"""Exact order statistics of groups of any size.

Values are counted first, then cut into slabs at approximate quantiles of the distinct values.
The slab counts tell which slabs hold the wanted ranks, and only those are put in order. No
task ever sees more than a slab, and since the slabs are only a way to split the work the
answer does not depend on how good the approximation is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.operators.joins import join_groups


def _cuts(value: str, side: int) -> Column:
    """Quantiles of the distinct values as ``side`` rows of ``side - 1`` cuts and a last cut."""
    n = side * side
    points = ", ".join(f"{i / n!r}D" for i in range(1, n))
    cuts = F.expr(f"percentile_approx(`{value}`, array({points}), {10 * n})")
    return F.transform(
        F.sequence(F.lit(0), F.lit(side - 1)), lambda row: F.slice(cuts, row * side + 1, side)
    )


def _slab(cuts: Column, value: Column, side: int) -> Column:
    """Number of cuts below the value: first the row it falls into, then the place in the row."""
    full_rows = F.size(F.filter(cuts, lambda row: F.get(row, side - 1) < value))
    within = F.size(F.filter(F.get(cuts, full_rows), lambda cut: cut < value))
    return F.coalesce(full_rows * side + within, F.lit(0))


def values_at_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    side: int = 16,
) -> DataFrame:
    """Per key, the number of values as ``total`` and the value at each rank.

    ``ranks`` maps an output name to a function of the total that gives a rank from 0.
    NULL values are left out. Each key is worked on in ``side`` squared slabs.
    """
    copies = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("copies"))
    )
    key_facts = copies.groupBy(*keys).agg(
        F.struct(F.sum("copies").alias("total"), _cuts(value, side).alias("cuts")).alias("of_key")
    )
    if keys:
        tagged = join_groups(copies, key_facts, keys)
    else:
        tagged = copies.withColumn("of_key", key_facts.scalar())
    slab = _slab(F.col("of_key.cuts"), F.col(value), side)
    tagged = tagged.select(*keys, value, "copies", "of_key.total", slab.alias("slab"))

    per_key = Window.partitionBy(*keys)
    slabs = (
        tagged.groupBy(*keys, "slab")
        .agg(F.sum("copies").alias("slab_copies"), F.max("total").alias("total"))
        .withColumn("slab_end", F.sum("slab_copies").over(per_key.orderBy("slab")))
        .withColumn("slab_start", F.col("slab_end") - F.col("slab_copies"))
    )
    wanted = {name: rank(F.col("total")).cast("bigint") for name, rank in ranks.items()}
    holds_rank = F.lit(False)
    for rank in wanted.values():
        holds_rank |= (rank >= F.col("slab_start")) & (rank < F.col("slab_end"))
    slabs = slabs.where(holds_rank).select(*keys, "slab", "slab_start")

    in_slab = Window.partitionBy(*keys, "slab").orderBy(value)
    end = F.col("slab_start") + F.sum("copies").over(in_slab)
    ordered = (
        join_groups(tagged, slabs, [*keys, "slab"])
        .withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("copies"))
    )
    picks = [
        F.max(F.when((rank >= F.col("start")) & (rank < F.col("end")), F.col(value))).alias(name)
        for name, rank in wanted.items()
    ]
    return ordered.groupBy(*keys).agg(F.max("total").alias("total"), *picks)


def upper_median(total: Column) -> Column:
    return F.floor(total / 2)


def p95_or_max(total: Column) -> Column:
    """Rank of the 95th percentile; the last value below twenty points."""
    return F.when(total >= 20, F.floor(total * 0.95)).otherwise(total - 1)


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Interpolated percentiles (the SQL ``percentile_cont``), exact at any size."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in points.items():
        ranks[f"{name}_lo"] = lambda total, p=p: F.floor((total - 1) * F.lit(p))
        ranks[f"{name}_hi"] = lambda total, p=p: F.ceil((total - 1) * F.lit(p))
    found = values_at_ranks(df, keys, value, ranks)
    columns = []
    for name, p in points.items():
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        position = (F.col("total") - 1) * F.lit(p)
        columns.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return found.select(*keys, "total", *columns)
