"""Upserts as joins. The caller writes the result to a new folder or table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(source: DataFrame, key: str, order: tuple[str, ...] | None = None) -> DataFrame:
    """One source row per key: the greatest by ``order``, by all columns when not given."""
    rest = [c for c in source.columns if c != key]
    ranking = F.struct(*(order or rest))
    best = F.max_by(F.struct(*rest), ranking).alias("_row")
    return source.groupBy(key).agg(best).select(key, *[f"_row.{c}" for c in rest])


def merge_insert_only(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target as it is plus the source rows whose key it lacks."""
    fresh = one_per_key(source, key).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    stamp: Column,
    stamp_column: str = "updated",
    order: tuple[str, ...] | None = None,
) -> DataFrame:
    """Matched keys take the source values (NULL included) and the stamp; the rest is inserted.

    Of several source rows with one key the greatest by ``order`` counts.
    """
    source = one_per_key(source, key, order)
    values = [c for c in source.columns if c != key]
    incoming = source.select(
        key, *[F.col(c).alias(f"_in_{c}") for c in values], F.lit(True).alias("_hit")
    )
    hit = F.coalesce("_hit", F.lit(False))
    merged = target.join(incoming, key, "full_outer")
    columns = []
    for name in target.columns:
        if name == stamp_column:
            columns.append(F.when(hit, stamp).otherwise(F.col(name)).alias(name))
        elif name in values:
            columns.append(F.when(hit, F.col(f"_in_{name}")).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return merged.select(*columns)


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition get new values; a NULL condition leaves a row alone."""
    return df.withColumns(
        {name: F.when(condition, value).otherwise(F.col(name)) for name, value in changes.items()}
    )
