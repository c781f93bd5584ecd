"""Declared constraints as a report: NOT NULL, keys, enums, precision, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas as S


def _one_pass(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count the rows that break each check, all in one aggregate."""
    broken = df.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    return broken.unpivot([], list(checks), "check_name", "failures")


def not_null(columns: list[str]) -> dict[str, Column]:
    return {f"not_null:{c}": F.col(c).isNull() for c in columns}


def one_of(column: str, allowed: list[str]) -> dict[str, Column]:
    return {f"enum:{column}": ~F.coalesce(F.col(column).isin(allowed), F.lit(False))}


def fits(column: str, decimal: str) -> dict[str, Column]:
    """Raw numbers that the declared decimal can't hold, or holds only with digits lost."""
    given, held = F.col(column).cast("double"), F.col(column).try_cast(decimal).cast("double")
    return {f"precision:{column}": given.isNotNull() & (held.isNull() | (held != given))}


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    extra = df.groupBy(key).agg((F.count("*") - 1).alias("extra")).agg(F.sum("extra").alias("n"))
    return extra.select(
        F.lit(f"unique:{key}").alias("check_name"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("failures"),
    )


def orphans(facts: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key the dimension lacks; counted per key before the join."""
    per_key = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    lost = per_key.join(dims.select(key), key, "left_anti").agg(F.sum("n").alias("n"))
    return lost.select(
        F.lit(f"reference:{key}").alias("check_name"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("failures"),
    )


def dq_report(events: DataFrame, positions: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Failures per check. Precision is checked on ``raw``, the rows as delivered, before any cast."""
    checks = {
        **not_null(["event_id", "event_ts", "event_type", "position_id"]),
        **one_of("event_type", [S.TRADE, S.MARK, S.CREDIT_EVENT, S.WARMUP]),
        "order:ingested_ts": F.col("ingested_ts") < F.col("event_ts"),
    }
    dims = not_null(["issuer", "sector", "tranche", "par_amount", "fund", "baseline_mark"])
    kinds = {"qty": "decimal(18,2)", "price": "decimal(10,4)", "new_mark": "decimal(10,4)", "value": "decimal(4,1)"}
    delivered = raw if raw is not None else events
    precise = {k: v for c in delivered.columns if c in kinds for k, v in fits(c, kinds[c]).items()}
    return (
        _one_pass(events, checks)
        .unionByName(_one_pass(delivered, precise))
        .unionByName(_one_pass(positions, dims))
        .unionByName(duplicate_keys(events, "event_id"))
        .unionByName(duplicate_keys(positions, "position_id"))
        .unionByName(orphans(events, positions, "position_id"))
    )
