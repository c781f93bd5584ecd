"""Latency attribution: where the time of each event went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.functions.money import rounded
from bookpulse.functions.text import event_label
from bookpulse.operators.joins import join_groups
from bookpulse.operators.latest import numbered, retain_newest
from bookpulse.operators.ranks import upper_median, values_at_ranks

STEPS = {
    "network_ms": "1 network",
    "sdk_appended_ms": "2 append",
    "flush_committed_ms": "3 flush",
    "poll_ms": "4 poll",
}


def _tenths(ms: Column) -> Column:
    """Half-up tenths of the decimal value, so 30.45 gives 30.5 whatever its binary form.

    Values beyond the decimal's range have no such form; they are rounded as they are.
    """
    return F.coalesce(rounded(ms.try_cast("decimal(18,6)"), 1), F.round(ms, 1))


def attribute(traces: DataFrame) -> DataFrame:
    """Add the derived segments: time on the wire and the wait until the row was visible."""
    wire = F.coalesce("roundtrip_ms", F.lit(0.0)) - F.coalesce("total_handler_ms", F.lit(0.0))
    waited = F.greatest(F.lit(0.0), F.col("visible_ms") - F.coalesce("roundtrip_ms", F.lit(0.0)))
    return traces.withColumns({
        "network_ms": _tenths(wire),
        "poll_ms": _tenths(F.coalesce(waited, F.lit(0.0))),
    })


def bucket(ms: Column) -> Column:
    return F.when(ms < 300, "fast").when(ms < 1000, "slow").otherwise("stalled")


def segments(traces: DataFrame, session: str, history: int | None = None) -> DataFrame:
    """Long form (event, step, ms) of each session's events, numbered oldest first.

    With ``history``, only the newest so many events of a session, as a chart shows them.
    """
    if history is None:
        kept = numbered(attribute(traces), [session])
    else:
        kept = retain_newest(attribute(traces), [session], history)
    labelled = kept.select(
        session,
        "event_id",
        event_label(F.col("seq"), F.col("event_type")).alias("event"),
        *[F.coalesce(c, F.lit(0.0)).alias(label) for c, label in STEPS.items()],
    )
    return labelled.unpivot([session, "event_id", "event"], list(STEPS.values()), "step", "ms")


def summary(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Fired and completed events, upper medians, extremes, mean round trip without errors."""
    traces = attribute(traces)
    done = F.coalesce(F.col("visible_ms"), F.lit(0.0)) != 0
    flush = F.coalesce("flush_committed_ms", F.lit(0.0))
    # Values of unfinished events are NULL, which the ranks leave out.
    measures = traces.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("visible").alias("measure"), F.when(done, F.col("visible_ms")).alias("ms")),
                F.struct(F.lit("flush").alias("measure"), F.when(done, flush).alias("ms")),
            )
        ),
    )
    found = values_at_ranks(measures, [*keys, "measure"], "ms", {"median": upper_median})

    def median(measure: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col("median")))

    medians = found.groupBy(*keys).agg(
        median("visible").alias("median_visible_ms"),
        median("flush").alias("median_flush_ms"),
    )
    clean = F.when(F.col("error").isNull(), F.col("roundtrip_ms"))
    totals = traces.groupBy(*keys).agg(
        F.count("*").alias("fired"),
        F.count_if(done).alias("completed"),
        F.min(F.nullif("visible_ms", F.lit(0.0))).alias("min_visible_ms"),
        F.max(F.nullif("visible_ms", F.lit(0.0))).alias("max_visible_ms"),
        F.round(F.avg(clean), 2).alias("avg_roundtrip_ms"),
    )
    return (
        join_groups(totals, medians, keys, "left")
        .withColumn("grade", bucket(F.col("median_visible_ms")))
    )
