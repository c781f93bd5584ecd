"""Ingest requests to event rows: batch bodies, validation, normalisation, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse import schemas as S
from bookpulse.functions.ratings import notch
from bookpulse.functions.text import channel_of, is_recoverable, stable_id

# Columns each event type fills; every other type leaves them NULL.
_OWNERS = {
    "side": S.TRADE,
    "qty": S.TRADE,
    "price": S.TRADE,
    "counterparty": S.TRADE,
    "prev_mark": S.MARK,
    "new_mark": S.MARK,
    "mark_source": S.MARK,
    "from_rating": S.CREDIT_EVENT,
    "to_rating": S.CREDIT_EVENT,
    "agency": S.CREDIT_EVENT,
}


def explode_batches(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per request of each JSON array body, with its place as ``seq`` and its text as ``raw``.

    A body that is not an array yields one row with ``seq`` NULL and no event type, which
    validation then quarantines.
    """
    is_array = F.ltrim(F.col(body)).startswith("[")
    requests = F.from_json(F.when(is_array, F.col(body)), T.ArrayType(T.StringType()))
    keep = [c for c in bodies.columns if c != body]
    each = bodies.select(*keep, F.posexplode_outer(requests).alias("seq", "raw"))
    fields = [f.name for f in S.REQUEST_SCHEMA]
    # A generator of one row: fields read later can't have the text parsed again for each of them.
    parsed = each.select(*keep, "seq", "raw", F.inline_outer(F.array(F.from_json("raw", S.REQUEST_SCHEMA))))
    return parsed.select(*keep, "seq", *fields, "raw")


def _typed(requests: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The requests, with a reason for each field of the raw request whose JSON type isn't the declared one.

    The text is parsed once, into a variant for each field.
    """
    checked = [f for f in S.REQUEST_SCHEMA if f.name != "payload"]
    kinds = T.StructType([T.StructField(f"kind of {f.name}", T.VariantType()) for f in checked])
    renamed = T.StructType([T.StructField(f.name, T.VariantType()) for f in checked])
    parsed = F.inline_outer(F.array(F.from_json("raw", renamed).cast(kinds)))
    reasons = []
    for field in checked:
        kind = F.schema_of_variant(F.col(f"`kind of {field.name}`"))
        numeric = isinstance(field.dataType, T.DoubleType)
        right = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") if numeric else kind == "STRING"
        fits = F.coalesce(right | (kind == "VOID"), F.lit(True))  # a missing field has no kind
        reasons.append(F.when(~fits, F.lit(f"{field.name} is not a {'number' if numeric else 'string'}")))
    return requests.select("*", parsed), reasons


def _out_of_range() -> list[Column]:
    """A reason for each number that the event column can't hold."""
    return [
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"{f.name} is out of range"))
        for f in S.EVENT_SCHEMA
        if isinstance(f.dataType, T.DecimalType)
    ]


def validate(requests: DataFrame) -> DataFrame:
    """Add ``reasons``: what is wrong with each request, an empty array when nothing is.

    With the ``raw`` text of the request, fields of the wrong JSON type are among the reasons.
    """

    def unless(ok: Column, reason: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))

    def payload_ok() -> Column:
        parsed = F.try_parse_json("payload")
        return F.col("payload").isNull() | F.schema_of_variant(parsed).startswith("OBJECT")

    typed, wrong_types = _typed(requests) if "raw" in requests.columns else (requests, [])
    problems = F.array(
        unless(F.col("event_type").isNotNull(), "missing event_type"),
        unless(
            F.col("event_type").isNull() | F.col("event_type").isin(S.REQUEST_TYPES),
            "unknown event_type",
        ),
        unless(payload_ok(), "payload is not an object"),
        *wrong_types,
        *_out_of_range(),
    )
    # Again a generator of one row, so that a filter on the reasons and their readers share one evaluation.
    return typed.select(*requests.columns, F.explode(F.array(F.array_compact(problems))).alias("reasons"))


def is_accepted() -> Column:
    return F.size("reasons") == 0


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(is_accepted()).drop("reasons")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.where(~is_accepted())


def normalise(
    requests: DataFrame, stamp: Column, source_app: str = "app", id_columns: list[str] | None = None
) -> DataFrame:
    """Event rows out of accepted requests.

    Columns of other event types are blanked, numbers become decimals, and missing id, times
    and source are filled. Ids hash all columns of the request (or ``id_columns``) in full, so a
    retried task writes the same id. Requests need a column with their place in the source (file
    and offset, or body and ``seq``): without one, two equal requests are one event. A credit event without a new rating moves one notch down.
    """
    given = set(requests.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in given else F.lit(None)

    values = {
        name: F.when(F.col("event_type") == owner, column(name)) for name, owner in _OWNERS.items()
    }
    values["to_rating"] = F.coalesce(
        values["to_rating"],
        F.when(F.col("event_type") == S.CREDIT_EVENT, notch(column("from_rating"), 1)),
    )
    ident = stable_id(*[F.col(c) for c in (id_columns or requests.columns)])
    values |= {
        "event_id": F.coalesce(column("event_id").cast("string"), ident),
        "event_ts": F.coalesce(column("event_ts").cast("timestamp_ntz"), stamp),
        "ingested_ts": F.coalesce(column("ingested_ts").cast("timestamp_ntz"), stamp),
        "event_type": F.col("event_type"),
        "position_id": column("position_id"),
        "payload": F.try_parse_json(column("payload").cast("string")),
        "source_app": F.coalesce(column("source_app").cast("string"), F.lit(source_app)),
    }
    return requests.select(
        *[
            values[f.name].try_cast(f.dataType).alias(f.name)
            if f.name != "payload"
            else values[f.name].alias(f.name)
            for f in S.EVENT_SCHEMA
        ]
    )


def end_offsets(rows: DataFrame, key: str = "position_id", order: tuple[str, ...] = ("event_ts", "event_id")):
    """Rows and last event id per key: the offset a producer may resume after."""
    return rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.max_by("event_id", F.struct(*order)).alias("end_offset")
    )


def in_key_order(
    rows: DataFrame,
    key: str = "position_id",
    order: tuple[str, ...] = ("event_ts", "event_id"),
    folder: str | None = None,
) -> DataFrame:
    """Rows grouped by key and ordered within it, for writing.

    Range partitioning by key and order splits a hot key into consecutive ranges, where hash
    partitioning would send all of it to one task. With the ``folder`` column of a partitioned
    table in front, a task writes few folders and a large folder gets many tasks.
    """
    columns = [*([folder] if folder else []), key, *order]
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)


def channel_counts(rows: DataFrame, channels: int = 4, key: str = "position_id") -> DataFrame:
    """Events per channel; keys are counted first, then hashed."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.groupBy(channel_of(F.col(key), channels).alias("channel")).agg(
        F.sum("n").alias("events")
    )


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors and the newest of them, by whether a retry may help."""
    kind = is_recoverable(F.col("error")).alias("recoverable")
    return errors.groupBy(kind).agg(F.count("*").alias("errors"), F.max("ts").alias("last_ts"))


def error_status(errors: DataFrame, last: int = 10) -> DataFrame:
    """The newest errors, each with the total number logged."""
    total = errors.agg(F.count("*")).scalar()
    newest = errors.orderBy(F.desc("ts"), F.desc("error_id")).limit(last)
    return newest.withColumn("total_errors", total)
