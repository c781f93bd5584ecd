"""Text helpers: trigrams, labels, keys, lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.schemas import RECOVERABLE_ERRORS


def plain(text: Column) -> Column:
    """Lower case, everything but letters and digits folded to single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def pieces(text: Column) -> Column:
    """Distinct three-letter pieces of a text that is plain already, padded."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=(...))"), 1))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the padded plain text."""
    return pieces(plain(text))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two sets, each an array without repeats."""
    common = F.size(F.array_intersect(left, right))
    return common / (F.size(left) + F.size(right) - common)


def event_label(number: Column, event_type: Column) -> Column:
    return F.concat(F.lit("#"), number.cast("string"), F.lit(" "), F.substring(event_type, 1, 6))


def series_name(metric: Column, labels: Column) -> Column:
    """``metric{a=1,b=2}`` with labels in key order; the bare metric when there are none."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    suffix = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return F.when(F.size(labels) > 0, F.concat(metric, suffix)).otherwise(metric)


def stable_id(*content: Column) -> Column:
    """The SHA-256 of all content, as upper-case hex: the same when a task is retried.

    Content is length-prefixed, so neighbouring values can't run into each other.
    """
    parts = [
        F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))
        for text in (c.cast("string") for c in content)
    ]
    return F.upper(F.sha2(F.concat_ws("|", *parts), 256))


def short_id(*content: Column) -> Column:
    """Twelve upper-case hex digits for display; too few to tell rows of a large table apart."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in content])
    return F.upper(F.substring(F.sha2(joined, 256), 1, 12))


def channel_of(key: Column, channels: int) -> Column:
    """Stable channel of a key: the 31-fold character hash modulo the channel count."""
    text = key.cast("string")
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(
        codes,
        F.lit(0).cast("bigint"),
        lambda acc, code: F.pmod(acc * 31 + code, F.lit(channels).cast("bigint")),
    ).cast("int")


def is_recoverable(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike("|".join(RECOVERABLE_ERRORS)), F.lit(False))


def as_variant(df: DataFrame, name: str) -> Column:
    """A VARIANT column as is; JSON text parsed, bad JSON to NULL."""
    if df.schema[name].dataType.typeName() == "variant":
        return F.col(name)
    return F.try_parse_json(F.col(name))
