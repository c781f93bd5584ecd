"""Reading and writing the event fact and its companions."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse import schemas as S

#: Files of events carry a bloom filter on the id, for point lookups.
EVENT_FILES = {"parquet.bloom.filter.enabled#event_id": "true"}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event fact with its declared schema and the ``event_date`` partition column."""
    schema = T.StructType([*S.EVENT_SCHEMA.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events by day. The rebalance hint sizes files and splits days that are large."""
    (
        events.withColumn("event_date", F.col("event_ts").cast("date"))
        .hint("rebalance", F.col("event_date"))
        .write.mode(mode)
        .options(**EVENT_FILES)
        .partitionBy("event_date")
        .parquet(path)
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.POSITION_SCHEMA).parquet(path)


def read_positions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.POSITION_SCHEMA).option("header", True).csv(path)


def write_clustered(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Write in range order of the columns, so row-group statistics skip on them."""
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode(mode).parquet(path)


#: Quantiles per column that interleaved order tells apart, as bits.
ORDER_BITS = 6


def interleaved(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``_place``: the bits of each column's quantile in turn.

    Rows near each other in all columns are near in that order, so files and row groups hold narrow
    ranges of each. Quantiles come from a sketch in one pass; what reaches the driver is 63 numbers a
    column. Text goes by seven bytes after the beginning that all its values share. NULL comes first.
    """
    kinds = {c: df.schema[c].dataType.typeName() for c in columns}
    texts = [c for c in columns if kinds[c] == "string"]
    ends = df.agg(*[f(c).alias(f"{name}_{c}") for c in texts for name, f in (("least", F.min), ("most", F.max))]).first() if texts else {}

    def number(c: str) -> Column:
        if kinds[c] == "string":
            shared = os.path.commonprefix([(ends[f"{name}_{c}"] or "").encode() for name in ("least", "most")])
            rest = F.substring(F.hex(F.col(c).cast("binary")), 2 * len(shared) + 1, 14)
            return F.conv(F.rpad(rest, 14, "0"), 16, 10).cast("double")
        if kinds[c] in ("timestamp", "timestamp_ntz", "date"):
            return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        return F.col(c).cast("double")

    steps = 1 << ORDER_BITS
    shares = F.array(*[F.lit(k / steps) for k in range(1, steps)])
    cuts = df.agg(*[F.percentile_approx(number(c), shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    place = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        above = [F.lit(cut) for cut in cuts[i] or []]
        bin_ = F.lit(0).cast("long")
        if above:
            # One-element array: the value is computed once, not for each cut.
            below = F.transform(F.array(number(c)), lambda value: F.size(F.filter(F.array(*above), lambda cut: cut < value)))
            bin_ = F.coalesce(F.get(below, F.lit(0)), F.lit(0)).cast("long")
        for b in range(ORDER_BITS):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(bin_, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + i))
    return df.withColumn("_place", place)


def write_interleaved(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite", files: int | None = None) -> None:
    """Write in interleaved order, so file and row-group statistics skip on each of the columns alone."""
    placed = interleaved(df, columns)
    ranged = placed.repartitionByRange(files, "_place") if files else placed.repartitionByRange("_place")
    ranged.sortWithinPartitions("_place", *columns).drop("_place").write.mode(mode).parquet(path)


def crowded_days(events: DataFrame, before: Column, file_bytes: int) -> list:
    """Closed days with more files than their bytes need. Reads no column but those of the file's own."""
    files = (
        events.where(F.col("event_date") < before)
        .groupBy("event_date", F.col("_metadata.file_path").alias("path"))
        .agg(F.first("_metadata.file_size").alias("bytes"))
    )
    days = files.groupBy("event_date").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return [r.event_date for r in days.where(F.col("files") > F.ceil(F.col("bytes") / file_bytes)).select("event_date").collect()]


def compact_days(spark: SparkSession, path: str, before: Column, file_bytes: int = 128 << 20) -> list:
    """Join the small files of closed days; the days it rewrote.

    Only crowded days are read and take their folder's place on commit, so a second run finds nothing
    to do and a job cut off changes nothing. A day may be closed when no writer adds to it any more.
    """
    events = read_events(spark, path)
    days = crowded_days(events, before, file_bytes)
    if days:
        rows = events.where(F.col("event_date").isin(days)).hint("rebalance", F.col("event_date"))
        writer = rows.sortWithinPartitions("event_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.options(**EVENT_FILES).partitionBy("event_date").parquet(path)
    return days


def find_event(events: DataFrame, event_id) -> DataFrame:
    """Is the event there yet? At most one row; file statistics and bloom filters do the skipping."""
    return events.where(F.col("event_id") == F.lit(event_id)).limit(1)


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A relation written out in code: seeds, settings, lookup lists."""
    return spark.createDataFrame(rows, schema)
