"""Micro-batch writers. Running a batch again leaves the tables as they are.

A batch goes under a key of its own, made of the streaming query's id and the batch number. A
checkpoint keeps its query id over restarts; a new checkpoint has a new one, so its batch 0 never
replaces the batch 0 of another.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse import schemas as S
from bookpulse.functions.time import Clock
from bookpulse.operators import ingest, sketches
from bookpulse.operators.latest import latest_by
from bookpulse.sources.tables import EVENT_FILES

KNOWN_TYPES = [S.TRADE, S.MARK, S.CREDIT_EVENT, S.WARMUP]
#: Event ids are kept in this many folders, so a batch opens those of its own ids only.
ID_FOLDERS = 256
PROGRESS = "newest_event_ts timestamp_ntz, received long, quarantined long, batch string"


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """A table that may not have been written yet; every other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def batch_key(batch: DataFrame, batch_id: int) -> str:
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query or 'batch'}-{batch_id}"


def problems() -> Column:
    """What keeps an event out of the table, empty when nothing does."""
    kind = F.col("event_type")
    return F.array_compact(F.array(
        F.when(F.col("event_id").isNull(), "missing event_id"),
        F.when(F.col("event_ts").isNull(), "missing event_ts"),
        F.when(kind.isNull(), "missing event_type"),
        F.when(~kind.isin(KNOWN_TYPES), "unknown event_type"),
    ))


class EventSink:
    """Appends events exactly once, by event id alone.

    The event delivered first stays, whatever days the copies carry; of copies in one batch, the
    earliest by event and arrival time. Instead of a watermarked state, which forgets old ids and
    drops late rows, ids are kept beside the events in folders by hash: a batch reads the ids of
    the folders it touches, not the events. ``remember`` limits that to ids that arrived in the
    last so many days, where the producer never delivers again later.

    Rows older than the newest event of earlier batches minus ``lateness`` are kept and flagged
    ``late``. Rows without id, time or a known type go to a quarantine folder with their reasons.
    Counts per batch go to a progress table. Events are written before their ids, and a batch
    that runs again replaces both and doesn't meet its own ids.
    """

    def __init__(self, path: str, lateness: timedelta = timedelta(minutes=10), remember: int | None = None):
        self.events = f"{path}/events"
        self.ids = f"{path}/ids"
        self.quarantine = f"{path}/quarantine"
        self.progress = f"{path}/progress"
        self.lateness, self.remember = lateness, remember

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.events).drop("batch")

    def read_progress(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PROGRESS).parquet(self.progress)

    def clock(self, spark: SparkSession) -> Clock:
        """The newest event time, from the progress table: a literal, so scans of events prune by it."""
        newest = self.read_progress(spark).agg(F.max("newest_event_ts")).first()[0]
        return Clock.fixed(newest)

    def _newest_before(self, spark: SparkSession, key: str):
        done = read_if_there(spark, self.progress, PROGRESS)
        return done.where(F.col("batch") != key).agg(F.max("newest_event_ts")).first()[0] if done is not None else None

    def _known(self, rows: DataFrame, key: str) -> DataFrame | None:
        """Ids of these rows that an earlier batch has stored."""
        schema = T.StructType([
            rows.schema["event_id"],
            *T.StructType.fromDDL("folder int, arrived date, batch string"),
        ])
        stored = read_if_there(rows.sparkSession, self.ids, schema)
        if stored is None:
            return None
        folders = [r.folder for r in rows.select("folder").distinct().collect()]  # at most ID_FOLDERS
        stored = stored.where(F.col("folder").isin(folders) & (F.col("batch") != key))
        if self.remember is not None:
            stored = stored.where(F.col("arrived") >= F.date_sub(F.current_date(), self.remember))
        return stored.select("folder", "event_id")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, batch_key(batch, batch_id)
        checked = batch.withColumn("reasons", problems()).persist()
        try:
            self._store(spark, checked, key)
        finally:
            checked.unpersist()

    def _store(self, spark: SparkSession, checked: DataFrame, key: str) -> None:
        good = F.size("reasons") == 0
        seen = checked.agg(
            F.count("*").alias("received"),
            F.count_if(~good).alias("quarantined"),
            F.max(F.when(good, F.col("event_ts"))).alias("newest"),
        ).first()
        newest_before = self._newest_before(spark, key)
        if seen["quarantined"]:
            checked.where(~good).write.mode("overwrite").parquet(f"{self.quarantine}/batch={key}")

        late = F.lit(False)
        if newest_before is not None:
            late = F.col("event_ts") < F.lit(newest_before - self.lateness).cast("timestamp_ntz")
        columns = [c for c in checked.columns if c not in ("event_id", "reasons")]
        first = F.min_by(F.struct(*columns), F.struct("event_ts", "ingested_ts")).alias("row")
        rows = checked.where(good).groupBy("event_id").agg(first).select("event_id", *[f"row.{c}" for c in columns])
        rows = rows.withColumns({
            "late": late,
            "event_date": F.col("event_ts").cast("date"),
            "folder": F.pmod(F.xxhash64("event_id"), F.lit(ID_FOLDERS)).cast("int"),
            "batch": F.lit(key),
        })
        known = self._known(rows, key)
        if known is not None:
            rows = rows.join(known, ["folder", "event_id"], "left_anti")
        rows = rows.persist()
        try:
            self._write(
                rows.drop("folder").hint("rebalance", "event_date")
                .sortWithinPartitions("event_date", "position_id", "event_ts", "event_id"),
                self.events, "event_date", "batch",
            )
            ids = rows.select("event_id", "folder", F.current_date().alias("arrived"), "batch")
            self._write(ids.hint("rebalance", "folder"), self.ids, "folder", "arrived", "batch")
        finally:
            rows.unpersist()
        self._log(spark, key, seen, newest_before)

    @staticmethod
    def _write(rows: DataFrame, path: str, *folders: str) -> None:
        """Replaces the folders that the rows belong to; they carry the batch's key."""
        writer = rows.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **EVENT_FILES)
        writer.partitionBy(*folders).parquet(path)

    def _log(self, spark: SparkSession, key: str, seen, newest_before) -> None:
        times = [t for t in (seen["newest"], newest_before) if t is not None]
        newest = max(times) if times else None
        spark.range(0, 1, 1, 1).select(
            F.lit(newest).cast("timestamp_ntz").alias("newest_event_ts"),
            F.lit(seen["received"]).alias("received"),
            F.lit(seen["quarantined"]).alias("quarantined"),
        ).write.mode("overwrite").parquet(f"{self.progress}/batch={key}")


class RequestSink:
    """Request bodies to events: explode, validate, normalise, append once.

    Bodies need a column with their place in the source (``body_id``); with ``seq`` it makes the
    event id, so a body delivered again adds nothing. Requests that fail validation go to a
    folder of their own with their reasons.
    """

    def __init__(self, path: str, stamp: str = "event_ts"):
        self.events = EventSink(path)
        self.rejected = f"{path}/rejected"
        self.stamp = stamp

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        checked = ingest.validate(ingest.explode_batches(batch)).persist()
        try:
            bad = ingest.quarantined(checked)
            bad.write.mode("overwrite").parquet(f"{self.rejected}/batch={batch_key(batch, batch_id)}")
            good = ingest.accepted(checked).withColumn("event_id", F.concat_ws("-", "body_id", "seq"))
            self.events(ingest.normalise(good, F.col(self.stamp)), batch_id)
        finally:
            checked.unpersist()


class ChangeSink:
    """Keeps the changed rows of every batch of an aggregation in update mode.

    Every ``compact`` batches the current values are written as a new base, and reading takes the
    newest base and the changes after it. A checkpoint with a new query id starts anew.
    """

    def __init__(self, path: str, keys: list[str], compact: int = 32):
        self.path, self.keys, self.compact = path, keys, compact

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")
        if (batch_id + 1) % self.compact == 0:
            current = self._current(batch.sparkSession, batch_id)
            current.write.mode("overwrite").parquet(f"{self.path}/base/upto={batch_id}")

    def _current(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        changes = spark.read.parquet(f"{self.path}/changes")
        if last is not None:
            changes = changes.where(F.col("batch_id") <= last)
        bases = read_if_there(spark, f"{self.path}/base", T.StructType([*changes.drop("batch_id").schema, T.StructField("upto", T.IntegerType())]))
        if bases is not None:
            if last is not None:
                bases = bases.where(F.col("upto") < last)
            upto = bases.agg(F.max("upto")).first()[0]
            if upto is not None:
                base = bases.where(F.col("upto") == upto).withColumnRenamed("upto", "batch_id")
                changes = changes.where(F.col("batch_id") > upto).unionByName(base)
        columns = [c for c in changes.columns if c not in (*self.keys, "batch_id")]
        return latest_by(changes, self.keys, columns, order=("batch_id",))

    def read(self, spark: SparkSession) -> DataFrame:
        """The current value of every key."""
        return self._current(spark)


class SnapshotSink:
    """Recomputes the snapshot after every batch and keeps each as a version.

    The clock is the newest event of the progress table, so only the trailing days are scanned.
    The whole window is recomputed, so marks expire by the clock. To expire them while no events
    arrive, call ``refresh`` from a schedule with a later clock. The newest version's name is kept
    in a file of its own; reading opens that version only.
    """

    def __init__(self, path: str, events: EventSink, snapshot: Callable[[DataFrame, Clock], DataFrame]):
        self.path, self.events, self.snapshot = path, events, snapshot

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.events(batch, batch_id)
        spark = batch.sparkSession
        self.refresh(spark, batch_key(batch, batch_id), self.events.clock(spark))

    def refresh(self, spark: SparkSession, version: str, clock: Clock) -> None:
        snapshot = self.snapshot(self.events.read(spark), clock)
        (
            snapshot.repartitionByRange("sector", "issuer")
            .sortWithinPartitions("sector", "issuer")
            .write.mode("overwrite")
            .parquet(f"{self.path}/version={version}")
        )
        pointer = spark.range(0, 1, 1, 1).select(F.lit(version).alias("version"))
        pointer.write.mode("overwrite").parquet(f"{self.path}/newest")

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest version."""
        version = spark.read.schema("version string").parquet(f"{self.path}/newest").first()[0]
        return spark.read.parquet(f"{self.path}/version={version}")


class SketchSink:
    """Sketches of every batch by minute, in folders by day. A batch that runs again replaces its own."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = sketches.minute_sketches(batch).withColumns({"day": F.col("minute").cast("date"), "batch": F.lit(batch_key(batch, batch_id))})
        writer = rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """(minute, n, sketch), one row a minute. A bound on ``minute`` should come with one on ``day``."""
        stored = spark.read.schema("minute timestamp_ntz, n long, sketch binary, day date, batch string").parquet(self.path)
        return sketches.merged(stored, "minute", "day")
