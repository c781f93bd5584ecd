"""Tables with one row a key that are changed a little at a time, and what is kept in them.

A change writes the new rows of the keys it touches, numbered in sequence; every ``compact`` changes
the current rows become a new base, in folders by a hash of the key. A lookup reads the base folders
of its keys and the changes since. So a refresh costs what it touches, and now and then a rewrite.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse import schemas as S
from bookpulse.functions.time import Clock
from bookpulse.operators.snapshot import portfolio_live, portfolio_table
from bookpulse.streaming.sinks import batch_key, read_if_there

FOLDERS = 64
LOG = "clock timestamp_ntz, batch string, seq long"


class KeyedTable:
    """One row a key, in numbered changes over a base. A key whose ``gone`` is true has left."""

    def __init__(self, path: str, key: str, fields: str, folders: int = FOLDERS, compact: int = 16):
        self.path, self.key, self.folders, self.compact = path, key, folders, compact
        self.schema = T.StructType([*T.StructType.fromDDL(fields), T.StructField("gone", T.BooleanType())])

    def _folder(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.folders)).cast("int")

    def _stored(self, spark: SparkSession, before: int | None, based: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """The newest base (before ``based``, if given), and the changes after it, of what was written before a number."""
        base = read_if_there(spark, f"{self.path}/base", T.StructType([*self.schema, *T.StructType.fromDDL("seq long, folder int")]))
        upto = -1
        if base is not None:
            based = before if based is None else based
            base = base.where(F.col("seq") < based) if based is not None else base
            found = base.agg(F.max("seq")).first()[0]  # of folder names
            upto = -1 if found is None else found
            base = base.where(F.col("seq") == upto)
        changes = read_if_there(spark, f"{self.path}/changes", T.StructType([*self.schema, *T.StructType.fromDDL("seq long")]))
        if changes is not None:
            changes = changes.where(F.col("seq") > upto)
            changes = changes.where(F.col("seq") < before) if before is not None else changes
        return base, changes

    def _newest(self, base: DataFrame | None, changes: DataFrame | None, keys: DataFrame | None = None) -> DataFrame | None:
        parts = [p for p in (base.drop("folder") if base is not None else None, changes) if p is not None]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rows = rows.join(keys, self.key, "left_semi") if keys is not None else rows
        return self._first(rows, self.key).drop("seq", "gone")

    def _first(self, rows: DataFrame, *by: str) -> DataFrame:
        """The newest rows, of keys that have not left."""
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))
        return rows.withColumn("place", place).where((F.col("place") == 1) & ~F.col("gone")).drop("place")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The current row of every key."""
        found = self._newest(*self._stored(spark, before))
        return found if found is not None else spark.createDataFrame([], T.StructType(self.schema[:-1]))

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The current rows of some keys, read from their folders only."""
        spark = keys.sparkSession
        base, changes = self._stored(spark, before)
        if base is not None:
            folders = [r.folder for r in keys.select(self._folder().alias("folder")).distinct().collect()]  # at most ``folders``
            base = base.where(F.col("folder").isin(folders))
        found = self._newest(base, changes, keys)
        return found if found is not None else spark.createDataFrame([], T.StructType(self.schema[:-1]))

    def change(self, rows: DataFrame, seq: int) -> None:
        """New rows for the keys in ``rows``; a number written again replaces what it wrote."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/changes/seq={seq}")
        if (seq + 1) % self.compact == 0:
            spark = rows.sparkSession
            base, changes = self._stored(spark, seq + 1, seq)  # not the base that an earlier run of the change wrote
            rows = changes.withColumn("folder", self._folder())
            rows = rows if base is None else rows.unionByName(base)
            # One move serves the window and the folders.
            current = self._first(rows.repartition("folder"), "folder", self.key).drop("seq").withColumn("gone", F.lit(False))
            current.sortWithinPartitions("folder", self.key).write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/base/seq={seq}")

    def base(self, spark: SparkSession, seq: int) -> DataFrame:
        """The current rows as the change with this number left them, if it made a base."""
        return spark.read.schema(T.StructType(self.schema[:-1])).parquet(f"{self.path}/base/seq={seq}")

    def changed(self, spark: SparkSession, seq: int) -> DataFrame:
        """The rows that one change wrote, those of keys that left included."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/changes/seq={seq}")


class Sequence:
    """The numbers of changes and their clocks. A batch that runs again gets its number again."""

    def __init__(self, path: str):
        self.path = path

    def next(self, spark: SparkSession, batch: str) -> tuple[int, object]:
        """The number of a batch, and the clock before it."""
        log = read_if_there(spark, self.path, LOG)
        if log is None:
            return 0, None
        own = log.where(F.col("batch") == batch).agg(F.max("seq")).first()[0]
        last = log.agg(F.max("seq")).first()[0]
        seq = own if own is not None else -1 if last is None else last
        seq = seq if own is not None else seq + 1
        return seq, log.where(F.col("seq") < seq).agg(F.max("clock")).first()[0]

    def done(self, spark: SparkSession, seq: int, batch: str, clock) -> None:
        row = spark.range(0, 1, 1, 1).select(F.lit(clock).cast("timestamp_ntz").alias("clock"), F.lit(batch).alias("batch"))
        row.write.mode("overwrite").parquet(f"{self.path}/seq={seq}")

    def clock(self, spark: SparkSession) -> Clock:
        return Clock.fixed(spark.read.schema(LOG).parquet(self.path).agg(F.max("clock")).first()[0])


EVENT_FIELDS = ["event_id", "event_ts", "event_type", "new_mark", "to_rating", "side", "qty", "price", "counterparty"]


def witnesses(events: DataFrame) -> DataFrame:
    """Per position the few events that decide its state: the newest mark, rating, trade, and newest of all.

    The snapshot over these is the snapshot over all events.
    """
    when, event = F.struct("event_ts", "event_id"), F.struct(*EVENT_FIELDS)
    kinds = [F.col("event_type") == kind for kind in (S.MARK, S.CREDIT_EVENT, S.TRADE)]
    newest = [F.max_by(event, F.when(kind, when)) for kind in kinds] + [F.max_by(event, when)]
    return events.where("position_id is not null").groupBy("position_id").agg(
        F.array_distinct(F.array_compact(F.array(*newest))).alias("events")
    )


class LiveSnapshot:
    """The portfolio snapshot, kept by change.

    State is ``witnesses`` a position. A refresh merges the new events into the state of their
    positions, and looks up the positions of which an event leaves the window between the clock
    before and now: an hour's folder of ``due`` names them, so a mark expires without an event
    coming. Only rows of these positions are written (the due hours of past clocks can be deleted); a position without an event in the window
    leaves the state. Events must be new, as an ``EventSink`` hands them on; the same event twice
    changes nothing. Clocks go forwards; a batch that brings only older events is merged at the clock
    before. A refresh that runs again writes the same rows again.
    """

    def __init__(self, path: str, positions: DataFrame, event_schema: T.StructType, hours: int = 24, compact: int = 16):
        kinds = {f.name: f.dataType.simpleString() for f in event_schema}
        event = ", ".join(f"{c}: {kinds[c]}" for c in EVENT_FIELDS)
        self.state = KeyedTable(f"{path}/state", "position_id", f"position_id {kinds['position_id']}, events array<struct<{event}>>", compact=compact)
        shape = portfolio_table(portfolio_live(positions.sparkSession.createDataFrame([], event_schema), positions, Clock.wall()), Clock.wall())
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.schema)
        self.rows = KeyedTable(f"{path}/rows", "position_id", columns, compact=compact)
        self.due, self.sequence = f"{path}/due", Sequence(f"{path}/log")
        self.due_fields = f"position_id {kinds['position_id']}, at timestamp_ntz, hour timestamp_ntz"
        self.positions, self.window = positions, timedelta(hours=hours)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.refresh(batch, batch_key(batch, batch_id))

    def _expiring(self, spark: SparkSession, before, now) -> DataFrame | None:
        """Positions with an event that was in the window at the clock before and isn't now."""
        due = read_if_there(spark, self.due, self.due_fields)
        if due is None or before is None:
            return None
        hours = [F.date_trunc("hour", F.lit(x).cast("timestamp_ntz")).cast("timestamp_ntz") for x in (before, now)]
        due = due.where((F.col("hour") >= hours[0]) & (F.col("hour") <= hours[1]))
        at = F.col("at")
        return due.where((at >= F.lit(before).cast("timestamp_ntz")) & (at < F.lit(now).cast("timestamp_ntz"))).select("position_id").distinct()

    def refresh(self, events: DataFrame, batch: str, clock: object = None) -> None:
        """New events (maybe none) at a clock; without one, at the newest event so far."""
        spark = events.sparkSession
        seq, before = self.sequence.next(spark, batch)
        events = events.select("position_id", *EVENT_FIELDS).persist()
        try:
            times = [t for t in (before, clock or events.agg(F.max("event_ts")).first()[0]) if t is not None]
            if times:
                self._merge(spark, events, max(times), before, seq)
                self.sequence.done(spark, seq, batch, max(times))
        finally:
            events.unpersist()

    def _merge(self, spark: SparkSession, events: DataFrame, now, before, seq: int) -> None:
        came = witnesses(events)
        keys = came.select("position_id")
        expiring = self._expiring(spark, before, now)
        if seq == 0:
            keys = keys.unionByName(self.positions.select("position_id"))  # the first refresh writes every position
        if expiring is not None:
            keys = keys.unionByName(expiring)
        keys = keys.distinct().persist()
        try:
            old = self.state.lookup(keys, seq)
            both = old.unionByName(came).select("position_id", F.inline("events"))
            fresh = both.where(F.col("event_ts") >= F.lit(now - self.window).cast("timestamp_ntz"))
            state = witnesses(fresh).withColumn("gone", F.lit(False))
            left = keys.join(state, "position_id", "left_anti").select("position_id", F.lit(None).alias("events"), F.lit(True).alias("gone"))
            self.state.change(state.unionByName(left), seq)
            written = self.state.changed(spark, seq).where(~F.col("gone")).select("position_id", F.inline("events"))
            # Only a hint where to look: a row written twice does no harm.
            at = F.col("event_ts") + F.lit(self.window)
            due = written.select("position_id", at.alias("at"), F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour"))
            due.hint("rebalance", "hour").write.mode("append").partitionBy("hour").parquet(self.due)
            # Quiet positions are stamped when read: their rows needn't change with the clock.
            touched = self.positions.join(keys, "position_id", "left_semi")
            live = portfolio_table(portfolio_live(written, touched, Clock.fixed(now)), Clock.fixed(now))
            heard = written.select("position_id").distinct().withColumn("heard", F.lit(True))
            rows = live.join(heard, "position_id", "left").withColumn("latest_event_ts", F.when(F.col("heard"), F.col("latest_event_ts")))
            self.rows.change(rows.withColumn("gone", F.lit(False)), seq)
        finally:
            keys.unpersist()

    def read(self, spark: SparkSession) -> DataFrame:
        """The snapshot as of the last clock."""
        now = self.sequence.clock(spark).now()
        return self.rows.read(spark).withColumn("latest_event_ts", F.coalesce("latest_event_ts", now))


class OffsetLedger:
    """Rows and last event per key, over all batches, committed with each.

    A batch whose events of a key start at or before the key's stored end is out of order there: the
    end stays the greatest, and ``behind`` counts the events that came late. A batch that runs again
    changes nothing. Events without a key have no order and are left out.
    """

    FIELDS = "rows long, behind long, end_ts timestamp_ntz"

    def __init__(self, path: str, event_schema: T.StructType, key: str = "position_id", compact: int = 16):
        kinds = {f.name: f.dataType.simpleString() for f in event_schema}
        self.key = key
        self.table = KeyedTable(f"{path}/offsets", key, f"{key} {kinds[key]}, {self.FIELDS}, end_offset {kinds['event_id']}", compact=compact)
        self.sequence = Sequence(f"{path}/offsets-log")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_key(batch, batch_id)
        seq, before = self.sequence.next(spark, name)
        rows = batch.select(self.key, "event_ts", "event_id").where(F.col(self.key).isNotNull()).persist()
        try:
            keyed = rows.groupBy(self.key).agg(
                F.count("*").alias("rows"), F.max(F.struct("event_ts", "event_id")).alias("end")
            ).select(self.key, "rows", F.col("end.event_ts").alias("end_ts"), F.col("end.event_id").alias("end_offset"))
            old = self.table.lookup(keyed.select(self.key), seq).select(
                self.key, F.col("rows").alias("old_rows"), F.col("behind").alias("old_behind"), F.col("end_ts").alias("old_ts"), F.col("end_offset").alias("old_end")
            ).persist()
            stale = rows.join(old, self.key).where(F.struct("event_ts", "event_id") <= F.struct("old_ts", "old_end"))
            behind = stale.groupBy(self.key).agg(F.count("*").alias("late"))
            merged = keyed.join(old, self.key, "left").join(behind, self.key, "left")
            ahead = F.col("old_ts").isNull() | (F.struct("end_ts", "end_offset") > F.struct("old_ts", "old_end"))
            zero = F.lit(0).cast("long")
            self.table.change(
                merged.select(
                    self.key,
                    (F.coalesce("old_rows", zero) + F.col("rows")).alias("rows"),
                    (F.coalesce("old_behind", zero) + F.coalesce("late", zero)).alias("behind"),
                    F.when(ahead, F.col("end_ts")).otherwise(F.col("old_ts")).alias("end_ts"),
                    F.when(ahead, F.col("end_offset")).otherwise(F.col("old_end")).alias("end_offset"),
                    F.lit(False).alias("gone"),
                ),
                seq,
            )
            old.unpersist()
            newest = rows.agg(F.max("event_ts")).first()[0]
            self.sequence.done(spark, seq, name, newest or before)
        finally:
            rows.unpersist()

    def read(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark)


def chained(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One writer out of several, in order. The batch is computed once, so observed metrics count it once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return run
