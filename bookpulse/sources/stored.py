"""Upserts and updates on a stored table that rewrite only what they hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.operators import upsert


class StoredTable:
    """A table in folders by a hash of its key.

    A change reads and rewrites the folders that hold keys it hits, by dynamic partition overwrite:
    new files are staged and take their folder's place when the job commits, so a lost task or job
    leaves the table as it was. A change that was cut off among its last renames is run again; each
    of them gives the same rows when repeated. One writer at a time; readers that started before a
    change may have to start again. ``folders`` bounds what is collected, and sets a folder's size:
    about the table's size over the size of a file.
    """

    def __init__(self, path: str, key: str, schema: str | T.StructType, folders: int = 64):
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.path, self.key, self.folders, self.fields = path, key, folders, fields
        self.stored = T.StructType([*fields, T.StructField("folder", T.IntegerType())])

    def folder(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.folders)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        placed = rows.select(*self.fields.names).withColumn("folder", self.folder())
        writer = placed.hint("rebalance", "folder").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("folder").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "errorifexists")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).select(*self.fields.names)

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.stored).parquet(self.path)

    def _hit(self, rows: DataFrame) -> DataFrame:
        """The rows of the folders that ``rows`` (of a column folder) names."""
        folders = [r.folder for r in rows.select("folder").distinct().collect()]  # at most ``folders``
        return self._stored(rows.sparkSession).where(F.col("folder").isin(folders)).select(*self.fields.names)

    def _of(self, source: DataFrame) -> DataFrame:
        return self._hit(source.select(self.folder().alias("folder")))

    def upsert(self, source: DataFrame, stamp: Column, stamp_column: str = "updated", order: tuple[str, ...] | None = None) -> None:
        """As ``merge_upsert``, in the folders of the source's keys."""
        self._write(upsert.merge_upsert(self._of(source), source, self.key, stamp, stamp_column, order), "overwrite")

    def insert_only(self, source: DataFrame) -> None:
        """As ``merge_insert_only``: new keys come as files of their own, stored rows are only looked up."""
        fresh = upsert.one_per_key(source, self.key).join(self._of(source).select(self.key), self.key, "left_anti")
        self._write(fresh, "append")

    def update_where(self, condition: Column, changes: dict[str, Column]) -> None:
        """As the operator of that name, in the folders with a row that meets the condition."""
        if self.key in changes:
            raise ValueError("the key places a row and can't be changed")
        hit = self._hit(self._stored(SparkSession.active()).where(condition))
        self._write(upsert.update_where(hit, condition, changes), "overwrite")
