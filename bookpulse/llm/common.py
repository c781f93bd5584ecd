"""What the operators share: reading tables, written intermediate tables, rows through Arrow."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.session import work_dir

#: The six white-space characters of the contracts: x20 and x09 to x0D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder: lineage ends here and values stay as they are."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_hand(spark: SparkSession) -> None:
    """Lets Python workers that run on the driver's machine find this package where the driver did."""
    seen = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(__file__).resolve().parents[2])
    if root not in seen:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, seen)])


def text_of(column: str = "text") -> Column:
    """A text column whose nulls are empty texts."""
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(df: DataFrame, columns: list[Column], schema: str, rows: Callable[..., Iterable]) -> DataFrame:
    """A few columns of ``df`` through ``rows``, an Arrow batch at a time.

    ``rows`` gets a list for each column and returns a list for each field of ``schema``. Names of
    other columns of ``df`` don't matter.
    """
    named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    fields = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(*[column.to_pylist() for column in batch.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, field.type) for values, field in zip(out, fields, strict=True)],
                    schema=fields,
                )

    return named.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow form of a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    at_hand(spark)
    return to_arrow_schema(StructType.fromDDL(ddl))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose id and text digest are among ``kept`` (doc_id, sha, rows), once each.

    ``rows`` is how many documents share that id and digest; only where it is over 1 must documents
    be told apart, and texts move once more. Columns of documents may have any names.
    """
    once = store(kept.distinct(), "kept").select(F.struct("doc_id", "sha").alias("wanted"), "rows")
    own = F.struct(F.col("doc_id"), F.sha2(text_of().cast("binary"), 256).alias("sha")).alias("own")
    met = whole(docs, own).join(once, F.col("own.doc_id").eqNullSafe(F.col("wanted.doc_id")) & (F.col("own.sha") == F.col("wanted.sha")))
    if once.where("rows > 1").isEmpty():
        return met.select("row.*")
    again = met.where("rows > 1").dropDuplicates(["own"])
    return met.where("rows = 1").select("row").unionByName(again.select("row")).select("row.*")


def whole(docs: DataFrame, *columns: Column) -> DataFrame:
    """Each document as one column ``row``, beside columns computed from it: no two names can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)
