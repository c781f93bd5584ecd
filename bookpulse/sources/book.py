"""The position book on top of the benchmark tables.

``events`` stands in for the event fact and ``customer`` with ``nation`` and ``region`` for the
position dimension. Everything is a projection, so the whole of each table flows through.
Schemas are declared: opening a table reads no footer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse import schemas as S

TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_LADDER = "array(" + ", ".join(f"'{g}'" for g in S.RATING_LADDER) + ")"
_GRADES = len(S.RATING_LADDER)

K = "cast(get_json_object(props, '$.k') as int)"

_EVENT_COLUMNS = [
    "event_id",
    "ts AS event_ts",
    "ts + make_dt_interval(0, 0, 0, k / 1000BD) AS ingested_ts",
    f"""CASE event_type WHEN 'purchase' THEN '{S.TRADE}' WHEN 'click' THEN '{S.MARK}'
        WHEN 'error' THEN '{S.CREDIT_EVENT}' WHEN 'signup' THEN '{S.WARMUP}'
        WHEN 'view' THEN 'VIEW' END AS event_type""",
    "user_id AS position_id",
    "CASE WHEN event_type = 'purchase' THEN if(k % 2 = 0, 'BUY', 'SELL') END AS side",
    "CASE WHEN event_type = 'purchase' THEN cast(k * 100 AS decimal(18,2)) END AS qty",
    "CASE WHEN event_type = 'purchase' THEN cast(value AS decimal(10,4)) END AS price",
    "CASE WHEN event_type = 'purchase' THEN concat('CP-', k % 10) END AS counterparty",
    "CASE WHEN event_type = 'click' THEN cast(50 AS decimal(10,4)) END AS prev_mark",
    "CASE WHEN event_type = 'click' THEN cast(value AS decimal(10,4)) END AS new_mark",
    "CASE WHEN event_type = 'click' THEN concat('SRC-', k % 5) END AS mark_source",
    f"CASE WHEN event_type = 'error' THEN element_at({_LADDER}, k % {_GRADES} + 1) END AS from_rating",
    f"CASE WHEN event_type = 'error' THEN element_at({_LADDER}, k * 7 % {_GRADES} + 1) END AS to_rating",
    "CASE WHEN event_type = 'error' THEN concat('AG-', k % 3) END AS agency",
    "try_parse_json(props) AS payload",
    f"if(event_type = 'signup', '{S.WARMUP_SOURCE}', 'app') AS source_app",
]

_POSITION_COLUMNS = [
    "c_custkey AS position_id",
    "c_name AS issuer",
    "c_mktsegment AS sector",
    "r_name AS tranche",
    "cast(abs(cast(c_acctbal AS decimal(18,2))) AS decimal(18,2)) AS par_amount",
    "cast(400 + c_custkey % 500 AS decimal(8,1)) AS original_spread_bps",
    "cast(2022 + c_custkey % 5 AS int) AS vintage_year",
    "n_name AS fund",
    "c_custkey % 10 = 0 AS watchlist",
    f"element_at({_LADDER}, cast(c_custkey % {_GRADES} + 1 AS int)) AS current_rating",
    "cast(50 AS decimal(10,4)) AS baseline_mark",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def as_book_events(raw: DataFrame) -> DataFrame:
    """Map raw rows onto the event fact; works on batches and streams."""
    return raw.selectExpr("*", f"{K} AS k").selectExpr(*_EVENT_COLUMNS)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_book_events(table(spark, sf_dir, "events"))


def newest_events(spark: SparkSession, sf_dir: str, n: int, condition: str) -> DataFrame:
    """The n newest events whose raw row meets a condition; only those are parsed and mapped."""
    newest = table(spark, sf_dir, "events").where(condition).orderBy(
        F.desc_nulls_last("ts"), F.desc("event_id")
    )
    return as_book_events(newest.limit(n))


def bodies_of(events: DataFrame) -> DataFrame:
    """A batch body per event: its own request and a credit event; views send a bare object.

    Works on batches and streams.
    """
    own = F.struct(
        F.col("event_type"),
        F.col("position_id").cast("string").alias("position_id"),
        "side",
        F.col("qty").cast("double").alias("qty"),
        F.col("price").cast("double").alias("price"),
        F.col("new_mark").cast("double").alias("new_mark"),
        "from_rating",
    )
    extra = F.struct(
        F.lit(S.CREDIT_EVENT).alias("event_type"),
        F.col("position_id").cast("string").alias("position_id"),
        F.lit("BB").alias("from_rating"),
    )
    array = F.concat(F.lit("["), F.to_json(own), F.lit(","), F.to_json(extra), F.lit("]"))
    body = F.when(F.col("event_type") == "VIEW", F.to_json(own)).otherwise(array)
    return events.select("event_id", "event_ts", body.alias("body"))


def stream_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 64, spread: bool = False) -> DataFrame:
    """The events as a stream; ``spread`` deals the raw rows over tasks, however few row groups hold them."""
    raw = (
        spark.readStream.schema(TABLE_SCHEMAS["events"])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{sf_dir}/events*.parquet")
    )
    if spread:
        raw = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id", "user_id", "ts")
    return as_book_events(raw)


def load_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per position. Nation and region are lookups of fixed size, left to Catalyst's check."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, nation.n_regionkey == region.r_regionkey, "left")
        .selectExpr(*_POSITION_COLUMNS)
    )
