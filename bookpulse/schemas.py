"""Table schemas and the fixed vocabulary of the book."""

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("ingested_ts", T.TimestampNTZType()),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("position_id", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("qty", T.DecimalType(18, 2)),
    T.StructField("price", T.DecimalType(10, 4)),
    T.StructField("counterparty", T.StringType()),
    T.StructField("prev_mark", T.DecimalType(10, 4)),
    T.StructField("new_mark", T.DecimalType(10, 4)),
    T.StructField("mark_source", T.StringType()),
    T.StructField("from_rating", T.StringType()),
    T.StructField("to_rating", T.StringType()),
    T.StructField("agency", T.StringType()),
    T.StructField("payload", T.VariantType()),
    T.StructField("source_app", T.StringType()),
])

POSITION_SCHEMA = T.StructType([
    T.StructField("position_id", T.StringType(), False),
    T.StructField("issuer", T.StringType(), False),
    T.StructField("sector", T.StringType(), False),
    T.StructField("tranche", T.StringType(), False),
    T.StructField("par_amount", T.DecimalType(18, 2), False),
    T.StructField("original_spread_bps", T.DecimalType(8, 1), False),
    T.StructField("vintage_year", T.IntegerType(), False),
    T.StructField("fund", T.StringType(), False),
    T.StructField("watchlist", T.BooleanType()),
    T.StructField("current_rating", T.StringType()),
    T.StructField("baseline_mark", T.DecimalType(10, 4), False),
])

CONFIG_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType()),
    T.StructField("updated", T.TimestampNTZType()),
])

# One ingest request. Numbers arrive as doubles and become decimals in `normalise`.
REQUEST_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("position_id", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("prev_mark", T.DoubleType()),
    T.StructField("new_mark", T.DoubleType()),
    T.StructField("mark_source", T.StringType()),
    T.StructField("from_rating", T.StringType()),
    T.StructField("to_rating", T.StringType()),
    T.StructField("agency", T.StringType()),
    T.StructField("payload", T.StringType()),
])

METRIC_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("value", T.DoubleType()),
])

# Names and lists that have to match what producers send.
TRADE, MARK, CREDIT_EVENT = "TRADE", "MARK", "CREDIT_EVENT"
WARMUP = "WARMUP"
WARMUP_SOURCE = "warmup"
REQUEST_TYPES = ["TRADE", "MARK", "CREDIT_EVENT"]
RATING_LADDER = [
    "AAA", "AA+", "AA", "AA-", "A+", "A", "A-",
    "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-",
    "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C", "D",
]
NOT_RATED = "NR"
RECOVERABLE_ERRORS = ["token has expired", "invalid state", "invalidchannelerror", "unauthorized"]
SILENT_RESPONSE_EVENTS = [
    "response.thinking.delta", "response.thinking", "response.status",
    "response.tool_use", "response.tool_result", "response.tool_result.status",
    "response", "response.text",
]
LATENCY_METRIC = "credit_ingest_latency_ms"
THROUGHPUT_METRIC = "credit_events_per_min"
ISSUER_METRIC = "credit_issuer_event_count"
ERROR_METRIC = "credit_error_count"
