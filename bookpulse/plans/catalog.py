"""Every query by name, bound to the benchmark tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse import schemas as S
from bookpulse.functions import money, ratings, text
from bookpulse.functions.time import Clock, bin_start, hour_of, millis_between, seconds_between
from bookpulse.operators import chat, ingest, latency, profile, quality, search, series, upsert
from bookpulse.operators.latest import latest_by, pick_random, retain_newest
from bookpulse.operators.snapshot import portfolio_live, portfolio_table, portfolio_view
from bookpulse.plans import desk, questions
from bookpulse.plans.model import BOOK, Between, query_model
from bookpulse.session import work_dir
from bookpulse.sources import book, stored, tables
from bookpulse.streaming import jobs
from bookpulse.streaming.names import NameIndex


class Book:
    """The tables one query works on, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return book.table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return book.load_events(self.spark, self.sf_dir)

    @cached_property
    def positions(self) -> DataFrame:
        return book.load_positions(self.spark, self.sf_dir)

    @cached_property
    def clock(self) -> Clock:
        return Clock.latest(self.table("events"), "ts")

    @cached_property
    def live(self) -> DataFrame:
        return portfolio_live(self.events, self.positions, self.clock)

    @cached_property
    def raw(self) -> DataFrame:
        """Events as stored with the k of their payload, parsed once per row."""
        return self.table("events").selectExpr("*", f"{book.K} AS k")

    @cached_property
    def traces(self) -> DataFrame:
        """A latency trace per event, from its value and the k of its payload."""
        k = F.col("k")
        flush = (F.lit(30) + k % 50).cast("double")
        append = (k % 7).cast("double")
        roundtrip = F.col("value") + flush + append
        failed = (F.col("event_type") == "error") & (k >= 90)
        return (
            self.raw.select(
                "event_id",
                F.col("ts").alias("event_ts"),
                F.col("user_id").alias("position_id"),
                F.col("event_type"),
                append.alias("sdk_appended_ms"),
                flush.alias("flush_committed_ms"),
                (append + flush).alias("total_handler_ms"),
                roundtrip.alias("roundtrip_ms"),
                F.when(F.col("event_type") != "view", roundtrip + k - 10).alias("visible_ms"),
                F.when(failed, "timeout").alias("error"),
            )
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Metric observations with JSON text in ``extra`` and ``fields``."""
        kind = F.col("event_type")
        metric = (
            F.when(kind == "purchase", S.THROUGHPUT_METRIC)
            .when(kind == "click", S.LATENCY_METRIC)
            .when(kind == "error", S.ERROR_METRIC)
            .otherwise(S.ISSUER_METRIC)
        )
        issuer = F.concat(F.lit("issuer-"), F.col("user_id").cast("string"))
        value = F.when(metric == S.ISSUER_METRIC, F.col("event_id").cast("double")).otherwise(
            F.col("value")
        )
        return self.table("events").select(
            "ts",
            F.when(kind == "view", "trace").otherwise("http").alias("observation_kind"),
            F.to_json(F.struct(metric.alias("metric_name"), issuer.alias("issuer"))).alias("extra"),
            F.to_json(F.struct(value.alias("value"))).alias("fields"),
        )

    def points(self, *metrics: str) -> DataFrame:
        return series.metric_points(self.observations, "http", list(metrics))

    @cached_property
    def store(self) -> DataFrame:
        """Metric points as recorded by name, one series per event type."""
        return self.table("events").select(
            "event_id", "ts", F.col("event_type").alias("metric"), "value"
        )

    @cached_property
    def errors(self) -> DataFrame:
        """An error log row per credit event."""
        message = (
            F.when(F.col("k") % 5 == 0, "Token has EXPIRED for channel")
            .when(F.col("k") % 5 == 1, "channel in Invalid State")
            .when(F.col("k") % 5 == 2, "InvalidChannelError: closed")
            .when(F.col("k") % 5 == 3, "401 Unauthorized")
            .otherwise("connection reset by peer")
        )
        return self.raw.where("event_type = 'error'").select(
            F.col("event_id").alias("error_id"), "ts", message.alias("error")
        )

    def newest(self, n: int, condition: str) -> DataFrame:
        return book.newest_events(self.spark, self.sf_dir, n, condition)

    @cached_property
    def bodies(self) -> DataFrame:
        return book.bodies_of(self.events)

    @cached_property
    def requests(self) -> DataFrame:
        requests = ingest.explode_batches(self.bodies)
        return requests.withColumnRenamed("event_id", "body_id")

    @cached_property
    def answer_log(self) -> DataFrame:
        """Conversation turns logged as answer events, each payload shape in turn."""
        part = F.struct(F.lit("text").alias("type"), "text")
        other = F.struct(F.lit("chart").alias("type"), F.lit("x").alias("text"))
        delta = F.struct(F.array(part, other).alias("content"))
        single = F.struct(F.struct(F.lit("text").alias("type"), "text").alias("content"))
        choice = F.struct(F.struct(F.col("text").alias("content")).alias("delta"))
        shape = F.col("turn") % 5
        data = (
            F.when(shape == 0, F.to_json(F.struct(delta.alias("delta"))))
            .when(shape == 1, F.to_json(F.struct(F.array(choice).alias("choices"))))
            .when(shape == 2, F.to_json(F.struct("text")))
            .when(shape == 3, F.to_json(F.struct(F.array(part, other).alias("content"))))
            .otherwise(F.to_json(F.struct(single.alias("delta"))))
        )
        broken = (F.col("conv_id") % 7 == 3) & (F.col("turn") % 4 == 1)
        data = F.when(broken, F.to_json(F.struct(F.col("role").alias("message")))).otherwise(data)
        event_type = (
            F.when(broken, "error")
            .when(F.col("role") == "system", "response.status")
            .otherwise("response.text.delta")
        )
        return self.table("conversations").select(
            F.col("conv_id").alias("response_id"),
            F.col("turn").alias("seq"),
            event_type.alias("event_type"),
            data.alias("data"),
        )

    def model(self, dims: list[str], measures: list[str], **options) -> DataFrame:
        sources = {"events": self.events, "positions": self.positions, "live": self.live}
        return query_model(BOOK, sources, dims, measures, **options)


def _seed_values(b: Book) -> DataFrame:
    """The rating ladder written out as a relation, with the positions on each grade."""
    rows = [(g, i + 1) for i, g in enumerate([*S.RATING_LADDER, S.NOT_RATED])]
    ladder = tables.literal_rows(b.spark, rows, "rating string, place int")
    held = b.positions.groupBy(F.col("current_rating").alias("rating")).agg(
        F.count("*").alias("held")
    )
    return ladder.join(held, "rating", "left").select(
        "rating", "place", F.coalesce("held", F.lit(0).cast("bigint")).alias("held")
    )


def _merge_insert_only(b: Book) -> DataFrame:
    """Positions with events already exist; all positions arrive under another fund name."""
    columns = ["position_id", "issuer", "sector", "fund"]
    seen = b.events.select("position_id").distinct()
    target = b.positions.join(seen, "position_id", "left_semi").select(*columns)
    source = b.positions.withColumn("fund", F.concat(F.lit("NEW "), F.col("fund"))).select(*columns)
    return upsert.merge_insert_only(target, source, "position_id")


def _settings(b: Book) -> tuple[DataFrame, DataFrame]:
    """Customer balances as settings; the latest order of each customer overwrites its value."""
    target = b.table("customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_mktsegment").alias("value"),
        b.clock.ago(days=1).alias("updated"),
    )
    orders = b.table("orders").select(
        F.col("o_custkey").alias("key"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value"),
        "o_orderdate",
        "o_orderkey",
    )
    source = latest_by(orders, ["key"], ["value"], order=("o_orderdate", "o_orderkey"))
    return target, source


def _merge_upsert(b: Book) -> DataFrame:
    target, source = _settings(b)
    return upsert.merge_upsert(target, source, "key", b.clock.now())


def _update_where(b: Book) -> DataFrame:
    orders = b.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return upsert.update_where(
        orders,
        F.col("o_orderstatus") == "F",
        {"o_orderpriority": F.concat(F.lit("closed "), F.col("o_orderpriority"))},
    )


def _plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison across engines."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _latest(b: Book, event_type: str, columns: list[str]) -> DataFrame:
    latest = latest_by(
        b.events.where(F.col("position_id").isNotNull()),
        ["position_id"],
        ["event_ts", *columns],
        where=F.col("event_type") == event_type,
    )
    return _plain_numbers(latest)


def _error_classify(b: Book) -> DataFrame:
    return b.errors.select(
        "error_id", "error", text.is_recoverable(F.col("error")).alias("recoverable")
    )


def _normalised(b: Book) -> DataFrame:
    good = ingest.accepted(ingest.validate(b.requests))
    rows = ingest.normalise(
        good.withColumn("event_id", F.concat_ws("-", "body_id", "seq")), F.col("event_ts")
    )
    return _plain_numbers(rows.drop("payload"))


def _validate_split(b: Book) -> DataFrame:
    """Both outcomes in one pass over the requests."""
    outcome = F.when(ingest.is_accepted(), "accepted").otherwise("quarantined")
    return ingest.validate(b.requests).select(
        "body_id", "seq", outcome.alias("outcome"), F.array_join("reasons", "; ").alias("reasons")
    )


def _scalar_nulls(b: Book) -> DataFrame:
    return b.events.select(
        "event_id",
        F.coalesce("side", F.lit("")).alias("side"),
        F.nullif("counterparty", F.lit("CP-0")).alias("not_cp_0"),
        F.when(F.col("new_mark") > 50, "above").when(F.col("new_mark") <= 50, "below").alias("band"),
        F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"),
    ).fillna({"band": "none"})


def _scalar_math(b: Book) -> DataFrame:
    mark, base = F.col("new_mark"), F.col("prev_mark")
    move = mark - base
    return b.events.where(mark.isNotNull()).select(
        "event_id",
        money.rounded(mark, 1).alias("mark_1"),
        money.rounded(move).alias("move_0"),
        F.abs(move).cast("double").alias("abs_move"),
        F.greatest(move, F.lit(0).cast("decimal(10,4)")).cast("double").alias("gain"),
        money.mark_change_bps(mark, base).cast("double").alias("bps"),
        money.rounded(money.pnl(mark, base, F.lit(1000000).cast("decimal(18,2)")), 2).alias("pnl"),
        latency.bucket(mark.cast("double") * 5).alias("grade"),
    )


def _scalar_time(b: Book) -> DataFrame:
    ts, arrived = F.col("event_ts"), F.col("ingested_ts")
    return b.events.select(
        "event_id",
        (ts - F.expr("interval 90 minutes")).alias("earlier"),
        hour_of(ts).alias("hour"),
        bin_start(ts, 300).alias("five_minutes"),
        millis_between(ts, arrived).alias("millis"),
        seconds_between(ts, b.clock.now()).alias("age_seconds"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("written"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").cast("timestamp_ntz").alias("read_back"),
    )


def _scalar_string(b: Book) -> DataFrame:
    labels = F.create_map(
        F.lit("type"), F.col("event_type"), F.lit("app"), F.col("source_app")
    )
    return b.events.select(
        "event_id",
        F.format_string("POS-%04d", F.col("position_id")).alias("padded"),
        text.short_id(F.col("event_id"), F.col("event_type")).alias("short_id"),
        text.event_label(F.col("event_id"), F.col("event_type")).alias("label"),
        text.series_name(F.lit("events"), labels).alias("series"),
    )


def _scalar_json(b: Book) -> DataFrame:
    written = F.to_json(F.struct("event_type", F.struct("position_id").alias("at")))
    body, parsed = F.col("body"), F.col("parsed")
    encoded = b.events.withColumn("body", written).withColumn("parsed", F.try_parse_json("body"))
    return encoded.select(
        "event_id",
        "body",
        F.variant_get(parsed, "$.event_type", "string").alias("event_type"),
        F.variant_get(parsed, "$.at.position_id", "bigint").alias("position_id"),
        F.variant_get("payload", "$.k", "double").alias("k"),
        F.try_parse_json(F.concat(F.lit("{"), body)).isNull().alias("broken_is_null"),
    )


def _scalar_hash(b: Book) -> DataFrame:
    keys = b.positions.select("position_id", "issuer")
    return keys.select(
        "position_id",
        text.channel_of(F.format_string("POS-%04d", F.col("position_id")), 4).alias("channel"),
        text.channel_of(F.col("issuer"), 16).alias("issuer_channel"),
    )


def _scalar_ladder(b: Book) -> DataFrame:
    old, new = F.col("from_rating"), F.col("to_rating")
    return b.events.where("event_type = 'CREDIT_EVENT'").select(
        "event_id",
        ratings.ordinal(old).alias("from_place"),
        ratings.ordinal(new).alias("to_place"),
        ratings.notch(old, 1).alias("one_down"),
        ratings.notch(old, -1).alias("one_up"),
        ratings.is_downgrade(old, new).alias("downgrade"),
    )


def _fuzzy_search(b: Book) -> DataFrame:
    catalog = b.table("part").select(
        F.col("p_partkey").alias("position_id"),
        F.col("p_name").alias("issuer"),
        F.col("p_brand").alias("sector"),
        F.col("p_type").alias("tranche"),
    )
    return search.fuzzy_search(
        catalog, ["red widgt", "smal ring", "Blue  BOLT"], attributes=("sector", "tranche")
    )


def _fuzzy_search_table(b: Book) -> DataFrame:
    """The names of every hundredth part against those of all parts."""
    parts = b.table("part")
    catalog = parts.select(F.col("p_partkey").alias("position_id"), F.col("p_name").alias("issuer"))
    queries = parts.where("p_partkey % 100 = 0").select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")
    )
    return search.search_table(catalog, queries)


def _search_index(b: Book) -> DataFrame:
    """The same from an index kept by change: names come in parts, some are wrong at first, some leave."""
    catalog = b.table("part").select(F.col("p_partkey").alias("position_id"), F.col("p_name").alias("issuer"))
    part = F.pmod("position_id", F.lit(3))
    wrong = catalog.where(part == 1).withColumn("issuer", F.reverse("issuer"))
    passing = catalog.where(part == 1).withColumn("position_id", -F.col("position_id"))
    index = NameIndex(work_dir(b.spark, "search-index"), kind=catalog.schema["position_id"].dataType.simpleString(), compact=2)
    index.change(catalog.where(part == 0).unionByName(wrong).unionByName(passing), "first")
    index.change(catalog.where(part == 1), "second")
    leaving = passing.withColumn("gone", F.lit(True))
    index.change(catalog.where(part == 2).withColumn("gone", F.lit(False)).unionByName(leaving), "third")
    queries = catalog.where("position_id % 100 = 0").select(F.col("position_id").alias("query_id"), F.col("issuer").alias("query"))
    return index.search(queries)


def _stored_upsert(b: Book) -> DataFrame:
    """The settings of customers as a stored table: orders are merged in, one value is changed, the nations are added."""
    target, source = _settings(b)
    settings = stored.StoredTable(work_dir(b.spark, "settings"), "key", target.schema)
    settings.create(target)
    settings.upsert(source, b.clock.now())
    settings.update_where(F.col("value") == "1-URGENT", {"value": F.lit("now")})
    nations = b.table("nation").select((-1 - F.col("n_nationkey")).alias("key"), F.col("n_name").alias("value"), b.clock.now().alias("updated"))
    settings.insert_only(nations.unionByName(target))
    return settings.read(b.spark)


def _column_profile_stored(b: Book) -> DataFrame:
    """Frequent values from the stored sketches of days, and whether their distinct counts are near the exact ones."""
    path = work_dir(b.spark, "profile")
    profile.day_sketches(b.events, F.col("event_ts").cast("date"), PROFILED).write.parquet(path)
    merged = profile.merged_profile(b.spark.read.parquet(path))
    exact = b.events.select(*[F.col(c).cast("string").alias(c) for c in PROFILED]).unpivot([], PROFILED, "column_name", "value")
    exact = exact.groupBy("column_name").agg(F.count_distinct("value").alias("exact"))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")
    checked = merged.join(exact, "column_name").select("column_name", "rows", "nulls", near.alias("near_exact"))
    return profile.frequent_values(merged).join(checked, "column_name")


def _stored(b: Book) -> DataFrame:
    return b.events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.EVENT_SCHEMA])


def _event_table(b: Book) -> DataFrame:
    """The event table by day, written in three parts; its closed days are compacted before it is read."""
    path = work_dir(b.spark, "event-table")
    events = _stored(b).where("event_ts is not null")
    for k in range(3):
        tables.write_events(events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), path)
    tables.compact_days(b.spark, path, F.current_date())
    return tables.read_events(b.spark, path).groupBy("event_date", "event_type").agg(
        F.count("*").alias("events"),
        F.sum(F.col("event_id").cast("long")).alias("ids"),
        F.count_distinct("_metadata.file_path").alias("files"),
    )


def _interleaved_events(b: Book) -> DataFrame:
    """The events of one position, of one hour and of both, from files in interleaved order."""
    path = work_dir(b.spark, "interleaved")
    tables.write_interleaved(_stored(b).select("event_id", "event_ts", "position_id"), path, ["position_id", "event_ts"], files=16)
    rows = b.spark.read.parquet(path)
    one, hour = F.col("position_id") == "7", F.col("event_ts") >= b.clock.ago(hours=1)
    found = {"position": one, "hour": hour, "both": one & hour}
    asked = [rows.where(test).agg(F.lit(name).alias("asked"), F.count("*").alias("events"), F.max(F.col("event_id").cast("long")).alias("last")) for name, test in found.items()]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


def _metric_summary(b: Book) -> DataFrame:
    asked = [("purchase",), ("click",), ("error",), ("signup",), ("view",), ("missing",)]
    metrics = tables.literal_rows(b.spark, asked, "metric string")
    return series.metric_summary(b.store, b.clock, metrics, window_seconds=86400)


def _four_places(df: DataFrame) -> DataFrame:
    """Values rounded, for comparison across engines."""
    return df.withColumn("value", F.round("value", 4))


#: Conditions on raw rows that leave out warm-up, or keep trades.
NOT_SIGNUP, IS_TRADE = "event_type IS DISTINCT FROM 'signup'", "event_type = 'purchase'"
PROFILED = ["event_type", "side", "counterparty", "mark_source", "from_rating", "agency", "source_app"]

QUERIES = {
    # Snapshot
    "portfolio_view": lambda b: _plain_numbers(portfolio_view(b.live)),
    "portfolio_live_table": lambda b: _plain_numbers(portfolio_table(b.live, b.clock)),
    "latest_mark": lambda b: _latest(b, S.MARK, ["new_mark"]),
    "latest_rating": lambda b: _latest(b, S.CREDIT_EVENT, ["to_rating"]),
    "latest_trade": lambda b: _latest(b, S.TRADE, ["side", "qty", "price", "counterparty"]),
    # Dashboard
    "tape": lambda b: _plain_numbers(desk.tape(b.newest(30, NOT_SIGNUP), b.positions)),
    "tape_display": lambda b: _plain_numbers(
        tables.keep_existing(desk.tape(b.newest(30, NOT_SIGNUP), b.positions), desk.TAPE_DISPLAY)
    ),
    "pnl_today": lambda b: desk.pnl_today(b.live),
    "sector_exposure": lambda b: desk.sector_exposure(b.positions),
    "top_marks": lambda b: desk.top_marks(b.live),
    "watchlist": lambda b: desk.watchlist(b.live),
    "watchlist_count": lambda b: desk.watchlist_count(b.positions),
    "hourly_trades": lambda b: desk.hourly_trades(b.events, b.clock),
    "event_count": lambda b: desk.event_count(b.events, b.clock),
    "ingest_latency_exact": lambda b: desk.ingest_latency_exact(b.events, b.clock, 1440),
    "ingest_latency_approx": lambda b: desk.ingest_latency(b.events, b.clock, 1440),
    "refresh_lag": lambda b: desk.refresh_lag(b.live, b.clock),
    "throughput": lambda b: desk.throughput(b.events, b.clock, 1440),
    # Questions
    "pnl_by_sector": lambda b: questions.pnl_by_sector(b.live),
    "fund_pnl": lambda b: questions.fund_pnl(b.live),
    "top_sectors_by_par": lambda b: questions.top_sectors_by_par(b.positions),
    "top_five_marks": lambda b: desk.top_marks(b.live, 5),
    "fund_exposure": lambda b: desk.exposure(b.positions, "fund"),
    "latest_trades": lambda b: questions.latest_trades(b.newest(10, IS_TRADE), b.positions),
    "most_recent_trade": lambda b: questions.latest_trades(b.newest(1, IS_TRADE), b.positions, 1),
    "downgrades": lambda b: questions.downgrades(b.events, b.positions),
    "watchlist_downgrades": lambda b: questions.watchlist_downgrades(b.events, b.positions),
    "issuer_exposure": lambda b: questions.issuer_exposure(
        b.live, b.positions, "custmer 000000007"
    ),
    "recent_marks_for_issuer": lambda b: questions.recent_marks_for_issuer(
        b.events, b.positions, b.clock, "Customr#000000007", hours=720
    ),
    "latest_mark_per_issuer": lambda b: questions.latest_mark_per_issuer(b.events, b.positions),
    "changed_last_hour": lambda b: questions.changed_since(b.events, b.clock),
    # Series and latency
    "timechart_avg": lambda b: _four_places(
        series.average_chart(b.points(S.LATENCY_METRIC, S.THROUGHPUT_METRIC), b.clock)
    ),
    "timechart_sum": lambda b: _four_places(series.total_chart(b.points(S.ERROR_METRIC), b.clock)),
    "top_issuers": lambda b: series.top_issuers(b.points(S.ISSUER_METRIC), b.clock),
    "metric_summary": _metric_summary,
    "latency_segments": lambda b: latency.segments(b.traces, "position_id"),
    "latency_summary": lambda b: latency.summary(b.traces, ["event_type"]),
    "retain_last_n": lambda b: retain_newest(b.store, ["metric"], 1000, ("ts", "event_id")),
    "random_pick": lambda b: pick_random(b.positions.select("position_id", "issuer"), "position_id", 5, 7),
    # Ingest, quality, upserts
    "json_batch_explode": lambda b: b.requests.drop("event_ts", "payload", "raw"),
    "validate_split": _validate_split,
    "normalise_events": _normalised,
    "dq_report": lambda b: quality.dq_report(b.events, b.positions, b.table("events")),
    "batch_end_offsets": lambda b: ingest.end_offsets(b.events),
    "partition_counts": lambda b: ingest.channel_counts(b.events),
    "error_classify": _error_classify,
    "error_counts": lambda b: ingest.error_counts(b.errors),
    "error_status": lambda b: ingest.error_status(b.errors),
    "event_lookup": lambda b: tables.find_event(b.events, 777).select("event_id", "event_ts", "event_type"),
    "seed_values": _seed_values,
    "merge_insert_only": _merge_insert_only,
    "merge_upsert": _merge_upsert,
    "update_where": _update_where,
    # Scalar functions
    "scalar_nulls": _scalar_nulls,
    "scalar_math": _scalar_math,
    "scalar_time": _scalar_time,
    "scalar_string": _scalar_string,
    "scalar_json": _scalar_json,
    "scalar_hash": _scalar_hash,
    "scalar_ladder": _scalar_ladder,
    # Model, search, text
    "model_pnl_by_sector": lambda b: b.model(["sector"], ["pnl"]),
    "model_events_by_type": lambda b: b.model(["event_type"], ["events", "last_event"]),
    "model_trades_by_fund": lambda b: b.model(
        ["fund", "side"], ["trades", "traded_qty"], where={"event_type": [S.TRADE]}
    ),
    "model_par_by_tranche": lambda b: b.model(["tranche", "watchlist"], ["par", "positions"]),
    "column_profile": lambda b: profile.sample_values(b.events, PROFILED),
    "column_summary": lambda b: profile.column_summary(b.events, PROFILED),
    "fuzzy_search": _fuzzy_search,
    "fuzzy_search_table": _fuzzy_search_table,
    "model_recent_by_type": lambda b: b.model(
        ["event_type"], ["events"], where={"event_ts": Between(b.clock.ago(hours=24), b.clock.now())}
    ),
    "search_index": _search_index,
    "stored_upsert": _stored_upsert,
    "column_profile_stored": _column_profile_stored,
    "event_table": _event_table,
    "interleaved_events": _interleaved_events,
    "model_checked_keys": lambda b: b.model(["fund"], ["trades", "traded_qty"], check_keys=True),
    "conversation_history": lambda b: chat.conversation_history(b.table("conversations")),
    "conversation_parts": lambda b: chat.history_parts(b.table("conversations")),
    "event_log_text": lambda b: chat.answer_text(b.answer_log),
    # Streams
    "stream_ingest": lambda b: jobs.run_ingest(b.spark, b.sf_dir),
    "stream_requests": lambda b: jobs.run_requests(b.spark, b.sf_dir),
    "stream_quarantine": lambda b: jobs.run_quarantine(b.spark, b.sf_dir),
    "stream_dedupe": lambda b: jobs.run_dedupe(b.spark, b.sf_dir),
    "stream_latest_state": lambda b: jobs.run_latest_state(b.spark, b.sf_dir),
    "stream_live_state": lambda b: jobs.run_live_state(b.spark, b.sf_dir),
    "stream_hourly_trades": lambda b: jobs.run_hourly_trades(b.spark, b.sf_dir),
    "stream_throughput": lambda b: jobs.run_throughput(b.spark, b.sf_dir),
    "stream_latency": lambda b: jobs.run_latency(b.spark, b.sf_dir),
    "stream_enrich": lambda b: jobs.run_enrich(b.spark, b.sf_dir),
    "stream_downgrades": lambda b: jobs.run_downgrades(b.spark, b.sf_dir),
    "stream_portfolio": lambda b: jobs.run_portfolio(b.spark, b.sf_dir),
    "stream_health": lambda b: jobs.run_health(b.spark, b.sf_dir),
    "stream_snapshot_changes": lambda b: _plain_numbers(jobs.run_snapshot_changes(b.spark, b.sf_dir)),
    "stream_state_expiry": lambda b: jobs.run_state_expiry(b.spark, b.sf_dir),
    "stream_latency_sliding": lambda b: jobs.run_latency_sliding(b.spark, b.sf_dir),
    "stream_observed_health": lambda b: jobs.run_observed_health(b.spark, b.sf_dir),
    "stream_end_offsets": lambda b: jobs.run_end_offsets(b.spark, b.sf_dir),
}


_OPEN: dict[tuple, Book] = {}


def open_book(spark: SparkSession, sf_dir: str) -> Book:
    """The tables of a folder, set up once per session like views. No data is cached."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Book(spark, sf_dir)
    return _OPEN[key]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](open_book(spark, sf_dir))
