"""The same results in plain SQL over the benchmark tables, written independently of the jobs:
row numbers where the jobs use max_by, sorted positions where they use slabs.
"""

from __future__ import annotations

from bookpulse.schemas import RATING_LADDER

_LADDER = "[" + ", ".join(f"'{g}'" for g in RATING_LADDER) + "]"

_BASE = f"""
WITH raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), ev AS (
  SELECT event_id, ts AS event_ts, ts + k * INTERVAL 1 MILLISECOND AS ingested_ts,
    CASE event_type WHEN 'purchase' THEN 'TRADE' WHEN 'click' THEN 'MARK'
      WHEN 'error' THEN 'CREDIT_EVENT' WHEN 'signup' THEN 'WARMUP' WHEN 'view' THEN 'VIEW' END
      AS event_type,
    user_id AS position_id,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END END AS side,
    CASE WHEN event_type = 'purchase' THEN CAST(k * 100 AS DECIMAL(18,2)) END AS qty,
    CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(10,4)) END AS price,
    CASE WHEN event_type = 'purchase' THEN 'CP-' || (k % 10) END AS counterparty,
    CASE WHEN event_type = 'click' THEN CAST(50 AS DECIMAL(10,4)) END AS prev_mark,
    CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(10,4)) END AS new_mark,
    CASE WHEN event_type = 'click' THEN 'SRC-' || (k % 5) END AS mark_source,
    CASE WHEN event_type = 'error' THEN ({_LADDER})[k % 22 + 1] END AS from_rating,
    CASE WHEN event_type = 'error' THEN ({_LADDER})[(k * 7) % 22 + 1] END AS to_rating,
    CASE WHEN event_type = 'error' THEN 'AG-' || (k % 3) END AS agency,
    CASE WHEN event_type = 'signup' THEN 'warmup' ELSE 'app' END AS source_app
  FROM raw
), pos AS (
  SELECT c_custkey AS position_id, c_name AS issuer, c_mktsegment AS sector, r_name AS tranche,
    CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS par_amount, n_name AS fund,
    c_custkey % 10 = 0 AS watchlist, ({_LADDER})[c_custkey % 22 + 1] AS current_rating,
    CAST(50 AS DECIMAL(10,4)) AS baseline_mark
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
), clock AS (
  SELECT max(ts) AS now FROM events
), day AS (
  SELECT * FROM ev WHERE event_ts >= (SELECT now FROM clock) - INTERVAL 24 HOUR
), ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY position_id, event_type ORDER BY event_ts DESC, event_id DESC) AS rn
  FROM day
), live AS (
  SELECT p.position_id, p.issuer, p.sector, p.tranche, p.par_amount, p.fund, p.watchlist,
    coalesce(m.new_mark, p.baseline_mark) AS current_mark, p.baseline_mark AS opening_mark,
    (coalesce(m.new_mark, p.baseline_mark) - p.baseline_mark) * 100 AS mark_change_bps,
    (coalesce(m.new_mark, p.baseline_mark) - p.baseline_mark) * p.par_amount * 0.01 AS pnl_today,
    coalesce(r.to_rating, p.current_rating) AS rating,
    t.side AS last_trade_side, t.qty AS last_trade_qty, t.price AS last_trade_price,
    t.counterparty AS last_trade_cpty, t.event_ts AS last_trade_ts,
    c.latest_event_ts, coalesce(c.n, 0) AS events_today
  FROM pos p
    LEFT JOIN (SELECT * FROM ranked WHERE rn = 1 AND event_type = 'MARK') m USING (position_id)
    LEFT JOIN (SELECT * FROM ranked WHERE rn = 1 AND event_type = 'CREDIT_EVENT') r USING (position_id)
    LEFT JOIN (SELECT * FROM ranked WHERE rn = 1 AND event_type = 'TRADE') t USING (position_id)
    LEFT JOIN (SELECT position_id, count(*) AS n, max(event_ts) AS latest_event_ts
               FROM day GROUP BY position_id) c USING (position_id)
)
"""

_TRACE = """
, trace AS (
  SELECT event_id, ts AS event_ts, user_id AS position_id, event_type,
    CAST(k % 7 AS DOUBLE) AS sdk_appended_ms, CAST(30 + k % 50 AS DOUBLE) AS flush_committed_ms,
    CAST(k % 7 AS DOUBLE) + CAST(30 + k % 50 AS DOUBLE) AS total_handler_ms,
    value + CAST(30 + k % 50 AS DOUBLE) + CAST(k % 7 AS DOUBLE) AS roundtrip_ms,
    CASE WHEN event_type <> 'view'
      THEN value + CAST(30 + k % 50 AS DOUBLE) + CAST(k % 7 AS DOUBLE) + k - 10 END AS visible_ms,
    CASE WHEN event_type = 'error' AND k >= 90 THEN 'timeout' END AS error
  FROM raw
)
"""

_POINTS = """
, points AS (
  SELECT ts,
    CASE event_type WHEN 'purchase' THEN 'credit_events_per_min'
      WHEN 'click' THEN 'credit_ingest_latency_ms' WHEN 'error' THEN 'credit_error_count'
      ELSE 'credit_issuer_event_count' END AS metric,
    'issuer-' || user_id AS issuer, event_id, value
  FROM events WHERE event_type <> 'view'
), bins AS (
  SELECT unnest(generate_series(
    date_trunc('hour', now - INTERVAL 24 HOUR), date_trunc('hour', now), INTERVAL 1 HOUR)) AS bin
  FROM clock
)
"""

_REQUESTS = """
, batch AS (
  SELECT event_id AS body_id, event_ts, 0 AS seq, event_type,
    CAST(position_id AS VARCHAR) AS position_id, side, CAST(qty AS DOUBLE) AS qty,
    CAST(price AS DOUBLE) AS price, CAST(new_mark AS DOUBLE) AS new_mark, from_rating
  FROM ev WHERE event_type <> 'VIEW'
  UNION ALL
  SELECT event_id, event_ts, 1, 'CREDIT_EVENT', CAST(position_id AS VARCHAR), NULL, NULL, NULL,
    NULL, 'BB'
  FROM ev WHERE event_type <> 'VIEW'
  UNION ALL
  SELECT event_id, event_ts, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM ev WHERE event_type = 'VIEW'
)
"""


def _q(select: str, *more: str) -> str:
    return _BASE + "".join(more) + select


def _latest(event_type: str, columns: str) -> str:
    return _q(f"""
SELECT position_id, event_ts, {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY event_ts DESC, event_id DESC) AS r
  FROM ev WHERE event_type = '{event_type}' AND position_id IS NOT NULL) WHERE r = 1
""")


_DOUBLES = "CAST({0} AS DOUBLE) AS {0}"


def _d(*names: str) -> str:
    return ", ".join(_DOUBLES.format(n) for n in names)


_TAPE_HEAD = "ingested_ts, event_type, position_id, issuer, sector"
_TAPE_BODY = f"""
  coalesce(side, '') AS side, CAST(coalesce(qty, 0) AS DOUBLE) AS qty,
  {_d('price', 'prev_mark', 'new_mark')},
  coalesce(from_rating, '') AS from_rating, coalesce(to_rating, '') AS to_rating,
  coalesce(counterparty, '') AS counterparty,
  epoch_ms(ingested_ts) - epoch_ms(event_ts) AS latency_ms
"""
_TAPE_FROM = """
FROM ev LEFT JOIN pos USING (position_id)
WHERE coalesce(source_app, '') <> 'warmup'
ORDER BY event_ts DESC, event_id DESC LIMIT 30
"""


def _top_marks(n: int) -> str:
    return _q(f"""
SELECT position_id, issuer, sector, tranche, {_d('current_mark')},
  CAST(round(mark_change_bps, 1) AS DOUBLE) AS mark_change_bps,
  CAST(round(pnl_today, 0) AS DOUBLE) AS pnl_today, fund
FROM live ORDER BY abs(live.mark_change_bps) DESC, position_id LIMIT {n}
""")


def _exposure(by: str) -> str:
    return _q(f"""
SELECT {by}, CAST(round(sum(par_amount), 0) AS DOUBLE) AS total_par,
  round(CAST(sum(par_amount) AS DOUBLE) / CAST(sum(sum(par_amount)) OVER () AS DOUBLE) * 100, 1) AS pct
FROM live GROUP BY {by}
""")


def _pnl_by(column: str) -> str:
    return _q(f"""
SELECT {column}, CAST(round(sum(pnl_today), 2) AS DOUBLE) AS pnl, count(*) AS positions
FROM live GROUP BY {column}
""")


def _trades(n: int) -> str:
    return _q(f"""
SELECT event_id, event_ts, position_id, issuer, fund, side, {_d('qty', 'price')}, counterparty
FROM ev LEFT JOIN pos USING (position_id) WHERE event_type = 'TRADE'
ORDER BY event_ts DESC, event_id DESC LIMIT {n}
""")


_DOWN = f"""
, down AS (
  SELECT * FROM ev WHERE event_type = 'CREDIT_EVENT'
    AND list_position({_LADDER}, to_rating) > list_position({_LADDER}, from_rating)
)
"""

_GRAMS = """list_distinct([substr('  ' || {0} || ' ', i, 3) for i in range(1, length({0}) + 2)])"""
_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _search_cte(catalog: str, terms: list[str], name: str) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""
, {name}_terms AS (
  SELECT query_id, query, text, {_GRAMS.format('text')} AS grams FROM (
    SELECT *, {_NORM.format('query')} AS text FROM (VALUES {values}) v(query_id, query))
), {name}_names AS (
  SELECT *, {_GRAMS.format('plain')} AS name_grams FROM (
    SELECT *, {_NORM.format('issuer')} AS plain FROM {catalog})
), {name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, position_id) AS rank
  FROM (
    SELECT n.*, query_id, query,
      len(list_intersect(name_grams, grams)) * 1.0::DOUBLE
        / len(list_distinct(list_concat(name_grams, grams))) AS score,
      levenshtein(plain, text) AS distance
    FROM {name}_names n, {name}_terms) WHERE score > 0
)
"""


def _found(term: str) -> str:
    return _search_cte("pos", [term], "found")


def _hash(key: str, n: int) -> str:
    return (
        f"list_reduce(list_prepend(0::BIGINT, [unicode(c)::BIGINT for c in string_split({key}, '')]),"
        f" lambda a, c: (a * 31 + c) % {n})"
    )


_PROFILED = ["event_type", "side", "counterparty", "mark_source", "from_rating", "agency", "source_app"]
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value FROM ev" for c in _PROFILED
)


def _checks(table: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) AS failures FROM {table} WHERE {test}"
        for name, test in checks.items()
    )


_NN_EV = {f"not_null:{c}": f"{c} IS NULL" for c in ["event_id", "event_ts", "event_type", "position_id"]}
_NN_POS = {
    f"not_null:{c}": f"{c} IS NULL"
    for c in ["issuer", "sector", "tranche", "par_amount", "fund", "baseline_mark"]
}

_NORMAL = f"""
SELECT body_id || '-' || seq AS event_id, event_ts, event_ts AS ingested_ts, event_type, position_id,
  CASE WHEN event_type = 'TRADE' THEN side END AS side,
  CASE WHEN event_type = 'TRADE' THEN qty END AS qty,
  CASE WHEN event_type = 'TRADE' THEN price END AS price,
  NULL::VARCHAR AS counterparty, NULL::DOUBLE AS prev_mark,
  CASE WHEN event_type = 'MARK' THEN new_mark END AS new_mark,
  NULL::VARCHAR AS mark_source,
  CASE WHEN event_type = 'CREDIT_EVENT' THEN from_rating END AS from_rating,
  CASE WHEN event_type = 'CREDIT_EVENT'
    THEN ({_LADDER})[least(list_position({_LADDER}, from_rating) + 1, 22)] END AS to_rating,
  NULL::VARCHAR AS agency, 'app' AS source_app
FROM batch WHERE event_type IN ('TRADE', 'MARK', 'CREDIT_EVENT')
"""

SQL: dict[str, str] = {
    "portfolio_view": _q(f"""
SELECT position_id, issuer, sector, tranche, {_d('par_amount')}, fund, watchlist,
  {_d('current_mark', 'opening_mark', 'mark_change_bps', 'pnl_today')}, rating, last_trade_side,
  {_d('last_trade_qty', 'last_trade_price')}, last_trade_cpty, latest_event_ts, events_today
FROM live
"""),
    "portfolio_live_table": _q(f"""
SELECT position_id, issuer, sector, tranche, {_d('par_amount')}, fund,
  CAST(current_mark AS DOUBLE) AS latest_mark, {_d('mark_change_bps')}, last_trade_ts, last_trade_side,
  {_d('last_trade_qty', 'last_trade_price')}, rating AS current_rating, watchlist,
  CAST(round(pnl_today, 2) AS DOUBLE) AS pnl_today,
  coalesce(latest_event_ts, (SELECT now FROM clock)) AS latest_event_ts
FROM live
"""),
    "latest_mark": _latest("MARK", _d("new_mark")),
    "latest_rating": _latest("CREDIT_EVENT", "to_rating"),
    "latest_trade": _latest("TRADE", f"side, {_d('qty', 'price')}, counterparty"),
    "tape": _q(
        f"SELECT event_id, event_ts, {_TAPE_HEAD}, {_TAPE_BODY}, source_app {_TAPE_FROM}"
    ),
    "tape_display": _q(f"SELECT {_TAPE_HEAD}, {_TAPE_BODY} {_TAPE_FROM}"),
    "pnl_today": _q("""
SELECT CAST(round(sum(pnl_today), 2) AS DOUBLE) AS total_pnl, count(*) AS position_count,
  count(*) FILTER (WHERE pnl_today > 0) AS gainers, count(*) FILTER (WHERE pnl_today < 0) AS losers
FROM live
"""),
    "sector_exposure": _exposure("sector"),
    "fund_exposure": _exposure("fund"),
    "top_marks": _top_marks(10),
    "top_five_marks": _top_marks(5),
    "watchlist": _q(f"""
SELECT position_id, issuer, rating, sector, CAST(round(par_amount, 0) AS DOUBLE) AS par_amount,
  {_d('current_mark')}, CAST(round(pnl_today, 0) AS DOUBLE) AS pnl_today
FROM live WHERE watchlist
"""),
    "watchlist_count": _q("SELECT count(*) AS watchlisted FROM pos WHERE watchlist"),
    "hourly_trades": _q("""
SELECT date_trunc('hour', event_ts) AS hour, count(*) AS trade_count
FROM day WHERE event_type = 'TRADE' GROUP BY 1
"""),
    "event_count": _q("SELECT count(*) AS cnt FROM day"),
    "ingest_latency_exact": _q("""
SELECT count(*) AS event_count, round(quantile_cont(ms, 0.5), 0) AS p50_ms,
  round(quantile_cont(ms, 0.95), 0) AS p95_ms, round(quantile_cont(ms, 0.99), 0) AS p99_ms
FROM (SELECT epoch_ms(ingested_ts) - epoch_ms(event_ts) AS ms FROM day)
"""),
    "refresh_lag": _q("""
SELECT date_diff('second', max(latest_event_ts), (SELECT now FROM clock)) AS lag_seconds FROM live
"""),
    "throughput": _q("SELECT round(count(*) / 1440.0::DOUBLE, 1) AS events_per_min FROM day"),
    "pnl_by_sector": _pnl_by("sector"),
    "fund_pnl": _pnl_by("fund"),
    "top_sectors_by_par": _q("""
SELECT sector, CAST(round(sum(par_amount), 2) AS DOUBLE) AS total_par
FROM pos GROUP BY sector ORDER BY sum(par_amount) DESC, sector LIMIT 5
"""),
    "latest_trades": _trades(10),
    "most_recent_trade": _trades(1),
    "downgrades": _q("""
SELECT event_id, event_ts, position_id, from_rating, to_rating, agency, issuer, fund, watchlist
FROM down LEFT JOIN pos USING (position_id)
""", _DOWN),
    "watchlist_downgrades": _q("""
SELECT position_id, issuer, n AS downgrades, event_ts AS last_ts, from_rating, to_rating FROM (
  SELECT *, count(*) OVER (PARTITION BY position_id) AS n,
    row_number() OVER (PARTITION BY position_id ORDER BY event_ts DESC, event_id DESC) AS r
  FROM down JOIN pos USING (position_id) WHERE watchlist) WHERE r = 1
""", _DOWN),
    "issuer_exposure": _q("""
SELECT issuer, CAST(round(sum(par_amount), 2) AS DOUBLE) AS total_par,
  CAST(round(sum(pnl_today), 2) AS DOUBLE) AS pnl, count(*) AS positions
FROM live WHERE issuer = (SELECT issuer FROM found WHERE rank = 1) GROUP BY issuer
""", _found("custmer 000000007")),
    "recent_marks_for_issuer": _q("""
SELECT event_id, event_ts, position_id, issuer, CAST(new_mark AS DOUBLE) AS new_mark
FROM ev JOIN pos USING (position_id)
WHERE event_type = 'MARK' AND issuer = (SELECT issuer FROM found WHERE rank = 1)
  AND event_ts >= (SELECT now FROM clock) - INTERVAL 720 HOUR
""", _found("Customr#000000007")),
    "latest_mark_per_issuer": _q("""
SELECT issuer, position_id, event_ts, CAST(new_mark AS DOUBLE) AS new_mark FROM (
  SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY event_ts DESC, event_id DESC) AS r
  FROM ev JOIN pos USING (position_id) WHERE event_type = 'MARK') WHERE r = 1
"""),
    "changed_last_hour": _q("""
, hour AS (
  SELECT *,
    row_number() OVER (PARTITION BY position_id, event_type ORDER BY event_ts, event_id) AS first,
    row_number() OVER (PARTITION BY position_id, event_type ORDER BY event_ts DESC, event_id DESC) AS last
  FROM ev WHERE event_ts >= (SELECT now FROM clock) - INTERVAL 1 HOUR AND position_id IS NOT NULL
)
SELECT position_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'TRADE') AS trades,
  count(*) FILTER (WHERE event_type = 'MARK') AS marks,
  count(*) FILTER (WHERE event_type = 'CREDIT_EVENT') AS credit_events,
  CAST(max(new_mark) FILTER (WHERE event_type = 'MARK' AND last = 1)
    - max(new_mark) FILTER (WHERE event_type = 'MARK' AND first = 1) AS DOUBLE) AS mark_move,
  max(event_ts) AS latest_event_ts
FROM hour GROUP BY position_id
"""),
    "timechart_avg": _q("""
SELECT metric, bin, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value), 4) AS value,
  count(value) AS points
FROM (SELECT metric, bin FROM bins,
        (SELECT DISTINCT metric FROM points, clock
         WHERE metric IN ('credit_ingest_latency_ms', 'credit_events_per_min')
           AND ts >= now - INTERVAL 24 HOUR)) spine
  LEFT JOIN (SELECT metric, date_trunc('hour', ts) AS bin, value FROM points, clock
             WHERE ts >= now - INTERVAL 24 HOUR) p USING (metric, bin)
GROUP BY metric, bin
""", _POINTS),
    "timechart_sum": _q("""
SELECT 'credit_error_count' AS metric, bin,
  round(coalesce(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 0), 4) AS value,
  count(value) AS points
FROM bins LEFT JOIN (SELECT date_trunc('hour', ts) AS bin, value FROM points, clock
  WHERE metric = 'credit_error_count' AND ts >= now - INTERVAL 24 HOUR) p USING (bin)
GROUP BY bin
""", _POINTS),
    "top_issuers": _q("""
SELECT issuer, event_id AS count FROM points, clock WHERE metric = 'credit_issuer_event_count'
  AND ts >= now - INTERVAL 24 HOUR
ORDER BY event_id DESC, issuer LIMIT 10
""", _POINTS),
    "metric_summary": _q("""
, kept AS (
  SELECT event_type AS metric, ts, value FROM events
), recent AS (
  SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS i,
    count(*) OVER (PARTITION BY metric) AS n
  FROM kept, clock WHERE ts >= now - INTERVAL 1 DAY
)
SELECT asked.metric, count(value) AS count,
  coalesce(max(value) FILTER (WHERE i = n // 2), 0) AS p50,
  coalesce(max(value) FILTER (WHERE i = CASE WHEN n >= 20 THEN floor(n * 0.95::DOUBLE) ELSE n - 1 END), 0) AS p95,
  coalesce(round_even(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value), 1), 0) AS avg,
  coalesce(max(value), 0) AS max
FROM (VALUES ('purchase'), ('click'), ('error'), ('signup'), ('view'), ('missing')) asked(metric)
  LEFT JOIN recent USING (metric)
GROUP BY asked.metric
"""),
    "latency_segments": _q("""
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY event_ts, event_id) AS seq FROM trace
)
SELECT position_id, event_id, '#' || seq || ' ' || substr(event_type, 1, 6) AS event, step, ms FROM (
  SELECT *, unnest(['1 network', '2 append', '3 flush', '4 poll']) AS step,
    unnest([CAST(round(CAST(roundtrip_ms - total_handler_ms AS DECIMAL(18,6)), 1) AS DOUBLE),
      sdk_appended_ms, flush_committed_ms,
      CAST(round(CAST(coalesce(greatest(0, visible_ms - roundtrip_ms), 0) AS DECIMAL(18,6)), 1) AS DOUBLE)]) AS ms
  FROM numbered)
""", _TRACE),
    "latency_summary": _q("""
, done AS (
  SELECT event_type, visible_ms, flush_committed_ms,
    row_number() OVER (PARTITION BY event_type ORDER BY visible_ms) - 1 AS i,
    row_number() OVER (PARTITION BY event_type ORDER BY flush_committed_ms) - 1 AS j,
    count(*) OVER (PARTITION BY event_type) AS n
  FROM trace WHERE coalesce(visible_ms, 0) <> 0
), medians AS (
  SELECT event_type, max(visible_ms) FILTER (WHERE i = n // 2) AS median_visible_ms,
    max(flush_committed_ms) FILTER (WHERE j = n // 2) AS median_flush_ms FROM done GROUP BY event_type
), totals AS (
  SELECT event_type, count(*) AS fired, count(*) FILTER (WHERE coalesce(visible_ms, 0) <> 0) AS completed,
    min(nullif(visible_ms, 0)) AS min_visible_ms, max(nullif(visible_ms, 0)) AS max_visible_ms,
    round(CAST(sum(CAST(roundtrip_ms AS DECIMAL(28,6))) FILTER (WHERE error IS NULL) AS DOUBLE)
      / count(*) FILTER (WHERE error IS NULL), 2) AS avg_roundtrip_ms
  FROM trace GROUP BY event_type
)
SELECT *, CASE WHEN median_visible_ms < 300 THEN 'fast' WHEN median_visible_ms < 1000 THEN 'slow'
  ELSE 'stalled' END AS grade
FROM totals LEFT JOIN medians USING (event_type)
""", _TRACE),
    "retain_last_n": """
SELECT event_id, ts, metric, value,
  CAST(row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS INTEGER) AS seq
FROM (SELECT event_id, ts, event_type AS metric, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= 1000
""",
    "random_pick": """
SELECT c_custkey AS position_id, c_name AS issuer, md5('7:' || c_custkey) AS draw
FROM customer ORDER BY draw, position_id LIMIT 5
""",
    "json_batch_explode": _q("""
SELECT body_id, seq, event_type, position_id, side, qty, price, NULL::VARCHAR AS counterparty,
  NULL::DOUBLE AS prev_mark, new_mark, NULL::VARCHAR AS mark_source, from_rating,
  NULL::VARCHAR AS to_rating, NULL::VARCHAR AS agency
FROM batch
""", _REQUESTS),
    "validate_split": _q("""
SELECT body_id, seq,
  CASE WHEN event_type IN ('TRADE', 'MARK', 'CREDIT_EVENT') THEN 'accepted' ELSE 'quarantined' END AS outcome,
  CASE WHEN event_type IN ('TRADE', 'MARK', 'CREDIT_EVENT') THEN ''
    WHEN event_type IS NULL THEN 'missing event_type' ELSE 'unknown event_type' END AS reasons
FROM batch
""", _REQUESTS),
    "normalise_events": _q(_NORMAL, _REQUESTS),
    "dq_report": _q(
        _checks("ev", {
            **_NN_EV,
            "enum:event_type": "event_type NOT IN ('TRADE', 'MARK', 'CREDIT_EVENT', 'WARMUP')",
            "order:ingested_ts": "ingested_ts < event_ts",
            "reference:position_id": "position_id IS NOT NULL AND position_id NOT IN (SELECT position_id FROM pos)",
        })
        + " UNION ALL "
        + _checks("pos", _NN_POS)
        + """
UNION ALL SELECT 'precision:value', count(*) FROM events
WHERE value IS NOT NULL AND coalesce(try_cast(value AS DECIMAL(4,1))::DOUBLE <> value, true)
UNION ALL SELECT 'unique:event_id', count(*) - count(DISTINCT event_id) FROM ev
UNION ALL SELECT 'unique:position_id', count(*) - count(DISTINCT position_id) FROM pos
"""),
    "batch_end_offsets": """
SELECT user_id AS position_id, n AS rows, event_id AS end_offset FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1
""",
    "partition_counts": f"""
SELECT CAST({_hash("CAST(user_id AS VARCHAR)", 4)} AS INTEGER) AS channel, count(*) AS events
FROM events GROUP BY 1
""",
    "error_classify": _q("""
SELECT event_id AS error_id, error,
  contains(lower(error), 'token has expired') OR contains(lower(error), 'invalid state')
  OR contains(lower(error), 'invalidchannelerror') OR contains(lower(error), 'unauthorized') AS recoverable
FROM (SELECT *, CASE k % 5 WHEN 0 THEN 'Token has EXPIRED for channel'
    WHEN 1 THEN 'channel in Invalid State' WHEN 2 THEN 'InvalidChannelError: closed'
    WHEN 3 THEN '401 Unauthorized' ELSE 'connection reset by peer' END AS error
  FROM raw WHERE event_type = 'error')
"""),
    "error_counts": _q("""
SELECT k % 5 <> 4 AS recoverable, count(*) AS errors, max(ts) AS last_ts
FROM raw WHERE event_type = 'error' GROUP BY 1
"""),
    "error_status": _q("""
SELECT event_id AS error_id, ts, CASE k % 5 WHEN 0 THEN 'Token has EXPIRED for channel'
    WHEN 1 THEN 'channel in Invalid State' WHEN 2 THEN 'InvalidChannelError: closed'
    WHEN 3 THEN '401 Unauthorized' ELSE 'connection reset by peer' END AS error,
  (SELECT count(*) FROM raw WHERE event_type = 'error') AS total_errors
FROM raw WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10
"""),
    "event_lookup": _q("SELECT event_id, event_ts, event_type FROM ev WHERE event_id = 777 LIMIT 1"),
    "seed_values": _q(f"""
SELECT rating, CAST(place AS INTEGER) AS place, count(position_id) AS held
FROM (SELECT unnest(list_append({_LADDER}, 'NR')) AS rating, unnest(range(1, 24)) AS place)
  LEFT JOIN pos ON current_rating = rating
GROUP BY rating, place
"""),
    "merge_insert_only": _q("""
SELECT position_id, issuer, sector,
  CASE WHEN position_id IN (SELECT position_id FROM ev) THEN fund ELSE 'NEW ' || fund END AS fund
FROM pos
"""),
    "merge_upsert": _q("""
, src AS (
  SELECT o_custkey AS key, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
    FROM orders) WHERE r = 1
)
SELECT coalesce(c_custkey, s.key) AS key,
  CASE WHEN s.key IS NOT NULL THEN s.value ELSE c_mktsegment END AS value,
  CASE WHEN s.key IS NOT NULL THEN now ELSE now - INTERVAL 1 DAY END AS updated
FROM customer FULL OUTER JOIN src s ON c_custkey = s.key, clock
"""),
    "update_where": """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F'
  THEN 'closed ' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority FROM orders
""",
    "scalar_nulls": _q("""
SELECT event_id, coalesce(side, '') AS side, nullif(counterparty, 'CP-0') AS not_cp_0,
  CASE WHEN new_mark > 50 THEN 'above' WHEN new_mark <= 50 THEN 'below' ELSE 'none' END AS band,
  coalesce(CAST(qty AS DOUBLE), 0) AS qty FROM ev
"""),
    "scalar_math": _q("""
SELECT event_id, CAST(round(new_mark, 1) AS DOUBLE) AS mark_1,
  CAST(round(new_mark - prev_mark, 0) AS DOUBLE) AS move_0,
  CAST(abs(new_mark - prev_mark) AS DOUBLE) AS abs_move,
  CAST(greatest(new_mark - prev_mark, 0) AS DOUBLE) AS gain,
  CAST((new_mark - prev_mark) * 100 AS DOUBLE) AS bps,
  CAST(round((new_mark - prev_mark) * 1000000 * 0.01, 2) AS DOUBLE) AS pnl,
  CASE WHEN CAST(new_mark AS DOUBLE) * 5 < 300 THEN 'fast' WHEN CAST(new_mark AS DOUBLE) * 5 < 1000
    THEN 'slow' ELSE 'stalled' END AS grade
FROM ev WHERE new_mark IS NOT NULL
"""),
    "scalar_time": _q("""
SELECT event_id, event_ts - INTERVAL 90 MINUTE AS earlier, date_trunc('hour', event_ts) AS hour,
  time_bucket(INTERVAL 5 MINUTE, event_ts) AS five_minutes,
  date_diff('millisecond', event_ts, ingested_ts) AS millis,
  date_diff('second', event_ts, (SELECT now FROM clock)) AS age_seconds,
  strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f') AS written, event_ts AS read_back
FROM ev
"""),
    "scalar_string": _q("""
SELECT event_id, printf('POS-%04d', position_id) AS padded,
  upper(substr(sha256(event_id || '|' || event_type), 1, 12)) AS short_id,
  '#' || event_id || ' ' || substr(event_type, 1, 6) AS label,
  'events{app=' || source_app || ',type=' || event_type || '}' AS series
FROM ev
"""),
    "scalar_json": _q("""
SELECT event_id, '{"event_type":"' || event_type || '","at":{"position_id":' || position_id || '}}' AS body,
  event_type, position_id, CAST(k AS DOUBLE) AS k, true AS broken_is_null
FROM ev JOIN (SELECT event_id, k FROM raw) USING (event_id)
"""),
    "scalar_hash": _q(f"""
SELECT position_id, CAST({_hash("printf('POS-%04d', position_id)", 4)} AS INTEGER) AS channel,
  CAST({_hash("issuer", 16)} AS INTEGER) AS issuer_channel
FROM pos
"""),
    "scalar_ladder": _q(f"""
SELECT event_id, f AS from_place, t AS to_place, ({_LADDER})[least(f + 1, 22)] AS one_down,
  ({_LADDER})[greatest(f - 1, 1)] AS one_up, t > f AS downgrade
FROM (SELECT *, CAST(list_position({_LADDER}, from_rating) AS BIGINT) AS f,
        CAST(list_position({_LADDER}, to_rating) AS BIGINT) AS t
      FROM ev WHERE event_type = 'CREDIT_EVENT')
"""),
    "model_pnl_by_sector": _q(
        "SELECT sector, CAST(round(sum(pnl_today), 2) AS DOUBLE) AS pnl FROM live GROUP BY sector"
    ),
    "model_events_by_type": _q("""
SELECT event_type, count(*) AS events, max(event_ts) AS last_event
FROM ev WHERE event_type <> 'WARMUP' GROUP BY event_type
"""),
    "model_trades_by_fund": _q("""
SELECT fund, side, count(*) AS trades, CAST(round(sum(qty), 2) AS DOUBLE) AS traded_qty
FROM ev LEFT JOIN pos USING (position_id) WHERE event_type = 'TRADE' GROUP BY fund, side
"""),
    "model_par_by_tranche": _q("""
SELECT tranche, watchlist, CAST(round(sum(par_amount), 2) AS DOUBLE) AS par, count(*) AS positions
FROM pos GROUP BY tranche, watchlist
"""),
    "column_profile": _q(f"""
SELECT column_name, value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT column_name, value, count(*) AS count,
    row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rank
  FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY column_name, value) WHERE rank <= 5
"""),
    "column_summary": _q(f"""
SELECT column_name, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS nulls,
  min(value) AS min_value, max(value) AS max_value
FROM ({_LONG}) GROUP BY column_name
"""),
    "fuzzy_search": """
WITH parts AS (
  SELECT p_partkey AS position_id, p_name AS issuer, p_brand AS sector, p_type AS tranche FROM part
)
""" + _search_cte("parts", ["red widgt", "smal ring", "Blue  BOLT"], "hits") + """
SELECT query_id, query, position_id, issuer, sector, tranche, score,
  CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank
FROM hits WHERE rank <= 10
""",
    "fuzzy_search_table": f"""
WITH names AS (
  SELECT p_partkey AS position_id, p_name AS issuer, plain, {_GRAMS.format('plain')} AS grams
  FROM (SELECT *, {_NORM.format('p_name')} AS plain FROM part)
), scored AS (
  SELECT q.position_id AS query_id, q.issuer AS query, n.position_id, n.issuer,
    len(list_intersect(n.grams, q.grams)) * 1.0::DOUBLE
      / len(list_distinct(list_concat(n.grams, q.grams))) AS score,
    CAST(levenshtein(n.plain, q.plain) AS INTEGER) AS distance
  FROM names n, names q WHERE q.position_id % 100 = 0
)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, position_id) AS INTEGER) AS rank
FROM scored WHERE score >= 0.3 QUALIFY rank <= 10
""",
    "model_recent_by_type": _q("""
SELECT event_type, count(*) AS events FROM day WHERE event_type <> 'WARMUP' GROUP BY event_type
"""),
    "conversation_history": """
SELECT conv_id, turn, '{"role":' || to_json(role) || ',"content":[{"type":"text","text":'
    || to_json(text) || '}]}' AS message
FROM conversations
""",
    "event_log_text": """
WITH failed AS (
  SELECT conv_id, min(turn) AS seq, min_by(role, turn) AS error FROM conversations
  WHERE conv_id % 7 = 3 AND turn % 4 = 1 GROUP BY conv_id
)
SELECT conv_id AS response_id, turn AS seq, text, CAST(NULL AS VARCHAR) AS error
FROM conversations WHERE role <> 'system' AND text <> '' AND conv_id NOT IN (SELECT conv_id FROM failed)
UNION ALL SELECT conv_id, seq, '', error FROM failed
""",
    "stream_ingest": _q("""
SELECT event_id, event_ts, event_type, position_id, false AS late FROM ev WHERE event_type <> 'VIEW'
"""),
    "stream_requests": _q(
        "SELECT event_id, event_ts, event_type, position_id, side, qty, to_rating FROM (" + _NORMAL + ")", _REQUESTS
    ),
    "stream_quarantine": _q("""
SELECT body_id, 'missing event_type' AS reasons FROM batch WHERE event_type IS NULL
UNION ALL SELECT body_id, 'unknown event_type' FROM batch
WHERE event_type NOT IN ('TRADE', 'MARK', 'CREDIT_EVENT')
""", _REQUESTS),
    "stream_latency": _q("""
SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS window_start, count(*) AS event_count,
  quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, quantile_disc(ms, 0.99) AS p99_ms
FROM (SELECT event_ts, epoch_ms(ingested_ts) - epoch_ms(event_ts) AS ms FROM ev) GROUP BY 1
"""),
    "ingest_latency_approx": _q("""
SELECT count(*) AS event_count, quantile_disc(ms, 0.5)::DOUBLE AS p50_ms,
  quantile_disc(ms, 0.95)::DOUBLE AS p95_ms, quantile_disc(ms, 0.99)::DOUBLE AS p99_ms
FROM (SELECT epoch_ms(ingested_ts) - epoch_ms(event_ts) AS ms FROM day)
"""),
    "stream_dedupe": _q("""
SELECT event_type, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id
FROM ev WHERE event_type <> 'VIEW' GROUP BY event_type
"""),
    "stream_latest_state": _q("""
, newest AS (
  SELECT *, row_number() OVER (
    PARTITION BY position_id, event_type ORDER BY event_ts DESC, event_id DESC) AS r
  FROM ev WHERE position_id IS NOT NULL
)
SELECT position_id,
  CAST(max(new_mark) FILTER (WHERE r = 1 AND event_type = 'MARK') AS DOUBLE) AS new_mark,
  max(to_rating) FILTER (WHERE r = 1 AND event_type = 'CREDIT_EVENT') AS to_rating,
  max(side) FILTER (WHERE r = 1 AND event_type = 'TRADE') AS side,
  count(*) AS events, max(event_ts) AS latest_event_ts
FROM newest GROUP BY position_id
"""),
    "stream_live_state": _q("""
, newest AS (
  SELECT *, row_number() OVER (
    PARTITION BY position_id, event_type ORDER BY event_ts DESC, event_id DESC) AS r
  FROM day WHERE position_id IS NOT NULL
)
SELECT position_id,
  CAST(max(new_mark) FILTER (WHERE r = 1 AND event_type = 'MARK') AS DOUBLE) AS new_mark,
  max(to_rating) FILTER (WHERE r = 1 AND event_type = 'CREDIT_EVENT') AS to_rating,
  max(side) FILTER (WHERE r = 1 AND event_type = 'TRADE') AS side, max(event_ts) AS latest_event_ts
FROM newest GROUP BY position_id
"""),
    "stream_hourly_trades": _q("""
SELECT date_trunc('hour', event_ts) AS hour, count(*) AS trade_count
FROM ev WHERE event_type = 'TRADE' GROUP BY 1
"""),
    "stream_throughput": _q("""
SELECT window_start, count(*) AS n, round(count(*) / 5.0::DOUBLE, 1) AS events_per_min
FROM (SELECT date_trunc('minute', event_ts) - unnest(range(0, 5)) * INTERVAL 1 MINUTE AS window_start FROM ev)
GROUP BY window_start
"""),
    "stream_enrich": _q("""
SELECT event_id, event_ts, event_type, issuer, sector,
  epoch_ms(ingested_ts) - epoch_ms(event_ts) AS latency_ms, CAST(price AS DOUBLE) AS price
FROM ev LEFT JOIN pos USING (position_id) WHERE source_app <> 'warmup'
"""),
    "stream_downgrades": _q("""
SELECT event_id, event_ts, position_id, from_rating, to_rating, agency, issuer, fund, watchlist
FROM down LEFT JOIN pos USING (position_id)
""", _DOWN),
    "stream_health": _q("""
SELECT count(*) AS received, count(*) FILTER (WHERE event_type = 'VIEW') AS quarantined,
  max(event_ts) FILTER (WHERE event_type <> 'VIEW') AS newest_event_ts
FROM ev
"""),
}

# The streamed snapshot never stores VIEW rows, so its clock and counts leave them out.
SQL["stream_portfolio"] = (
    _BASE.replace(
        "SELECT max(ts) AS now FROM events",
        "SELECT max(ts) AS now FROM events WHERE event_type <> 'view'",
    ).replace(
        "SELECT * FROM ev WHERE event_ts >=",
        "SELECT * FROM ev WHERE event_type <> 'VIEW' AND event_ts >=",
    )
    + """
SELECT position_id, sector, rating AS current_rating, CAST(current_mark AS DOUBLE) AS latest_mark,
  CAST(round(pnl_today, 2) AS DOUBLE) AS pnl_today,
  coalesce(latest_event_ts, (SELECT now FROM clock)) AS latest_event_ts
FROM live
"""
)

SQL["stream_snapshot_changes"] = SQL["portfolio_live_table"]
SQL["stream_end_offsets"] = """
SELECT user_id AS position_id, count(*) AS rows, arg_max(event_id, (ts, event_id)) AS end_offset
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
"""
SQL["stream_state_expiry"] = _q("""
SELECT h.hours, count(DISTINCT position_id) AS positions,
  count(DISTINCT position_id) FILTER (WHERE event_type = 'MARK') AS marks,
  count(DISTINCT position_id) FILTER (WHERE event_type = 'CREDIT_EVENT') AS ratings,
  count(DISTINCT position_id) FILTER (WHERE event_type = 'TRADE') AS trades
FROM (SELECT unnest([0.0, 8.0, 16.0, 23.5])::DOUBLE AS hours) h
  LEFT JOIN day ON position_id IS NOT NULL
    AND event_ts >= (SELECT now FROM clock) + h.hours * INTERVAL 1 HOUR - INTERVAL 24 HOUR
GROUP BY h.hours
""")

SQL["conversation_parts"] = """
WITH messages AS (
  SELECT conv_id, turn, '{"role":' || to_json(role) || ',"content":[{"type":"text","text":'
    || to_json(text) || '}]}' AS message
  FROM conversations
), placed AS (
  SELECT conv_id, message, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, message))::INTEGER AS position,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM messages
)
SELECT conv_id, position, CASE WHEN position = 1 THEN '[' ELSE ',' END || message
  || CASE WHEN position = n THEN ']' ELSE '' END AS part
FROM placed
"""
SQL["stream_observed_health"] = _q("""
, summed AS (
  SELECT count(*) AS rows, count(*) FILTER (WHERE event_id IS NULL OR event_ts IS NULL OR event_type IS NULL
      OR event_type NOT IN ('TRADE', 'MARK', 'CREDIT_EVENT', 'WARMUP')) AS quarantined,
    count(*) FILTER (WHERE event_type = 'CREDIT_EVENT') AS errors,
    max(epoch_us(ingested_ts) // 1000 - epoch_us(event_ts) // 1000) AS lag_ms, max(epoch_us(event_ts) // 1000) AS newest_ms
  FROM ev
)
SELECT 'ingest.' || metric AS metric, value::DOUBLE AS value
FROM (UNPIVOT summed ON rows, quarantined, errors, lag_ms, newest_ms INTO NAME metric VALUE value)
""")
SQL["stream_latency_sliding"] = _q("""
, spread AS (
  SELECT date_trunc('minute', event_ts) - b.back * INTERVAL 1 MINUTE AS window_start,
    epoch_ms(ingested_ts) - epoch_ms(event_ts) AS ms
  FROM ev, (SELECT unnest([0, 1, 2, 3, 4]) AS back) b
  WHERE ingested_ts IS NOT NULL AND event_ts IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY ms) AS r,
    count(*) OVER (PARTITION BY window_start) AS n FROM spread
)
SELECT window_start, any_value(n) AS event_count,
  min(ms) FILTER (WHERE 100 * r >= 50 * n) AS p50_ms, min(ms) FILTER (WHERE 100 * r >= 95 * n) AS p95_ms,
  min(ms) FILTER (WHERE 100 * r >= 99 * n) AS p99_ms, true AS near_exact
FROM placed GROUP BY window_start
""")

SQL["search_index"] = SQL["fuzzy_search_table"]
SQL["stored_upsert"] = _q("""
, src AS (
  SELECT o_custkey AS key, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
    FROM orders) WHERE r = 1
), merged AS (
  SELECT coalesce(c_custkey, s.key) AS key,
    CASE WHEN s.key IS NOT NULL THEN s.value ELSE c_mktsegment END AS value,
    CASE WHEN s.key IS NOT NULL THEN now ELSE now - INTERVAL 1 DAY END AS updated
  FROM customer FULL OUTER JOIN src s ON c_custkey = s.key, clock
)
SELECT key, CASE WHEN value = '1-URGENT' THEN 'now' ELSE value END AS value, updated FROM merged
UNION ALL SELECT -1 - n_nationkey, n_name, now FROM nation, clock
""")
SQL["column_profile_stored"] = _q(f"""
, long AS ({_LONG})
SELECT column_name, value, count, CAST(rank AS INTEGER) AS rank, rows, nulls, true AS near_exact FROM (
  SELECT column_name, value, count(*) AS count,
    row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rank
  FROM long WHERE value IS NOT NULL GROUP BY column_name, value)
JOIN (SELECT column_name, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS nulls FROM long GROUP BY column_name)
  USING (column_name)
WHERE rank <= 5
""")
SQL["event_table"] = _q("""
SELECT CAST(event_ts AS DATE) AS event_date, event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids, 1::BIGINT AS files
FROM ev WHERE event_ts IS NOT NULL GROUP BY ALL
""")
SQL["interleaved_events"] = _q("""
, asked AS (SELECT event_id, position_id = 7 AS one, event_ts >= now - INTERVAL 1 HOUR AS hour FROM ev, clock)
SELECT 'position' AS asked, count(*) AS events, max(event_id) AS last FROM asked WHERE one
UNION ALL SELECT 'hour', count(*), max(event_id) FROM asked WHERE hour
UNION ALL SELECT 'both', count(*), max(event_id) FROM asked WHERE one AND hour
""")
SQL["model_checked_keys"] = _q("""
SELECT fund, count(*) FILTER (WHERE event_type = 'TRADE') AS trades, CAST(round(sum(qty), 2) AS DOUBLE) AS traded_qty
FROM ev LEFT JOIN pos USING (position_id) WHERE event_type <> 'WARMUP' GROUP BY fund
""")
