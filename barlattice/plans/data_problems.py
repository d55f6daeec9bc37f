"""Queries of the core data-quality operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.functions.epoch import epoch_us, is_millis
from barlattice.operators.anomalies import implausible_bars
from barlattice.operators.dedupe import kept_deliveries, surplus_deliveries
from barlattice.operators.grid import bar_grid
from barlattice.operators.instants import state_instants, ticket_instants
from barlattice.operators.rejects import parse_lines
from barlattice.operators.rolling import rising_volume_days, rolling_bars
from barlattice.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rising_volume_days(table(spark, d, "bars", "universe_id", "symbol", "timestamp_open", "volume", "close"))


def fixed(c: str, digits: int) -> Column:
    """Column rounded by the same floating-point steps as ``floor(x * 1e<d> + 0.5) / 1e<d>`` in SQL."""
    scale = float(10**digits)
    return (F.floor(F.col(c) * scale + 0.5) / scale).alias(c)


def p1_rolling(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling_bars(table(spark, d, "bars", "universe_id", "symbol", "timestamp_open", "volume", "close"))
    return rolled.select(
        "universe_id",
        "symbol",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        fixed("volume_7d", 4),
        fixed("volume_30d", 4),
        fixed("close_avg_7d", 6),
        fixed("close_avg_30d", 6),
    )


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return bar_grid(
        table(spark, d, "bars", "universe_id", "symbol", "timestamp_open", "close", "bar_id"),
        table(spark, d, "universes", "universe_id", "frequency"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_grid(spark, d).filter("filled").select("universe_id", "symbol", "open_ms")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tickets = table(spark, d, "tickets", "run_id", "trade_id", "received_at", "delivery_id")
    return surplus_deliveries(tickets, ("run_id", "trade_id"), "received_at", "delivery_id").select("delivery_id")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    tickets = table(spark, d, "tickets", "run_id", "trade_id", "received_at", "delivery_id", "bar_index", "timestamp")
    return kept_deliveries(tickets, ("run_id", "trade_id"), "received_at", "delivery_id").drop("received_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tickets = ticket_instants(
        table(spark, d, "tickets", "delivery_id", "run_id", "timestamp", "bar_index", "clock_zone", "received_at")
    )
    states = state_instants(
        table(spark, d, "live_states", "state_id", "last_processed_timestamp_utc", "last_processed_datetime_str", "clock_zone", "saved_at")
    )
    bars = table(spark, d, "bars", "bar_id", "timestamp_open").filter(~is_millis(F.col("timestamp_open")))
    parts = (
        tickets.select(F.lit("tickets").alias("src"), F.col("delivery_id").alias("row_id"), "utc_us"),
        states.select(F.lit("live_states").alias("src"), F.col("state_id").alias("row_id"), "utc_us"),
        bars.select(F.lit("bars").alias("src"), F.col("bar_id").alias("row_id"), epoch_us(F.col("timestamp_open")).alias("utc_us")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("utc_us").isNotNull())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "raw_lines")).filter("kind = 'bad'").select("line_id", "reason")


def p5_bars(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "raw_lines")).filter("kind = 'bar'").drop("kind", "reason", "timestamp_close_ms")


def p7_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible_bars(table(spark, d, "bars", "universe_id", "symbol", "timestamp_open", "close", "high", "low", "volume"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_flags(spark, d).select("universe_id", "symbol", "open_ms")


_MS = """CASE WHEN timestamp_open < 100000000000 THEN timestamp_open * 1000
              WHEN timestamp_open < 100000000000000 THEN timestamp_open
              WHEN timestamp_open < 100000000000000000 THEN timestamp_open // 1000
              ELSE timestamp_open // 1000000 END"""

_DAILY = f"""
WITH once AS (
  SELECT universe_id, symbol, {_MS} AS ms, max(volume) AS volume, max(close) AS close
  FROM bars GROUP BY ALL),
daily AS (
  SELECT universe_id, symbol, CAST(ms // 86400000 AS INT) AS dn,
         sum(CASE WHEN volume > 0 THEN CAST(volume AS DECIMAL(28, 9)) ELSE 0 END) AS v, sum(CAST(close AS DECIMAL(28, 9))) AS cs, count(close) AS cc
  FROM once GROUP BY ALL),
span AS (SELECT universe_id, symbol, min(dn) AS a, max(dn) AS b FROM daily GROUP BY ALL),
days AS (SELECT universe_id, symbol, unnest(range(a, b + 1)) AS dn, a FROM span),
filled AS (
  SELECT d.universe_id, d.symbol, d.dn, d.dn - d.a + 1 AS day_no, coalesce(v, 0) AS v, coalesce(cs, 0) AS cs, coalesce(cc, 0) AS cc
  FROM days d LEFT JOIN daily x ON d.universe_id = x.universe_id AND d.symbol = x.symbol AND d.dn = x.dn),
rolled AS (
  SELECT universe_id, symbol, strftime(DATE '1970-01-01' + CAST(dn AS INT), '%Y-%m-%d') AS day, day_no,
         sum(v) OVER s AS x7, sum(v) OVER l AS x30, CAST(sum(v) OVER s AS DOUBLE) AS v7, CAST(sum(v) OVER l AS DOUBLE) AS v30,
         CAST(sum(cs) OVER s AS DOUBLE) / nullif(sum(cc) OVER s, 0) AS c7, CAST(sum(cs) OVER l AS DOUBLE) / nullif(sum(cc) OVER l, 0) AS c30
  FROM filled
  WINDOW s AS (PARTITION BY universe_id, symbol ORDER BY dn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         l AS (PARTITION BY universe_id, symbol ORDER BY dn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

_GRID = f"""
WITH steps AS (
  SELECT universe_id, CASE frequency WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 ELSE 86400000 END AS step FROM universes),
read AS (
  SELECT b.universe_id, symbol, step, {_MS} AS ms, close, bar_id
  FROM bars b JOIN steps u ON b.universe_id = u.universe_id WHERE close IS NOT NULL),
per AS (
  SELECT universe_id, symbol, step, ms // step AS p, arg_max(close, struct_pack(ms := ms, id := bar_id)) AS close
  FROM read GROUP BY ALL),
nxt AS (SELECT *, lead(p) OVER (PARTITION BY universe_id, symbol ORDER BY p) AS np FROM per),
grid AS (SELECT universe_id, symbol, step, p, unnest(range(p, coalesce(np, p + 1))) AS q, close FROM nxt)
"""

_RANKED = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, trade_id ORDER BY received_at, delivery_id) AS k FROM tickets)
"""

_LINES = r"""
WITH f AS (
  SELECT *, CASE WHEN regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
    THEN [CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END
          FOR x IN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)] END AS p
  FROM raw_lines),
t AS (SELECT line_id, file_name, line_no, line, [trim(x, ' ' || chr(9) || chr(13) || chr(10)) FOR x IN p] AS p FROM f
      WHERE NOT (line_no <= 1 AND coalesce(lower(list_aggregate(p, 'string_agg', ',')) =
        'timestamp_open,timestamp_close,symbol,open,high,low,close,volume,quote_volume,trades_count,state,ignore', false))),
n AS (SELECT *, CASE WHEN regexp_full_match(p[1], '[0-9]+') THEN try_cast(p[1] AS HUGEINT) END AS ts FROM t),
judged AS (
  SELECT *, CASE WHEN p IS NULL THEN 'quoting' WHEN len(p) <> 12 THEN 'column_count'
    WHEN NOT coalesce(ts BETWEEN 1420070400 AND 2051222399 OR ts BETWEEN 1420070400000 AND 2051222399999
      OR ts BETWEEN 1420070400000000 AND 2051222399999999 OR ts BETWEEN 1420070400000000000 AND 2051222399999999999, false) THEN 'timestamp_open'
    WHEN NOT (regexp_full_match(p[10], '[0-9]+') AND coalesce(try_cast(p[10] AS HUGEINT) < 2147483648, false)) THEN 'trades_count'
    WHEN NOT (regexp_full_match(p[9], '([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast(p[9] AS DOUBLE)), false))
      THEN 'quote_volume' END AS reason
  FROM n)
"""

# fixed values: zone abbreviations of the zones in the tables, with their offsets in hours
_ABBREVIATIONS = "('EST', -5), ('EDT', -4), ('CST', -6), ('CDT', -5), ('GMT', 0), ('BST', 1), ('CET', 1), ('CEST', 2), ('IST', 5.5), ('JST', 9), ('AEST', 10), ('AEDT', 11)"
_ZONE_END = " ?(Z|UTC|[A-Z]{3,4}|[+-][0-9]{2}(:?[0-9]{2})?)$"
_INSTANTS = f"""
WITH txt AS (
  SELECT 'tickets' AS src, delivery_id AS id, run_id, bar_index, trim(timestamp) AS v, coalesce(clock_zone, 'UTC') AS z, epoch_us(received_at) AS seen FROM tickets
  UNION ALL SELECT 'live_states', state_id, NULL, NULL, trim(last_processed_datetime_str), coalesce(clock_zone, 'UTC'), epoch_us(saved_at) FROM live_states),
cut AS (
  SELECT *, regexp_extract(v, '{_ZONE_END}', 1) AS zn, regexp_replace(v, '{_ZONE_END}', '') AS body FROM txt),
wall AS (
  SELECT *, try_strptime(body, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S.%g',
      '%Y-%m-%d %H:%M:%S.%g', '%Y%m%dT%H%M%S', '%Y/%m/%d %H:%M:%S', '%m/%d/%Y %I:%M:%S %p', '%d.%m.%Y %H:%M:%S', '%d %b %Y %H:%M:%S', '%a, %d %b %Y %H:%M:%S']) AS w,
    CASE WHEN regexp_full_match(v, '[0-9]{{9,11}}[.][0-9]+') THEN CAST(CAST(v AS DECIMAL(24, 6)) * 1000000 AS BIGINT)
      WHEN regexp_full_match(v, '[0-9]{{9,19}}') THEN CASE WHEN length(v) < 12 THEN CAST(v AS BIGINT) * 1000000 WHEN length(v) < 15 THEN CAST(v AS BIGINT) * 1000
        WHEN length(v) < 18 THEN CAST(v AS BIGINT) ELSE CAST(v AS BIGINT) // 1000 END END AS ep,
    CASE WHEN zn IN ('Z', 'UTC') THEN 0 WHEN regexp_matches(zn, '^[+-]') THEN
      (CASE WHEN zn LIKE '-%' THEN -1 ELSE 1 END) * (CAST(zn[2:3] AS INT) * 3600 + coalesce(try_cast(regexp_extract(zn, '([0-9]{{2}})$', 1) AS INT), 0) * CASE WHEN length(zn) > 3 THEN 60 ELSE 0 END) END AS off
  FROM cut),
loc AS (
  SELECT wall.*, CASE WHEN zn = '' AND w IS NOT NULL THEN epoch_us(timezone(z, w)) END AS late, coalesce(off, CAST(a.h * 3600 AS INT)) AS shift
  FROM wall LEFT JOIN (VALUES {_ABBREVIATIONS}) a(name, h) ON zn = a.name),
two AS (
  SELECT *, CASE WHEN timezone(z, timezone('UTC', make_timestamp(late))) = w THEN late END AS l,
    CASE WHEN timezone(z, timezone('UTC', make_timestamp(late - 3600000000))) = w THEN late - 3600000000 END AS e FROM loc),
got AS (
  SELECT *, coalesce(ep, CASE WHEN zn = '' THEN coalesce(e, l) ELSE epoch_us(w) - CAST(shift AS BIGINT) * 1000000 END) AS us, e IS NOT NULL AND l IS NOT NULL AS twice FROM two),
origin AS (
  SELECT run_id, mode(us // 3600000000 - bar_index) AS o FROM got WHERE src = 'tickets' AND NOT twice AND us IS NOT NULL GROUP BY run_id)
SELECT src, id AS row_id, CASE WHEN NOT twice THEN us WHEN src = 'live_states' THEN CASE WHEN l + 3600000000 <= seen THEN l ELSE e END
    WHEN abs(l // 3600000000 - o - bar_index) < abs(e // 3600000000 - o - bar_index) THEN l ELSE e END AS utc_us
FROM got LEFT JOIN origin ON got.run_id = origin.run_id
WHERE us IS NOT NULL AND NOT (src = 'live_states' AND id IN (SELECT state_id FROM live_states WHERE coalesce(last_processed_timestamp_utc, 0) <> 0))
UNION ALL SELECT 'live_states', state_id, CASE WHEN t < 100000000000 THEN t * 1000000 WHEN t < 100000000000000 THEN t * 1000 WHEN t < 100000000000000000 THEN t ELSE t // 1000 END
  FROM (SELECT state_id, last_processed_timestamp_utc AS t FROM live_states) WHERE coalesce(t, 0) <> 0
UNION ALL SELECT 'bars', bar_id, CASE WHEN t < 100000000000 THEN t * 1000000 WHEN t < 100000000000000000 THEN t ELSE t // 1000 END
  FROM (SELECT bar_id, timestamp_open AS t FROM bars) WHERE t < 100000000000 OR t >= 100000000000000
"""

# the cases by thresholds, without a model: excursions above 12.5 usual moves, volumes above 19 times the bars around
_JUDGED = f"""
WITH once AS (
  SELECT universe_id, symbol, {_MS} AS ms, max(close) AS close, max(high) AS high, max(low) AS low, max(volume) AS volume FROM bars GROUP BY ALL),
b AS (SELECT *, coalesce(close <= 0 OR high <= 0 OR low <= 0, false) OR coalesce(high < low, false) OR coalesce(close < low, false) OR coalesce(close > high, false) AS off FROM once),
scale AS (
  SELECT universe_id, symbol, median(d) AS scale FROM (
    SELECT universe_id, symbol, abs(ln(close) - lag(ln(close)) OVER (PARTITION BY universe_id, symbol ORDER BY ms)) AS d FROM b WHERE close > 0 AND NOT off)
  WHERE d > 0 GROUP BY ALL),
x AS (
  SELECT universe_id, symbol, ms, k, ln(v) AS v FROM (
    SELECT universe_id, symbol, ms, off, unnest(['c', 'h', 'l']) AS k, unnest([close, high, low]) AS v FROM b) WHERE v > 0 AND NOT off),
n AS (
  SELECT *, lag(v, 1) OVER w AS p1, lag(v, 2) OVER w AS p2, lag(v, 3) OVER w AS p3, lead(v, 1) OVER w AS n1, lead(v, 2) OVER w AS n2, lead(v, 3) OVER w AS n3
  FROM x WINDOW w AS (PARTITION BY universe_id, symbol, k ORDER BY ms)),
e AS (
  SELECT *, CASE WHEN sign(v - p1) = sign(v - n1) THEN least(abs(v - p1), abs(v - n1)) ELSE 0 END AS one,
    CASE WHEN sign(v - p1) = sign(v - n2) THEN sign(v - p1) * least(abs(v - p1), abs(v - n2)) ELSE 0 END AS a,
    CASE WHEN sign(v - p2) = sign(v - n1) THEN sign(v - p2) * least(abs(v - p2), abs(v - n1)) ELSE 0 END AS z,
    abs(v - list_aggregate(list_filter([p1, p2, p3, n1, n2, n3], lambda q: q IS NOT NULL), 'median')) AS away FROM n),
s AS (
  SELECT *, CASE WHEN sign(a) = sign(lead(z) OVER w) THEN least(abs(a), abs(lead(z) OVER w)) ELSE 0 END AS two,
    CASE WHEN sign(z) = sign(lag(a) OVER w) THEN least(abs(z), abs(lag(a) OVER w)) ELSE 0 END AS too
  FROM e WINDOW w AS (PARTITION BY universe_id, symbol, k ORDER BY ms)),
vol AS (
  SELECT universe_id, symbol, ms, volume / median(volume) OVER w AS r, count(*) OVER w AS n FROM b WHERE volume > 0
  WINDOW w AS (PARTITION BY universe_id, symbol ORDER BY ms ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING EXCLUDE CURRENT ROW)),
rep AS (
  SELECT *, coalesce(volume > 0 AND close = lag(close) OVER w AND high = lag(high) OVER w AND low = lag(low) OVER w, false) AS same
  FROM b WHERE close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL WINDOW w AS (PARTITION BY universe_id, symbol ORDER BY ms)),
isl AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY universe_id, symbol ORDER BY ms) AS i FROM rep),
run AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY universe_id, symbol, i) AS run FROM isl)
SELECT universe_id, symbol, ms AS open_ms, arg_min(flag, k) AS flag FROM (
  SELECT universe_id, symbol, ms, 'range' AS flag, 0 AS k FROM b WHERE off OR volume < 0
  UNION ALL SELECT universe_id, symbol, ms, 'stuck', 1 FROM run WHERE same AND run >= 5
  UNION ALL SELECT universe_id, symbol, ms, 'spike', 2 FROM vol WHERE n >= 3 AND r > 19
  UNION ALL SELECT universe_id, symbol, ms, 'spike', 2 FROM s JOIN scale USING (universe_id, symbol) WHERE least(greatest(coalesce(one, 0), coalesce(two, 0), coalesce(too, 0)), away) / scale > 12.5)
GROUP BY universe_id, symbol, ms
"""

QUERIES = {"p5_found": p5_found, "p5_bars": p5_bars, "p7_found": p7_found, "p7_flags": p7_flags, "p1_found": p1_found, "p1_rolling": p1_rolling, "p2_found": p2_found, "p2_kept": p2_kept, "p3_found": p3_found, "p4_found": p4_found, "p4_grid": p4_grid}

ORACLE = {
    "p3_found": _INSTANTS,
    "p7_found": f"SELECT universe_id, symbol, open_ms FROM ({_JUDGED})",
    "p7_flags": _JUDGED,
    "p1_found": _DAILY + "SELECT universe_id, symbol, day FROM rolled WHERE day_no >= 30 AND CAST(x7 AS DECIMAL(30, 9)) * 30 > CAST(x30 AS DECIMAL(30, 9)) * 7",
    "p1_rolling": _DAILY
    + "SELECT universe_id, symbol, day, floor(v7 * 1e4 + 0.5) / 1e4 AS volume_7d, floor(v30 * 1e4 + 0.5) / 1e4 AS volume_30d,"
    + " floor(c7 * 1e6 + 0.5) / 1e6 AS close_avg_7d, floor(c30 * 1e6 + 0.5) / 1e6 AS close_avg_30d FROM rolled",
    "p5_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_bars": _LINES
    + """SELECT line_id, file_name, line_no,
      CAST(CASE WHEN ts < 100000000000 THEN ts * 1000 WHEN ts < 100000000000000 THEN ts
        WHEN ts < 100000000000000000 THEN ts // 1000 ELSE ts // 1000000 END AS BIGINT) AS timestamp_open_ms,
      p[3] AS symbol, try_cast(p[4] AS DOUBLE) AS open, try_cast(p[5] AS DOUBLE) AS high, try_cast(p[6] AS DOUBLE) AS low,
      try_cast(p[7] AS DOUBLE) AS close, try_cast(p[8] AS DOUBLE) AS volume, CAST(p[9] AS DOUBLE) AS quote_volume,
      CAST(p[10] AS BIGINT) AS trades_count, upper(p[11]) AS state
    FROM judged WHERE reason IS NULL""",
    "p2_found": _RANKED + "SELECT delivery_id FROM ranked WHERE k > 1",
    "p2_kept": _RANKED + "SELECT run_id, trade_id, delivery_id, bar_index, timestamp FROM ranked WHERE k = 1",
    "p4_found": _GRID + "SELECT universe_id, symbol, q * step AS open_ms FROM grid WHERE q > p",
    "p4_grid": _GRID + "SELECT universe_id, symbol, q * step AS open_ms, close, q > p AS filled FROM grid",
}
