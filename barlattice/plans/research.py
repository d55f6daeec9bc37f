"""Queries of the research operators over the bar tables, and their SQL.

The SQL is a chain of named steps; each query takes those it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.operators import align, features, ledger, metrics, nulls, portfolio, signals
from barlattice.operators.align import whole
from barlattice.sources.tables import table

BARS = ("bar_id", "universe_id", "symbol", "timestamp_open", "open", "high", "low", "close", "volume", "quote_volume")
#: The fee of the example portfolios, small enough that equity does not vanish on invented bars.
FEE = 0.0010


def _aligned(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return align.aligned_bars(table(spark, d, "bars", *BARS, *more), table(spark, d, "universes", "universe_id", "frequency", "asset_count"))


def _period(spark: SparkSession, d: str) -> DataFrame:
    return align.period_bars(table(spark, d, "bars", *BARS), table(spark, d, "universes", "universe_id", "frequency", "asset_count"))


def _returns(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return features.simple_returns(_aligned(spark, d, *more))


def _positions(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return signals.hysteresis(features.canonical_factor(_returns(spark, d, *more)))


def _weights(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return signals.cap_leverage(signals.target_weights(_positions(spark, d, *more)))


def _portfolio(spark: SparkSession, d: str) -> DataFrame:
    rows = features.slippage_rate(features.friction_ratios(_weights(spark, d)))
    return portfolio.backtest(rows, fee=FEE)


def _rounded(df: DataFrame, keep: list[str], digits: dict[str, int]) -> DataFrame:
    return df.select(*keep, *[whole(F.col(c), n).alias(c) for c, n in digits.items()])


def _sql_rounded(keep: str, digits: dict[str, int], source: str) -> str:
    fields = ", ".join(f"floor({c} * 1e{n} + 0.5) / 1e{n} AS {c}" for c, n in digits.items())
    return f"SELECT {keep}, {fields} FROM {source}"


_MS = """CASE WHEN timestamp_open < 100000000000 THEN timestamp_open * 1000
  WHEN timestamp_open < 100000000000000 THEN timestamp_open
  WHEN timestamp_open < 100000000000000000 THEN timestamp_open // 1000 ELSE timestamp_open // 1000000 END"""
_W = "PARTITION BY universe_id, symbol ORDER BY t"
_YEAR = "sqrt(8760e0)"

#: Named steps of the SQL in the order in which they build on each other.
STEPS: dict[str, str] = {
    "steps": "SELECT universe_id, asset_count, CASE frequency WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 ELSE 86400000 END AS step FROM universes",
    "reading": f"""SELECT b.universe_id, symbol, step, asset_count, ms - ms % step AS t,
        coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0) AS volume,
        coalesce(quote_volume, coalesce(volume, 0) * close) AS quote_volume, coalesce(volume, 0) * 0.5e0 AS taker_buy_volume, quote_volume IS NULL AS substituted,
        row_number() OVER (PARTITION BY b.universe_id, symbol, ms - ms % step ORDER BY ms DESC, bar_id DESC) AS latest
      FROM (SELECT *, {_MS} AS ms FROM bars WHERE close > 0) b JOIN steps u ON b.universe_id = u.universe_id""",
    "period": "SELECT * FROM reading WHERE latest = 1",
    "aligned": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY universe_id, t) AS together FROM period) WHERE together = asset_count",
    "ret": f"SELECT *, coalesce((close - lag(close) OVER w) / greatest(1e-8, lag(close) OVER w), 0e0) AS ret FROM aligned WINDOW w AS ({_W})",
    "factor": f"""SELECT *, coalesce(tanh(0.6e0 * momentum + 0.4e0 * volume_ratio), 0e0) AS factor FROM (
      SELECT *, close / lag(close, 24) OVER w - 1 AS momentum,
        CASE WHEN row_number() OVER w >= 24 THEN avg(volume) OVER (w ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)
          / (avg(volume) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) + 1e-8) END AS volume_ratio
      FROM ret WINDOW w AS ({_W}))""".replace("OVER (w ROWS", f"OVER ({_W} ROWS"),
    "pos": f"""SELECT *, coalesce(last_value(d IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS position FROM (
      SELECT *, CASE WHEN row_number() OVER ({_W}) = 1 THEN 0e0 WHEN abs(factor) > 0.5e0 THEN sign(factor) * 1e0 WHEN abs(factor) < 0.2e0 THEN 0e0 END AS d FROM factor)""",
    "weighed": """SELECT *, w0 / greatest(1e0, sum(abs(w0)) OVER (PARTITION BY universe_id, t)) AS weight FROM (
      SELECT *, position / count(*) OVER (PARTITION BY universe_id, t) AS w0 FROM pos)""",
    "friction": f"""SELECT *, 0.0005e0 * (0.5e0 * vol_ratio + 0.5e0 * spread_ratio) AS slippage FROM (
      SELECT *, CASE WHEN rn < 48 THEN 1e0 ELSE vol / greatest(avg(vol) OVER r, 1e-6) END AS vol_ratio,
        CASE WHEN rn < 48 THEN 1e0 ELSE spread / greatest(avg(spread) OVER r, 1e-6) END AS spread_ratio
      FROM (SELECT *, row_number() OVER ({_W}) AS rn, (high - low) / greatest(1e-8, close) AS spread,
          CASE WHEN row_number() OVER ({_W}) <= 24 THEN 0e0 ELSE stddev_pop(ret) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS vol
        FROM weighed) WINDOW r AS ({_W} ROWS BETWEEN 719 PRECEDING AND CURRENT ROW))""",
    "bt": f"""SELECT universe_id, t, gross, gross - cost AS net, gross - turnover * ({FEE} + 0.0005) AS flat_net, turnover,
        CASE WHEN turnover > 1e-6 THEN cost / turnover * 10000 ELSE 10e0 END AS cost_bps, turnover > 1e-4 AS traded FROM (
      SELECT universe_id, t, sum(weight * nxt) AS gross, sum(ch) AS turnover, sum(ch * ({FEE} + slippage)) AS cost FROM (
        SELECT *, abs(weight - CASE WHEN rn = 25 THEN 0e0 ELSE coalesce(lw, 0e0) END) AS ch FROM (
          SELECT *, lead(ret) OVER w AS nxt, lag(weight) OVER w AS lw FROM friction WINDOW w AS ({_W})) WHERE rn >= 25 AND nxt IS NOT NULL)
      GROUP BY ALL)""",
    "curve": f"""SELECT universe_id, fee_bps, avg(x) AS mean, stddev_samp(x) AS sd,
        CASE WHEN stddev_samp(x) > 1e-12 THEN avg(x) / stddev_samp(x) * {_YEAR} ELSE 0e0 END AS sharpe_ann
      FROM (SELECT universe_id, fee_bps, gross - turnover * fee_bps / 10000 AS x FROM bt, (SELECT unnest([0e0, 5e0, 10e0, 25e0, 50e0, 100e0]) AS fee_bps)) GROUP BY ALL""",
    "levels": f"""SELECT *, avg(level) OVER n AS market, CASE WHEN count(*) OVER n = 1 THEN level ELSE (sum(level) OVER n - level) / greatest(count(*) OVER n - 1, 1) END AS peer
      FROM (SELECT *, close / greatest(1e-12, first_value(close) OVER ({_W})) AS level FROM aligned) WINDOW n AS (PARTITION BY universe_id, t)""",
    "mom": f"""SELECT universe_id, symbol, t, coalesce(last_value(d IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS weight FROM (
        SELECT *, CASE WHEN k >= 480 AND (k - 480) % 168 = 0 THEN CASE WHEN row_number() OVER (PARTITION BY universe_id, t ORDER BY r DESC NULLS LAST, symbol) = 1 THEN 1e0 ELSE 0e0 END END AS d
        FROM (SELECT *, close / lag(close, 480) OVER ({_W}) - 1 AS r, row_number() OVER ({_W}) - 1 AS k FROM aligned))""",
    "rev": f"""SELECT universe_id, symbol, t, z, coalesce(last_value(CASE WHEN z <= -2 THEN 1e0 WHEN z >= 0 THEN 0e0 END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS position FROM (
        SELECT *, CASE WHEN count(*) OVER p >= 480 THEN (close - avg(close) OVER p) / (stddev_pop(close) OVER p + 1e-8) END AS z
        FROM aligned WINDOW p AS ({_W} ROWS BETWEEN 480 PRECEDING AND 1 PRECEDING))""",
    "sims": f"""SELECT *, 100000e0 * product(1 + net) OVER q AS nav, row_number() OVER q AS bar FROM (
        SELECT strategy, universe_id, t, gross, gross - cost AS net, turnover, CASE WHEN turnover > 1e-6 THEN cost / turnover * 10000 ELSE 10e0 END AS cost_bps, turnover > 1e-4 AS traded FROM (
          SELECT strategy, universe_id, t, sum(weight * nxt) AS gross, sum(ch) AS turnover, sum(ch * ({FEE} + slippage)) AS cost FROM (
            SELECT *, abs(weight - CASE WHEN rn = 25 THEN 0e0 ELSE coalesce(lw, 0e0) END) AS ch FROM (
              SELECT w.strategy, w.universe_id, w.symbol, w.t, w.weight, f.slippage, f.rn, lead(f.ret) OVER s AS nxt, lag(w.weight) OVER s AS lw FROM (
                SELECT 'STRATEGY' AS strategy, universe_id, symbol, t, weight FROM weighed
                UNION ALL SELECT 'BUY_AND_HOLD', universe_id, symbol, t, 1e0 / count(*) OVER (PARTITION BY universe_id, t) FROM aligned
                UNION ALL SELECT 'SIMPLE_MOMENTUM', universe_id, symbol, t, weight FROM mom
                UNION ALL SELECT 'SIMPLE_MEAN_REVERSION', universe_id, symbol, t, CASE WHEN sum(position) OVER n > 0 THEN position / sum(position) OVER n * position / count(*) OVER n ELSE 0e0 END FROM rev WINDOW n AS (PARTITION BY universe_id, t)
                UNION ALL SELECT 'CASH', universe_id, symbol, t, 0e0 FROM aligned) w
              JOIN friction f ON w.universe_id = f.universe_id AND w.symbol = f.symbol AND w.t = f.t WINDOW s AS (PARTITION BY w.strategy, w.universe_id, w.symbol ORDER BY w.t)) WHERE rn >= 25 AND nxt IS NOT NULL)
          GROUP BY ALL))
      WINDOW q AS (PARTITION BY strategy, universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "path": """SELECT *, max(eq) OVER p AS pk, max(cum) OVER p AS cpk FROM (
      SELECT universe_id, t, sum(net) OVER p AS cum, greatest(product(1 + net) OVER p, 1e-12) AS eq FROM bt
      WINDOW p AS (PARTITION BY universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WINDOW p AS (PARTITION BY universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}


def _chain(last: str, body: str) -> str:
    names = list(STEPS)
    used, todo = set(), [last]
    while todo:
        step = todo.pop()
        if step not in used:
            used.add(step)
            todo += [n for n in names if n != step and names.index(n) < names.index(step) and _mentions(STEPS[step], n)]
    parts = ", ".join(f"{n} AS ({STEPS[n]})" for n in names if n in used)
    return f"WITH {parts} {body}"


def _mentions(sql: str, name: str) -> bool:
    import re

    return re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql) is not None


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


KEYS = "universe_id, symbol, t"


@_query("SELECT bar_id, " + _MS + " AS ms FROM bars")
def units_normalised(spark, d):
    return align.normalise_units(table(spark, d, "bars", "bar_id", "timestamp_open")).select("bar_id", "ms")


@_query(f"SELECT universe_id, symbol, ms, bar_id FROM (SELECT *, row_number() OVER (PARTITION BY universe_id, symbol, {_MS} ORDER BY received_at, bar_id) AS k, {_MS} AS ms FROM bars) WHERE k = 1")
def bars_deduped(spark, d):
    rows = align.normalise_units(table(spark, d, "bars", "bar_id", "universe_id", "symbol", "timestamp_open", "received_at"))
    return align.first_delivery(rows).select("universe_id", "symbol", "ms", "bar_id")


@_query(f"SELECT bar_id FROM bars WHERE {_MS} BETWEEN 1672531200000 AND 1704067199999")
def bars_in_range(spark, d):
    rows = align.normalise_units(table(spark, d, "bars", "bar_id", "timestamp_open"))
    return align.in_range(rows, 1_672_531_200_000, 1_704_067_199_999).select("bar_id")


@_query(_chain("aligned", f"SELECT {KEYS}, open, high, low, close, volume, quote_volume, taker_buy_volume, substituted FROM aligned"))
def aligned_bars(spark, d):
    return _aligned(spark, d).select("universe_id", "symbol", "t", "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "substituted")


@_query(_chain("aligned", f"SELECT {KEYS}, close FROM aligned WHERE universe_id IN (SELECT universe_id FROM aligned GROUP BY universe_id HAVING count(*) / any_value(asset_count) >= 240)"))
def long_aligned_bars(spark, d):
    """Aligned bars of the universes that have at least 240 common periods."""
    rows = align.aligned_bars(table(spark, d, "bars", *BARS), table(spark, d, "universes", "universe_id", "frequency", "asset_count"), least=240)
    return rows.select("universe_id", "symbol", "t", "close")


@_query(
    _chain(
        "period",
        f"""SELECT universe_id, symbol, t AS after, n AS before, (n - t) // step - 1 AS missing FROM (SELECT *, lead(t) OVER ({_W}) AS n FROM period) WHERE n - t > step""",
    )
)
def series_gaps(spark, d):
    return align.gaps(_period(spark, d))


@_query("SELECT list_aggregate(list_sort(assets), 'string_agg', ',') AS asset_key, count(*) AS labels, min(universe_id) AS first_label FROM universes GROUP BY ALL")
def universe_identity(spark, d):
    return align.identity(table(spark, d, "universes", "universe_id", "assets"))


@_query(_chain("ret", _sql_rounded(KEYS, {"ret": 9}, "ret")))
def simple_returns(spark, d):
    return _rounded(_returns(spark, d), ["universe_id", "symbol", "t"], {"ret": 9})


@_query(_chain("aligned", _sql_rounded(KEYS, {"log_ret": 9}, f"(SELECT *, coalesce(ln(close) - ln(lag(close) OVER ({_W})), 0e0) AS log_ret FROM aligned)")))
def log_returns(spark, d):
    return _rounded(features.log_returns(_aligned(spark, d)), ["universe_id", "symbol", "t"], {"log_ret": 9})


@_query(
    _chain(
        "aligned",
        _sql_rounded(KEYS, {"open_ratio": 9, "high_ratio": 9, "low_ratio": 9, "spread": 9}, "(SELECT *, open / greatest(1e-8, close) AS open_ratio, high / greatest(1e-8, close) AS high_ratio, low / greatest(1e-8, close) AS low_ratio, (high - low) / greatest(1e-8, close) AS spread FROM aligned)"),
    )
)
def shape_ratios(spark, d):
    return _rounded(features.shape_ratios(_aligned(spark, d)), ["universe_id", "symbol", "t"], {"open_ratio": 9, "high_ratio": 9, "low_ratio": 9, "spread": 9})


@_query(
    _chain(
        "levels",
        _sql_rounded(
            KEYS,
            {"level": 7, "market": 7, "peer": 7, "dispersion": 7},
            "(SELECT l.universe_id, l.symbol, l.t, any_value(l.level) AS level, any_value(l.market) AS market, any_value(l.peer) AS peer, coalesce(stddev_pop(o.level), 0e0) AS dispersion"
            " FROM levels l LEFT JOIN levels o ON l.universe_id = o.universe_id AND l.t = o.t AND l.symbol <> o.symbol GROUP BY ALL)",
        ),
    )
)
def peer_indices(spark, d):
    return _rounded(features.peer_indices(_aligned(spark, d)), ["universe_id", "symbol", "t"], {"level": 7, "market": 7, "peer": 7, "dispersion": 7})


@_query(_chain("factor", _sql_rounded(KEYS, {"momentum": 8, "volume_ratio": 8, "factor": 8}, "factor")))
def canonical_factor(spark, d):
    return _rounded(features.canonical_factor(_returns(spark, d)), ["universe_id", "symbol", "t"], {"momentum": 8, "volume_ratio": 8, "factor": 8})


@_query(_chain("friction", _sql_rounded(KEYS, {"vol": 8, "vol_ratio": 7, "spread_ratio": 7, "slippage": 9}, "friction")))
def friction_ratios(spark, d):
    rows = features.slippage_rate(features.friction_ratios(_weights(spark, d)))
    return _rounded(rows, ["universe_id", "symbol", "t"], {"vol": 8, "vol_ratio": 7, "spread_ratio": 7, "slippage": 9})


@_query(
    _chain(
        "friction",
        _sql_rounded(
            KEYS,
            {"vol_ratio": 7, "spread_ratio": 7},
            "(SELECT universe_id, symbol, t, vol / greatest(avg(vol) OVER s, 1e-6) AS vol_ratio, spread / greatest(avg(spread) OVER s, 1e-6) AS spread_ratio FROM friction WINDOW s AS (PARTITION BY universe_id, symbol))",
        ),
    )
)
def whole_sample_ratios(spark, d):
    return _rounded(features.whole_sample_ratios(_returns(spark, d)), ["universe_id", "symbol", "t"], {"vol_ratio": 7, "spread_ratio": 7})


@_query(_chain("pos", f"SELECT {KEYS}, position FROM pos"))
def hysteresis_positions(spark, d):
    return _positions(spark, d).select("universe_id", "symbol", "t", "position")


@_query(
    _chain(
        "factor",
        f"""SELECT {KEYS}, coalesce(last_value(d IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS position FROM (
          SELECT *, CASE WHEN row_number() OVER ({_W}) = 1 THEN 0e0 WHEN n >= 336 AND abs(factor) >= hi THEN sign(factor) * 1e0 WHEN n >= 336 AND abs(factor) <= lo THEN 0e0 END AS d FROM (
            SELECT *, count(*) OVER p AS n, quantile_cont(abs(factor), 0.95) OVER p AS hi, quantile_cont(abs(factor), 0.5) OVER p AS lo
            FROM factor WINDOW p AS ({_W} ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING)))""",
    )
)
def adaptive_positions(spark, d):
    rows = features.canonical_factor(_returns(spark, d))
    return signals.adaptive_hysteresis(rows).select("universe_id", "symbol", "t", "position")


@_query(_chain("weighed", _sql_rounded(KEYS, {"weight": 9}, "weighed")))
def target_weights(spark, d):
    return _rounded(_weights(spark, d), ["universe_id", "symbol", "t"], {"weight": 9})


@_query(_chain("mom", f"SELECT {KEYS}, weight FROM mom"))
def momentum_leader(spark, d):
    return signals.momentum_leader(_aligned(spark, d)).select("universe_id", "symbol", "t", "weight")


@_query(_chain("rev", f"SELECT {KEYS}, floor(z * 1e5 + 0.5) / 1e5 AS z, position FROM rev"))
def reversion_state(spark, d):
    return signals.reversion_state(_aligned(spark, d)).select("universe_id", "symbol", "t", whole(F.col("z"), 5).alias("z"), "position")


_BT = {"gross": 9, "net": 9, "flat_net": 9, "turnover": 9, "cost_bps": 6}


@_query(_chain("bt", _sql_rounded("universe_id, t, traded", _BT, "bt")))
def portfolio_returns(spark, d):
    return _rounded(_portfolio(spark, d), ["universe_id", "t", "traded"], _BT)


@_query(
    _chain(
        "pos",
        _sql_rounded(
            "universe_id, symbol, bars",
            {"total": 8, "mean": 9, "sd": 9},
            f"""(SELECT universe_id, symbol, count(*) AS bars, sum(x) AS total, avg(x) AS mean, stddev_pop(x) AS sd FROM (
              SELECT *, coalesce(lp, 0e0) * ret - abs(position - coalesce(lp, 0e0)) * 0.001e0 AS x FROM (
                SELECT *, lag(position) OVER ({_W}) AS lp, row_number() OVER ({_W}) AS rn FROM pos)) WHERE rn > 24 GROUP BY ALL)""",
        ),
    )
)
def reference_performance(spark, d):
    return _rounded(portfolio.reference_performance(_positions(spark, d)), ["universe_id", "symbol", "bars"], {"total": 8, "mean": 9, "sd": 9})


_PERF = {"mean": 10, "sd": 10, "sharpe_ann": 6, "sortino_ann": 6, "win_rate": 8, "profit_factor": 6, "skew": 6, "kurtosis": 5}


@_query(
    _chain(
        "bt",
        _sql_rounded(
            "universe_id, n",
            _PERF,
            f"""(SELECT *, CASE WHEN sd > 1e-12 THEN mean / sd ELSE 0e0 END * {_YEAR} AS sharpe_ann,
              CASE WHEN sqrt(down / (n - 1)) > 1e-12 THEN mean / sqrt(down / (n - 1)) ELSE 0e0 END * {_YEAR} AS sortino_ann,
              CASE WHEN moved > 0 THEN won / moved ELSE 0e0 END AS win_rate,
              CASE WHEN loss > 0 THEN profit / loss WHEN profit > 0 THEN 'inf'::DOUBLE ELSE 0e0 END AS profit_factor,
              CASE WHEN m2 > 1e-12 THEN m3 / pow(m2, 1.5) ELSE 0e0 END AS skew, CASE WHEN m2 > 1e-12 THEN m4 / (m2 * m2) ELSE 3e0 END AS kurtosis FROM (
              SELECT universe_id, count(*) AS n, avg(net) AS mean, stddev_samp(net) AS sd, sum(pow(least(net, 0e0), 2)) AS down,
                count(*) FILTER (net > 1e-12) AS won, count(*) FILTER (abs(net) > 1e-12) AS moved,
                coalesce(sum(net) FILTER (net > 0), 0e0) AS profit, coalesce(sum(-net) FILTER (net < 0), 0e0) AS loss,
                avg(pow(net - m, 2)) AS m2, avg(pow(net - m, 3)) AS m3, avg(pow(net - m, 4)) AS m4
              FROM (SELECT *, avg(net) OVER (PARTITION BY universe_id) AS m FROM bt) GROUP BY universe_id) WHERE n >= 2)""",
        ),
    )
)
def performance_metrics(spark, d):
    rows = metrics.performance(_portfolio(spark, d), "universe_id")
    return _rounded(rows, ["universe_id", "n"], _PERF)


@_query(_chain("bt", _sql_rounded("universe_id", {"sharpe": 5, "arithmetic_cagr": 6}, f"(SELECT universe_id, avg(net) / (stddev_pop(net) + 1e-8) * {_YEAR} AS sharpe, avg(net) * 8760 AS arithmetic_cagr FROM bt GROUP BY ALL)")))
def backtest_sharpe(spark, d):
    return _rounded(metrics.backtest_sharpe(_portfolio(spark, d), "universe_id"), ["universe_id"], {"sharpe": 5, "arithmetic_cagr": 6})


@_query(
    _chain(
        "path",
        _sql_rounded(
            "universe_id, n",
            {"nav_dd": 8, "cum_dd": 8, "equity": 8},
            "(SELECT universe_id, count(*) AS n, min((eq - greatest(1e0, pk)) / greatest(1e0, pk)) AS nav_dd, min(cum - cpk) AS cum_dd, arg_max(eq, t) AS equity FROM path GROUP BY ALL)",
        ),
    )
)
def drawdowns(spark, d):
    return _rounded(metrics.drawdowns(_portfolio(spark, d), "universe_id"), ["universe_id", "n"], {"nav_dd": 8, "cum_dd": 8, "equity": 8})


_GROWTH = {"baseline_sharpe": 5, "log_growth": 7}


@_query(
    _chain(
        "path",
        _sql_rounded(
            "universe_id, calmar",
            _GROWTH,
            f"""(SELECT universe_id, CAST(CAST(CASE WHEN dd < -1e-12 THEN least(1e30, greatest(-1e30, (pow(eq, 8760e0 / n) - 1) / abs(dd))) ELSE 0e0 END AS FLOAT) AS DOUBLE) AS calmar, ln(eq) * 8760 / n AS log_growth, s AS baseline_sharpe FROM (
              SELECT p.universe_id, count(*) AS n, arg_max(eq, p.t) AS eq, min((eq - greatest(1e0, pk)) / greatest(1e0, pk)) AS dd, avg(net) / (stddev_pop(net) + 1e-12) * {_YEAR} AS s
              FROM path p JOIN bt b ON p.universe_id = b.universe_id AND p.t = b.t GROUP BY p.universe_id))""",
        ),
    )
)
def growth(spark, d):
    """Geometric growth (as its logarithm, for it can be huge), Calmar ratio and the Sharpe ratio of baselines of each portfolio."""
    rows = _portfolio(spark, d)
    falls = metrics.drawdowns(rows, "universe_id").withColumn("log_growth", F.ln("equity") * metrics.HOURS_A_YEAR / F.col("n"))
    ratios = metrics.backtest_sharpe(rows, "universe_id", floor=1e-12).select("universe_id", F.col("sharpe").alias("baseline_sharpe"))
    calmar = F.least(F.lit(1e30), F.greatest(F.lit(-1e30), F.col("calmar"))).cast("float").cast("double").alias("calmar")
    joined = falls.join(ratios, "universe_id").select("universe_id", calmar, "log_growth", "baseline_sharpe")
    return _rounded(joined, ["universe_id", "calmar"], _GROWTH)


_TURN = {"annual_turnover": 5, "mean_cost_bps": 6, "max_cost_bps": 6, "mean_traded_bps": 6, "friction_penalty": 6}


@_query(
    _chain(
        "bt",
        _sql_rounded(
            "universe_id, trades",
            _TURN,
            """(SELECT universe_id, sum(turnover) * 8760 / count(*) AS annual_turnover, count(*) FILTER (traded) AS trades, avg(cost_bps) AS mean_cost_bps,
            max(cost_bps) AS max_cost_bps, avg(cost_bps) FILTER (traded) AS mean_traded_bps, (avg(flat_net) - avg(net)) * 8760 AS friction_penalty FROM bt GROUP BY ALL)""",
        ),
    )
)
def turnover_summary(spark, d):
    return _rounded(metrics.turnover_summary(_portfolio(spark, d), "universe_id"), ["universe_id", "trades"], _TURN)


@_query(_chain("curve", _sql_rounded("universe_id, fee_bps", {"mean": 10, "sd": 10, "sharpe_ann": 5}, "curve")))
def cost_curve(spark, d):
    return _rounded(metrics.cost_curve(_portfolio(spark, d), "universe_id"), ["universe_id", "fee_bps"], {"mean": 10, "sd": 10, "sharpe_ann": 5})


@_query(
    _chain(
        "curve",
        _sql_rounded(
            "universe_id, survives_10, survives_25",
            {"breakeven_bps": 4, "decay": 5},
            """(SELECT universe_id, bool_or(s > 0) FILTER (f = 10) AS survives_10, bool_or(s > 0) FILTER (f = 25) AS survives_25, abs(regr_slope(s, f)) * 10 AS decay,
              CASE WHEN max(s) FILTER (k = 1) <= 0 THEN 0e0 ELSE coalesce(min(f + (f2 - f) * s / (s - s2)) FILTER (s > 0 AND s2 <= 0),
                max(CASE WHEN (s2 - s) / (f2 - f) < -1e-12 THEN greatest(0e0, f2 - s2 / ((s2 - s) / (f2 - f))) ELSE 'inf'::DOUBLE END) FILTER (k = 5)) END AS breakeven_bps
            FROM (SELECT universe_id, sharpe_ann AS s, fee_bps AS f, lead(sharpe_ann) OVER w AS s2, lead(fee_bps) OVER w AS f2, row_number() OVER w AS k
              FROM curve WINDOW w AS (PARTITION BY universe_id ORDER BY fee_bps)) GROUP BY universe_id)""",
        ),
    )
)
def breakeven_fee(spark, d):
    rows = metrics.breakeven(metrics.cost_curve(_portfolio(spark, d), "universe_id"), "universe_id")
    return _rounded(rows, ["universe_id", "survives_10", "survives_25"], {"breakeven_bps": 4, "decay": 5})


@_query(
    _chain(
        "levels",
        _sql_rounded(
            "universe_id, regime",
            {"total": 8, "worst": 8},
            """(SELECT *, CASE WHEN total <= -0.2 AND worst <= -0.3 THEN 'CRASH' ELSE 'NORMAL' END AS regime FROM (
              SELECT universe_id, arg_max(nav, t) - 1 AS total, min(nav / greatest(1e0, pk) - 1) AS worst FROM (
                SELECT *, max(nav) OVER (PARTITION BY universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM (
                  SELECT universe_id, t, avg(level) AS nav FROM levels GROUP BY ALL)) GROUP BY universe_id))""",
        ),
    )
)
def regimes(spark, d):
    return _rounded(metrics.regime(features.peer_indices(_aligned(spark, d))), ["universe_id", "regime"], {"total": 8, "worst": 8})


_SNAP = {"cum": 8, "sharpe": 4, "drawdown": 8, "turnover_sum": 8}


@_query(
    _chain(
        "bt",
        _sql_rounded(
            "universe_id, day, trade_count",
            _SNAP,
            f"""(SELECT universe_id, CAST(bar // 24 AS INT) AS day, cum, sharpe, min(dd) OVER w AS drawdown, turnover_sum, trade_count, bar FROM (
              SELECT *, cum - max(cum) OVER w AS dd FROM (SELECT universe_id, t, row_number() OVER w AS bar, sum(net) OVER w AS cum,
                avg(net) OVER w / (stddev_pop(net) OVER w + 1e-8) * {_YEAR} AS sharpe, sum(turnover) OVER w AS turnover_sum, CAST(sum(CAST(traded AS INT)) OVER w AS BIGINT) AS trade_count
              FROM bt WINDOW w AS (PARTITION BY universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
              WINDOW w AS (PARTITION BY universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            WINDOW w AS (PARTITION BY universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE bar % 24 = 0""",
        ),
    )
)
def daily_snapshots(spark, d):
    return _rounded(metrics.daily_snapshots(_portfolio(spark, d), "universe_id"), ["universe_id", "day", "trade_count"], _SNAP)


def _asset_pairs(spark, d) -> DataFrame:
    rows = _returns(spark, d).select(F.concat_ws("/", "universe_id", "symbol").alias("series"), "universe_id", "t", "ret")
    return metrics.pair_correlations(rows, "universe_id", "series", "ret")


_PAIRS = """(SELECT a.universe_id || '/' || a.symbol AS a, b.universe_id || '/' || b.symbol AS b, count(*) AS overlap,
  CASE WHEN stddev_pop(a.ret) > 1e-12 AND stddev_pop(b.ret) > 1e-12 THEN covar_pop(a.ret, b.ret) / (stddev_pop(a.ret) * stddev_pop(b.ret)) ELSE 0e0 END AS rho
  FROM ret a JOIN ret b ON a.universe_id = b.universe_id AND a.t = b.t AND a.symbol < b.symbol GROUP BY a.universe_id, a.symbol, b.symbol, b.universe_id)"""


@_query(_chain("ret", _sql_rounded("a, b, overlap", {"rho": 7}, _PAIRS)))
def pair_correlations(spark, d):
    return _rounded(_asset_pairs(spark, d), ["a", "b", "overlap"], {"rho": 7})


@_query(
    _chain(
        "ret",
        _sql_rounded(
            "universe_id, k",
            {"k_mean": 6, "k_rank": 6},
            """(SELECT n.universe_id, k, least(k, greatest(1e0, k / (1 + (k - 1) * least(0.999e0, greatest(0e0, coalesce(m, 0e0)))))) AS k_mean,
              least(k, greatest(1e0, k * k / (k + 2 * coalesce(q, 0e0)))) AS k_rank
            FROM (SELECT universe_id, count(DISTINCT symbol) AS k FROM ret GROUP BY universe_id) n LEFT JOIN (
              SELECT universe_id, avg(rho) AS m, sum(rho * rho) AS q FROM (
                SELECT a.universe_id, CASE WHEN stddev_pop(a.ret) > 1e-12 AND stddev_pop(b.ret) > 1e-12 THEN covar_pop(a.ret, b.ret) / (stddev_pop(a.ret) * stddev_pop(b.ret)) ELSE 0e0 END AS rho
                FROM ret a JOIN ret b ON a.universe_id = b.universe_id AND a.t = b.t AND a.symbol < b.symbol GROUP BY a.universe_id, a.symbol, b.symbol)
              GROUP BY universe_id) p ON n.universe_id = p.universe_id)""",
        ),
    )
)
def effective_trials_by_universe(spark, d):
    """Of each universe by itself: all pairs of its series are measured."""
    series = _returns(spark, d).select("universe_id", "symbol").distinct()
    rows = metrics.effective_trials_by(_asset_pairs(spark, d), series, "universe_id")
    return _rounded(rows, ["universe_id", "k"], {"k_mean": 6, "k_rank": 6})


@_query(
    """SELECT delivery_id, CASE WHEN reject IS NULL THEN q ELSE 0e0 END AS filled_qty, reject, CASE WHEN abs(requested_notional_usd) > 1e-12 THEN CASE WHEN reject IS NULL THEN floor(q * fill_price / requested_notional_usd * 1e9 + 0.5) / 1e9 ELSE 0e0 END ELSE 1e0 END AS fill_ratio FROM (
      SELECT *, CASE WHEN requested_notional_usd IS NULL THEN 'notional' WHEN NOT coalesce(fill_price > 0, false) THEN 'price' WHEN abs(q) < least_qty - 1e-12 THEN 'min_qty' WHEN abs(q * fill_price) < least_worth - 1e-12 THEN 'min_notional' END AS reject FROM (
        SELECT t.*, coalesce(f.min_qty, 0) AS least_qty, coalesce(f.min_notional, 0) AS least_worth,
          CASE WHEN NOT fill_price > 0 THEN NULL WHEN coalesce(f.step_size, 0) <= 0 THEN requested_notional_usd / fill_price
            ELSE sign(requested_notional_usd / fill_price) * floor(abs(requested_notional_usd / fill_price) / f.step_size + 1e-9) * f.step_size END AS q
        FROM tickets t LEFT JOIN symbol_filters f ON t.symbol = f.symbol))"""
)
def lot_quantised(spark, d):
    orders = table(spark, d, "tickets", "delivery_id", "symbol", "requested_notional_usd", "fill_price")
    orders = orders.select("delivery_id", "symbol", F.col("requested_notional_usd").alias("notional"), F.col("fill_price").alias("price"))
    return portfolio.quantise_orders(orders, table(spark, d, "symbol_filters")).select("delivery_id", "filled_qty", "reject", whole(F.col("fill_ratio"), 9).alias("fill_ratio"))


@_query(
    """WITH k AS (SELECT universe_id, list_aggregate(list_sort(list_distinct(assets)), 'string_agg', ',') AS asset_key FROM universes)
    SELECT asset_key, count(*) AS trials, count(DISTINCT p.universe_id) AS labels, count(*) FILTER (length(variant_name) > 0) AS named
    FROM proposals p JOIN k ON p.universe_id = k.universe_id GROUP BY asset_key"""
)
def search_footprint(spark, d):
    return ledger.search_footprint(table(spark, d, "proposals", "universe_id", "variant_name"), table(spark, d, "universes", "universe_id", "assets"))


@_query("SELECT priority_category, count(*) AS trials, count(predicted_confidence) AS present, count(*) - count(predicted_confidence) AS missing FROM proposals GROUP BY priority_category")
def ledger_coverage(spark, d):
    return ledger.coverage(table(spark, d, "proposals", "priority_category", "predicted_confidence"), "priority_category", "predicted_confidence")


@_query("SELECT state_id, u.universe_id, len(list_distinct(u.assets)) > len(list_distinct(s.symbols)) AS proper FROM live_states s JOIN universes u ON len(s.symbols) > 0 AND list_has_all(u.assets, s.symbols)")
def state_subsets(spark, d):
    """Universes whose assets contain all symbols of a saved state."""
    states = table(spark, d, "live_states", "state_id", "symbols").select("state_id", F.array_sort(F.array_distinct("symbols")).alias("set"), ledger.asset_key(F.col("symbols")).alias("inner_id"))
    universes = table(spark, d, "universes", "universe_id", "assets").select(F.col("universe_id").alias("outer_id"), F.array_distinct("assets").alias("set"))
    found = ledger.contained(states.select("inner_id", "set").distinct(), universes)
    return states.join(found, "inner_id").select("state_id", F.col("outer_id").alias("universe_id"), "proper")


@_query(
    """SELECT proposal_id, k AS family_trial, k > 1 AS revisit, epoch_us(submitted_at) // 1000000 - lag(epoch_us(submitted_at) // 1000000) OVER w AS interval_s,
      CASE WHEN k <= 10 THEN 1 WHEN k <= 20 THEN 2 ELSE 3 END AS epoch
    FROM (SELECT *, row_number() OVER (PARTITION BY universe_id ORDER BY submitted_at, proposal_id) AS k FROM proposals)
    WINDOW w AS (PARTITION BY universe_id ORDER BY submitted_at, proposal_id)"""
)
def trial_numbering(spark, d):
    rows = table(spark, d, "proposals", "proposal_id", "universe_id", "submitted_at")
    rows = ledger.numbered(rows, "universe_id", "submitted_at", "proposal_id")
    rows = ledger.occurrences(rows, "universe_id", "submitted_at", "proposal_id")
    rows = ledger.repetition_interval(rows, "universe_id", "submitted_at", "proposal_id")
    return ledger.epochs(rows, "family_trial").select("proposal_id", "family_trial", "revisit", "interval_s", "epoch")


@_query(
    """SELECT universe_id, max(n) AS longest FROM (
      SELECT universe_id, i, count(*) FILTER (m) AS n FROM (
        SELECT universe_id, m, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY universe_id ORDER BY submitted_at, proposal_id) AS i FROM (
          SELECT *, coalesce(predicted_confidence < 0.5, false) AS m FROM proposals)) GROUP BY ALL) GROUP BY ALL"""
)
def low_confidence_streaks(spark, d):
    rows = table(spark, d, "proposals", "proposal_id", "universe_id", "submitted_at", "predicted_confidence")
    return ledger.longest_streaks(rows, "universe_id", F.col("predicted_confidence") < 0.5, "submitted_at", "proposal_id")


@_query(
    """SELECT from_value, to_value, count(*) AS n FROM (SELECT lag(priority_category) OVER w AS from_value, priority_category AS to_value, row_number() OVER w AS k
      FROM proposals WINDOW w AS (PARTITION BY universe_id ORDER BY submitted_at, proposal_id)) WHERE k > 1 GROUP BY ALL"""
)
def category_transitions(spark, d):
    rows = table(spark, d, "proposals", "proposal_id", "universe_id", "submitted_at", "priority_category")
    return ledger.transitions(rows, "universe_id", "priority_category", "submitted_at", "proposal_id")


@_query(
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS hour, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
      count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT) % 2) AS BIGINT) AS odd FROM events GROUP BY ALL"""
)
def bars_from_events(spark, d):
    """Hourly bars of an event stream, and a field of its JSON payload."""
    rows = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(k, F.lit(2))).alias("odd"),
    )


@_query()
def block_bootstrap_market(spark, d):
    return nulls.block_bootstrap(_aligned(spark, d))


@_query()
def phase_randomised_market(spark, d):
    return nulls.phase_randomised(_aligned(spark, d))


_EACH = "for j in range(1, len(w) + 1)"
_PAPER = {"nav": 4, "gross": 9, "net": 9, "turnover": 9, "cost_bps": 5}


@_query(
    _chain(
        "friction",
        f""", wide AS (
          SELECT universe_id, t, list(weight ORDER BY f.symbol) AS w, list(close ORDER BY f.symbol) AS c, list(ret ORDER BY f.symbol) AS r, list(slippage ORDER BY f.symbol) AS slip,
            list(coalesce(step_size, 0) ORDER BY f.symbol) AS st, list(coalesce(min_qty, 0) ORDER BY f.symbol) AS mq, list(coalesce(min_notional, 0) ORDER BY f.symbol) AS mn
          FROM friction f LEFT JOIN symbol_filters x ON f.symbol = x.symbol GROUP BY universe_id, t),
        bar AS (SELECT *, row_number() OVER u - 1 AS k, lead(r) OVER u AS nxt FROM wide WINDOW u AS (PARTITION BY universe_id ORDER BY t)),
        sim AS (
          SELECT universe_id, k, t, 100000e0 AS nav, [0e0 {_EACH}] AS a, [0e0 {_EACH}] AS d, 0e0 AS gross, 0e0 AS net, 0e0 AS turnover, NULL::DOUBLE AS cost_bps, 0::BIGINT AS orders, 0::BIGINT AS rejected FROM bar WHERE k = 0
          UNION ALL
          SELECT universe_id, k, t, v * (1 + g - cost / v), CASE WHEN live THEN held ELSE a END, CASE WHEN live THEN w ELSE d END, g, g - cost / v, turn, CASE WHEN turn > 1e-6 THEN cost / v / turn * 10000 END, n, n - good FROM (
            SELECT *, CASE WHEN live THEN list_sum([held[j] * nxt[j] {_EACH}]) ELSE 0e0 END AS g FROM (
              SELECT *, [a[j] + val[j] / v {_EACH}] AS held, list_sum([abs(val[j]) / v {_EACH}]) AS turn, list_sum([abs(val[j]) * ({FEE} + slip[j]) {_EACH}]) AS cost, len([1 {_EACH} if go[j]]) AS n, len([1 {_EACH} if val[j] <> 0]) AS good FROM (
                SELECT *, [CASE WHEN go[j] AND abs(lot[j]) >= mq[j] - 1e-12 AND abs(lot[j] * c[j]) >= mn[j] - 1e-12 AND abs(lot[j] * c[j]) >= 1e-12 THEN lot[j] * c[j] ELSE 0e0 END {_EACH}] AS val FROM (
                  SELECT *, [CASE WHEN NOT go[j] THEN 0e0 WHEN st[j] > 0 THEN sign(w[j] - a[j]) * floor(abs((w[j] - a[j]) * v / c[j]) / st[j] + 1e-9) * st[j] ELSE (w[j] - a[j]) * v / c[j] END {_EACH}] AS lot FROM (
                    SELECT b.*, s.nav AS v, s.a, s.d, b.k >= 24 AND b.nxt IS NOT NULL AS live, [b.k >= 24 AND b.nxt IS NOT NULL AND abs(w[j] - s.d[j]) > 1e-9 AND abs(w[j] - s.a[j]) > 1e-4 {_EACH}] AS go
                    FROM sim s JOIN bar b ON s.universe_id = b.universe_id AND b.k = s.k + 1)))))) """
        + _sql_rounded("universe_id, t, orders, rejected", _PAPER, "sim"),
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def paper_simulation(spark, d):
    rows = features.slippage_rate(features.friction_ratios(_weights(spark, d)))
    return _rounded(portfolio.paper_simulation(rows, table(spark, d, "symbol_filters"), fee=FEE), ["universe_id", "t", "orders", "rejected"], _PAPER)


@_query()
def spot_simulation(spark, d):
    return portfolio.spot_simulation(portfolio.long_only(_weights(spark, d, "state")))


CAPITAL = 100_000.0
STRATEGIES = ("STRATEGY", "BUY_AND_HOLD", "SIMPLE_MOMENTUM", "SIMPLE_MEAN_REVERSION", "CASH")


def _simulated(spark: SparkSession, d: str) -> DataFrame:
    """The strategy and its baselines bar by bar: all weights are columns of one frame, so the bars are aligned once."""
    rows = features.slippage_rate(features.friction_ratios(_weights(spark, d)))
    rows = signals.held_weights(rows.withColumnRenamed("weight", "w0")).withColumnRenamed("weight", "w1")
    rows = signals.momentum_leader(rows).withColumnRenamed("weight", "w2")
    rows = signals.reversion_weights(signals.reversion_state(rows)).withColumnRenamed("weight", "w3").withColumn("w4", F.lit(0.0))
    return portfolio.weighted_simulation(rows, CAPITAL, FEE, weights={name: f"w{i}" for i, name in enumerate(STRATEGIES)})


_SUM = {"net_sharpe": 4, "gross_sharpe": 4, "cagr_net": 5, "max_drawdown": 7, "annual_turnover": 5, "mean_cost_bps": 6, "ending_nav_usd": 3, "total_pnl_usd": 3}


@_query(
    _chain(
        "sims",
        _sql_rounded(
            "universe_id, strategy, total_trades",
            _SUM,
            f"""(SELECT universe_id, strategy, avg(net) / (stddev_pop(net) + 1e-8) * {_YEAR} AS net_sharpe, avg(gross) / (stddev_pop(gross) + 1e-8) * {_YEAR} AS gross_sharpe, avg(net) * 8760 AS cagr_net,
              min(dd) AS max_drawdown, sum(turnover) * 8760 / count(*) AS annual_turnover, avg(cost_bps) AS mean_cost_bps, count(*) FILTER (traded) AS total_trades, arg_max(nav, t) AS ending_nav_usd, arg_max(nav, t) - 100000 AS total_pnl_usd
            FROM (SELECT *, cum - max(cum) OVER p AS dd FROM (SELECT *, sum(net) OVER p AS cum FROM sims WINDOW p AS (PARTITION BY strategy, universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
              WINDOW p AS (PARTITION BY strategy, universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY universe_id, strategy)""",
        ),
    )
)
def baseline_performance(spark, d):
    """The strategy beside buy and hold, momentum, reversion and cash."""
    return _rounded(portfolio.summary(_simulated(spark, d), ["universe_id", "strategy"], CAPITAL), ["universe_id", "strategy", "total_trades"], _SUM)


_DAY = {"strategy_nav": 3, "strategy_sharpe": 4, "strategy_drawdown": 7, "bnh_nav": 3, "bnh_sharpe": 4, "mom_nav": 3, "mr_nav": 3, "cash_nav": 3, "excess_vs_bnh": 7}
_SHORT = {"STRATEGY": "strategy", "BUY_AND_HOLD": "bnh", "SIMPLE_MOMENTUM": "mom", "SIMPLE_MEAN_REVERSION": "mr", "CASH": "cash"}


_DAYS = (
    "(SELECT universe_id, CAST(bar // 24 AS INT) AS day, max(trades) FILTER (strategy = 'STRATEGY') AS strategy_trades, "
    + ", ".join(f"max({c}) FILTER (strategy = '{n}') AS {s}_{c}" for n, s in _SHORT.items() for c in ("nav", "sharpe", "drawdown"))
    + f""", (max(nav) FILTER (strategy = 'STRATEGY') - max(nav) FILTER (strategy = 'BUY_AND_HOLD')) / 100000 AS excess_vs_bnh
    FROM (SELECT *, min(dd) OVER p AS drawdown FROM (SELECT *, cum - max(cum) OVER p AS dd FROM (
      SELECT *, sum(net) OVER p AS cum, avg(net) OVER p / (stddev_pop(net) OVER p + 1e-8) * {_YEAR} AS sharpe, CAST(sum(CAST(traded AS INT)) OVER p AS BIGINT) AS trades FROM sims
      WINDOW p AS (PARTITION BY strategy, universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WINDOW p AS (PARTITION BY strategy, universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WINDOW p AS (PARTITION BY strategy, universe_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE bar % 24 = 0 GROUP BY universe_id, bar)"""
)


@_query(_chain("sims", _sql_rounded("universe_id, day, strategy_trades", _DAY, _DAYS)))
def portfolio_snapshots(spark, d):
    """Every 24 bars: value, running Sharpe ratio and drawdown of the strategy and its baselines, and the excess over buy and hold."""
    rows = _snapshots(spark, d)
    return _rounded(rows, ["universe_id", "day", "strategy_trades"], _DAY)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return metrics.strategy_snapshots(_simulated(spark, d), _SHORT, CAPITAL)


_WEEK = {"strategy_nav": 3, "bnh_nav": 3, "excess_vs_bnh": 7}


@_query(
    _chain("sims", f""", days AS {_DAYS}, ends AS (SELECT universe_id, w AS week, least(7 * w, last) AS day FROM (SELECT universe_id, max(day) AS last FROM days GROUP BY ALL), (SELECT CAST(unnest(range(1, 14)) AS INT) AS w)) """)
    + _sql_rounded("universe_id, week, day, strategy_trades", _WEEK, "(SELECT * FROM ends JOIN days USING (universe_id, day))")
)
def weekly_progress(spark, d):
    """The snapshots at the end of each of 13 weeks, or of the last day where there are fewer."""
    return _rounded(metrics.weekly(_snapshots(spark, d), "universe_id"), ["universe_id", "week", "day", "strategy_trades"], _WEEK)


@_query(_chain("ret", _sql_rounded("a, b, overlap, duplicate", {"rho": 7}, f"(SELECT *, rho >= 0.999e0 AND overlap > 100 AS duplicate FROM {_PAIRS})")))
def duplicate_series(spark, d):
    """Pairs of series within a universe, with those that are duplicates (rho of 0.999 or more over more than 100 bars)."""
    return _rounded(metrics.duplicates(_asset_pairs(spark, d)), ["a", "b", "overlap", "duplicate"], {"rho": 7})


def _clusters(pairs: DataFrame, series: DataFrame, estimators: tuple[str, ...] = ("cluster", "rho_avg", "rank"), threshold: float = 0.95) -> DataFrame:
    """Effective number of series of each universe by each estimator, from its matrix of correlations (of a few assets)."""
    import numpy as np
    import pandas as pd

    from barlattice.functions.stats import effective_trials as effective

    names = series.groupBy("universe_id").agg(F.array_sort(F.collect_set("series")).alias("names"))
    matrix = pairs.groupBy("universe_id").agg(F.collect_list(F.struct("a", "b", "rho")).alias("pairs"))

    def frames(parts):
        for p in parts:
            out = []
            for u, labels, found in zip(p["universe_id"], p["names"], p["pairs"]):
                at = {n: i for i, n in enumerate(labels)}
                m = np.eye(len(labels))
                for r in found if found is not None else ():
                    m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["rho"]
                out.append((u, len(labels), *[effective(m, e, threshold) for e in estimators]))
            yield pd.DataFrame(out, columns=["universe_id", "k", *[f"k_{e}" for e in estimators]])

    return names.join(matrix, "universe_id", "left").mapInPandas(frames, "universe_id string, k long, " + ", ".join(f"k_{e} double" for e in estimators))


@_query()
def trial_clusters(spark, d):
    """Number of series, of clusters by complete linkage at 0.95, and by mean correlation and rank, of each universe."""
    series = _returns(spark, d).select("universe_id", F.concat_ws("/", "universe_id", "symbol").alias("series")).distinct()
    return _clusters(_asset_pairs(spark, d), series)


@_query()
def deflated_sharpe(spark, d):
    """Deflated Sharpe ratio of each strategy of a universe by each way of knowing the trials' spread.

    The trials of a universe are its strategies and baselines but cash; ``empirical`` takes their own ratios.
    """
    import pandas as pd

    from barlattice.functions.stats import VARIANCES, deflated_sharpe_by

    rows = _simulated(spark, d).filter("strategy <> 'CASH'").withColumn("key", F.struct("universe_id", "strategy"))
    per = metrics.performance(rows, "key").select("key.universe_id", F.struct("key.strategy", "n", "sharpe", "skew", "kurtosis").alias("s"))
    trials = per.groupBy("universe_id").agg(F.collect_list("s").alias("trials"))  # four to a universe

    def frames(parts):
        for p in parts:
            out = []
            for u, found in zip(p["universe_id"], p["trials"]):
                ratios = [r["sharpe"] for r in found]
                for r in found:
                    for method in VARIANCES:
                        if method != "empirical" or len(ratios) >= 2:
                            got = deflated_sharpe_by(method, r["sharpe"], int(r["n"]), r["skew"], r["kurtosis"], len(ratios), ratios, 0.05)
                            out.append((u, r["strategy"], method, got["dsr"], got["psr"], got["expected_max"]))
            yield pd.DataFrame(out, columns=["universe_id", "strategy", "method", "dsr", "psr", "expected_max"])

    return trials.mapInPandas(frames, "universe_id string, strategy string, method string, dsr double, psr double, expected_max double")


@_query()
def null_tests(spark, d):
    """Bootstrap test of the mean return of each strategy and baseline but cash."""
    rows = _simulated(spark, d).filter("strategy <> 'CASH'").withColumn("key", F.concat_ws("/", "universe_id", "strategy"))
    return nulls.bootstrap_tests(rows, "key", "net", 400)


@_query()
def live_books(spark, d):
    """The live books (strategy and baselines) of each universe, bar by bar, as the stream keeps them."""
    from barlattice.operators import books

    bars = _aligned(spark, d).select("universe_id", "symbol", "t", "open", "high", "low", "close", "volume")
    return books.replayed(bars, table(spark, d, "symbol_filters"))


@_query()
def code_hashes(spark, d):
    rows = table(spark, d, "proposals", "proposal_id", "code_str", *_CONFIG)
    return ledger.code_hashes(rows, "code_str", list(_CONFIG)).select("proposal_id", "code_hash")


_CONFIG = ("theta_enter", "theta_exit", "position_size", "adaptive_hysteresis", "enter_pct", "exit_pct")


@_query()
def repeated_code(spark, d):
    """Proposals whose code and configuration an earlier one had."""
    rows = ledger.code_hashes(table(spark, d, "proposals", "proposal_id", "code_str", "submitted_at", *_CONFIG), "code_str", list(_CONFIG))
    return ledger.repeated_hashes(rows, "code_hash", "submitted_at", "proposal_id")


@_query(
    """SELECT proposal_id, row_number() OVER (PARTITION BY universe_id ORDER BY submitted_at, proposal_id) AS family_trial,
      row_number() OVER (ORDER BY submitted_at, proposal_id) AS global_trial FROM proposals WHERE submitted_at IS NOT NULL"""
)
def recorded_trials(spark, d):
    rows = table(spark, d, "proposals", "proposal_id", "universe_id", "submitted_at", "variant_name").filter("submitted_at IS NOT NULL")
    return ledger.recorded(rows, "universe_id", "submitted_at", "proposal_id", ["proposal_id", "variant_name"]).select("proposal_id", F.col("family_trial").cast("long").alias("family_trial"), F.col("global_trial").cast("long").alias("global_trial"))
