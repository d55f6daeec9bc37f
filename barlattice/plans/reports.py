"""Queries of states, logs and comparisons over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.operators import align, ledger, metrics, nulls, portfolio, states
from barlattice.plans import research
from barlattice.plans.research import _W, _chain, _rounded, _sql_rounded
from barlattice.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Instants later than this are still forming, for the example of closed bars.
NOW_MS = 1_700_000_000_000
_CLOSE_MS = research._MS.replace("timestamp_open", "timestamp_close")


@_query(f"SELECT bar_id FROM bars WHERE {_CLOSE_MS} <= {NOW_MS}")
def closed_bars(spark, d):
    return align.closed(table(spark, d, "bars", "bar_id", "timestamp_close"), NOW_MS).select("bar_id")


@_query(
    """SELECT delivery_id FROM tickets WHERE side = 'SELL' AND (contains(lower(symbol), 'qor') OR contains(lower(run_id), 'qor') OR contains(lower(batch_id), '0007'))"""
)
def trade_log(spark, d):
    rows = table(spark, d, "tickets", "delivery_id", "symbol", "side", "run_id", "batch_id")
    return rows.filter((F.col("side") == "SELL") & (states.mentions("qor", "symbol", "run_id") | states.mentions("0007", "batch_id"))).select("delivery_id")


@_query(
    """WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY saved_at DESC, state_id DESC) AS k FROM live_states) WHERE k = 1)
    SELECT run_id, state_id, total_trades_count, floor(portfolio_nav_usd * 1e4 + 0.5) / 1e4 AS nav FROM last"""
)
def latest_states(spark, d):
    rows = states.latest(table(spark, d, "live_states", "run_id", "state_id", "saved_at", "total_trades_count", "portfolio_nav_usd"), "run_id", "saved_at", "state_id")
    return rows.select("run_id", "state_id", "total_trades_count", align.whole(F.col("portfolio_nav_usd"), 4).alias("nav"))


@_query(
    """SELECT state_id, symbol, floor(position * 1e8 + 0.5) / 1e8 AS position, floor(cap * 1e8 + 0.5) / 1e8 AS cap, abs(position) > cap + 1e-12 AS above FROM (
      SELECT state_id, e.key AS symbol, e.value AS position, coalesce(position_caps[e.key], 1e0) AS cap
      FROM (SELECT state_id, position_caps, unnest(map_entries(positions)) AS e FROM live_states))"""
)
def positions_and_caps(spark, d):
    rows = states.against_caps(table(spark, d, "live_states", "state_id", "positions", "position_caps"), "state_id")
    return _rounded(rows, ["state_id", "symbol", "above"], {"position": 8, "cap": 8})


@_query("SELECT event_type, count(*) AS n, count(*) FILTER (contains(props, '9')) AS nines, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def event_counts(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("props").contains("9")).alias("nines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@_query(
    _chain(
        "path",
        _sql_rounded("universe_id, t", {"equity": 8, "cum": 8, "nav_dd": 8, "cum_dd": 8}, "(SELECT universe_id, t, eq AS equity, cum, (eq - greatest(1e0, pk)) / greatest(1e0, pk) AS nav_dd, cum - cpk AS cum_dd FROM path)"),
    )
)
def equity_paths(spark, d):
    return _rounded(portfolio.equity(research._portfolio(spark, d)), ["universe_id", "t"], {"equity": 8, "cum": 8, "nav_dd": 8, "cum_dd": 8})


@_query(
    _chain(
        "ret",
        _sql_rounded(
            "series, n",
            {"nav_dd": 8, "equity": 7},
            """(SELECT series, count(*) AS n, min((eq - greatest(1e0, pk)) / greatest(1e0, pk)) AS nav_dd, arg_max(eq, t) AS equity FROM (
              SELECT *, max(eq) OVER w AS pk FROM (
                SELECT universe_id || '/' || symbol AS series, t, greatest(product(1 + ret) OVER (PARTITION BY universe_id, symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-12) AS eq FROM ret)
              WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY series)""",
        ),
    )
)
def buy_and_hold_drawdowns(spark, d):
    rows = research._returns(spark, d).withColumn("series", F.concat_ws("/", "universe_id", "symbol"))
    return _rounded(metrics.drawdowns(rows, "series", "ret"), ["series", "n"], {"nav_dd": 8, "equity": 7})


@_query(
    _chain(
        "bt",
        _sql_rounded(
            "universe_id, t",
            {"net": 9, "market": 9, "excess": 9},
            f"""(SELECT b.universe_id, b.t, net, m AS market, net - m AS excess FROM bt b JOIN (
              SELECT universe_id, t, avg(nxt) AS m FROM (SELECT *, lead(ret) OVER ({_W}) AS nxt FROM ret) WHERE nxt IS NOT NULL GROUP BY ALL) k
              ON b.universe_id = k.universe_id AND b.t = k.t)""",
        ),
    )
)
def excess_over_market(spark, d):
    held = states.market_returns(research._returns(spark, d))
    rows = research._portfolio(spark, d).join(held, ["universe_id", "t"]).withColumn("excess", F.col("net") - F.col("market"))
    return _rounded(rows, ["universe_id", "t"], {"net": 9, "market": 9, "excess": 9})


@_query(
    """SELECT universe_id, max(n) AS longest FROM (
      SELECT universe_id, i, count(*) FILTER (m) AS n FROM (
        SELECT universe_id, m, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY universe_id ORDER BY submitted_at, proposal_id) AS i FROM (
          SELECT *, row_number() OVER (PARTITION BY universe_id, code_str ORDER BY submitted_at, proposal_id) > 1 AS m FROM proposals)) GROUP BY ALL) GROUP BY ALL"""
)
def redundant_streaks(spark, d):
    rows = table(spark, d, "proposals", "proposal_id", "universe_id", "submitted_at", "code_str").withColumn("key", F.struct("universe_id", "code_str"))
    rows = ledger.occurrences(rows, "key", "submitted_at", "proposal_id")
    return ledger.longest_streaks(rows, "universe_id", F.col("revisit"), "submitted_at", "proposal_id")


@_query(
    """SELECT universe_id, CASE WHEN k <= 10 THEN 1 WHEN k <= 20 THEN 2 ELSE 3 END AS epoch, count(*) FILTER (p IS NOT NULL AND o IS NOT NULL) AS n,
      floor(avg(p) FILTER (o IS NOT NULL) * 1e6 + 0.5) / 1e6 AS mean_predicted, floor(avg(abs(p - o)) * 1e6 + 0.5) / 1e6 AS mae, floor(avg(CASE WHEN p IS NULL OR o IS NULL THEN NULL WHEN (p >= 0.5) = (o >= 0.5) THEN 1e0 ELSE 0e0 END) * 1e6 + 0.5) / 1e6 AS accuracy
    FROM (SELECT *, predicted_confidence AS p, CAST(adaptive_hysteresis AS INT) AS o, row_number() OVER (PARTITION BY universe_id ORDER BY submitted_at, proposal_id) AS k FROM proposals) GROUP BY ALL"""
)
def epoch_calibration(spark, d):
    """Calibration of the predicted confidence by epoch; the tables have no outcome, a recorded yes or no stands for one."""
    rows = table(spark, d, "proposals", "proposal_id", "universe_id", "submitted_at", "predicted_confidence", "adaptive_hysteresis")
    rows = ledger.epochs(ledger.numbered(rows, "universe_id", "submitted_at", "proposal_id"), "family_trial")
    per = ledger.calibration(rows, ["universe_id", "epoch"], "predicted_confidence", "adaptive_hysteresis")
    return _rounded(per, ["universe_id", "epoch", "n"], {"mean_predicted": 6, "mae": 6, "accuracy": 6})


@_query(_chain("aligned", "SELECT universe_id, t, list(symbol ORDER BY symbol) AS symbols, list(close ORDER BY symbol) AS closes FROM aligned GROUP BY ALL"))
def wide_closes_all(spark, d):
    """Closes of all assets of a universe side by side, however many it has."""
    return states.all_side_by_side(research._aligned(spark, d), "close").withColumnRenamed("values", "closes")


@_query()
def resampled_panels(spark, d):
    """The same resampled instants for all assets of a universe."""
    return nulls.resampled_panel(research._returns(spark, d), "ret")


@_query(_chain("ret", _sql_rounded("universe_id, symbol, t", {"factor": 8}, f"(SELECT universe_id, symbol, t, coalesce(tanh(close / lag(close, 24) OVER ({_W}) - 1), 0e0) AS factor FROM ret)")))
def factor_udf(spark, d):
    """A factor given as a Python function of a series' frame, run by series on the workers."""
    return _rounded(states.apply_factor(research._returns(spark, d), states.example_factor), ["universe_id", "symbol", "t"], {"factor": 8})


@_query("SELECT delivery_id, row_number() OVER (ORDER BY received_at DESC, delivery_id DESC) AS place FROM tickets QUALIFY place <= 200")
def newest_tickets(spark, d):
    """The 200 newest deliveries, newest first (a report's list)."""
    rows = states.newest(table(spark, d, "tickets", "delivery_id", "received_at"), "received_at", "delivery_id")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("received_at"), F.desc("delivery_id"))  # of 200 rows
    return rows.select("delivery_id", F.row_number().over(order).cast("long").alias("place"))


@_query(
    _chain(
        "path",
        _sql_rounded(
            "universe_id",
            {"sharpe": 5},
            f"""(SELECT universe_id, CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * {research._YEAR} ELSE 0e0 END AS sharpe FROM (
              SELECT universe_id, eq / lag(eq) OVER (PARTITION BY universe_id ORDER BY t) - 1 AS r FROM path) GROUP BY universe_id)""",
        ),
    )
)
def nav_sharpe(spark, d):
    """Sharpe ratio of the changes of each portfolio's equity."""
    return _rounded(metrics.nav_sharpe(portfolio.equity(research._portfolio(spark, d)), "universe_id", "equity"), ["universe_id"], {"sharpe": 5})
