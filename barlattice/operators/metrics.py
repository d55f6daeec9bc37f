"""Performance metrics by named convention.  Frames have a key, a time ``t`` and return columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS_A_YEAR = 8760
FEE_GRID = (0.0, 5.0, 10.0, 25.0, 50.0, 100.0)


def _sum_when(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def performance(returns: DataFrame, key: str, column: str = "net", periods: int = HOURS_A_YEAR) -> DataFrame:
    """One row per key: mean, sample deviation, Sharpe, Sortino, win rate, profit factor, skew, kurtosis.

    Sharpe and Sortino are per period and annualised; 0 where the deviation is at
    most 1e-12.  Downside deviation divides by n - 1.  The profit factor is
    infinite without losses and 0 without profit; skew and (Pearson) kurtosis are 0
    and 3 for a constant series.  Keys with fewer than 2 returns do not come out.
    """
    r = F.col(column)
    rows = returns.groupBy(key).agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("sd"),
        F.sum(F.pow(F.least(r, F.lit(0.0)), 2)).alias("__down"),
        F.count_if(r > 1e-12).alias("__won"),
        F.count_if(F.abs(r) > 1e-12).alias("__moved"),
        _sum_when(r > 0, r).alias("__profit"),
        _sum_when(r < 0, -r).alias("__loss"),
        F.var_pop(r).alias("__m2"),
        F.skewness(r).alias("__skew"),
        F.kurtosis(r).alias("__kurt"),
    ).filter("n >= 2")
    moving = F.col("sd") > 1e-12
    down = F.sqrt(F.col("__down") / (F.col("n") - 1))
    sharpe = F.when(moving, F.col("mean") / F.when(moving, F.col("sd"))).otherwise(0.0)
    sortino = F.when(down > 1e-12, F.col("mean") / F.when(down > 1e-12, down)).otherwise(0.0)
    spread = F.col("__m2") > 1e-12
    factor = (
        F.when(F.col("__loss") > 0, F.col("__profit") / F.when(F.col("__loss") > 0, F.col("__loss")))
        .when(F.col("__profit") > 0, F.lit(float("inf")))
        .otherwise(0.0)
    )
    return rows.select(
        key,
        "n",
        "mean",
        "sd",
        sharpe.alias("sharpe"),
        (sharpe * F.sqrt(F.lit(float(periods)))).alias("sharpe_ann"),
        (sortino * F.sqrt(F.lit(float(periods)))).alias("sortino_ann"),
        F.when(F.col("__moved") > 0, F.col("__won") / F.when(F.col("__moved") > 0, F.col("__moved"))).otherwise(0.0).alias("win_rate"),
        factor.alias("profit_factor"),
        F.when(spread, F.col("__skew")).otherwise(0.0).alias("skew"),
        F.when(spread, F.col("__kurt") + 3).otherwise(3.0).alias("kurtosis"),
    )


def backtest_sharpe(returns: DataFrame, key: str, column: str = "net", floor: float = 1e-8) -> DataFrame:
    """Annualised mean over (population deviation + ``floor``), the convention of backtests (1e-12: of baselines)."""
    r = F.col(column)
    return returns.groupBy(key).agg((F.avg(r) / (F.stddev_pop(r) + floor) * F.sqrt(F.lit(float(HOURS_A_YEAR)))).alias("sharpe"), (F.avg(r) * HOURS_A_YEAR).alias("arithmetic_cagr"))


def _path(returns: DataFrame, key: str, column: str, scale: float):
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(column) * scale
    return returns.select(key, "t", r.alias("__r"), F.sum(r).over(w).alias("__cum"), F.greatest(F.product(1 + r).over(w), F.lit(1e-12)).alias("__eq")), w


def drawdowns(returns: DataFrame, key: str, column: str = "net", scale: float = 1.0) -> DataFrame:
    """Per key: ``nav_dd`` (compounded, peak from 1), ``cum_dd`` (cumulative sum, peak from its first value), ``cagr``, ``calmar``.

    Equity is the product of all 1 + r, at least 1e-12: an account that is wiped out
    stays so.  CAGR is geometric; Calmar is 0 without a drawdown.
    """
    rows, w = _path(returns, key, column, scale)
    rows = rows.withColumns({"__peak": F.greatest(F.lit(1.0), F.max("__eq").over(w)), "__cpeak": F.max("__cum").over(w)})
    per = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min((F.col("__eq") - F.col("__peak")) / F.col("__peak")).alias("nav_dd"),
        F.min(F.col("__cum") - F.col("__cpeak")).alias("cum_dd"),
        F.max_by("__eq", "t").alias("equity"),
    )
    cagr = F.pow("equity", HOURS_A_YEAR / F.col("n")) - 1
    fell = F.abs("nav_dd") > 1e-12
    return per.select(key, "n", "nav_dd", "cum_dd", "equity", cagr.alias("cagr"), F.when(fell, cagr / F.when(fell, F.abs("nav_dd"))).otherwise(0.0).alias("calmar"))


def turnover_summary(returns: DataFrame, key: str) -> DataFrame:
    """Annual turnover, trades, mean and largest cost (idle bars at 10 bps, and traded bars only), friction penalty."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    return returns.groupBy(key).agg(
        (F.sum("turnover") * HOURS_A_YEAR / n).alias("annual_turnover"),
        F.count_if("traded").alias("trades"),
        F.avg("cost_bps").alias("mean_cost_bps"),
        F.max("cost_bps").alias("max_cost_bps"),
        F.avg(F.when(F.col("traded"), F.col("cost_bps"))).alias("mean_traded_bps"),
        ((F.avg("flat_net") - F.avg("net")) * HOURS_A_YEAR).alias("friction_penalty"),
    )


def cost_curve(returns: DataFrame, key: str, grid: tuple[float, ...] = FEE_GRID) -> DataFrame:
    """Mean, deviation and Sharpe of gross less turnover times fee for each fee of the grid (a literal of a few numbers)."""
    fees = returns.withColumn("fee_bps", F.explode(F.array(*[F.lit(f) for f in grid])))
    net = F.col("gross") - F.col("turnover") * F.col("fee_bps") / 10_000
    rows = fees.withColumn("__net", net).groupBy(key, "fee_bps").agg(F.avg("__net").alias("mean"), F.stddev_samp("__net").alias("sd"))
    moving = F.col("sd") > 1e-12
    return rows.withColumn("sharpe_ann", F.when(moving, F.col("mean") / F.when(moving, F.col("sd")) * F.sqrt(F.lit(float(HOURS_A_YEAR)))).otherwise(0.0))


def cost_curve_by(run: Callable[[float], DataFrame], key: str, column: str = "net", grid: tuple[float, ...] = FEE_GRID) -> DataFrame:
    """The same curve for a simulation that must be run anew for each fee: ``run`` gives the returns at a fee rate."""
    curve = None
    for fee in grid:
        rows = run(fee / 10_000).groupBy(key).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")).withColumn("fee_bps", F.lit(float(fee)))
        curve = rows if curve is None else curve.unionByName(rows)
    moving = F.col("sd") > 1e-12
    return curve.withColumn("sharpe_ann", F.when(moving, F.col("mean") / F.when(moving, F.col("sd")) * F.sqrt(F.lit(float(HOURS_A_YEAR)))).otherwise(0.0))


def breakeven(curve: DataFrame, key: str) -> DataFrame:
    """``breakeven_bps``: where the Sharpe of a cost curve reaches 0; ``decay``: size of its slope for 10 bps; survival at 10 and 25.

    0 if it starts at or below 0; linear between the first point above and the first
    at or below; beyond the grid by the last segment, infinite if that does not fall.
    """
    w = Window.partitionBy(key).orderBy("fee_bps")
    s, f = F.col("sharpe_ann"), F.col("fee_bps")
    rows = curve.withColumns({"__s2": F.lead(s).over(w), "__f2": F.lead(f).over(w), "__k": F.row_number().over(w), "__n": F.count(s).over(Window.partitionBy(key))})
    crossing = (s > 0) & (F.col("__s2") <= 0)
    cut = f + (F.col("__f2") - f) * s / F.when(crossing, s - F.col("__s2"))
    slope = (F.col("__s2") - s) / (F.col("__f2") - f)
    beyond = F.when(slope < -1e-12, F.greatest(F.lit(0.0), F.col("__f2") - F.col("__s2") / F.when(slope < -1e-12, slope))).otherwise(float("inf"))
    per = rows.groupBy(key).agg(
        F.min(F.when(crossing, cut)).alias("__cut"),
        F.max(F.when(F.col("__k") == 1, s)).alias("__first"),
        F.max(F.when(F.col("__k") == F.col("__n") - 1, beyond)).alias("__beyond"),
        (F.abs(F.regr_slope(s, f)) * 10).alias("decay"),
        F.max(F.when(f == 10, s > 0)).alias("survives_10"),
        F.max(F.when(f == 25, s > 0)).alias("survives_25"),
    )
    point = F.when(F.col("__first") <= 0, 0.0).otherwise(F.coalesce("__cut", "__beyond"))
    return per.select(key, point.alias("breakeven_bps"), "decay", "survives_10", "survives_25")


def regime(rows: DataFrame, crash_return: float = -0.20, crash_dd: float = -0.30) -> DataFrame:
    """Equal-weight buy and hold of each universe: ``total``, ``worst`` drawdown, ``regime`` CRASH or NORMAL."""
    per = rows.groupBy("universe_id", "t").agg(F.avg("level").alias("nav"))
    w = Window.partitionBy("universe_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("__peak", F.greatest(F.lit(1.0), F.max("nav").over(w)))
    total = F.max_by("nav", "t") - 1
    worst = F.min(F.col("nav") / F.col("__peak") - 1)
    out = per.groupBy("universe_id").agg(total.alias("total"), worst.alias("worst"))
    return out.withColumn("regime", F.when((F.col("total") <= crash_return) & (F.col("worst") <= crash_dd), "CRASH").otherwise("NORMAL"))


def daily_snapshots(returns: DataFrame, key: str, every: int = 24, column: str = "net") -> DataFrame:
    """Every ``every`` bars: expanding Sharpe (population deviation + 1e-8), cumulative-sum drawdown, turnover, trades."""
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(column)
    rows = returns.withColumns({"bar": F.row_number().over(Window.partitionBy(key).orderBy("t")), "cum": F.sum(r).over(w)})
    rows = rows.withColumn("__dd", F.col("cum") - F.max("cum").over(w))
    rows = rows.withColumns(
        {
            "sharpe": F.avg(r).over(w) / (F.stddev_pop(r).over(w) + 1e-8) * F.sqrt(F.lit(float(HOURS_A_YEAR))),
            "drawdown": F.min("__dd").over(w),
            "turnover_sum": F.sum("turnover").over(w),
            "trade_count": F.sum(F.col("traded").cast("int")).over(w),
        }
    )
    return rows.filter(F.pmod("bar", F.lit(every)) == 0).select(key, (F.col("bar") / every).cast("int").alias("day"), "cum", "sharpe", "drawdown", "turnover_sum", "trade_count")


def strategy_snapshots(simulated: DataFrame, names: dict[str, str], capital: float, every: int = 24) -> DataFrame:
    """Every ``every`` bars of a universe: ``<name>_nav``, ``_sharpe`` (expanding, population deviation + 1e-8), ``_drawdown``
    (of the summed returns) and ``_trades`` of each strategy side by side, and the excess of the first over the second."""
    w = Window.partitionBy("universe_id", "strategy").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = simulated.withColumn("__cum", F.sum("net").over(w)).withColumn("__dd", F.col("__cum") - F.max("__cum").over(w))
    rows = rows.withColumns(
        {
            "drawdown": F.min("__dd").over(w),
            "sharpe": F.avg("net").over(w) / (F.stddev_pop("net").over(w) + 1e-8) * F.sqrt(F.lit(float(HOURS_A_YEAR))),
            "trades": F.sum(F.col("traded").cast("long")).over(w),
        }
    ).filter(F.pmod("bar", F.lit(every)) == 0)
    fields = [F.max(F.when(F.col("strategy") == n, F.col(c))).alias(f"{short}_{c}") for n, short in names.items() for c in ("nav", "sharpe", "drawdown", "trades")]
    first, second = [*names.values()][:2]
    per = rows.groupBy("universe_id", (F.col("bar") / every).cast("int").alias("day")).agg(*fields)
    return per.withColumn(f"excess_vs_{second}", (F.col(f"{first}_nav") - F.col(f"{second}_nav")) / capital)


def weekly(snapshots: DataFrame, key: str, weeks: int = 13) -> DataFrame:
    """``week`` 1 to ``weeks`` of each key with the snapshot of day 7 * week, or of the last day if that comes before."""
    last = snapshots.groupBy(key).agg(F.max("day").alias("__last"))
    wanted = last.select(key, F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"), "__last").select(key, "week", F.least(F.col("week") * 7, F.col("__last")).alias("day"))
    return wanted.join(snapshots, [key, "day"])


def nav_sharpe(values: DataFrame, key: str, nav: str, periods: int = HOURS_A_YEAR) -> DataFrame:
    """Annualised Sharpe ratio of the changes of a value (population deviation, 0 where it does not move), as dashboards show it."""
    w = Window.partitionBy(key).orderBy("t")
    change = F.col(nav) / F.lag(nav).over(w) - 1
    per = values.select(key, change.alias("__r")).groupBy(key).agg(F.avg("__r").alias("m"), F.stddev_pop("__r").alias("s"))
    moving = F.col("s") > 0
    return per.select(key, F.when(moving, F.col("m") / F.when(moving, F.col("s")) * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe"))


def pair_correlations(returns: DataFrame, within: str, key: str, column: str = "net") -> DataFrame:
    """Correlation of every two keys of the same ``within`` over their common ``t`` (a before b); 0 if one is constant.

    The pairs are the result: of the strategies or assets of a universe, of which there are few.
    """
    rows = returns.select(F.col(within), F.col(key).alias("key"), "t", F.col(column).alias("r"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{within}") == F.col(f"b.{within}")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.key") < F.col("b.key")))
    x, y = F.col("a.r"), F.col("b.r")
    sums = pairs.groupBy(F.col(f"a.{within}").alias(within), F.col("a.key").alias("a"), F.col("b.key").alias("b")).agg(
        F.count(F.lit(1)).alias("overlap"), F.covar_pop(x, y).alias("__c"), F.stddev_pop(x).alias("__x"), F.stddev_pop(y).alias("__y")
    )
    usable = (F.col("__x") > 1e-12) & (F.col("__y") > 1e-12)
    rho = F.when(usable, F.col("__c") / F.when(usable, F.col("__x") * F.col("__y"))).otherwise(0.0)
    return sums.select(within, "a", "b", "overlap", rho.alias("rho"))


def duplicates(pairs: DataFrame, rho: float = 0.999, overlap: int = 100) -> DataFrame:
    """Adds ``duplicate``: more than ``overlap`` common returns that correlate at ``rho`` or more."""
    return pairs.withColumn("duplicate", (F.col("rho") >= rho) & (F.col("overlap") > overlap))


def effective_trials(pairs: DataFrame, series: DataFrame) -> DataFrame:
    """Effective number of trials by mean correlation and by rank: k/(1+(k-1)rho) and k^2/sum of squares, within 1 to k.

    k is the number of rows of ``series``; it is counted in the same aggregation.
    """
    both = pairs.select("rho", F.lit(0).alias("__one")).unionByName(series.select(F.lit(None).cast("double").alias("rho"), F.lit(1).alias("__one")))
    sums = both.agg(F.avg("rho").alias("__m"), F.sum(F.col("rho") * F.col("rho")).alias("__q"), F.sum("__one").cast("double").alias("__k"))
    k = F.col("__k")
    mean = F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.coalesce("__m", F.lit(0.0))))
    bounded = lambda x: F.least(k, F.greatest(F.lit(1.0), x))
    return sums.select(bounded(k / (1 + (k - 1) * mean)).alias("k_mean"), bounded(k * k / (k + 2 * F.coalesce("__q", F.lit(0.0)))).alias("k_rank"))


def effective_trials_by(pairs: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """``effective_trials`` of each key on its own: ``k`` is the number of its ``series``, ``pairs`` are those between them."""
    sums = pairs.groupBy(key).agg(F.avg("rho").alias("__m"), F.sum(F.col("rho") * F.col("rho")).alias("__q"))
    k = F.col("k").cast("double")
    mean = F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.coalesce("__m", F.lit(0.0))))
    bounded = lambda x: F.least(k, F.greatest(F.lit(1.0), x))
    rows = series.groupBy(key).agg(F.count(F.lit(1)).alias("k")).join(sums, key, "left")
    return rows.select(key, "k", bounded(k / (1 + (k - 1) * mean)).alias("k_mean"), bounded(k * k / (k + 2 * F.coalesce("__q", F.lit(0.0)))).alias("k_rank"))
