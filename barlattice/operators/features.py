"""Causal columns of bars: returns, indices of peers, factors, friction.

All take aligned bars (``universe_id``, ``symbol``, ``t`` and prices) and add columns by
windows over a series or over the assets of one instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.align import SERIES, along


def _rows(before: int, after: int = 0):
    return along(*SERIES).rowsBetween(-before, after)


def _number() -> Column:
    return F.row_number().over(along(*SERIES))


def simple_returns(rows: DataFrame) -> DataFrame:
    """``ret``: change of close over the last close (at least 1e-8); 0 on the first bar."""
    last = F.lag("close").over(along(*SERIES))
    return rows.withColumn("ret", F.coalesce((F.col("close") - last) / F.greatest(F.lit(1e-8), last), F.lit(0.0)))


def log_returns(rows: DataFrame) -> DataFrame:
    """``log_ret``: difference of log close; 0 on the first bar."""
    last = F.lag("close").over(along(*SERIES))
    return rows.withColumn("log_ret", F.coalesce(F.ln("close") - F.ln(last), F.lit(0.0)))


def shape_ratios(rows: DataFrame) -> DataFrame:
    """Open, high and low over close, and the spread proxy (high - low) / close."""
    base = F.greatest(F.lit(1e-8), F.col("close"))
    ratios = {f"{c}_ratio": F.col(c) / base for c in ("open", "high", "low")}
    return rows.withColumns(ratios | {"spread": (F.col("high") - F.col("low")) / base})


def peer_indices(rows: DataFrame) -> DataFrame:
    """``level`` (close over first close), ``market`` (mean level), ``peer`` and ``dispersion``
    (mean and population deviation of the other assets' levels; alone: own level and 0)."""
    first = F.first("close").over(along(*SERIES).rowsBetween(Window.unboundedPreceding, 0))
    now = Window.partitionBy("universe_id", "t")
    rows = rows.withColumn("level", F.col("close") / F.greatest(F.lit(1e-12), first))
    rows = rows.withColumns({"market": F.avg("level").over(now), "__n": F.count(F.lit(1)).over(now) - 1})
    # sums over all, less the own: offsets from the mean keep small differences of large levels
    off, n = F.col("level") - F.col("market"), F.greatest("__n", F.lit(1))
    rows = rows.withColumn("__squares", F.sum(off * off).over(now))
    peer = F.when(F.col("__n") == 0, F.col("level")).otherwise(F.col("market") - off / n)
    spread = F.greatest(F.lit(0.0), F.col("__squares") - off * off - off * off / n) / n
    return rows.withColumns({"peer": peer, "dispersion": F.when(F.col("__n") <= 1, 0.0).otherwise(F.sqrt(spread))}).drop("__n", "__squares")


def momentum(rows: DataFrame, bars: int = 24) -> DataFrame:
    """``momentum``: close over the close ``bars`` before, less 1; null before that."""
    return rows.withColumn("momentum", F.try_divide(F.col("close"), F.lag("close", bars).over(along(*SERIES))) - 1)


def volume_ratio(rows: DataFrame, short: int = 16, long: int = 24) -> DataFrame:
    """``volume_ratio``: mean volume of ``short`` bars over that of ``long``; full windows only."""
    ratio = F.avg("volume").over(_rows(short - 1)) / (F.avg("volume").over(_rows(long - 1)) + 1e-8)
    return rows.withColumn("volume_ratio", F.when(_number() >= long, ratio))


def canonical_factor(rows: DataFrame) -> DataFrame:
    """``factor``: tanh of 0.6 momentum and 0.4 volume ratio, 0 while either is unknown."""
    known = volume_ratio(momentum(rows))
    value = F.tanh(0.60 * F.col("momentum") + 0.40 * F.col("volume_ratio"))
    return sanitise(known.withColumn("factor", value), "factor")


def sanitise(rows: DataFrame, column: str, limit: float = 1.05) -> DataFrame:
    """A factor made usable: null, NaN and infinite are 0, the rest is clipped to [-1, 1]; beyond ``limit`` it raises."""
    x = F.col(column)
    finite = F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    checked = F.when(F.abs(finite) > limit, F.raise_error(F.lit(f"{column} is outside its range"))).otherwise(finite)
    return rows.withColumn(column, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), checked.cast("double"))))


def trailing_volatility(rows: DataFrame, bars: int = 24) -> DataFrame:
    """``vol``: population deviation of the ``bars`` returns before this bar; 0 until there are so many."""
    sd = F.stddev_pop("ret").over(_rows(bars, -1))
    return rows.withColumn("vol", F.when(_number() <= bars, F.lit(0.0)).otherwise(sd))


def friction_ratios(rows: DataFrame, window: int = 720, least: int = 48) -> DataFrame:
    """``vol_ratio`` and ``spread_ratio``: against their own trailing mean (this bar included); 1 before ``least`` bars.

    Needs ``ret``; adds ``vol`` and ``spread``.  A window's mean is the difference of two
    prefix sums, so a row costs the same for any ``window``.
    """
    rows = trailing_volatility(shape_ratios(rows))
    series = along(*SERIES)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__k": _number(), "__vol": F.sum("vol").over(so_far), "__spread": F.sum("spread").over(so_far)})
    fields = {}
    for name, source in (("vol_ratio", "vol"), ("spread_ratio", "spread")):
        prefix = F.col(f"__{source}")
        mean = (prefix - F.coalesce(F.lag(prefix, window).over(series), F.lit(0.0))) / F.least("__k", F.lit(window))
        fields[name] = F.when(F.col("__k") < least, F.lit(1.0)).otherwise(F.col(source) / F.greatest(mean, F.lit(1e-6)))
    return rows.withColumns(fields).drop("__k", "__vol", "__spread")


def whole_sample_ratios(rows: DataFrame) -> DataFrame:
    """Friction ratios against the mean of the whole sample: looks ahead, for comparison only."""
    rows = trailing_volatility(shape_ratios(rows))
    series = Window.partitionBy(*SERIES)
    return rows.withColumns(
        {n: F.col(c) / F.greatest(F.avg(c).over(series), F.lit(1e-6)) for n, c in (("vol_ratio", "vol"), ("spread_ratio", "spread"))}
    )


def slippage_rate(rows: DataFrame, base: float = 0.0005) -> DataFrame:
    """``slippage``: half by volatility ratio, half by spread ratio."""
    return rows.withColumn("slippage", base * (0.5 * F.col("vol_ratio") + 0.5 * F.col("spread_ratio")))
