"""Bars on a common time axis: one reading per period, periods that all assets share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.epoch import epoch_ms, period_ms

SERIES = ("universe_id", "symbol")


def along(*keys: str, order: str = "t"):
    """Rows of a series in order of time."""
    return Window.partitionBy(*keys).orderBy(order)


def normalise_units(bars: DataFrame) -> DataFrame:
    """Adds ``ms``: the bar's instant in epoch milliseconds, whatever its unit was."""
    return bars.withColumn("ms", epoch_ms(F.col("timestamp_open")))


def closed(bars: DataFrame, now_ms: int) -> DataFrame:
    """Bars that are over at ``now_ms``; a bar without a closing time is not known to be."""
    return bars.filter(epoch_ms(F.col("timestamp_close")) <= now_ms)


def in_range(bars: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Bars whose ``ms`` lies in the range, both ends included."""
    return bars.filter(F.col("ms").between(start_ms, end_ms))


def first_delivery(bars: DataFrame) -> DataFrame:
    """One row per series and instant: the earliest delivery, at ties the smallest ``bar_id``."""
    order = F.struct("received_at", "bar_id")
    kept = [c for c in bars.columns if c not in (*SERIES, "ms")]
    grouped = bars.groupBy(*SERIES, "ms").agg(F.min_by(F.struct(*kept), order).alias("__row"))
    return grouped.select(*SERIES, "ms", "__row.*")


def period_bars(bars: DataFrame, universes: DataFrame) -> DataFrame:
    """The last priced reading of each period of the universe's frequency.

    ``t`` is the start of the period in ms.  A missing open, high or low is the
    close; a missing volume is 0; a missing quote volume is volume times close and
    a missing taker volume half the volume (``substituted`` tells).  Readings
    without a positive close are none.  ``state``, if the bars have it, is the reading's.
    """
    more = [c for c in ("state",) if c in bars.columns]
    steps = universes.select("universe_id", period_ms(F.col("frequency")).alias("step"), "asset_count")
    close, volume = F.col("close"), F.coalesce(F.col("volume"), F.lit(0.0))
    rows = (
        bars.select(*SERIES, epoch_ms(F.col("timestamp_open")).alias("ms"), "bar_id", "open", "high", "low", "close", "volume", "quote_volume", *more)
        .filter((close > 0) & F.col("ms").isNotNull())
        .join(steps, "universe_id")
        .withColumn("t", F.col("ms") - F.pmod("ms", "step"))
    )
    reading = F.struct(
        F.coalesce("open", "close").alias("open"),
        F.coalesce("high", "close").alias("high"),
        F.coalesce("low", "close").alias("low"),
        "close",
        volume.alias("volume"),
        F.coalesce(F.col("quote_volume"), volume * close).alias("quote_volume"),
        (volume * 0.5).alias("taker_buy_volume"),
        F.col("quote_volume").isNull().alias("substituted"),
        *more,
    )
    # by instant: the assets of a period meet here anyway, so aligning them needs no other shuffle
    return (
        rows.repartition("universe_id", "t").groupBy(*SERIES, "t", "step", "asset_count").agg(F.max_by(reading, F.struct("ms", "bar_id")).alias("r")).select(*SERIES, "t", "step", "asset_count", "r.*")
    )


def aligned_bars(bars: DataFrame, universes: DataFrame, least: int = 1) -> DataFrame:
    """Period bars of the periods in which every asset of the universe has a reading.

    Universes with fewer than ``least`` such periods do not come out.
    """
    together = Window.partitionBy("universe_id", "t")
    rows = period_bars(bars, universes).withColumn("__n", F.count(F.lit(1)).over(together)).filter(F.col("__n") == F.col("asset_count"))
    if least > 1:
        enough = rows.groupBy("universe_id").agg((F.count(F.lit(1)) / F.max("asset_count")).alias("k")).filter(F.col("k") >= least)
        rows = rows.join(enough.select("universe_id"), "universe_id", "left_semi")
    return rows.drop("__n", "asset_count")


def wide(rows: DataFrame, symbols: list[str], value: str = "close") -> DataFrame:
    """One column per symbol; the symbols are given, so the data are read once."""
    return rows.groupBy("universe_id", "t").pivot("symbol", symbols).agg(F.first(value))


def gaps(rows: DataFrame) -> DataFrame:
    """Where a series skips periods: ``after`` and ``before`` (ms) and ``missing`` periods between."""
    nxt = F.lead("t").over(along(*SERIES))
    return (
        rows.select(*SERIES, F.col("t").alias("after"), nxt.alias("before"), "step")
        .filter(F.col("before") - F.col("after") > F.col("step"))
        .select(*SERIES, "after", "before", (F.call_function("div", F.col("before") - F.col("after"), F.col("step")) - 1).alias("missing"))
    )


def identity(universes: DataFrame) -> DataFrame:
    """Universes by what they are, not how they are called: one row per set of assets."""
    return universes.groupBy(F.array_sort("assets").alias("key")).agg(
        F.count(F.lit(1)).alias("labels"), F.min("universe_id").alias("first_label")
    ).select(F.array_join("key", ",").alias("asset_key"), "labels", "first_label")


def ambiguous_labels(universes: DataFrame) -> DataFrame:
    """Labels that stand for more than one set of assets."""
    return universes.groupBy("universe_id").agg(F.countDistinct(F.array_sort("assets")).alias("sets")).filter("sets > 1")


def assets_of(universes: DataFrame, label: str) -> list[str]:
    """The assets of a label of the catalogs, sorted; raises where it stands for none or for more than one set."""
    sets = [r[0] for r in universes.filter(F.col("universe_id") == label).select(F.array_sort(F.array_distinct("assets"))).distinct().limit(2).collect()]
    if not sets:
        raise KeyError(label)
    if len(sets) > 1:
        raise ValueError(f"{label} stands for more than one set of assets")
    return list(sets[0])


def whole(value: Column, digits: int) -> Column:
    """Value rounded by the same floating-point steps as ``floor(x * 1e<d> + 0.5) / 1e<d>`` in SQL."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale
