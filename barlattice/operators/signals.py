"""Positions and weights from factors, as windows without recursion."""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.align import SERIES, along


def _held(decision: Column) -> Column:
    """The last decision that was made, 0 before the first."""
    return F.coalesce(F.last(decision, ignorenulls=True).over(along(*SERIES).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def hysteresis(rows: DataFrame, enter: float = 0.5, leave: float = 0.2, size: float = 1.0) -> DataFrame:
    """``position``: enters beyond ``enter``, leaves inside ``leave`` (both strict), else holds; the first bar is flat."""
    x = F.col("factor")
    first = F.row_number().over(along(*SERIES)) == 1
    decision = F.when(first, 0.0).when(F.abs(x) > enter, F.signum(x) * size).when(F.abs(x) < leave, 0.0)
    return rows.withColumn("__d", decision).withColumn("position", _held(F.col("__d"))).drop("__d")


def adaptive_hysteresis(rows: DataFrame, enter_pct: float = 95, leave_pct: float = 50, window: int = 720, least: int = 336, size: float = 1.0) -> DataFrame:
    """Hysteresis at percentiles of the factor's size over the ``window`` bars before (this bar excluded).

    Inclusive, entry first; holds until ``least`` bars are known; the first bar is flat.
    Null and NaN factors are no bars of the past and hold.  A window function would
    sort each window anew; here a series goes by once, with its window kept sorted.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        factor = pdf["factor"].to_numpy(float)
        past, ordered, held = deque(), [], 0.0
        position = np.zeros(len(pdf))
        for i, (v, x) in enumerate(zip(factor.tolist(), np.abs(factor).tolist())):
            if i and x == x and len(ordered) >= max(1, least):
                if x >= _percentile(ordered, enter_pct):
                    held = size * ((v > 0) - (v < 0))
                elif x <= _percentile(ordered, leave_pct):
                    held = 0.0
            position[i] = held
            past.append(x)
            if x == x:
                bisect.insort(ordered, x)
            if len(past) > window and (old := past.popleft()) == old:
                del ordered[bisect.bisect_left(ordered, old)]
        return pdf.assign(position=position)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "position")
    return rows.drop("position").groupBy(*SERIES).applyInPandas(one, f"{fields}, position double")


def _percentile(ordered: list[float], percent: float) -> float:
    """Linear between the two nearest of some sorted values."""
    at = (len(ordered) - 1) * percent / 100
    low = int(at)
    a, b = ordered[low], ordered[min(low + 1, len(ordered) - 1)]
    return a + (b - a) * (at - low)


def target_weights(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``weight``: position over the number of assets, or by the shares in ``weights`` (``symbol``, ``w``).

    A symbol without a share has 1/n; shares that do not sum above 0 are equal.
    """
    now = Window.partitionBy("universe_id", "t")
    n = F.count(F.lit(1)).over(now)
    if weights is None:
        return rows.withColumn("weight", F.col("position") / n)
    rows = rows.join(weights.select("symbol", F.col("w").alias("__w")), "symbol", "left").withColumn("__n", n)
    rows = rows.withColumn("__w", F.coalesce("__w", 1.0 / F.col("__n"))).withColumn("__s", F.sum("__w").over(now))
    share = F.when(F.col("__s") > 0, F.col("__w") / F.when(F.col("__s") > 0, F.col("__s"))).otherwise(1.0 / F.col("__n"))
    return rows.withColumn("weight", F.col("position") * share).drop("__w", "__n", "__s")


def cap_leverage(rows: DataFrame) -> DataFrame:
    """Weights of an instant scaled down so that their sizes sum to at most 1."""
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("universe_id", "t"))
    return rows.withColumn("weight", F.col("weight") / F.greatest(F.lit(1.0), gross))


def momentum_leader(rows: DataFrame, look_back: int = 480, every: int = 168) -> DataFrame:
    """``weight`` 1 for the asset with the best ``look_back`` return, chosen anew every ``every`` bars (ties: first symbol)."""
    series = along(*SERIES)
    now = Window.partitionBy("universe_id", "t")
    rows = rows.withColumn("__r", F.try_divide(F.col("close"), F.lag("close", look_back).over(series)) - 1).withColumn("__k", F.row_number().over(series) - 1)
    chosen = (F.col("__k") >= look_back) & (F.pmod(F.col("__k") - look_back, F.lit(every)) == 0)
    best = F.row_number().over(now.orderBy(F.col("__r").desc_nulls_last(), "symbol")) == 1
    rows = rows.withColumn("__d", F.when(chosen, F.when(best, 1.0).otherwise(0.0)))
    return rows.withColumn("weight", _held(F.col("__d"))).drop("__d", "__r", "__k")


def reversion_state(rows: DataFrame, look_back: int = 480, enter: float = -2.0, leave: float = 0.0) -> DataFrame:
    """``z`` of close against the bars before (this bar excluded) and ``position``: 1 from ``enter`` down until ``leave``."""
    past = along(*SERIES).rowsBetween(-look_back, -1)
    known = F.count("close").over(past) >= look_back
    z = (F.col("close") - F.avg("close").over(past)) / (F.stddev_pop("close").over(past) + 1e-8)
    rows = rows.withColumn("z", F.when(known, z))
    decision = F.when(F.col("z") <= enter, 1.0).when(F.col("z") >= leave, 0.0)
    return rows.withColumn("__d", decision).withColumn("position", _held(F.col("__d"))).drop("__d")


def reversion_weights(rows: DataFrame) -> DataFrame:
    """``weight`` of reversion positions: each active asset has a share of 1/active, scaled by 1/assets."""
    now = Window.partitionBy("universe_id", "t")
    active, n = F.sum("position").over(now), F.count(F.lit(1)).over(now)
    share = F.when(active > 0, F.col("position") / F.when(active > 0, active) * F.col("position") / n).otherwise(0.0)
    return rows.withColumn("weight", share)


def held_weights(rows: DataFrame) -> DataFrame:
    """``weight`` of buy and hold: the same share of each asset at every bar."""
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("universe_id", "t")))
