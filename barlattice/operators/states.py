"""Saved states, logs, comparisons, and factors given as Python functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.operators.align import SERIES, along


def mentions(text: str, *columns: str) -> Column:
    """Whether one of ``columns`` contains ``text``, whatever the letter case; nulls contain nothing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return hit


def newest(rows: DataFrame, order: str, tie: str, n: int = 200) -> DataFrame:
    """The ``n`` newest rows, newest first: a report's list."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """One row per key: the one with the latest ``order``, at ties the largest ``tie`` (partial aggregation, no sort)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("__row")).select(key, "__row.*")


def against_caps(rows: DataFrame, key: str, default: float = 1.0) -> DataFrame:
    """Entries of the map ``positions`` beside those of ``position_caps`` (``default`` where there is none)."""
    each = rows.select(key, "position_caps", F.explode("positions").alias("symbol", "position"))
    cap = F.coalesce(F.try_element_at("position_caps", F.col("symbol")), F.lit(default))
    return each.select(key, "symbol", "position", cap.alias("cap")).withColumn("above", F.abs("position") > F.col("cap") + 1e-12)


def market_returns(rows: DataFrame) -> DataFrame:
    """``market``: mean of the assets' next returns at each instant of a universe."""
    nxt = rows.withColumn("__next", F.lead("ret").over(along(*SERIES))).filter(F.col("__next").isNotNull())
    return nxt.groupBy("universe_id", "t").agg(F.avg("__next").alias("market"))


def all_side_by_side(rows: DataFrame, value: str) -> DataFrame:
    """The values of all assets of a universe in one row per instant: ``symbols`` in order and ``values`` beside them."""
    per = rows.groupBy("universe_id", "t").agg(F.array_sort(F.collect_list(F.struct("symbol", F.col(value).alias("value")))).alias("__all"))
    return per.select("universe_id", "t", F.col("__all.symbol").alias("symbols"), F.col("__all.value").alias("values"))


def apply_factor(rows: DataFrame, factor: Callable[[pd.DataFrame], pd.Series], limit: float = 1.05) -> DataFrame:
    """``factor`` of each series by a Python function of its frame (in order of ``t``).

    The function must return as many values as it was given; NaN, null and infinite
    become 0, values beyond ``limit`` raise, the rest is clipped to [-1, 1].  For
    trusted functions only; column expressions are faster where they can say it.
    """
    kept = ("universe_id", "symbol", "t", "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        values = np.asarray(factor(pdf), dtype=float)
        if values.shape != (len(pdf),):
            raise ValueError(f"the factor gave {values.shape} values for {len(pdf)} bars")
        values = np.where(np.isfinite(values), values, 0.0)
        if np.abs(values).max(initial=0.0) > limit:
            raise ValueError("the factor is outside its range")
        return pd.DataFrame({"universe_id": pdf["universe_id"], "symbol": pdf["symbol"], "t": pdf["t"], "factor": np.clip(values, -1, 1)})

    return rows.select(*kept).groupBy("universe_id", "symbol").applyInPandas(one, "universe_id string, symbol string, t long, factor double")


def example_factor(bars: pd.DataFrame) -> pd.Series:
    """Change of close over 24 bars, squeezed."""
    return np.tanh(bars["close"].pct_change(24))
