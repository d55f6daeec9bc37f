"""Synthetic null markets and bootstrap tests, seeded by what they are made for, not by partition."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "universe_id string, symbol string, t long, open double, high double, low double, close double, volume double"
#: Volumes that follow the bars if they are there.
VOLUMES = ("volume", "quote_volume", "taker_buy_volume")


def block_indices(n: int, length: float, rng: np.random.Generator) -> np.ndarray:
    """Stationary bootstrap: geometric blocks of mean ``length``, wrapped around."""
    if n == 0:
        return np.empty(0, np.int64)
    fresh = rng.random(n) < 1 / length
    fresh[0] = True
    starts = rng.integers(0, n, n)
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (starts[at] + np.arange(n) - at) % n


def _seed(seed: int, *names: str) -> np.random.Generator:
    return np.random.default_rng([seed, *(zlib.crc32(x.encode()) for x in names)])


def _resampled(rows: DataFrame, one) -> DataFrame:
    """``one`` on each series, with the columns of a bar and the volumes that there are."""
    more = [c for c in VOLUMES[1:] if c in rows.columns]
    schema = BAR_SCHEMA + "".join(f", {c} double" for c in more)
    return rows.select(*[c.split()[0] for c in schema.split(", ")]).groupBy("universe_id", "symbol").applyInPandas(one, schema)


def _rebuilt(pdf: pd.DataFrame, log_returns: np.ndarray, traded: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Bars of new returns: shapes of the bars ``at``, volumes of the bars ``traded``; the first close stays."""
    log_returns[0] = 0.0
    close = float(pdf["close"].iloc[0]) * np.exp(np.cumsum(log_returns))
    base = np.maximum(1e-8, pdf["close"].to_numpy())
    out = {"universe_id": pdf["universe_id"].to_numpy(), "symbol": pdf["symbol"].to_numpy(), "t": pdf["t"].to_numpy()}
    out |= {c: close * (pdf[c].to_numpy() / base)[at] for c in ("open", "high", "low")}
    return pd.DataFrame(out | {"close": close} | {c: pdf[c].to_numpy()[traded] for c in VOLUMES if c in pdf})


def block_bootstrap(rows: DataFrame, length: float = 48.0, seed: int = 0) -> DataFrame:
    """Each series resampled by itself in blocks of log returns (the first is 0); shapes and volumes follow."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        r = np.diff(np.log(pdf["close"].to_numpy()), prepend=np.log(pdf["close"].iloc[0]))
        at = block_indices(len(pdf), length, _seed(seed, pdf["universe_id"].iloc[0], pdf["symbol"].iloc[0]))
        return _rebuilt(pdf, r[at], at, at)

    return _resampled(rows, one)


def phase_randomised(rows: DataFrame, iterations: int = 100, seed: int = 0) -> DataFrame:
    """Surrogates with the spectrum and the values of each series' log returns (iterated amplitude adjustment)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        rng = _seed(seed, pdf["universe_id"].iloc[0], pdf["symbol"].iloc[0])
        r = np.diff(np.log(pdf["close"].to_numpy()), prepend=np.log(pdf["close"].iloc[0]))
        n = len(r)
        ordered, size = np.sort(r), np.abs(np.fft.rfft(r))
        phases = rng.uniform(0, 2 * np.pi, len(size))
        phases[0] = 0.0
        if n % 2 == 0:
            phases[-1] = 0.0
        x = np.fft.irfft(size * np.exp(1j * phases), n)
        for _ in range(iterations):
            new = ordered[np.argsort(np.argsort(x, kind="stable"), kind="stable")]
            spectrum = np.fft.rfft(new)
            y = np.fft.irfft(size * np.exp(1j * np.angle(spectrum)), n)
            if np.max(np.abs(y - x), initial=0.0) < 1e-6:
                x = y
                break
            x = y
        new = ordered[np.argsort(np.argsort(x, kind="stable"), kind="stable")]
        return _rebuilt(pdf, new, rng.permutation(n), np.arange(n))

    return _resampled(rows, one)


def blinded_markets(rows: DataFrame, bootstrapped: int = 6, length: float = 48.0, iterations: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(bars under blind labels, key): every real universe and a null market made from it.

    The first ``bootstrapped`` universes (by name) have a block bootstrap, the others a
    phase-randomised surrogate.  Labels ``UNIV_01`` ... are a seeded permutation of all
    of them.  The key (``label``, ``kind``, ``parent``, ``method``) has two rows for each
    universe and is kept apart from the bars, which carry nothing but their label.
    """
    import random

    spark = rows.sparkSession
    names = sorted(r[0] for r in rows.select("universe_id").distinct().collect())  # a study's universes: a catalog
    kinds = [("REAL", u, "") for u in names] + [("NULL", u, "bootstrap" if i < bootstrapped else "phase") for i, u in enumerate(names)]
    random.Random(seed).shuffle(kinds)
    width = max(2, len(str(len(kinds))))
    key = spark.createDataFrame([(f"UNIV_{i:0{width}d}", *k) for i, k in enumerate(kinds, 1)], "label string, kind string, parent string, method string")
    base = _resampled(rows, lambda pdf: pdf)
    boot, phase = block_bootstrap(rows, length, seed), phase_randomised(rows, iterations, seed)
    made = base.withColumns({"kind": F.lit("REAL"), "method": F.lit("")})
    for null, method in ((boot, "bootstrap"), (phase, "phase")):
        made = made.unionByName(null.withColumns({"kind": F.lit("NULL"), "method": F.lit(method)}))
    named = made.join(key.withColumnRenamed("parent", "universe_id"), ["universe_id", "kind", "method"])
    return named.select(F.col("label").alias("universe_id"), *[c for c in base.columns if c != "universe_id"]), key


def resampled_panel(rows: DataFrame, value: str, length: float = 48.0, seed: int = 0) -> DataFrame:
    """Rows of a universe at resampled instants, the same for all its assets: ``k`` (new order), ``t`` (drawn), ``value``.

    The indices are drawn per universe from its sorted instants (one row per
    instant); the assets' rows come by a join on the drawn instant.
    """
    instants = rows.groupBy("universe_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))

    def draw(frames):
        for pdf in frames:
            out = []
            for u, ts in zip(pdf["universe_id"], pdf["ts"]):
                ts = np.asarray(ts)
                drawn = ts[block_indices(len(ts), length, _seed(seed, u))]
                out.append(pd.DataFrame({"universe_id": u, "k": np.arange(len(ts)), "t": drawn}))
            yield pd.concat(out) if out else pd.DataFrame({"universe_id": [], "k": [], "t": []})

    drawn = instants.mapInPandas(draw, "universe_id string, k long, t long")
    return drawn.join(rows.select("universe_id", "symbol", "t", F.col(value).alias("value")), ["universe_id", "t"])


def mean_statistic(r: np.ndarray) -> float:
    return float(r.mean())


def sharpe_statistic(r: np.ndarray) -> float:
    """Mean over the sample deviation; 0 where the returns do not move."""
    spread = float(r.std(ddof=1)) if len(r) > 1 else 0.0
    return float(r.mean()) / spread if spread > 1e-12 else 0.0


def bootstrap_test(spark: SparkSession, returns: list[float], replicates: int = 1000, length: float = 48.0, seed: int = 42, statistic: Callable[[np.ndarray], float] = mean_statistic) -> DataFrame:
    """Null test of a statistic of one strategy's returns (a vector): see ``bootstrap_tests``."""
    rows = spark.createDataFrame([("", i, float(r)) for i, r in enumerate(returns)], "key string, t long, r double")
    return bootstrap_tests(rows, "key", "r", replicates, length, seed, statistic).drop("key", "n")


def bootstrap_tests(
    returns: DataFrame, key: str, column: str = "net", replicates: int = 1000, length: float = 48.0, seed: int = 42, statistic: Callable[[np.ndarray], float] = mean_statistic, chunk: int = 125
) -> DataFrame:
    """Null test of a statistic of each key's returns: ``n``, ``observed``, ``p_value``, mean, deviation and 95 % band of the null.

    The centred series is resampled in blocks (stationary bootstrap); the p-value is
    (1 + replicates at least as large) / (1 + replicates).  Every replicate has its own
    seed, so the result does not depend on partitions or on the other keys; a task takes
    a chunk of replicates of one key.  Null returns are left out; a key's returns are one
    array, bounded by the calendar.
    """
    series = returns.filter(F.col(column).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", F.col(column).alias("r")))).getField("r").alias("__r"))
    parts = series.withColumn("__from", F.explode(F.sequence(F.lit(0), F.lit(max(0, replicates - 1)), F.lit(chunk)))).repartition(key, "__from")
    kind = returns.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, r, first in zip(pdf[key], pdf["__r"], pdf["__from"]):
                r = np.asarray(r, float)
                centred, observed = r - r.mean(), statistic(r)
                for i in range(first, min(first + chunk, replicates)):
                    out.append((k, len(r), observed, statistic(centred[block_indices(len(r), length, np.random.default_rng([seed, i]))])))
            yield pd.DataFrame(out, columns=[key, "n", "observed", "stat"])

    stats = parts.mapInPandas(run, f"`{key}` {kind}, n long, observed double, stat double")
    return stats.groupBy(key, "n", "observed").agg(
        ((1 + F.count_if(F.col("stat") >= F.col("observed"))) / (replicates + 1)).alias("p_value"),
        F.avg("stat").alias("null_mean"),
        F.stddev_samp("stat").alias("null_sd"),
        F.percentile("stat", F.lit(0.025)).alias("low"),
        F.percentile("stat", F.lit(0.975)).alias("high"),
    )
