"""Feeds: klines and prices through a given transport, and exchange filters from their records.

There is no HTTP client here: a transport is any function of (path, parameters) that
gives decoded JSON, so a feed can be a service, a recording or a test.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.sources.klines import KLINE

Transport = Callable[[str, dict[str, Any]], Any]
#: Tries of a request and seconds before the second one; each further wait is twice as long.
TRIES, WAIT_S = 3, 1.0
#: Columns of a kline record, typed.
_TYPES = {"open_time": int, "close_time": int, "trades_count": int}


class FeedError(RuntimeError):
    """No try of a request had an answer."""


def asked(transport: Transport, path: str, tries: int = TRIES, wait_s: float = WAIT_S, sleep: Callable[[float], None] = time.sleep, **parameters: Any) -> Any:
    """The answer of the transport, tried again after growing waits; the last failure is the cause of the error."""
    for k in range(tries):
        try:
            return transport(path, {n: v for n, v in parameters.items() if v is not None})
        except Exception as e:
            failure = e
            if k + 1 < tries:
                sleep(wait_s * 2**k)
    raise FeedError(f"{path} failed {tries} times") from failure


def recent_klines(spark: SparkSession, transport: Transport, symbol: str, interval: str = "1h", limit: int = 50, start_ms: int | None = None, end_ms: int | None = None, **retry: Any) -> DataFrame:
    """The latest klines of a symbol (a report of at most ``limit`` rows): ``symbol`` and the columns of a kline."""
    rows = asked(transport, "klines", symbol=symbol, interval=interval, limit=limit, startTime=start_ms, endTime=end_ms, **retry)
    typed = [(symbol, *[_TYPES.get(c, float)(v) for c, v in zip(KLINE[:-1], r)]) for r in rows]
    return spark.createDataFrame(typed, "symbol string, " + ", ".join(f"{c} {'long' if c in _TYPES else 'double'}" for c in KLINE[:-1]))


def last_price(transport: Transport, symbol: str, **retry: Any) -> float:
    """The latest price of a symbol."""
    return float(asked(transport, "price", symbol=symbol, **retry)["price"])


_RECORDS = "symbols array<struct<symbol: string, filters: array<map<string, string>>>>"


def exchange_filters(spark: SparkSession, path: str) -> DataFrame:
    """Lot filters from exchange records (JSON files at ``path``): ``symbol``, ``step_size``, ``min_qty``, ``min_notional``, ``tick_size``.

    A symbol without a lot size does not come out; a missing minimum quantity is the
    step, other missing values are 0; a symbol listed twice has its smallest step.
    """
    listed = spark.read.schema(_RECORDS).option("multiLine", True).json(path).select(F.explode("symbols").alias("s"))
    each = listed.select("s.symbol", F.explode("s.filters").alias("f"))
    kind = F.col("f")["filterType"]

    def value(name: str, *kinds: str):
        return F.min(F.when(kind.isin(*kinds), F.col("f")[name].try_cast("double")))

    per = each.groupBy("symbol").agg(
        value("stepSize", "LOT_SIZE").alias("step_size"),
        value("minQty", "LOT_SIZE").alias("__least"),
        value("minNotional", "MIN_NOTIONAL", "NOTIONAL").alias("__worth"),
        value("tickSize", "PRICE_FILTER").alias("__tick"),
    )
    return per.filter("step_size IS NOT NULL").select(
        "symbol", "step_size", F.coalesce("__least", "step_size").alias("min_qty"), F.coalesce("__worth", F.lit(0.0)).alias("min_notional"), F.coalesce("__tick", F.lit(0.0)).alias("tick_size")
    )


def with_fallback(wanted: Iterable[str], *sources: DataFrame) -> DataFrame:
    """One row of filters for each ``wanted`` symbol that any source has: from the first source that has it."""
    spark = sources[0].sparkSession
    ranked = None
    for rank, source in enumerate(sources):
        part = source.withColumn("__rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    rest = [c for c in sources[0].columns if c != "symbol"]
    best = ranked.groupBy("symbol").agg(F.min_by(F.struct(*rest), "__rank").alias("__f")).select("symbol", "__f.*")
    return best.join(spark.createDataFrame([(s,) for s in wanted], "symbol string"), "symbol", "left_semi")
