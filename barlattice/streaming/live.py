"""Streaming forms: duplicates, closed periods, positions and books that live in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlattice.operators import books

BAR = "universe_id string, symbol string, t long, open double, high double, low double, close double, volume double"


def replay_source(spark: SparkSession, folder: str, schema: str = BAR, files: int = 1) -> DataFrame:
    """A stream that replays parquet files of bars in order of their age; stands for a live feed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_within(stream: DataFrame, keys: list[str], event_time: str, lateness: str = "1 day") -> DataFrame:
    """One delivery per key among those that are at most ``lateness`` late; later ones are dropped."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([*keys])


def closed_periods(stream: DataFrame, length: str = "1 hour", lateness: str = "0 seconds") -> DataFrame:
    """Bars of periods that are over: a window comes out once the watermark has passed its end."""
    timed = stream.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", lateness)
    bars = timed.groupBy("universe_id", "symbol", F.window("ts", length).alias("w")).agg(
        F.min_by("open", "t").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "t").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return bars.select("universe_id", "symbol", F.unix_millis("w.start").alias("t"), "open", "high", "low", "close", "volume")


def live_positions(stream: DataFrame, enter: float = 0.5, leave: float = 0.2, history: int = 25) -> DataFrame:
    """Factor and hysteresis position of each series, bar by bar.

    State per series: the last ``history`` closes and volumes, the position and the
    time of the last bar.  Bars at or before it are dropped, so a replay changes
    nothing; within a micro-batch bars are taken in order of time.  Equal to the
    batch operators over the same bars.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        closes, volumes, position, last, seen = state.get if state.exists else ([], [], 0.0, -1, 0)
        closes, volumes, out = list(closes), list(volumes), []
        for r in pd.concat(list(frames)).sort_values("t").itertuples():
            if r.t <= last:
                continue
            closes, volumes, last, seen = [*closes, r.close][-history:], [*volumes, r.volume][-history:], int(r.t), seen + 1
            factor = 0.0
            if len(closes) >= 25 and closes[-25] != 0:
                ratio = np.mean(volumes[-16:]) / (np.mean(volumes[-24:]) + 1e-8)
                factor = float(np.tanh(0.6 * (closes[-1] / closes[-25] - 1) + 0.4 * ratio))
            if seen == 1:
                position = 0.0
            elif abs(factor) > enter:
                position = float(np.sign(factor))
            elif abs(factor) < leave:
                position = 0.0
            out.append((key[0], key[1], last, factor, position))
        state.update((closes, volumes, position, last, seen))
        yield pd.DataFrame(out, columns=["universe_id", "symbol", "t", "factor", "position"])

    return stream.groupBy("universe_id", "symbol").applyInPandasWithState(
        step,
        "universe_id string, symbol string, t long, factor double, position double",
        "closes array<double>, volumes array<double>, position double, last long, seen long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def live_books(stream: DataFrame, filters: DataFrame, **options: float) -> DataFrame:
    """The books of each universe (strategy and baselines) after each of its bars, kept in the state store.

    ``stream`` has the columns of a bar and ``asset_count``; ``filters`` is a small dimension.
    One state for all books of a universe: none can fall behind another.  After a stop
    the query goes on from its checkpoint; bars that come again change nothing.  Equal
    to ``books.replayed`` over the same bars.
    """
    columns = ["universe_id", "symbol", "t", "high", "low", "close", "volume", "asset_count", *books.LOTS]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = books.Books(state.get[0] if state.exists else None, **options)
        rows = held.take(pd.concat(list(frames)))
        state.update((held.dump(),))
        yield books.frame(key[0], rows)

    return books.with_lots(stream, filters).select(*columns).groupBy("universe_id").applyInPandasWithState(step, books.BOOK_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


def health(bars: DataFrame, now_ms: int, failures: int = 0, stale_ms: int = 3 * 3_600_000, critical: int = 5) -> dict:
    """One small report of the feed: series, newest bar, its age, and ``status`` (``unreachable``, ``critical``, ``stale`` or ``healthy``)."""
    row = bars.agg(F.max("t").alias("t"), F.countDistinct("universe_id", "symbol").alias("n")).first()
    age = None if row.t is None else now_ms - row.t
    status = "critical" if failures >= critical else "unreachable" if failures or age is None else "stale" if age > stale_ms else "healthy"
    return {"series": row.n, "newest": row.t, "age_ms": age, "failures": failures, "status": status}


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what there is and stops; a restart goes on from the checkpoint without repeating rows."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_every(stream: DataFrame, sink: str, checkpoint: str, seconds: int = 300, mode: str = "append") -> StreamingQuery:
    """A running query that takes what has come every ``seconds``; stop it with ``stop()``, a new one goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=f"{seconds} seconds").start()


def staleness(bars: DataFrame, now_ms: int, stale_ms: int = 3 * 3_600_000) -> DataFrame:
    """Per series: the latest bar, its age and whether the feed is ``stale`` or ``healthy``."""
    latest = bars.groupBy("universe_id", "symbol").agg(F.max("t").alias("latest"))
    age = F.lit(now_ms) - F.col("latest")
    return latest.select("universe_id", "symbol", "latest", age.alias("age_ms"), F.when(age > stale_ms, "stale").otherwise("healthy").alias("feed"))
