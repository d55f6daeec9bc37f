"""Irregular readings onto a regular grid (problem 4).

Each source is cut into time shards.  Within a shard the readings of a period
collapse to the last one and inner gaps are found by ``lead``; a summary per
shard (first and last reading) goes through a prefix scan over the shards of
its source, which carries the last value across shard boundaries; the gaps
between shards are cut into shard pieces again and filled independently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.epoch import epoch_ms, floor_div, period_ms

#: Periods in a shard: the most that one task must hold of a source at a time.
SHARD_PERIODS = 4096


def regular_grid(
    readings: DataFrame,
    source: Sequence[str],
    instant_ms: Column,
    step_ms: Column,
    value: Column,
    tie: Column,
    shard_periods: int = SHARD_PERIODS,
) -> DataFrame:
    """One row for each period of a source from its first to its last period with a reading.

    ``step_ms`` is the period's length and must be the same for all rows of a
    source; periods are counted from the epoch (UTC midnight for divisors of a
    day), include their start and exclude their end.  Of several readings in a
    period the latest holds, at ties that with the largest ``tie``.  Rows whose
    value, instant or step is null (or step not above 0) are no readings.

    Columns: source, ``open_ms`` (start of the period), ``value`` (the period's
    reading, else the last one before it), ``filled`` (true where the period had
    none).  NaN is a reading.  An empty table gives an empty result.
    """
    keys = [*source, "__step", "__shard"]
    rows = (
        readings.select(
            *source, step_ms.cast("long").alias("__step"), instant_ms.alias("__ms"), value.alias("__value"), tie.alias("__tie")
        )
        .filter(F.col("__value").isNotNull() & F.col("__ms").isNotNull() & (F.col("__step") > 0))
        .withColumn("__period", F.call_function("div", F.col("__ms") - F.pmod("__ms", "__step"), F.col("__step")))
        .withColumn("__shard", floor_div(F.col("__period"), shard_periods))
    )
    latest = (
        rows.repartition(*keys)
        .groupBy(*keys, "__period")
        .agg(F.max_by("__value", F.struct("__ms", "__tie")).alias("__value"))
    )

    within = Window.partitionBy(*keys).orderBy("__period")
    inner = latest.withColumn("__next", F.lead("__period").over(within))

    summary = latest.groupBy(*keys).agg(
        F.min("__period").alias("__first"),
        F.max("__period").alias("__last"),
        F.max_by("__value", "__period").alias("__last_value"),
    )
    scan = Window.partitionBy(*source, "__step").orderBy("__shard")
    between = (
        summary.select(
            *source,
            "__step",
            (F.lag("__last").over(scan) + 1).alias("__from"),
            (F.col("__first") - 1).alias("__to"),
            F.lag("__last_value").over(scan).alias("__value"),
        )
        .filter(F.col("__from") <= F.col("__to"))
        .withColumn("__piece", F.explode(F.sequence(floor_div(F.col("__from"), shard_periods), floor_div(F.col("__to"), shard_periods))))
        .repartition(*source, "__step", "__piece")  # the pieces of a long gap leave the task that found it
    )
    carried = between.select(
        *source,
        "__step",
        F.explode(
            F.sequence(
                F.greatest("__from", F.col("__piece") * shard_periods),
                F.least("__to", F.col("__piece") * shard_periods + (shard_periods - 1)),
            )
        ).alias("__period"),
        "__value",
        F.lit(True).alias("filled"),
    )
    # a reading followed by the periods it fills: position 0 is the reading itself
    own = inner.select(
        *source,
        "__step",
        F.posexplode(F.sequence("__period", F.coalesce(F.col("__next") - 1, F.col("__period")))).alias("__at", "__period"),
        "__value",
    ).select(*source, "__step", "__period", "__value", (F.col("__at") > 0).alias("filled"))

    return own.unionByName(carried).select(
        *source, (F.col("__period") * F.col("__step")).alias("open_ms"), F.col("__value").alias("value"), "filled"
    )


def bar_grid(bars: DataFrame, universes: DataFrame, shard_periods: int = SHARD_PERIODS) -> DataFrame:
    """Closes of each series on the grid of its universe's ``frequency``.

    A series whose universe is not listed or has no readable frequency has no
    grid and does not come out.  A universe listed twice with different
    frequencies takes the shortest.
    """
    steps = universes.groupBy("universe_id").agg(F.min(period_ms(F.col("frequency"))).alias("__freq_ms"))
    rows = bars.select("universe_id", "symbol", "timestamp_open", "close", "bar_id").join(steps, "universe_id")
    return regular_grid(
        rows,
        ("universe_id", "symbol"),
        epoch_ms(F.col("timestamp_open")),
        F.col("__freq_ms"),
        F.col("close"),
        F.col("bar_id"),
        shard_periods,
    ).withColumnRenamed("value", "close")
