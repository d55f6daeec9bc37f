"""Rolling totals over trailing periods, quiet days included (problem 1).

Cumulative prefix sums per entity, carried forward over the days without
activity; a trailing total is the difference of the prefixes at the two ends of
its window, so every further window length costs one more ``lag`` and no join.

Numbers are added as exact decimals.  What a decimal of 15 places cannot hold (a
number of 1e15 or more, digits behind the 15th place) is added beside it as a
double, within the window only, so that nothing is lost and nothing far away
leaves rounding behind.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from barlattice.functions.epoch import epoch_ms, utc_day

#: Numbers below this size are added as decimals.
EXACT_BELOW = 1e15
_EXACT = "decimal(30,15)"
_TOTAL = "decimal(38,15)"
#: A window's total that can be multiplied by a length of up to three digits without rounding.
_FACTOR = "decimal(34,15)"


def number(value: Column) -> Column:
    """``value`` as double, or null where it is no number (NaN, infinite)."""
    v = value.cast("double")
    return F.when(F.abs(v) < float("inf"), v)  # NaN compares above every number in Spark


def exact_part(value: Column) -> Column:
    """The decimal part of a double (shortest digits, 15 places); 0 from ``EXACT_BELOW`` on, null stays null."""
    v = value.cast("double")
    return F.when(F.abs(v) < EXACT_BELOW, v.cast(_EXACT)).when(v.isNotNull(), F.lit(0).cast(_EXACT))


def rest_part(value: Column) -> Column:
    """What ``exact_part`` leaves of a double: 0 for ordinary numbers."""
    v = value.cast("double")
    return v - exact_part(v).cast("double")


def daily_bars(bars: DataFrame) -> DataFrame:
    """One row for each series and active UTC day.

    Columns ``volume`` and ``close_sum`` (decimal), ``volume_rest`` and ``close_rest``
    (double, what the decimals cannot hold), ``close_count`` and ``bars`` (long).

    Bars with equal universe, symbol and instant count once (of unequal copies
    the largest value holds).  Null, negative and unusable volumes (NaN, infinite)
    add nothing, null and unusable closes do not enter the averages.  A bar without
    an instant belongs to no day and is left out; null symbols form a series.

    The rows are shuffled once, by series and day: both aggregations use that
    partitioning, and a series of any size is spread over its days.
    """
    ms = epoch_ms(F.col("timestamp_open"))
    rows = bars.filter(F.col("timestamp_open").isNotNull()).select(
        "universe_id",
        "symbol",
        utc_day(ms).alias("day"),
        ms.alias("__ms"),
        number(F.col("volume")).alias("__volume"),
        number(F.col("close")).alias("__close"),
    )
    once = (
        rows.repartition("universe_id", "symbol", "day")
        .groupBy("universe_id", "symbol", "day", "__ms")
        .agg(F.max("__volume").alias("__volume"), F.max("__close").alias("__close"))
    )
    volume = F.greatest(F.coalesce("__volume", F.lit(0.0)), F.lit(0.0))
    return once.groupBy("universe_id", "symbol", "day").agg(
        F.sum(exact_part(volume)).cast(_TOTAL).alias("volume"),
        F.sum(rest_part(volume)).alias("volume_rest"),
        F.coalesce(F.sum(exact_part(F.col("__close"))), F.lit(0)).cast(_TOTAL).alias("close_sum"),
        F.coalesce(F.sum(rest_part(F.col("__close"))), F.lit(0.0)).alias("close_rest"),
        F.count("__close").alias("close_count"),
        F.count(F.lit(1)).alias("bars"),
    )


def trailing(
    daily: DataFrame,
    entity: Sequence[str],
    day: str,
    sums: Sequence[str],
    lengths: Sequence[int],
) -> DataFrame:
    """For each entity and each calendar day from its first to its last: trailing sums.

    ``daily`` has at most one row per entity and ``day`` (a date) and numeric
    columns ``sums``.  Result: entity, ``day``, ``day_no`` (1 on the first day),
    ``active`` (the day had a row) and ``<sum>_<n>d`` for each sum and length n:
    the total over the n days ending that day; days before the first count as 0.

    Decimals and whole numbers come out as differences of exact prefixes, in their
    own type (decimals with 15 places; a total of 1e23 or more raises).  Doubles
    are added within each window, as differences of rounded prefixes would be
    wrong after a large number.  Null sums count as 0.  An empty table gives an
    empty result.  Entities are compared null-safe.

    One window over the daily rows gives prefix and next active day, an
    ``explode`` carries the prefix over quiet days, a second window in the same
    partitioning takes the lags.  An entity holds at most one row per calendar
    day, whatever its share of the raw rows; an epoch denotes a year before 5139
    (by its units), so that is at most 2.4 million rows however wrong a timestamp is.
    """
    w = Window.partitionBy(*entity).orderBy(day)
    exact = {c: _TOTAL if isinstance(daily.schema[c].dataType, DecimalType) else "long" for c in sums if isinstance(daily.schema[c].dataType, (DecimalType, IntegralType))}
    given = {c: F.coalesce(F.col(c).cast(exact.get(c, "double")), F.lit(0).cast(exact.get(c, "double"))) for c in sums}
    prefixed = daily.select(
        *entity,
        F.col(day).alias("__start"),
        F.lead(day).over(w).alias("__next"),
        *[(F.sum(v).over(w).cast(exact[c]) if c in exact else v).alias(f"__p_{c}") for c, v in given.items()],
    )
    filled = prefixed.select(
        *entity,
        F.explode(F.sequence("__start", F.coalesce(F.date_sub("__next", 1), F.col("__start")))).alias(day),
        "__start",
        *[f"__p_{c}" for c in sums],
    )
    own = F.col(day) == F.col("__start")
    fields = [F.row_number().over(w).alias("day_no"), own.alias("active")]
    for c in sums:
        now = F.col(f"__p_{c}")
        for n in lengths:
            if c in exact:
                total = (now - F.coalesce(F.lag(now, n).over(w), F.lit(0).cast(exact[c]))).cast(exact[c])
            else:
                total = F.sum(F.when(own, now).otherwise(0.0)).over(w.rowsBetween(1 - n, 0))
            fields.append(total.alias(f"{c}_{n}d"))
    return filled.select(*entity, F.col(day), *fields)


_SERIES = ("universe_id", "symbol")


def _totals(bars: DataFrame, lengths: Sequence[int]) -> DataFrame:
    return trailing(daily_bars(bars), _SERIES, "day", ("volume", "volume_rest", "close_sum", "close_rest", "close_count"), lengths)


def rolling_bars(bars: DataFrame, lengths: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing volume totals and close averages of each series and UTC day.

    Columns: ``universe_id``, ``symbol``, ``day`` (date), ``day_no``, ``active``, and
    for each length n ``volume_<n>d`` (double), ``bars_<n>d`` (closes in the window) and
    ``close_avg_<n>d`` (null where the window holds no close).
    """
    fields = []
    for n in lengths:
        volume = F.col(f"volume_{n}d").cast("double") + F.col(f"volume_rest_{n}d")
        close = F.col(f"close_sum_{n}d").cast("double") + F.col(f"close_rest_{n}d")
        fields += [volume.alias(f"volume_{n}d"), F.col(f"close_count_{n}d").alias(f"bars_{n}d"), F.try_divide(close, F.col(f"close_count_{n}d")).alias(f"close_avg_{n}d")]
    return _totals(bars, lengths).select(*_SERIES, "day", "day_no", "active", *fields)


def rising_volume_days(bars: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """Days from the ``long``-th calendar day of a series on whose short mean volume exceeds the long one.

    ``short total * long > long total * short`` is compared in exact decimals, so equal
    means are no case; only totals with a rest beyond the decimals are compared in doubles.
    """
    if not 0 < short < 1000 or not 0 < long < 1000:
        raise ValueError("lengths have one to three digits")
    times = {n: F.lit(Decimal(n)) for n in (short, long)}
    a, b = F.col(f"volume_{short}d"), F.col(f"volume_{long}d")
    ra, rb = F.col(f"volume_rest_{short}d"), F.col(f"volume_rest_{long}d")
    exactly = a.try_cast(_FACTOR) * times[long] > b.try_cast(_FACTOR) * times[short]
    roughly = (a.cast("double") + ra) * float(long) > (b.cast("double") + rb) * float(short)
    more = F.when((ra == 0) & (rb == 0), F.coalesce(exactly, roughly)).otherwise(roughly)
    totals = trailing(daily_bars(bars).select(*_SERIES, "day", "volume", "volume_rest"), _SERIES, "day", ("volume", "volume_rest"), (short, long))
    return totals.filter((F.col("day_no") >= long) & more).select(*_SERIES, F.date_format("day", "yyyy-MM-dd").alias("day"))
