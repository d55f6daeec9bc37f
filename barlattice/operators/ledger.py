"""Research ledgers: identity by asset set, coverage, running numbers, streaks, repeats."""

from __future__ import annotations

import ast
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a ledger's rows that are read, of all schema versions.
LEDGER_SCHEMA = (
    "experiment_id string, trial_index long, variant_name string, hypothesis_family string, mechanism string, universe_id string, symbols array<string>,"
    " period_sharpe double, annualized_sharpe double, cumulative_global_trials long, proposal struct<universe_id: string, symbols: array<string>>, backtest struct<net_returns: array<double>>"
)


def asset_key(assets: Column) -> Column:
    """A universe is its set of assets, whatever its label."""
    return F.array_join(F.array_sort(F.array_distinct(assets)), ",")


def with_symbols(trials: DataFrame, outer: str = "symbols", nested: str = "proposal.symbols") -> DataFrame:
    """Symbols at the top level, else in the nested record (rows of different schema versions)."""
    return trials.withColumn("symbols", F.coalesce(F.col(outer), F.col(nested)))


def basket_footprint(trials: DataFrame) -> DataFrame:
    """Ledger rows by their own basket (``symbols``): ``trials``, ``with_returns``, distinct ``labels`` and ``ledgers``.

    Most trials first, then by basket.  Rows without symbols come under a null basket.
    """
    key = F.when(F.size("symbols") > 0, asset_key(F.col("symbols"))).alias("asset_key")
    per = trials.groupBy(key).agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if(F.coalesce(F.size("net_returns") > 0, F.lit(False))).alias("with_returns"),
        F.countDistinct("universe_id").alias("labels"),
        F.countDistinct("ledger").alias("ledgers"),
    )
    return per.orderBy(F.desc("trials"), "asset_key")


def stored_returns(trials: DataFrame, universes: DataFrame, subsets: bool = True, least: int = 2) -> DataFrame:
    """The stored return series that count for each universe, with where they come from.

    A row counts if its ``symbols`` are the universe's assets or (``subsets``) some of
    them; labels do not matter.  Series of fewer than ``least`` returns, with a null or
    infinite one, or that never move do not come out.  Columns: ``universe_id``, ``ledger``,
    ``trial_index``, ``variant_name``, ``symbols`` (sorted), ``n_obs``, ``subset_match``, ``net_returns``.
    """
    series = F.col("net_returns")
    sound = (F.size(series) >= least) & ~F.exists(series, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.array_max(series) > F.array_min(series))
    rows = trials.filter(F.coalesce(sound & (F.size("symbols") > 0), F.lit(False)))
    sets = rows.select(asset_key(F.col("symbols")).alias("inner_id"), F.array_sort(F.array_distinct("symbols")).alias("set")).distinct()
    wanted = universes.select(F.col("universe_id").alias("outer_id"), F.array_distinct("assets").alias("set"))
    found = contained(sets, wanted)
    found = found if subsets else found.filter(~F.col("proper"))
    return rows.withColumn("inner_id", asset_key(F.col("symbols"))).join(found, "inner_id").select(
        F.col("outer_id").alias("universe_id"), "ledger", "trial_index", "variant_name", F.split("inner_id", ",").alias("symbols"), F.size("net_returns").alias("n_obs"), F.col("proper").alias("subset_match"), "net_returns"
    )


def search_footprint(trials: DataFrame, universes: DataFrame) -> DataFrame:
    """Trials per asset set: ``trials``, ``labels`` (distinct universe ids), ``named`` (with a variant name)."""
    keys = universes.select("universe_id", asset_key(F.col("assets")).alias("asset_key"))
    return trials.join(keys, "universe_id").groupBy("asset_key").agg(
        F.count(F.lit(1)).alias("trials"),
        F.countDistinct("universe_id").alias("labels"),
        F.count_if(F.length("variant_name") > 0).alias("named"),
    )


def coverage(trials: DataFrame, by: str, present: str) -> DataFrame:
    """Per ``by``: trials, and with and without ``present``."""
    return trials.groupBy(by).agg(F.count(F.lit(1)).alias("trials"), F.count(present).alias("present"), F.count_if(F.col(present).isNull()).alias("missing"))


def contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """``inner_id``, ``outer_id``, ``proper`` of the sets of ``left`` that lie within a set of ``right``.

    ``left`` has ``inner_id`` and ``set``, ``right`` has ``outer_id`` and ``set`` (arrays without
    repeats).  A set can only lie in sets that hold its rarest member, so each meets
    those and no others.  The empty set lies in none.
    """
    members = right.select("outer_id", F.col("set").alias("__outer"), F.explode("set").alias("__member"))
    shares = members.groupBy("__member").agg(F.count(F.lit(1)).alias("__n"))
    each = left.filter(F.size("set") > 0).select("inner_id", F.col("set").alias("__inner"), F.explode("set").alias("__member"))
    # a member that no set of the right holds is the rarest of all: its set meets nothing
    rarest = each.join(shares, "__member", "left").groupBy("inner_id", "__inner").agg(F.min_by("__member", F.struct(F.coalesce("__n", F.lit(0)), "__member")).alias("__member"))
    met = rarest.join(members, "__member").filter(F.size(F.array_except("__inner", "__outer")) == 0)
    return met.select("inner_id", "outer_id", (F.size("__outer") > F.size("__inner")).alias("proper"))


def subset_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(inner, outer) labels whose asset set is contained in another universe's."""
    a = left.select(F.col("universe_id").alias("inner_id"), F.array_distinct("assets").alias("set"))
    b = right.select(F.col("universe_id").alias("outer_id"), F.array_distinct("assets").alias("set"))
    return contained(a, b).filter("inner_id <> outer_id").select("inner_id", "outer_id")


def code_hashes(trials: DataFrame, code: str, config: list[str], name: str = "code_hash") -> DataFrame:
    """Adds 16 hex digits that tell programs with their configuration apart, whatever their layout.

    The syntax tree counts; a text that is no Python counts without its white space.
    A null text has no hash.  Configuration values are compared as text.
    """
    @F.pandas_udf("string")
    def hashed(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text: str | None, value: str) -> str | None:
            if text is None:
                return None
            try:
                form = ast.dump(ast.parse(text))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                form = "".join(text.split())
            return hashlib.sha256(f"{form}\x1f{value}".encode("utf-8", "surrogatepass")).hexdigest()[:16]

        return pd.Series([one(t, v) for t, v in zip(texts, values)], dtype=object)

    return trials.withColumn(name, hashed(F.col(code), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in config]))))


def repeated_hashes(trials: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """``tie`` of each trial whose ``key`` an earlier one had, and ``first`` (the earliest): a probe by hash, null keys repeat nothing."""
    known = trials.filter(F.col(key).isNotNull())
    first = known.groupBy(key).agg(F.min_by(tie, F.struct(order, tie)).alias("first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return known.join(first, key).filter(F.col(tie) != F.col("first")).select(tie, "first")


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """Ledgers of JSON lines (``path``: a file, folder or pattern) as typed rows, whatever their schema version.

    Torn and blank lines are left out.  Symbols and label are taken from the top
    level, else from the nested proposal; net returns from the nested backtest.
    Missing texts are ``UNKNOWN``, missing numbers 0; a missing ``cumulative_global_trials``
    is the row's place in its ledger.  ``ledger`` is the file's name.
    """
    raw = spark.read.schema(LEDGER_SCHEMA).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_name").alias("ledger"), F.col("_metadata.file_block_start").alias("__block"))
    rows = with_symbols(raw).withColumn("__row", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("ledger").orderBy("__block", "__row"))
    text = {c: F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in ("experiment_id", "hypothesis_family", "mechanism")}
    number = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("period_sharpe", "annualized_sharpe")}
    filled = rows.withColumns({**text, **number, "universe_id": F.coalesce("universe_id", "proposal.universe_id"), "cumulative_global_trials": F.coalesce("cumulative_global_trials", place.cast("long")), "net_returns": F.col("backtest.net_returns")})
    # a ratio that was stored only for the year is brought to the period
    period = F.when((F.col("period_sharpe") == 0) & (F.col("annualized_sharpe") != 0), F.col("annualized_sharpe") / F.sqrt(F.lit(8760.0))).otherwise(F.col("period_sharpe"))
    return filled.withColumn("period_sharpe", period).drop("proposal", "backtest", "__block", "__row")


def recorded(trials: DataFrame, family: str, order: str, tie: str, content: list[str]) -> DataFrame:
    """Running numbers of recorded experiments: ``family_trial``, ``global_trial`` and ``experiment_id`` (``exp_`` and 16 hex digits of the content).

    The global number is a prefix sum over (day, place in the day), so no task sorts all trials.
    """
    rows = numbered(trials, family, order, tie).withColumn("__day", F.to_date(order))
    days = rows.groupBy("__day").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    offsets = days.select("__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__day").orderBy(order, tie))
    joined = rows.withColumn("__inside", inside).join(offsets.withColumnRenamed("__day", "__d"), F.col("__day").eqNullSafe(F.col("__d")))
    digest = F.substring(F.sha2(F.to_json(F.struct(*content)), 256), 1, 16)
    return joined.withColumn("global_trial", F.col("__before") + F.col("__inside")).withColumn("experiment_id", F.concat(F.lit("exp_"), digest)).drop("__day", "__d", "__before", "__inside")


def numbered(trials: DataFrame, family: str, order: str, tie: str) -> DataFrame:
    """``family_trial``: 1, 2, ... in order of time within a family."""
    w = Window.partitionBy(family).orderBy(order, tie)
    return trials.withColumn("family_trial", F.row_number().over(w))


def occurrences(trials: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """``occurrence`` of each key, and ``revisit`` after the first."""
    w = Window.partitionBy(key).orderBy(order, tie)
    return trials.withColumn("occurrence", F.row_number().over(w)).withColumn("revisit", F.col("occurrence") > 1)


def repetition_interval(trials: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Seconds since the previous trial with the same key (null for the first)."""
    w = Window.partitionBy(key).orderBy(order, tie)
    seconds = F.unix_seconds(order)
    return trials.withColumn("interval_s", seconds - F.lag(seconds).over(w))


def longest_streaks(rows: DataFrame, key: str, condition: Column, order: str, tie: str) -> DataFrame:
    """Longest run of rows that meet ``condition`` in each key (0 if none): gaps and islands."""
    w = Window.partitionBy(key).orderBy(order, tie)
    met = F.coalesce(condition, F.lit(False))
    marked = rows.select(key, met.alias("__met"), F.sum(F.when(met, 0).otherwise(1)).over(w).alias("__island"))
    runs = marked.groupBy(key, "__island").agg(F.count_if("__met").alias("__n"))
    return runs.groupBy(key).agg(F.max("__n").alias("longest"))


def epochs(rows: DataFrame, number: str, bounds: tuple[int, int] = (10, 20)) -> DataFrame:
    """``epoch`` of a running number: 1 up to the first bound, 2 up to the second, else 3."""
    n = F.col(number)
    return rows.withColumn("epoch", F.when(n <= bounds[0], 1).when(n <= bounds[1], 2).otherwise(3))


def calibration(rows: DataFrame, keys: list[str], predicted: str, outcome: str) -> DataFrame:
    """Per ``keys``: ``n`` predictions with a known outcome, their mean, ``mae`` against it and ``accuracy`` (0.5 and above says yes).

    ``outcome`` is 0 to 1 (or boolean) and true from 0.5 on.  Keys without any known pair have 0 and nulls.
    """
    p, o = F.col(predicted).cast("double"), F.col(outcome).cast("double")
    known = p.isNotNull() & o.isNotNull()
    return rows.groupBy(*keys).agg(
        F.count_if(known).alias("n"),
        F.avg(F.when(known, p)).alias("mean_predicted"),
        F.avg(F.when(known, F.abs(p - o))).alias("mae"),
        F.avg(F.when(known, ((p >= 0.5) == (o >= 0.5)).cast("double"))).alias("accuracy"),
    )


def transitions(rows: DataFrame, key: str, column: str, order: str, tie: str) -> DataFrame:
    """How often ``column`` goes from one value to the next within a key."""
    w = Window.partitionBy(key).orderBy(order, tie)
    return (
        rows.select(F.lag(column).over(w).alias("from_value"), F.col(column).alias("to_value"), F.row_number().over(w).alias("__k"))
        .filter("__k > 1")
        .groupBy("from_value", "to_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def window_guard(bars: DataFrame, last_allowed_ms: int) -> DataFrame:
    """The frame itself, if no instant (``ms``) lies after ``last_allowed_ms``; else raises before it is handed on."""
    latest = bars.agg(F.max("ms")).first()[0]
    if latest is not None and latest > last_allowed_ms:
        raise PermissionError(f"instants up to {latest} lie beyond the allowed {last_allowed_ms}")
    return bars
