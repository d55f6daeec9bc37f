"""Portfolio returns, costs and order sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.align import SERIES, along

WARM_UP = 24
#: A bar counts as a trade above the first turnover; above the second it has a cost in basis points of its own.
TRADED, COSTED = 1e-4, 1e-6


def backtest(rows: DataFrame, fee: float = 0.0090, warm_up: int = WARM_UP, key: str = "universe_id", weights: dict[str, str] | None = None) -> DataFrame:
    """Returns of a portfolio per bar: ``gross``, ``net``, ``flat_net``, ``turnover``, ``cost_bps``, ``traded``.

    ``rows`` has ``weight``, ``ret`` and ``slippage`` per asset.  Weights held at a bar
    earn the next bar's return; changes of weight pay fee and slippage.  Bars from
    ``warm_up`` (0-based) to the last but one count; the weight before the first of
    them is 0.  ``cost_bps`` is 10 on bars without turnover.  With ``weights`` (name of a
    portfolio to its column of weights) all portfolios are run over the same rows and
    come out by ``strategy``: the rows are neither repeated nor shuffled for each.
    """
    series = along(*SERIES)
    columns = weights or {"": "weight"}
    k = F.row_number().over(series) - 1
    last = {f"__last{i}": F.lag(c).over(series) for i, c in enumerate(columns.values())}
    rows = rows.withColumns({"__k": k, "__next": F.lead("ret").over(series), **last})
    rows = rows.filter((F.col("__k") >= warm_up) & F.col("__next").isNotNull())
    sums = []
    for i, c in enumerate(columns.values()):
        before = F.when(F.col("__k") == warm_up, F.lit(0.0)).otherwise(F.coalesce(f"__last{i}", F.lit(0.0)))
        change = F.abs(F.col(c) - before)
        sums += [F.sum(F.col(c) * F.col("__next")).alias(f"__g{i}"), F.sum(change).alias(f"__u{i}"), F.sum(change * (fee + F.col("slippage"))).alias(f"__c{i}")]
    per = rows.groupBy(key, "t").agg(*sums)
    parts = [F.struct(F.lit(n).alias("strategy"), F.col(f"__g{i}").alias("gross"), F.col(f"__u{i}").alias("turnover"), F.col(f"__c{i}").alias("__cost")) for i, n in enumerate(columns)]
    per = per.select(key, "t", F.explode(F.array(*parts)).alias("__s")).select(key, "t", "__s.*")
    costed = F.col("turnover") > COSTED
    return per.select(
        key,
        *(["strategy"] if weights else []),
        "t",
        "gross",
        (F.col("gross") - F.col("__cost")).alias("net"),
        (F.col("gross") - F.col("turnover") * (fee + 0.0005)).alias("flat_net"),
        "turnover",
        F.when(costed, F.col("__cost") / F.when(costed, F.col("turnover")) * 10_000).otherwise(10.0).alias("cost_bps"),
        (F.col("turnover") > TRADED).alias("traded"),
    )


def reference_performance(rows: DataFrame, cost: float = 0.001, drop: int = WARM_UP) -> DataFrame:
    """Single assets: cost of a change of ``position`` at once, profit at the next bar; the first ``drop`` bars do not count.

    Per series: ``bars``, ``total``, ``mean``, ``sd`` of the net returns.
    """
    series = along(*SERIES)
    held = F.coalesce(F.lag("position").over(series), F.lit(0.0))
    rows = rows.withColumns({"__k": F.row_number().over(series) - 1, "__net": held * F.col("ret") - F.abs(F.col("position") - held) * cost})
    return rows.filter(F.col("__k") >= drop).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("__net").alias("total"), F.avg("__net").alias("mean"), F.stddev_pop("__net").alias("sd")
    )


def quantised(quantity: Column, step: Column) -> Column:
    """Quantity towards zero to a multiple of ``step`` (a step of 0 or less: unchanged)."""
    return F.when(step <= 0, quantity).otherwise(F.signum(quantity) * F.floor(F.abs(quantity) / F.when(step > 0, step) + 1e-9) * step)


def quantise_orders(orders: DataFrame, filters: DataFrame) -> DataFrame:
    """Orders (``symbol``, ``notional``, ``price``) cut to lots or rejected.

    Adds ``filled_qty``, ``filled_notional``, ``reject`` (``notional`` where it is null, ``price``,
    ``min_qty``, ``min_notional`` or null) and ``fill_ratio`` (1 for an order of nothing).
    ``filters`` is a small dimension; a symbol without one (or null) has no step and no minima.
    """
    rows = orders.join(filters.select("symbol", "step_size", "min_qty", "min_notional"), "symbol", "left")
    step, least, worth = (F.coalesce(c, F.lit(0.0)) for c in ("step_size", "min_qty", "min_notional"))
    usable = F.coalesce(F.col("price") > 0, F.lit(False))
    qty = quantised(F.col("notional") / F.when(usable, F.col("price")), step)
    rows = rows.withColumn("__q", qty).withColumn("__v", F.col("__q") * F.col("price"))
    reject = F.when(F.col("notional").isNull(), "notional").when(~usable, "price").when(F.abs("__q") < least - 1e-12, "min_qty").when(F.abs("__v") < worth - 1e-12, "min_notional")
    rows = rows.withColumn("reject", reject)
    good = F.col("reject").isNull()
    rows = rows.withColumns({"filled_qty": F.when(good, F.col("__q")).otherwise(0.0), "filled_notional": F.when(good, F.col("__v")).otherwise(0.0)})
    asked = F.coalesce(F.abs("notional") > 1e-12, F.lit(False))
    ratio = F.when(asked, F.col("filled_notional") / F.when(asked, F.col("notional"))).otherwise(1.0)
    return rows.withColumn("fill_ratio", ratio).drop("__q", "__v", "step_size", "min_qty", "min_notional")


def fill(notional: float, price: float, step: float, least: float, worth: float) -> float | None:
    """Notional of one order that the lots allow, or None where it is rejected (the scalar form of ``quantise_orders``)."""
    if not price > 0:
        return None
    q = notional / price
    q = np.sign(q) * np.floor(abs(q) / step + 1e-9) * step if step > 0 else q
    if abs(q) < least - 1e-12 or abs(q * price) < worth - 1e-12 or abs(q * price) < 1e-12:
        return None
    return float(q * price)


def paper_simulation(rows: DataFrame, filters: DataFrame, capital: float = 100_000.0, fee: float = 0.0090) -> DataFrame:
    """Path-dependent simulation with quantised fills, one pandas group per universe.

    ``rows``: ``universe_id``, ``symbol``, ``t``, ``close``, ``ret``, ``weight`` (desired), ``slippage``.
    Orders go out when the desired weight changes and differs from the achieved one
    by more than 1e-4; all orders of a bar are sized by the value before it; what the
    lots allow is achieved and earns the next bar's return, less the bar's costs.
    Result for each bar: ``nav`` (with what it earns by the next bar), ``gross``, ``net``,
    ``turnover``, ``cost_bps`` (null without turnover), ``orders``, ``rejected``; bars of the warm-up
    and the last one trade nothing.  Recursive by nature: a universe's bars are held by one task (its
    length in time bounds them, not the number of universes).
    """
    lots = rows.join(filters.select("symbol", "step_size", "min_qty", "min_notional"), "symbol", "left").na.fill(0.0, ["step_size", "min_qty", "min_notional"])

    def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "symbol"])
        wide = {c: pdf.pivot(index="t", columns="symbol", values=c).to_numpy() for c in ("close", "ret", "weight", "slippage", "step_size", "min_qty", "min_notional")}
        times = np.sort(pdf["t"].unique())
        n = wide["close"].shape[1]
        achieved, wanted, nav = np.zeros(n), np.zeros(n), capital
        out = []
        for k in range(len(times)):
            if k < WARM_UP or k == len(times) - 1:  # no trade, and no return to come
                out.append((pdf["universe_id"].iloc[0], int(times[k]), nav, 0.0, 0.0, 0.0, None, 0, 0))
                continue
            filled, cost, orders, rejected = np.zeros(n), 0.0, 0, 0
            changed = np.abs(wide["weight"][k] - wanted) > 1e-9
            for j in np.flatnonzero(changed & (np.abs(wide["weight"][k] - achieved) > 1e-4)):
                orders += 1
                got = fill((wide["weight"][k, j] - achieved[j]) * nav, wide["close"][k, j], wide["step_size"][k, j], wide["min_qty"][k, j], wide["min_notional"][k, j])
                if got is None:
                    rejected += 1
                    continue
                filled[j] = got / max(1e-12, nav)
                cost += abs(got) * (fee + wide["slippage"][k, j])
            wanted = wide["weight"][k]
            achieved = achieved + filled
            turnover, share = float(np.abs(filled).sum()), cost / max(1e-12, nav)
            gross = float(np.nansum(achieved * wide["ret"][k + 1]))
            nav *= 1 + gross - share
            out.append((pdf["universe_id"].iloc[0], int(times[k]), nav, gross, gross - share, turnover, share / turnover * 10_000 if turnover > COSTED else None, orders, rejected))
        return pd.DataFrame(out, columns=["universe_id", "t", "nav", "gross", "net", "turnover", "cost_bps", "orders", "rejected"])

    columns = ["universe_id", "symbol", "t", "close", "ret", "weight", "slippage", "step_size", "min_qty", "min_notional"]
    return lots.select(*columns).groupBy("universe_id").applyInPandas(
        simulate, "universe_id string, t long, nav double, gross double, net double, turnover double, cost_bps double, orders long, rejected long"
    )


def weighted_simulation(rows: DataFrame, capital: float = 100_000.0, fee: float = 0.0090, warm_up: int = WARM_UP, weights: dict[str, str] | None = None) -> DataFrame:
    """``backtest`` with the value of an account beside it: ``nav`` is ``capital`` compounded by the net returns, ``bar`` counts from 1."""
    w = Window.partitionBy("universe_id", *(["strategy"] if weights else [])).orderBy("t")
    path = F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return backtest(rows, fee, warm_up, weights=weights).withColumns({"bar": F.row_number().over(w), "nav": capital * path})


def summary(simulated: DataFrame, keys: list[str], capital: float = 100_000.0, periods: int = 8760) -> DataFrame:
    """One row per simulation: Sharpe ratios (population deviation + 1e-8), arithmetic growth, drawdown of the summed returns, turnover, costs, value."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = simulated.withColumn("__cum", F.sum("net").over(w)).withColumn("__dd", F.col("__cum") - F.max("__cum").over(w))
    year = F.sqrt(F.lit(float(periods)))

    def sharpe(c: str) -> Column:
        return F.avg(c) / (F.stddev_pop(c) + 1e-8) * year

    return rows.groupBy(*keys).agg(
        sharpe("net").alias("net_sharpe"),
        sharpe("gross").alias("gross_sharpe"),
        (F.avg("net") * periods).alias("cagr_net"),
        F.min("__dd").alias("max_drawdown"),
        (F.sum("turnover") * periods / F.count(F.lit(1))).alias("annual_turnover"),
        F.avg("cost_bps").alias("mean_cost_bps"),
        F.count_if("traded").alias("total_trades"),
        F.max_by("nav", "t").alias("ending_nav_usd"),
        (F.max_by("nav", "t") - capital).alias("total_pnl_usd"),
    )


_UNTRADED = ("NO_TRADES", "DELISTED")


def spot_simulation(rows: DataFrame, capital: float = 100_000.0, fee_bps: float = 5.0, slip_bps: float = 5.0, defer: int = 3, penalty_bps: float = 200.0) -> DataFrame:
    """Long-only spot account: the targets of a bar are executed at the next bar's open.

    ``rows``: ``universe_id``, ``symbol``, ``t``, ``open``, ``close``, ``state``, ``weight``.  A
    negative weight, and weights of a bar that sum above 1, raise; a null one is no target.  An order on a bar
    without trades, of a delisted asset, or for an asset without a bar waits up to
    ``defer`` bars and is then dropped; the newest target of an asset holds.  A delisted
    asset is sold at its last known close less ``penalty_bps``.  Purchases are cut to
    the cash.  Result per bar: ``nav``, ``cash``, ``deferred``, ``turnover`` (one way), ``fees``
    and ``slippage`` paid so far.  A universe's bars are held by one task.
    """
    fee, slip, penalty = fee_bps / 10_000, slip_bps / 10_000, penalty_bps / 10_000

    def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, units, known, waiting, waited, paid = capital, {}, {}, {}, {}, [0.0, 0.0]
        pdf = pdf.sort_values(["t", "symbol"])
        universe, times = pdf["universe_id"].iloc[0], pdf["t"].to_numpy()
        rows = list(zip(*[pdf[c].tolist() for c in ("symbol", "open", "close", "state", "weight")]))
        starts = [0, *(np.flatnonzero(np.diff(times)) + 1).tolist(), len(times)]
        out, targets = [], {}
        for low, high in zip(starts, starts[1:]):
            bar = {s: (o, c, state) for s, o, c, state, _ in rows[low:high]}
            active = {**waiting, **targets}
            known.update({s: c for s, (_, c, state) in bar.items() if state != "DATA_GAP" and c > 0})
            for s in [s for s, (_, _, state) in bar.items() if state == "DELISTED" and units.get(s, 0.0) > 1e-12]:
                price = known.get(s, 0.0)
                cash += units[s] * max(0.0, price * (1 - penalty))
                paid[1] += units.pop(s) * price * penalty
                active[s] = 0.0 if s in active else active.get(s, 0.0)
                waiting.pop(s, None), waited.pop(s, None)

            def value(at: int) -> float:
                return cash + sum(q * (bar[s][at] if s in bar and bar[s][at] > 0 else known.get(s, 0.0)) for s, q in units.items())

            before = value(0)
            if before <= 0:
                raise ValueError("the account is worth nothing")
            held = {s: q * (bar[s][0] if s in bar and bar[s][0] > 0 else known.get(s, 0.0)) / before for s, q in units.items()}
            turnover = 0.0
            for s in sorted({*held, *active}):
                change = active.get(s, 0.0) - held.get(s, 0.0)
                if abs(change) < 1e-12:
                    continue
                if s not in bar or bar[s][2] in _UNTRADED:
                    waited[s] = waited.get(s, 0) + 1
                    if waited[s] <= defer:
                        waiting[s] = active.get(s, 0.0)
                    else:
                        waiting.pop(s, None)
                        waited[s] = 0
                    continue
                waiting.pop(s, None), waited.pop(s, None)
                price, worth = bar[s][0], abs(change) * before
                if not price > 0:  # a bar without a price trades nothing
                    continue
                if change > 0:
                    if worth * (1 + fee) > cash + 1e-6:
                        worth = max(0.0, cash / (1 + fee))
                    cash -= worth * (1 + fee)
                    units[s] = units.get(s, 0.0) + worth / (price * (1 + slip))
                else:
                    sold = min(units.get(s, 0.0), worth / price)
                    cash += sold * price * (1 - slip) - worth * fee
                    units[s] = units.get(s, 0.0) - sold
                turnover += abs(change)
                paid[0] += worth * fee
                paid[1] += worth * slip
            targets = {s: w for s, *_, w in rows[low:high] if w is not None and w == w}
            if any(w < -1e-12 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
                raise ValueError("a spot account holds weights of at least 0 that sum to at most 1")
            out.append((universe, int(times[low]), value(1), cash, len(waiting), turnover / 2, *paid))
        return pd.DataFrame(out, columns=["universe_id", "t", "nav", "cash", "deferred", "turnover", "fees", "slippage"])

    return rows.select("universe_id", "symbol", "t", "open", "close", "state", "weight").groupBy("universe_id").applyInPandas(
        simulate, "universe_id string, t long, nav double, cash double, deferred long, turnover double, fees double, slippage double"
    )


def long_only(rows: DataFrame) -> DataFrame:
    """Weights for a spot account: below 0 they are 0; those of an instant that sum above 1 are scaled down to 1."""
    held = F.greatest(F.col("weight"), F.lit(0.0))
    total = F.sum(held).over(Window.partitionBy("universe_id", "t"))
    return rows.withColumn("weight", held / F.greatest(F.lit(1.0), total))


def equity(returns: DataFrame, column: str = "net", key: str = "universe_id", scale: float = 1.0) -> DataFrame:
    """``equity`` (compounded, at least 1e-12), ``nav_dd`` and ``cum_dd`` (cumulative-sum convention) per bar."""
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(column) * scale
    rows = returns.withColumns({"equity": F.greatest(F.product(1 + r).over(w), F.lit(1e-12)), "cum": F.sum(r).over(w)})
    rows = rows.withColumns({"__peak": F.greatest(F.lit(1.0), F.max("equity").over(w)), "__cpeak": F.max("cum").over(w)})
    return rows.withColumns({"nav_dd": (F.col("equity") - F.col("__peak")) / F.col("__peak"), "cum_dd": F.col("cum") - F.col("__cpeak")}).drop("__peak", "__cpeak")
