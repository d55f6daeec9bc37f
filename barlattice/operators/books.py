"""Live books: a strategy and its baselines marked to market bar by bar, the same in batch and in a stream.

All that a universe's books need is one state of bounded size: values, positions,
running sums and the last few hundred bars.  ``Books`` advances it by one bar; the
batch form replays a universe's bars through it, the streaming form keeps it in the
state store.  A bar at or before the last one changes nothing, so a replay from any
earlier position gives the same books, for the strategy and the baselines alike.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.portfolio import fill

#: Bars of closes that a state keeps, for momentum and reversion; bars of volatility and spread for friction.
CLOSES, FRICTION, KNOWN = 520, 720, 48
LOOK_BACK, REBALANCE = 480, 168
FEE, SLIPPAGE = 0.0090, 0.0005
BASELINES = ("BUY_AND_HOLD", "SIMPLE_MOMENTUM", "SIMPLE_MEAN_REVERSION", "CASH")
STRATEGY = "STRATEGY"

BOOK_SCHEMA = (
    "universe_id string, t long, book string, nav double, net double, peak double, max_drawdown double, trades long, sharpe double, cagr double,"
    " weights map<string,double>, orders array<struct<symbol:string,side:string,delta:double,price:double,notional:double,cost:double>>, rejected long"
)
LOTS = ("step_size", "min_qty", "min_notional")


class Books:
    """The books of one universe.  ``state`` is a JSON text; None starts anew."""

    def __init__(self, state: str | None = None, capital: float = 100_000.0, warm_up: int = 25, enter: float = 0.5, leave: float = 0.2, cap: float = 1.0):
        self.capital, self.warm_up, self.enter, self.leave, self.cap = capital, warm_up, enter, leave, cap
        self.s = json.loads(state) if state else {"last": None, "seen": 0, "closes": [], "volumes": [], "rets": [], "vols": [], "spreads": [], "books": {}, "pending": {}}

    def dump(self) -> str:
        return json.dumps(self.s)

    # -- one bar

    def advance(self, t: int, symbols: list[str], high: list[float], low: list[float], close: list[float], volume: list[float], lots: list[tuple[float, float, float]]) -> list[tuple]:
        """The books after the bar at ``t`` (one row each); nothing while warming up or where the bar is not new."""
        s = self.s
        if s["last"] is not None and t <= s["last"]:
            return []
        n = len(symbols)
        before = s["closes"][-1] if s["closes"] else close
        rets = [(b - a) / (a + 1e-8) for a, b in zip(before, close)]
        past = np.array(s["rets"][-24:]) if len(s["rets"]) >= 24 else None
        s["vols"].append([0.0] * n if past is None or s["seen"] < 25 else past.std(axis=0).tolist())
        s["spreads"].append([(h - w) / max(1e-8, c) for h, w, c in zip(high, low, close)])
        s["rets"].append([0.0] * n if not s["seen"] else [(b - a) / max(1e-8, a) for a, b in zip(before, close)])
        s["closes"].append(list(close))
        s["volumes"].append(list(volume))
        for name, most in (("vols", FRICTION), ("spreads", FRICTION), ("rets", 25), ("closes", CLOSES), ("volumes", 24)):
            del s[name][:-most]
        s["seen"] += 1
        s["last"] = t
        if s["seen"] < self.warm_up:
            return []
        if not s["books"]:
            self._launch(n)
            return [self._row(t, symbols, name, [], 0) for name in s["books"]]
        return [self._strategy(t, symbols, close, rets, lots), *(self._baseline(t, symbols, name, close, rets, lots) for name in BASELINES)]

    def _launch(self, n: int) -> None:
        def book(weight: float) -> dict:
            return {"nav": self.capital, "peak": self.capital, "dd": 0.0, "trades": 0, "w": [weight] * n, "n": 0, "sum": 0.0, "squares": 0.0, "net": 0.0, "since": 0, "active": [0.0] * n}

        books = {STRATEGY: book(0.0), **{b: book(1 / n if b == "BUY_AND_HOLD" else 0.0) for b in BASELINES}}
        held = books["BUY_AND_HOLD"]  # pays its entry once
        held["nav"] -= self.capital * (FEE + SLIPPAGE)
        held["trades"] = n
        self.s["books"] = books

    def _mark(self, book: dict, nav: float, net: float) -> None:
        book["nav"], book["net"] = nav, net
        book["n"], book["sum"], book["squares"] = book["n"] + 1, book["sum"] + net, book["squares"] + net * net
        book["peak"] = max(book["peak"], nav)
        if book["peak"] > 0:
            book["dd"] = min(book["dd"], (nav - book["peak"]) / book["peak"])

    def _row(self, t: int, symbols: list[str], name: str, orders: list[tuple], rejected: int) -> tuple:
        b = self.s["books"][name]
        n = max(1, b["n"])
        mean = b["sum"] / n
        spread = math.sqrt(max(0.0, b["squares"] / n - mean * mean)) + 1e-12
        sharpe = mean / spread * math.sqrt(8760) if b["n"] else 0.0
        return (t, name, b["nav"], b["net"], b["peak"], b["dd"], b["trades"], sharpe, mean * 8760, dict(zip(symbols, b["w"])), orders, rejected)

    # -- strategy

    def _factors(self) -> list[float]:
        closes, volumes = self.s["closes"], np.array(self.s["volumes"])
        if len(closes) < 25 or len(volumes) < 24:
            return [0.0] * len(closes[-1])
        ratio = volumes[-16:].mean(axis=0) / (volumes.mean(axis=0) + 1e-8)
        return [math.tanh(0.6 * (now / then - 1) + 0.4 * r) if then > 0 else 0.0 for now, then, r in zip(closes[-1], closes[-25], ratio.tolist())]

    def _slippage(self) -> list[float]:
        def against_mean(rows: list[list[float]]) -> np.ndarray:
            x = np.array(rows)
            return x[-1] / np.maximum(1e-6, x.mean(axis=0)) if len(x) >= KNOWN else np.ones(x.shape[1])

        return (SLIPPAGE * (0.5 * against_mean(self.s["vols"]) + 0.5 * against_mean(self.s["spreads"]))).tolist()

    def _strategy(self, t: int, symbols: list[str], close: list[float], rets: list[float], lots: list[tuple[float, float, float]]) -> tuple:
        """Marked to market asset by asset, then hysteresis on the factor as of this bar; each order is paid before the next is sized."""
        b, share = self.s["books"][STRATEGY], 1 / len(symbols)
        start = nav = b["nav"]
        for position, r in zip(b["w"], rets):
            nav += nav * share * position * r
        orders, rejected = [], 0
        slip = self._slippage()
        for j, x in enumerate(self._factors()):
            held = b["w"][j]
            target = math.copysign(self.cap, x) if abs(x) > self.enter else 0.0 if abs(x) < self.leave else held
            if abs(target - held) <= 1e-4:
                continue
            got = fill(nav * share * (target - held), close[j], *lots[j])
            if got is None:
                rejected += 1
                continue
            change, cost = got / max(1e-12, nav * share), abs(got) * (FEE + slip[j])
            nav -= cost
            b["w"][j] = held + change
            b["trades"] += 1
            orders.append((symbols[j], "BUY" if change > 0 else "SELL", change, close[j], got, cost))
        self._mark(b, round(nav, 2), nav / max(1e-12, start) - 1)
        return self._row(t, symbols, STRATEGY, orders, rejected)

    # -- baselines

    def _target(self, name: str, book: dict) -> list[float]:
        closes = self.s["closes"]
        if name == "SIMPLE_MOMENTUM":
            book["since"] += 1
            if book["since"] >= REBALANCE and len(closes) > LOOK_BACK:
                book["since"] = 0
                gains = [(now - then) / max(1e-8, then) for now, then in zip(closes[-1], closes[-1 - LOOK_BACK])]
                best = int(np.argmax(gains))
                return [float(j == best) for j in range(len(gains))]
        elif name == "SIMPLE_MEAN_REVERSION" and len(closes) > LOOK_BACK:
            past = np.array(closes[-1 - LOOK_BACK : -1])
            z = (np.array(closes[-1]) - past.mean(axis=0)) / (past.std(axis=0) + 1e-8)
            book["active"] = [1.0 if x <= -2 else 0.0 if x >= 0 else a for x, a in zip(z.tolist(), book["active"])]
            return [a / len(z) for a in book["active"]]
        return list(book["w"])

    def _baseline(self, t: int, symbols: list[str], name: str, close: list[float], rets: list[float], lots: list[tuple[float, float, float]]) -> tuple:
        b = self.s["books"][name]
        if name == "CASH":
            self._mark(b, b["nav"], 0.0)
            return self._row(t, symbols, name, [], 0)
        gross = sum(w * r for w, r in zip(b["w"], rets))
        target = self._target(name, b)
        valued, cost, orders, rejected = b["nav"] * (1 + gross), 0.0, [], 0
        for j, (wanted, held) in enumerate(zip(list(target), b["w"])):
            if abs(wanted - held) <= 1e-6:
                continue
            got = fill(valued * (wanted - held), close[j], *lots[j])
            if got is None:
                target[j], rejected = held, rejected + 1
                continue
            change, paid = got / max(1e-12, valued), abs(got) * (FEE + SLIPPAGE)
            target[j], cost = held + change, cost + paid
            b["trades"] += 1
            orders.append((symbols[j], "BUY" if change > 0 else "SELL", change, close[j], got, paid))
        net = gross - cost / max(1e-12, b["nav"])
        b["w"] = target
        self._mark(b, valued - cost, net)
        return self._row(t, symbols, name, orders, rejected)

    # -- rows of a frame

    def take(self, pdf: pd.DataFrame) -> list[tuple]:
        """Advances by the bars of ``pdf`` (``symbol``, ``t``, ``high``, ``low``, ``close``, ``volume``, ``asset_count``, lots).

        An instant is a bar once all assets have one; until then it waits in the state,
        and it is dropped when a later instant is complete first.
        """
        pending: dict[int, dict[str, list]] = defaultdict(dict, {int(k): v for k, v in self.s["pending"].items()})
        fields = ["high", "low", "close", "volume", *LOTS]
        known = -1 if self.s["last"] is None else self.s["last"]
        for t, symbol, count, *values in pdf[["t", "symbol", "asset_count", *fields]].itertuples(index=False, name=None):
            if t > known:
                pending[int(t)].setdefault(symbol, [int(count), *map(float, values)])
        out = []
        for t in sorted(pending):
            bar = pending[t]
            if len(bar) < max(v[0] for v in bar.values()):
                continue
            symbols = sorted(bar)
            high, low, close, volume = ([bar[x][k] for x in symbols] for k in (1, 2, 3, 4))
            out += self.advance(t, symbols, high, low, close, volume, [tuple(bar[x][5:]) for x in symbols])
        last = self.s["last"]
        self.s["pending"] = {str(t): v for t, v in pending.items() if last is None or t > last}
        return out


def with_lots(bars: DataFrame, filters: DataFrame) -> DataFrame:
    """Bars with their symbols' lot sizes; a symbol without a filter has no step and no minima."""
    return bars.join(filters.select("symbol", *LOTS), "symbol", "left").na.fill(0.0, list(LOTS))


def frame(universe: str, rows: list[tuple]) -> pd.DataFrame:
    names = [c.strip().split(" ")[0] for c in ("universe_id", "t", "book", "nav", "net", "peak", "max_drawdown", "trades", "sharpe", "cagr", "weights", "orders", "rejected")]
    out = pd.DataFrame([(universe, *r) for r in rows], columns=names)
    out["orders"] = [[dict(zip(("symbol", "side", "delta", "price", "notional", "cost"), o)) for o in orders] for orders in out["orders"]]
    return out


def replayed(bars: DataFrame, filters: DataFrame, **options: float) -> DataFrame:
    """The books of each universe after each of its bars, with the assets that share an instant.

    ``bars``: ``universe_id``, ``symbol``, ``t``, ``high``, ``low``, ``close``, ``volume``.  Recursive by
    nature: a universe's bars are held by one task.
    """
    counted = bars.withColumn("asset_count", F.count(F.lit(1)).over(Window.partitionBy("universe_id", "t")))
    columns = ["universe_id", "symbol", "t", "high", "low", "close", "volume", "asset_count", *LOTS]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame(pdf["universe_id"].iloc[0], Books(**options).take(pdf))

    return with_lots(counted, filters).select(*columns).groupBy("universe_id").applyInPandas(one, BOOK_SCHEMA)
