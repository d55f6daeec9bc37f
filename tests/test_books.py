"""Live books: batch by hand, stream equals batch, a stop at any place changes nothing."""

import numpy as np
import pandas as pd
import pytest

from barlattice.operators import books
from barlattice.streaming import live

HOUR = 3_600_000
SCHEMA = "universe_id string, symbol string, t long, open double, high double, low double, close double, volume double, asset_count long"
LOTS = "symbol string, step_size double, min_qty double, min_notional double"


def bars(n=620, symbols=("a", "b", "c"), seed=0, universe="u"):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        out += [(universe, s, i * HOUR, c, c * 1.01, c * 0.99, c, float(v), len(symbols)) for i, (c, v) in enumerate(zip(map(float, close), rng.uniform(1, 9, n)))]
    return out


def filters(spark):
    return spark.createDataFrame([("a", 0.01, 0.01, 1.0), ("b", 0.5, 0.5, 5.0)], LOTS)


def key(rows):
    return {(r.universe_id, r.t, r.book): (round(r.nav, 6), round(r.net, 12), r.trades, {k: round(v, 9) for k, v in r.weights.items()}, len(r.orders), r.rejected) for r in rows}


def test_books_by_hand():
    b = books.Books(capital=1000.0, warm_up=2)
    lots = [(0.0, 0.0, 0.0)] * 2
    assert b.advance(0, ["x", "y"], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], lots) == []
    launch = {r[1]: r for r in b.advance(1, ["x", "y"], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], lots)}
    assert launch["BUY_AND_HOLD"][2] == pytest.approx(1000 - 1000 * (books.FEE + books.SLIPPAGE)) and launch["CASH"][2] == 1000
    after = {r[1]: r for r in b.advance(2, ["x", "y"], [1.1, 0.9], [1.1, 0.9], [1.1, 0.9], [1.0, 1.0], lots)}
    assert after["BUY_AND_HOLD"][3] == pytest.approx(0.0, abs=1e-7) and after["STRATEGY"][2] == 1000
    assert b.advance(2, ["x", "y"], [9.0, 9.0], [9.0, 9.0], [9.0, 9.0], [1.0, 1.0], lots) == []  # a bar counts once
    again = books.Books(b.dump(), capital=1000.0, warm_up=2)
    assert again.s == b.s


def test_momentum_and_reversion_of_the_books_equal_numpy(spark):
    rows = bars()
    got = [r for r in books.replayed(spark.createDataFrame(rows, SCHEMA), filters(spark)).collect()]
    close = np.array([[r[6] for r in rows if r[1] == s] for s in "abc"]).T
    leader = {r.t // HOUR: r.weights for r in got if r.book == "SIMPLE_MOMENTUM"}
    first = min(k for k, w in leader.items() if any(w.values()))
    assert first == 480  # a rebalance is overdue as soon as 480 bars lie behind
    gains = close[first] / close[first - 480] - 1
    assert max(leader[first], key=leader[first].get) == "abc"[int(gains.argmax())]
    active = np.zeros(3)
    for k in range(620):
        if k >= 480:
            past = close[k - 480 : k]
            z = (close[k] - past.mean(axis=0)) / (past.std(axis=0) + 1e-8)
            active = np.where(z <= -2, 1.0, np.where(z >= 0, 0.0, active))
    last = next(r.weights for r in got if r.book == "SIMPLE_MEAN_REVERSION" and r.t == 619 * HOUR)
    assert [round(last[s] * 3) for s in "abc"] == active.tolist()
    assert {r.book for r in got} == {books.STRATEGY, *books.BASELINES} and all(r.max_drawdown <= 0 for r in got)
    assert sum(len(r.orders) for r in got if r.book == books.STRATEGY) > 0


def test_a_stream_that_loses_its_power_has_the_books_of_the_batch(spark, tmp_path):
    rows = bars(90) + bars(90, ("x", "y"), 3, "v")
    folder, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        live.run_available(live.live_books(live.replay_source(spark, folder, SCHEMA, 100), filters(spark)), sink, state)

    for low, high in ((0, 31), (31, 32), (32, 70)):
        part = [r for r in rows if low <= r[2] // HOUR < high]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run()  # each run is a new query on the same checkpoint: what was owed is caught up
    half = [r for r in rows if r[2] // HOUR == 70 and r[1] in "ax"]  # an instant whose other assets come later
    spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run()
    rest = [r for r in rows if r[2] // HOUR >= 70 and r not in half]
    spark.createDataFrame(rest + rows[:40], SCHEMA).coalesce(1).write.mode("append").parquet(folder)  # and bars that came before
    run()
    run()  # nothing is owed
    got, want = spark.read.parquet(sink).collect(), books.replayed(spark.createDataFrame(rows, SCHEMA), filters(spark)).collect()
    assert len(got) == len(want) and key(got) == key(want)


def test_instants_that_never_complete_are_dropped(spark):
    rows = [r for r in bars(60) if not (r[2] // HOUR == 40 and r[1] == "b")]
    b, out = books.Books(), []
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).assign(step_size=0.0, min_qty=0.0, min_notional=0.0)
    for _, part in pdf.groupby("t"):
        out += b.take(part)
    assert 40 * HOUR not in {r[0] for r in out} and max(r[0] for r in out) == 59 * HOUR and b.s["pending"] == {}
    health = live.health(spark.createDataFrame(rows, SCHEMA), 59 * HOUR)
    assert health["status"] == "healthy" and health["series"] == 3
    assert live.health(spark.createDataFrame(rows, SCHEMA).limit(0), 0)["status"] == "unreachable"
    assert live.health(spark.createDataFrame(rows, SCHEMA), 99 * HOUR, 5)["status"] == "critical"
