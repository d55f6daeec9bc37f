"""Statistics, signals, simulation, sources, lint and streaming."""

import datetime as dt
import hashlib
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.functions import stats
from barlattice.operators import align, features, ledger, lint, metrics, nulls, portfolio, signals
from barlattice.session import cut_lineage
from barlattice.sources import klines
from barlattice.streaming import live

ROWS = "universe_id string, symbol string, t long, open double, high double, low double, close double, volume double"


def bars(n=200, symbols=("a", "b"), seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        out += [("u", s, i * 3_600_000, c, c * 1.01, c * 0.99, c, float(v)) for i, (c, v) in enumerate(zip(map(float, close), rng.uniform(1, 9, n)))]
    return out


def test_hysteresis_on_the_thresholds(spark):
    x = [0.9, 0.5, 0.51, 0.3, 0.2, 0.19, -0.6, float("nan"), None, 0.4]
    df = spark.createDataFrame([("u", "a", i, v) for i, v in enumerate(x)], "universe_id string, symbol string, t long, factor double")
    got = [r.position for r in signals.hysteresis(features.sanitise(df, "factor")).orderBy("t").collect()]
    assert got == [0, 0, 1, 1, 1, 0, -1, 0, 0, 0]
    with pytest.raises(Exception, match="outside its range"):
        features.sanitise(df.withColumn("factor", F.lit(1.2)), "factor").collect()


def test_adaptive_hysteresis_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.tanh(rng.normal(0, 1, 120))
    df = spark.createDataFrame([("u", "a", i, float(v)) for i, v in enumerate(x)], "universe_id string, symbol string, t long, factor double")
    got = [r.position for r in signals.adaptive_hysteresis(df, 90, 40, 50, 20).orderBy("t").collect()]
    want, held = [], 0.0
    for i, v in enumerate(x):
        past = np.abs(x[max(0, i - 50) : i])
        if i and len(past) >= 20:
            if abs(v) >= np.percentile(past, 90):
                held = float(np.sign(v))
            elif abs(v) <= np.percentile(past, 40):
                held = 0.0
        want.append(held)
    assert got == want


def test_features_look_only_back(spark):
    rows = bars()
    cut = 120 * 3_600_000
    whole, part = (spark.createDataFrame([r for r in rows if r[2] <= last], ROWS) for last in (1e18, cut))
    f = lambda df: {(r.symbol, r.t): (r.factor, r.vol_ratio) for r in features.friction_ratios(features.canonical_factor(features.simple_returns(df))).filter(F.col("t") <= cut).collect()}
    assert f(whole) == f(part)


def test_weights_and_leverage(spark):
    df = spark.createDataFrame([("u", s, 0, p) for s, p in (("a", 1.0), ("b", -1.0), ("c", 1.0))], "universe_id string, symbol string, t long, position double")
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "symbol string, w double")
    got = {r.symbol: r.weight for r in signals.target_weights(df, shares).collect()}
    total = 0.5 + 0.5 + 1 / 3
    assert got["a"] == pytest.approx(0.5 / total) and got["c"] == pytest.approx(1 / 3 / total)
    heavy = df.withColumn("weight", F.lit(0.8))
    assert {round(r.weight, 9) for r in signals.cap_leverage(heavy).collect()} == {round(1 / 3, 9)}


def test_orders_below_the_minima_are_rejected(spark):
    orders = spark.createDataFrame([(1, "a", 10.0, 3.0), (2, "a", 0.5, 3.0), (3, "a", 4.0, 0.0), (4, "zz", 4.0, 3.0), (5, "a", 0.0, 3.0)], "id int, symbol string, notional double, price double")
    filters = spark.createDataFrame([("a", 0.5, 0.5, 5.0)], "symbol string, step_size double, min_qty double, min_notional double")
    got = {r.id: (r.filled_qty, r.reject) for r in portfolio.quantise_orders(orders, filters).collect()}
    assert got[1] == (3.0, None) and got[2][1] == "min_qty" and got[3][1] == "price" and got[4] == (pytest.approx(4 / 3), None) and got[5][1] == "min_qty"


def test_simulations_keep_the_books(spark):
    rows = spark.createDataFrame(bars(), ROWS)
    ready = features.slippage_rate(features.friction_ratios(signals.target_weights(signals.hysteresis(features.canonical_factor(features.simple_returns(rows))))))
    filters = spark.createDataFrame([("a", 0.01, 0.01, 1.0)], "symbol string, step_size double, min_qty double, min_notional double")
    paper = portfolio.paper_simulation(ready, filters, fee=0.001).collect()
    assert len(paper) == 200 and all(r.nav > 0 for r in paper) and sum(r.turnover for r in paper) > 0
    states = ready.withColumn("state", F.when((F.col("t") == 100 * 3_600_000) & (F.col("symbol") == "a"), "DELISTED").otherwise("NORMAL"))
    spot = portfolio.spot_simulation(states).collect()
    assert len(spot) == 200 and all(r.cash > -1e-6 and r.nav > 0 for r in spot)


def test_metrics_of_special_series(spark):
    rows = [("flat", i, 0.0) for i in range(5)] + [("lost", i, -1.0 if i == 2 else 0.01) for i in range(5)] + [("one", 0, 0.1)] + [("up", i, 0.01 + i * 0.001) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t long, net double")
    got = {r.k: r for r in metrics.performance(df, "k").collect()}
    assert "one" not in got and got["flat"].sharpe == 0 and got["flat"].kurtosis == 3 and math.isinf(got["up"].profit_factor)
    dd = {r.k: r for r in metrics.drawdowns(df, "k").collect()}
    assert dd["lost"].nav_dd == pytest.approx(-1.0) and dd["flat"].nav_dd == 0 and dd["flat"].calmar == 0
    assert dd["lost"].nav_dd == pytest.approx(stats.max_drawdown([r[2] for r in rows if r[0] == "lost"]), abs=1e-9)


def test_scalar_statistics():
    assert stats.expected_max_sharpe(1, 0.1, 0.05) == 0.05
    assert stats.expected_max_sharpe(100, 0.1) > stats.expected_max_sharpe(10, 0.1) > 0
    assert stats.deflated_sharpe(0.1, 1000, 0, 3, 1) > stats.deflated_sharpe(0.1, 1000, 0, 3, 50)
    with pytest.raises(ValueError):
        stats.deflated_sharpe(12.0, 1000, 0, 3, 1)
    near = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1.0]])
    assert stats.cluster_count(near) == 2 and stats.cluster_count(np.eye(4)) == 4 and stats.effective_rank(np.eye(4)) == 4
    more = np.ones((4, 4)) * 0.99
    more[:3, :3] = near
    more[2, 3] = more[3, 2] = 0.1
    np.fill_diagonal(more, 1)
    assert stats.cluster_count(more) >= stats.cluster_count(near)  # a near copy never lowers the count
    r = np.random.default_rng(0).normal(0, 0.05, 300)
    g = stats.gross_for_drawdown(r, -0.2)
    assert stats.max_drawdown(g * r) >= -0.2 > stats.max_drawdown((g + 0.01) * r)


def test_null_markets_are_seeded_and_keep_their_margins(spark):
    rows = spark.createDataFrame(bars(128), ROWS)
    a, b = (sorted(map(tuple, nulls.block_bootstrap(df).collect())) for df in (rows.repartition(1), rows.repartition(7)))
    assert a == b and len(a) == 256
    surrogate = nulls.phase_randomised(rows).filter("symbol = 'a'").orderBy("t").toPandas()
    before, after = (np.sort(np.diff(np.log(x), prepend=np.log(x[0]))) for x in ([r[6] for r in bars(128) if r[1] == "a"], surrogate["close"].to_numpy()))
    assert np.allclose(before[1:-1], after[1:-1], atol=0.05) and sorted(surrogate["volume"]) == pytest.approx(sorted(r[7] for r in bars(128) if r[1] == "a"))


def test_bootstrap_p_value(spark):
    rng = np.random.default_rng(0)
    assert nulls.bootstrap_test(spark, list(rng.normal(0.05, 0.1, 200)), 200, 10).first().p_value < 0.05
    assert nulls.bootstrap_test(spark, list(rng.normal(0, 0.1, 200) - 0.02), 200, 10).first().p_value > 0.3
    assert (nulls.block_indices(50, 10, rng) < 50).all() and len(nulls.block_indices(0, 5, rng)) == 0


def test_ledger(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, "k", at + dt.timedelta(seconds=10 * i), v) for i, v in enumerate([True, True, False, True, None, True, True, True])]
    df = spark.createDataFrame(rows, "id long, k string, at timestamp, bad boolean")
    assert ledger.longest_streaks(df, "k", F.col("bad"), "at", "id").first().longest == 3
    assert [r.interval_s for r in ledger.repetition_interval(df, "k", "at", "id").orderBy("id").collect()] == [None] + [10] * 7
    u = spark.createDataFrame([("x", ["b", "a"]), ("y", ["a", "b", "c"]), ("z", ["d"]), ("x2", ["a", "b", "a"])], "universe_id string, assets array<string>")
    got = {(r.inner_id, r.outer_id) for r in ledger.subset_match(u, u).collect()}
    assert got == {("x", "y"), ("x2", "y"), ("x", "x2"), ("x2", "x")}
    with pytest.raises(PermissionError):
        ledger.window_guard(spark.createDataFrame([(5,)], "ms long"), 4)


def test_lint():
    assert lint.check_code("def f(df, n=24):\n    return df['close'].rolling(n).mean()") == []
    bad = "import os\ndef f(df):\n    w = 3\n    x = df.close.shift(-1) + df.close.rolling(w, center=True).mean()\n    return eval('x').bfill()"
    found = " ".join(lint.check_code(bad))
    for part in ("import of os", "shift", "too short", "centred", "call of eval", "back filling"):
        assert part in found
    assert "syntax" in lint.check_code("def f(:")[0]


def test_kline_zips_and_checksums(spark, tmp_path):
    head = ",".join(klines.KLINE)
    text = f"{head}\n1700000000000,1,2,0.5,1.5,10,1700003599999,15,3,5,7,0\n1700003600000000,1,2,x,1.5,10,1700007199999000,15,3,5,7,0\nbad,row\n"
    with zipfile.ZipFile(tmp_path / "AAA-1h-2023-11.zip", "w") as z:
        z.writestr("AAA-1h-2023-11.csv", text)
        z.writestr("notes.txt", "no")
    got = klines.read_kline_zips(spark, str(tmp_path)).orderBy("open_time").collect()
    assert [(r.symbol, r.open_time, r.low) for r in got] == [("AAA", 1700000000000, 0.5), ("AAA", 1700003600000, None)]
    digest = hashlib.sha256((tmp_path / "AAA-1h-2023-11.zip").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("AAA-1h-2023-11.zip", digest.upper())], "name string, sha256 string")
    assert [r.ok for r in klines.verify_checksums(spark, str(tmp_path), manifest).collect()] == [True]


def test_json_lines_and_states(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": 3}\n{"a": 3')
    assert sorted(r.a for r in klines.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a long").collect()) == [1, 2]
    path = str(tmp_path / "state.json")
    assert klines.load_state(path, {}) == {}
    klines.save_state(path, {"nav": 1})
    klines.save_state(path, {"nav": 2})
    (tmp_path / "state.json").write_text('{"nav"')
    assert klines.load_state(path) == {"nav": 1}
    (tmp_path / "x.tmp").write_text("")
    assert klines.sweep_temporary(str(tmp_path), -1) == 1


def test_streamed_positions_equal_batch_and_survive_a_restart(spark, tmp_path):
    rows = bars(90)
    folder, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 3_600_000 // 30 == part], ROWS).coalesce(1).write.mode("append").parquet(folder)
        if part:  # the first two files together, then a restart from the checkpoint
            live.run_available(live.live_positions(live.replay_source(spark, folder)), sink, state)
    spark.createDataFrame(rows[:20], ROWS).coalesce(1).write.mode("append").parquet(folder)  # delivered again
    live.run_available(live.live_positions(live.replay_source(spark, folder)), sink, state)
    got = {(r.symbol, r.t): (round(r.factor, 9), r.position) for r in spark.read.parquet(sink).collect()}
    batch = signals.hysteresis(features.canonical_factor(spark.createDataFrame(rows, ROWS)))
    want = {(r.symbol, r.t): (round(r.factor, 9), r.position) for r in batch.collect()}
    assert spark.read.parquet(sink).count() == len(rows) and got == want


def test_streamed_periods_and_duplicates(spark, tmp_path):
    rows = [("u", "a", (i + 6) * 600_000, float(i), float(i), float(i), float(i), 1.0) for i in range(24)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows + rows[:5], ROWS).coalesce(1).write.parquet(folder)
    stream = live.replay_source(spark, folder)
    timed = stream.withColumn("at", F.timestamp_millis("t"))
    live.run_available(live.once_within(timed, ["universe_id", "symbol", "t"], "at"), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 24
    live.run_available(live.closed_periods(stream), str(tmp_path / "closed"), str(tmp_path / "c2"))
    closed = spark.read.parquet(str(tmp_path / "closed")).orderBy("t").collect()
    assert [(r.open, r.close) for r in closed][:3] == [(0.0, 5.0), (6.0, 11.0), (12.0, 17.0)]
    stale = live.staleness(spark.createDataFrame(rows, ROWS), 24 * 3_600_000).first()
    assert stale.feed == "stale"


BASE = 19_000 * 86_400_000  # instants this late are in ms by their size


def test_alignment(spark):
    random.seed(0)
    raw = [(i, "u", s, BASE + t * 3_600_000 + 5, None, None, None, float(i + 1), None, None) for i, (s, t) in enumerate([("a", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 2)])]
    df = spark.createDataFrame(raw, "bar_id long, universe_id string, symbol string, timestamp_open long, open double, high double, low double, close double, volume double, quote_volume double")
    u = spark.createDataFrame([("u", "1h", 2)], "universe_id string, frequency string, asset_count long")
    got = sorted((r.symbol, (r.t - BASE) // 3_600_000, r.close) for r in align.aligned_bars(df, u).collect())
    assert got == [("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 3.0), ("b", 2, 7.0)]
    assert align.aligned_bars(df, u, least=3).count() == 0
    assert {c for c in align.wide(align.aligned_bars(df, u), ["a", "b"]).columns} == {"universe_id", "t", "a", "b"}


def test_lineage_is_cut_reliably(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()
