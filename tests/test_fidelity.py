"""Conventions that were once departed from, on cases where the departure shows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.functions import stats
from barlattice.operators import features, ledger, lint, metrics, nulls, portfolio

HOUR = 3_600_000


def backtest_rows(spark, weights, ret=0.01):
    rows = [("u", "a", k * HOUR, float(w), ret, 0.0005) for k, w in enumerate(weights)]
    return spark.createDataFrame(rows, "universe_id string, symbol string, t long, weight double, ret double, slippage double")


def test_small_changes_cost_but_are_no_trades(spark):
    weights = [0.0] * 25 + [1e-5, 1e-5, 1e-5 + 5e-7, 0.5, 0.5]
    got = {r.t // HOUR: r for r in portfolio.backtest(backtest_rows(spark, weights), fee=0.001).collect()}
    assert not got[25].traded and got[25].cost_bps == pytest.approx(15.0)  # above 1e-6, not above 1e-4
    assert got[27].cost_bps == 10.0 and got[28].traded and got[26].cost_bps == 10.0


def test_a_wiped_out_account_stays_wiped_out(spark):
    r = [0.1, -1.0, 1.0, 1.0, 0.5]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(r)], "universe_id string, t long, net double")
    got = metrics.drawdowns(df, "universe_id").first()
    assert got.equity == 1e-12 and got.nav_dd == pytest.approx(stats.max_drawdown(r)) and got.cagr == pytest.approx(-1.0)
    path = portfolio.equity(df).orderBy("t").collect()
    assert [x.equity for x in path][1:] == [1e-12] * 4


def test_orders_of_a_bar_are_sized_by_the_value_before_it(spark):
    n = 27
    rows = [("u", s, k * HOUR, 10.0, 0.0, 0.4 if k >= 24 else 0.0, 0.0) for s in "ab" for k in range(n)]
    df = spark.createDataFrame(rows, "universe_id string, symbol string, t long, close double, ret double, weight double, slippage double")
    lots = spark.createDataFrame([("a", 0.001, 0.0, 0.0), ("b", 0.001, 0.0, 0.0)], "symbol string, step_size double, min_qty double, min_notional double")
    got = {r.t // HOUR: r for r in portfolio.paper_simulation(df, lots, 1000.0, 0.01).collect()}
    assert got[24].turnover == pytest.approx(0.8) and got[24].nav == pytest.approx(1000 - 800 * 0.01) and got[24].cost_bps == pytest.approx(100.0)


def spot(spark, states, weights, closes=None, **options):
    closes = closes or [10.0] * len(states)
    rows = [("u", "a", k * HOUR, c, c, s, w) for k, (s, w, c) in enumerate(zip(states, weights, closes))]
    df = spark.createDataFrame(rows, "universe_id string, symbol string, t long, open double, close double, state string, weight double")
    return portfolio.spot_simulation(df, 1000.0, 0.0, 0.0, **options).orderBy("t").collect()


def test_spot_orders_wait_only_without_trades(spark):
    normal = ["NORMAL"] * 8
    assert spot(spark, normal, [1.0] * 8)[1].cash == pytest.approx(0)
    outage = spot(spark, ["NORMAL", "EXCHANGE_OUTAGE", *["NORMAL"] * 6], [1.0] * 8)
    assert outage[1].cash == pytest.approx(0) and outage[1].deferred == 0  # a bar with a price trades
    waits = spot(spark, ["NORMAL", "NO_TRADES", "NO_TRADES", *["NORMAL"] * 5], [1.0] * 8)
    assert [r.deferred for r in waits[:4]] == [0, 1, 1, 0] and waits[3].cash == pytest.approx(0)
    drops = spot(spark, ["NORMAL", *["NO_TRADES"] * 5, "NORMAL", "NORMAL"], [1.0, *[None] * 7])
    assert [r.deferred for r in drops] == [0, 1, 1, 1, 0, 0, 0, 0] and drops[-1].cash == 1000
    gone = spot(spark, ["NORMAL", "NORMAL", "DELISTED"], [1.0] * 3, [10.0, 10.0, 8.0])
    assert gone[2].cash == pytest.approx(100 * 8 * 0.98)
    for bad in ([-0.1], [1.2]):
        with pytest.raises(Exception, match="at most 1"):
            spot(spark, ["NORMAL"], bad)


ROWS = "universe_id string, symbol string, t long, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_volume double"


def market(spark, universes=("u",)):
    rng = np.random.default_rng(1)
    rows = []
    for u in universes:
        for s in "ab":
            close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 64)))
            rows += [(u, s, k * HOUR, c, c * 1.01, c * 0.99, c, float(k), float(k) * 2, float(k) / 2) for k, c in enumerate(map(float, close))]
    return spark.createDataFrame(rows, ROWS)


def test_null_markets_keep_the_first_close_and_all_volumes(spark):
    df = market(spark)
    first = {r.symbol: r.close for r in df.filter("t = 0").collect()}
    for made in (nulls.block_bootstrap(df), nulls.phase_randomised(df)):
        assert {r.symbol: r.close for r in made.filter("t = 0").collect()} == pytest.approx(first)
        assert made.filter("quote_volume <> 2 * volume OR taker_buy_volume <> volume / 2").count() == 0  # volumes go together


def test_blinded_markets(spark):
    df = market(spark, ("p", "q", "r"))
    bars, key = nulls.blinded_markets(df, bootstrapped=2, seed=5)
    labels = {r.label: r for r in key.collect()}
    assert sorted(labels) == [f"UNIV_{i:02d}" for i in range(1, 7)] and sorted(k.kind for k in labels.values()) == ["NULL"] * 3 + ["REAL"] * 3
    assert {k.parent: k.method for k in labels.values() if k.kind == "NULL"} == {"p": "bootstrap", "q": "bootstrap", "r": "phase"}
    assert bars.columns == df.columns and {r.universe_id: r["count"] for r in bars.groupBy("universe_id").count().collect()} == dict.fromkeys(labels, 128)
    real = next(k for k in labels.values() if k.kind == "REAL" and k.parent == "q")
    same = bars.filter(F.col("universe_id") == real.label).select("symbol", "t", "close").exceptAll(df.filter("universe_id = 'q'").select("symbol", "t", "close"))
    assert same.count() == 0
    assert {r.label: r.parent for r in nulls.blinded_markets(df, 2, seed=5)[1].collect()} == {k: v.parent for k, v in labels.items()}


def test_lint_knows_defaults_and_forward_places():
    def found(body):
        return " ".join(lint.check_code(f"import scipy.stats\ndef f(df, i=3):\n    return {body}"))

    assert "diff over 1" in found("df.close.diff()") and "pct_change over 1" in found("df.close.pct_change()")
    assert "ewm over 2" in found("df.close.ewm(halflife=2).mean()") and found("df.close.ewm(alpha=0.5).mean()") == ""
    assert "look-ahead by iloc" in found("df.close.iloc[i + 1]") and "look-ahead by loc" in found("df.loc[i + 2, 'close']") and found("df.close.iloc[i - 1]") == ""
    assert found("df.close.diff(24) + df.close.rolling(window=48).mean()") == ""
    assert lint.check_code("def f(df):\n    return df.close.shift(-1)", control=True) == []


def test_peers_in_closed_form(spark):
    rng = np.random.default_rng(2)
    level = {s: 10 ** rng.uniform(-2, 3, 5) for s in "abcd"}
    rows = [("u", s, k, float(x)) for s, xs in level.items() for k, x in enumerate(xs)] + [("v", "a", 0, 3.0), ("w", "a", 0, 3.0), ("w", "b", 0, 5.0)]
    got = {(r.universe_id, r.symbol, r.t): (r.peer, r.dispersion) for r in features.peer_indices(spark.createDataFrame(rows, "universe_id string, symbol string, t long, close double")).collect()}
    for s in "abcd":
        for k in range(5):
            others = [level[o][k] / level[o][0] for o in "abcd" if o != s]
            assert got["u", s, k] == (pytest.approx(np.mean(others)), pytest.approx(np.std(others), abs=1e-9))
    assert got["v", "a", 0] == (1.0, 0.0) and got["w", "a", 0][1] == 0.0


def test_deflated_ratios_by_method():
    ratios = [0.02, -0.01, 0.05, 0.0]
    by = {m: stats.deflated_sharpe_by(m, 0.05, 1000, 0.1, 4.0, 2, ratios, 0.03) for m in stats.VARIANCES}
    assert by["empirical"]["trials"] == 4 and by["empirical"]["deviation"] == pytest.approx(np.std(ratios, ddof=1))
    assert by["null"]["deviation"] == pytest.approx(1 / math.sqrt(999)) and by["fixed"]["deviation"] == 0.03 and by["fixed"]["trials"] == 2
    assert stats.deflated_sharpe_by(None, 0.05, 1000, 0, 3, 2, ratios)["method"] == "empirical"
    assert stats.deflated_sharpe_by(None, 0.05, 1000, 0, 3, 2, (), 0.03)["method"] == "fixed" and stats.deflated_sharpe_by(None, 0.05, 1000, 0, 3, 2)["method"] == "null"
    one = stats.deflated_sharpe_by("fixed", 0.05, 1000, 0, 3, 1, (), 0.03)
    assert one["dsr"] == one["psr"]
    for bad in (("empirical", (0.1,)), ("fixed", ()), ("other", ())):
        with pytest.raises(ValueError):
            stats.deflated_sharpe_by(bad[0], 0.05, 1000, 0, 3, 2, bad[1])
    near = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1.0]])
    assert stats.effective_trials(near) == 2 and 1 < stats.effective_trials(near, "rho_avg") < 3 and stats.effective_trials(np.eye(1)) == 1
    assert stats.drawdown_by("cumsum", [0.1, -0.2, 0.05]) == pytest.approx(-0.2) and stats.drawdown_by("nav", []) == 0
    with pytest.raises(ValueError):
        stats.drawdown_by("x", [])


def test_a_near_copy_is_a_duplicate(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, 150)
    series = {"a": base, "b": base * 2 + rng.normal(0, 0.01, 150), "c": rng.normal(0, 1, 150), "d": np.zeros(150), "e": np.concatenate([base[:90], np.full(60, np.nan)])}
    rows = [("u", k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs) if x == x]
    pairs = metrics.duplicates(metrics.pair_correlations(spark.createDataFrame(rows, "universe_id string, k string, t long, net double"), "universe_id", "k"))
    assert {(r.a, r.b) for r in pairs.filter("duplicate").collect()} == {("a", "b")}  # a and e agree on too few
    assert pairs.filter("a = 'a' AND b = 'd'").first().rho == 0 and pairs.count() == 10


def test_hashes_of_code(spark):
    rows = [(1, "x = 1 + 2", 0.5), (2, "x=1+2  # same", 0.5), (3, "x = 1 + 2", 0.6), (4, "x = (", 0.5), (5, " x=\n( ", 0.5), (6, None, 0.5), (7, None, 0.5), (8, "x = 12", 0.5)]
    df = ledger.code_hashes(spark.createDataFrame(rows, "id long, code string, theta double"), "code", ["theta"])
    h = {r.id: r.code_hash for r in df.collect()}
    assert h[1] == h[2] != h[3] and h[4] == h[5] and h[6] is None and len({h[i] for i in (1, 3, 4, 8)}) == 4 and len(h[1]) == 16
    assert {(r.id, r["first"]) for r in ledger.repeated_hashes(df.withColumn("at", F.col("id")), "code_hash", "at", "id").collect()} == {(2, 1), (5, 4)}


def test_snapshots_and_weeks(spark):
    rows = [("u", s, k * HOUR, k + 1, 0.01 * (s == "A") * (k % 3 - 1), k % 2 == 0, 100.0 + k * (s == "A")) for s in "AB" for k in range(50)]
    sims = spark.createDataFrame(rows, "universe_id string, strategy string, t long, bar int, net double, traded boolean, nav double")
    snap = metrics.strategy_snapshots(sims, {"A": "a", "B": "b"}, 100.0)
    got = {r.day: r for r in snap.collect()}
    assert sorted(got) == [1, 2] and got[1].a_nav == 123.0 and got[2].a_trades == 24 and got[2].excess_vs_b == pytest.approx(0.47) and got[1].b_sharpe == 0
    weeks = metrics.weekly(snap, "universe_id", 3).orderBy("week").collect()
    assert [(r.week, r.day) for r in weeks] == [(1, 2), (2, 2), (3, 2)]
    navs = spark.createDataFrame([("k", i, v) for i, v in enumerate([100.0, 110.0, 99.0, 99.0])] + [("f", i, 5.0) for i in range(3)], "k string, t int, nav double")
    r = np.array([0.1, -0.1, 0.0])
    assert {x.k: x.sharpe for x in metrics.nav_sharpe(navs, "k", "nav").collect()} == {"k": pytest.approx(r.mean() / r.std() * math.sqrt(8760)), "f": 0.0}
    curve = metrics.cost_curve_by(lambda fee: sims.withColumn("net", F.col("net") - fee), "strategy", grid=(0.0, 10.0))
    assert curve.count() == 4


def test_effective_trials_of_all_series(spark):
    pairs = spark.createDataFrame([(0.5,), (0.1,), (None,)], "rho double")
    series = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    got = metrics.effective_trials(pairs, series).first()
    assert got.k_mean == pytest.approx(3 / (1 + 2 * 0.3)) and got.k_rank == pytest.approx(9 / (3 + 2 * 0.26))
    alone = metrics.effective_trials(pairs.limit(0), series.limit(1)).first()
    assert alone.k_mean == alone.k_rank == 1.0
