"""The fitted model of problem 7: where it differs from thresholds, what it learns of a source, and shards of any length."""

import numpy as np

from barlattice.operators import anomalies

HOUR = 3_600_000
BASE = 19_000 * 24 * HOUR
SCHEMA = "universe_id string, symbol string, timestamp_open long, close double, high double, low double, volume double"


def quiet(n, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    return close, rng.uniform(8, 12, n)


def frame(spark, close, volume, symbol="a"):
    rows = [("u", symbol, BASE + k * HOUR, float(c), float(c * 1.001), float(c * 0.999), float(v)) for k, (c, v) in enumerate(zip(close, volume))]
    return spark.createDataFrame(rows, SCHEMA)


def flags(df, *options):
    return {(r.open_ms - BASE) // HOUR: r.flag for r in anomalies.judged_bars(df, *options).filter("flag IS NOT NULL").collect()}


def test_a_busy_spell_is_no_spike_though_each_bar_passes_the_threshold(spark):
    close, volume = quiet(900)
    rng = np.random.default_rng(1)
    volume[300:309] *= rng.uniform(21, 25, 9)  # nine busy bars: by a threshold of 20 each would be a case
    volume[500:502] *= 60.0
    volume[700] *= 60.0
    assert flags(frame(spark, close, volume)) == {500: "spike", 501: "spike", 700: "spike"}


def test_a_source_is_fitted_to_its_own_bars(spark):
    n = 2000
    calm, wild = quiet(n), quiet(n, 2)
    rng = np.random.default_rng(3)
    wild[1][:] = 10 * np.exp(rng.normal(0, 0.9, n))  # a source whose volumes always differ
    at = slice(100, None)
    sums = []
    for close, volume in (calm, wild):
        score, ratio, repeat, broken, _ = anomalies.observe(np.zeros(n, int), close, close * 1.001, close * 0.999, volume, np.array([0.0014]).repeat(n))
        start = anomalies.Parameters(np.zeros((1, anomalies.Parameters.SUMS)))
        p, moves = anomalies.posteriors(np.zeros(n, int), start.emissions(np.zeros(n, int), score, ratio, repeat, broken), start.transitions)
        up = np.maximum(ratio, 0)
        row = [p[:, s] @ x for s in (anomalies.CALM, anomalies.BUSY) for x in (np.ones(n), score**2, up**2)]
        row += [(p[:, 0] + p[:, 1]) @ repeat, p[:, anomalies.STUCK].sum(), p[:, anomalies.STUCK] @ repeat, n]
        sums.append(np.concatenate([moves[0].ravel(), row]))
        assert p[at].shape
    fitted = anomalies.Parameters(np.array(sums))
    assert fitted.spread[1, anomalies.CALM, 1] > 1.3 * fitted.spread[0, anomalies.CALM, 1]
    assert fitted.transitions[1, anomalies.CALM, anomalies.BUSY] > fitted.transitions[0, anomalies.CALM, anomalies.BUSY]
    assert np.allclose(fitted.transitions.sum(axis=2), 1) and fitted.transitions[0, anomalies.SPIKE, anomalies.SPIKE] == 0


def test_flags_and_posteriors_do_not_depend_on_the_shard_length(spark):
    close, volume = quiet(1200, 5)
    rng = np.random.default_rng(6)
    idle = rng.random(1200) < 0.3
    for edge in range(64, 1200, 64):  # cases and idle bars around every edge of the smaller shards
        idle[edge - 20 : edge] = True
        kind = edge // 64 % 4
        if kind == 0:
            volume[edge] *= 80
        elif kind == 1:
            close[edge - 1 : edge + 1] *= 1.3
        elif kind == 2:
            close[edge - 3 : edge + 4] = close[edge - 3]
        else:
            close[edge] *= 0.6
    volume[idle] = 0.0
    volume[[e for e in range(64, 1200, 64)]] = np.maximum(volume[[e for e in range(64, 1200, 64)]], 10.0)
    df = frame(spark, close, volume).cache()
    got = [{(r.open_ms - BASE) // HOUR: (r.flag, r.p_spike) for r in anomalies.judged_bars(df, n * HOUR).collect()} for n in (64, 300, 1 << 20)]
    assert sum(f is not None for f, _ in got[2].values()) > 10
    for other in got[:2]:
        assert {k: f for k, (f, _) in other.items()} == {k: f for k, (f, _) in got[2].items()}
        assert max(abs(p - got[2][k][1]) for k, (_, p) in other.items()) < 0.05


def test_a_stuck_run_needs_five_repeats_and_a_probable_state(spark):
    close, volume = quiet(600, 7)
    close[100:105], close[200:206], close[300:340] = close[100], close[200], close[300]
    want = {k: "stuck" for a, b in ((201, 206), (301, 340)) for k in range(a, b)}
    assert flags(frame(spark, close, volume)) == want


def test_a_source_that_is_frozen_most_of_the_time_and_one_that_never_moves(spark):
    close, volume = quiet(400, 8)
    assert flags(frame(spark, np.full(400, 5.0), volume)) == {k: "stuck" for k in range(1, 400)}
    close[np.arange(400) % 2 == 1] = close[np.arange(400) % 2 == 0]  # every second bar repeats: no run of five
    assert flags(frame(spark, close, volume)) == {}
