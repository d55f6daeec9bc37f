"""Null tests by key, calibration, guarded bars, a stream on a clock."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.operators import ledger, nulls
from barlattice.plans import research
from barlattice.sources.tables import bars_until
from barlattice.streaming import live


def test_null_tests_of_keys_do_not_depend_on_partitions_or_each_other(spark):
    rng = np.random.default_rng(0)
    rows = [("up", i, float(x)) for i, x in enumerate(rng.normal(0.05, 0.1, 200))] + [("flat", i, float(x)) for i, x in enumerate(rng.normal(-0.02, 0.1, 200))] + [("one", 0, 0.3), ("one", 1, None)]
    df = spark.createDataFrame(rows, "k string, t long, net double")
    a = {r.k: r for r in nulls.bootstrap_tests(df.repartition(5), "k", replicates=200, length=10, chunk=33).collect()}
    b = {r.k: r for r in nulls.bootstrap_tests(df.filter("k = 'up'"), "k", replicates=200, length=10, chunk=200).collect()}
    assert all(a["up"][c] == pytest.approx(b["up"][c], abs=1e-15) for c in ("observed", "p_value", "null_mean", "null_sd", "low", "high"))
    assert a["up"].p_value < 0.05 < 0.3 < a["flat"].p_value
    assert a["one"].n == 1 and a["one"].p_value == pytest.approx(1 / 201) and a["up"].low < 0 < a["up"].high and a["up"].null_mean == pytest.approx(0, abs=0.01)
    alone = nulls.bootstrap_test(spark, [r[2] for r in rows if r[0] == "up"], 200, 10).first()
    assert alone.p_value == a["up"].p_value
    sharpe = {r.k: r for r in nulls.bootstrap_tests(df, "k", replicates=50, length=10, statistic=nulls.sharpe_statistic).collect()}
    r = np.array([x[2] for x in rows if x[0] == "up"])
    assert sharpe["up"].observed == pytest.approx(r.mean() / r.std(ddof=1)) and sharpe["one"].observed == 0
    assert nulls.bootstrap_tests(df.limit(0), "k").count() == 0


def test_calibration_by_hand(spark):
    rows = [("a", 0.9, True), ("a", 0.4, True), ("a", 0.5, False), ("a", None, True), ("a", 0.2, None), ("b", None, None)]
    got = {r.k: r for r in ledger.calibration(spark.createDataFrame(rows, "k string, p double, o boolean"), ["k"], "p", "o").collect()}
    assert got["a"].n == 3 and got["a"].mae == pytest.approx((0.1 + 0.6 + 0.5) / 3) and got["a"].accuracy == pytest.approx(1 / 3)
    assert got["b"].n == 0 and got["b"].mae is None


def test_bars_beyond_the_allowed_window_are_not_handed_on(spark, tiny):
    assert bars_until(spark, tiny, 4_000_000_000_000, "bar_id").columns == ["bar_id"]
    with pytest.raises(PermissionError):
        bars_until(spark, tiny, 1_600_000_000_000)


def test_a_stream_on_a_clock(spark, tmp_path):
    folder, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    row = [("u", "a", 0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    spark.createDataFrame(row, live.BAR).coalesce(1).write.mode("append").parquet(folder)
    query = live.run_every(live.replay_source(spark, folder).withColumn("n", F.lit(1)), sink, state, seconds=1)
    try:
        query.processAllAvailable()
        spark.createDataFrame([(*row[0][:2], 1, *row[0][3:])], live.BAR).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.1)
        query.processAllAvailable()
        assert spark.read.parquet(sink).count() == 2
    finally:
        query.stop()


def test_resampled_panels_draw_the_same_instants_for_all_assets(spark):
    rows = [(u, s, 1000 + 7 * k, float(100 * i + k)) for u, n in (("u", 40), ("v", 9)) for i, s in enumerate("abc") for k in range(n)]
    df = spark.createDataFrame(rows, "universe_id string, symbol string, t long, ret double")
    got = [sorted(map(tuple, nulls.resampled_panel(d, "ret", 5.0, 3).select("universe_id", "k", "symbol", "t", "value").collect())) for d in (df.repartition(1), df.repartition(6))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    value = {r[:3]: r[3] for r in rows}
    assert all(v == value[u, s, t] for u, _, s, t, v in got[0])  # each row is one of the universe's own at that instant
    drawn = {}
    for u, k, _, t, _ in got[0]:
        drawn.setdefault((u, k), set()).add(t)
    assert all(len(ts) == 1 for ts in drawn.values()) and len(drawn) == 49
    path = [next(iter(drawn["u", k])) for k in range(40)]
    assert sum(b - a == 7 for a, b in zip(path, path[1:])) > 20 and len(set(path)) < 40  # blocks go on, some instants come again


def test_clusters_of_a_universe_by_hand(spark):
    series = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "c"), ("v", "x"), ("w", "p"), ("w", "q")], "universe_id string, series string")
    pairs = spark.createDataFrame([("u", "a", "b", 0.99), ("u", "a", "c", 0.2), ("u", "b", "c", 0.2), ("w", "p", "q", 0.9499)], "universe_id string, a string, b string, rho double")
    got = {r.universe_id: r for r in research._clusters(pairs, series).collect()}
    assert {u: (r.k, r.k_cluster) for u, r in got.items()} == {"u": (3, 2.0), "v": (1, 1.0), "w": (2, 2.0)}
    assert got["u"].k_rank == pytest.approx(9 / (3 + 2 * (0.99**2 + 2 * 0.2**2))) and got["u"].k_rho_avg == pytest.approx(3 / (1 + 2 * (0.99 + 0.4) / 3))
