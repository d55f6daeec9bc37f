"""Cases in which operators once did less than the whole job."""

import datetime as dt

import numpy as np
import pytest

from barlattice.operators import anomalies
from barlattice.plans import reports, research

HOUR = 3_600_000
BASE = 19_000 * 24 * HOUR


def write_bars(spark, folder, rows, assets):
    """``rows``: (universe, symbol, hour, close, state); ``assets``: those of each universe."""
    at = dt.datetime(2024, 1, 1)
    bars = [(i, u, s, BASE + k * HOUR, BASE + (k + 1) * HOUR - 1, c, c, c, c, 5.0, 5.0 * c, 1, state, at, "b") for i, (u, s, k, c, state) in enumerate(rows)]
    spark.createDataFrame(
        bars,
        "bar_id long, universe_id string, symbol string, timestamp_open long, timestamp_close long, open double, high double, low double, close double, volume double, quote_volume double, trades_count long, state string, received_at timestamp, batch_id string",
    ).write.parquet(f"{folder}/bars.parquet")
    spark.createDataFrame([(u, len(a), a, "1h") for u, a in assets.items()], "universe_id string, asset_count long, assets array<string>, frequency string").write.parquet(f"{folder}/universes.parquet")
    return folder


def test_spot_simulation_uses_recorded_states(spark, tmp_path):
    def state(s, k):
        return "DELISTED" if s == "a" and k >= 40 else "NO_TRADES" if s == "b" and 25 <= k < 27 else "NORMAL"

    rows = [("u", s, k, 100 * 1.02**k, state(s, k)) for s in "ab" for k in range(43)]
    got = {(r.t - BASE) // HOUR: r for r in research.spot_simulation(spark, write_bars(spark, str(tmp_path), rows, {"u": ["a", "b"]})).collect()}
    assert got[24].cash == 100_000 and got[26].cash == pytest.approx(50_000, rel=0.03)  # b waits for two bars without trades
    assert got[27].cash < 3_000
    sold = got[40].cash - got[39].cash
    assert sold == pytest.approx(got[39].nav * 1.02 / 2 * 0.98, rel=0.02)  # a at this bar's close less 200 bps
    assert got[40].nav == pytest.approx(got[39].cash + (got[39].nav - got[39].cash) * 1.02 - sold / 0.98 * 0.02, rel=1e-4)


def test_wide_closes_of_all_assets(spark, tmp_path):
    rows = [("u", s, k, 10.0 * i + k, "NORMAL") for i, s in enumerate("dbcae", 1) for k in range(2)] + [("v", "z", 0, 7.0, "NORMAL")]
    got = {(r.universe_id, (r.t - BASE) // HOUR): (r.symbols, r.closes) for r in reports.QUERIES["wide_closes_all"](spark, write_bars(spark, str(tmp_path), rows, {"u": list("abcde"), "v": ["z"]})).collect()}
    assert got == {("u", k): (list("abcde"), [40.0 + k, 20.0 + k, 30.0 + k, 10.0 + k, 50.0 + k]) for k in range(2)} | {("v", 0): (["z"], [7.0])}


def test_effective_trials_of_each_universe(spark, tmp_path):
    wave = [100 + 10 * ((k * 7) % 5) for k in range(30)]
    rows = [(u, s, k, float(c), "NORMAL") for u in ("u", "v") for s in "ab" for k, c in enumerate(wave)] + [("w", "a", k, float(c), "NORMAL") for k, c in enumerate(wave)]
    got = research.QUERIES["effective_trials_by_universe"](spark, write_bars(spark, str(tmp_path), rows, {"u": ["a", "b"], "v": ["a", "b"], "w": ["a"]})).collect()
    assert {r.universe_id: (r.k, r.k_rank) for r in got} == {"u": (2, 1.0), "v": (2, 1.0), "w": (1, 1.0)}  # equal series are one trial


def test_flags_beside_an_outage_at_a_shard_end(spark):
    shard = 256
    start = -(-BASE // (shard * HOUR)) * shard * HOUR
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 4 * shard)))
    volume = rng.uniform(4, 6, 4 * shard)
    dark = lambda k: 2 * shard - 40 <= k < 2 * shard or 3 * shard <= k < 3 * shard + 300
    idle = lambda k: shard - 30 <= k < shard
    close[2 * shard] *= 3  # the first priced bar after the outage
    close[3 * shard - 1] *= 3  # the last one before the other
    volume[shard] *= 30  # the first traded bar after idle ones
    volume[shard + 1 : shard + 13] *= 30 ** (np.arange(12) % 2)
    rows = [("u", "a", start + k * HOUR, *([None] * 4 if dark(k) else [float(c), float(c * 1.001), float(c * 0.999), 0.0 if idle(k) else float(v)])) for k, (c, v) in enumerate(zip(close, volume)) if k < 3 * shard + 320 and k < 4 * shard]
    rows += [("u", "a", start + k * HOUR, 100.0 + k % 3, 110.0, 90.0, 5.0) for k in range(4 * shard + 60, 4 * shard + 90)]
    df = spark.createDataFrame(rows, "universe_id string, symbol string, timestamp_open long, close double, high double, low double, volume double")
    got = [{(r.open_ms - start) // HOUR: r.flag for r in anomalies.judged_bars(df, n * HOUR).filter("flag IS NOT NULL").collect()} for n in (shard, 64, 1 << 20)]
    assert got[2][2 * shard] == got[2][3 * shard - 1] == "spike"
    assert got[0] == got[2] and got[1] == got[2]
