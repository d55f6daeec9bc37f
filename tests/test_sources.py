"""Archives by their header, feeds through a transport, exchange filters, ledgers, small records."""

import datetime as dt
import json
import zipfile

import pytest

from barlattice.operators import align, ledger
from barlattice.sources import feeds, klines, records


def archive(folder, name, members):
    with zipfile.ZipFile(folder / name, "w") as z:
        for member, text in members:
            z.writestr(member, text)


def test_archives_by_their_header(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    archive(good, "A.zip", [("a.csv", " Open_Time ,close,HIGH,low,open,volume,more\n1700000000000,1.5,2,1,1,7,x\n1700000000000,1.4,2,1,1,7,x\n1700003600,2,x,1,1,7,x\nbad,1,1,1,1,1,1\n"), ("b.csv", "no")])
    archive(good, "B.zip", [("b.csv", "1700000000000,1,2,0.5,1.5,10,1700003599999,15,3,5,7,0\n")])
    got = {(r.file[-5:], r.open_time): (r.close, r.high) for r in klines.read_required_columns(spark, str(good)).collect()}
    assert got == {("A.zip", 1700000000000): (1.4, 2.0), ("A.zip", 1700003600000): (2.0, None), ("B.zip", 1700000000000): (1.5, 2.0)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        klines.read_required_columns(spark, str(good), strict=True).collect()
    bad = tmp_path / "bad"
    bad.mkdir()
    archive(bad, "C.zip", [("c.csv", "open_time,open,high,low,close\n1,1,1,1,1\n")])
    with pytest.raises(Exception, match="lacks volume"):
        klines.read_required_columns(spark, str(bad)).collect()


def test_feeds_try_again(spark):
    tries, waits = [], []

    def transport(path, parameters):
        tries.append((path, parameters))
        if len(tries) < 3:
            raise OSError("down")
        return [[1700000000000, "1", "2", "0.5", "1.5", "10", 1700003599999, "15", 3, "5", "7", "0"]] if path == "klines" else {"price": "2.5"}

    row = feeds.recent_klines(spark, transport, "A", sleep=waits.append).first()
    assert (row.symbol, row.close, row.trades_count) == ("A", 1.5, 3) and waits == [1.0, 2.0] and "startTime" not in tries[0][1]
    assert feeds.last_price(transport, "A") == 2.5

    def down(path, parameters):
        raise OSError("down")

    with pytest.raises(feeds.FeedError):
        feeds.last_price(down, "A", sleep=waits.append)


def test_exchange_filters(spark, tmp_path):
    entry = {"symbol": "A", "filters": [{"filterType": "LOT_SIZE", "stepSize": "0.1", "minQty": "0.2"}, {"filterType": "NOTIONAL", "minNotional": "5"}, {"filterType": "PRICE_FILTER", "tickSize": "0.01"}]}
    others = [{"symbol": "B", "filters": [{"filterType": "LOT_SIZE", "stepSize": "1"}]}, {"symbol": "C", "filters": [{"filterType": "OTHER"}]}]
    (tmp_path / "x.json").write_text(json.dumps({"symbols": [entry, *others]}, indent=1))
    live = feeds.exchange_filters(spark, str(tmp_path / "x.json"))
    got = {r.symbol: (r.step_size, r.min_qty, r.min_notional, r.tick_size) for r in live.collect()}
    assert got == {"A": (0.1, 0.2, 5.0, 0.01), "B": (1.0, 1.0, 0.0, 0.0)}
    default = spark.createDataFrame([("A", 9.0, 9.0, 9.0, 9.0), ("D", 2.0, 2.0, 2.0, 2.0)], live.schema)
    assert {r.symbol: r.step_size for r in feeds.with_fallback(["A", "D", "Z"], live, default).collect()} == {"A": 0.1, "D": 2.0}


def test_ledgers_of_all_schemas(spark, tmp_path):
    old = {"trial_index": 1, "proposal": {"universe_id": "u", "symbols": ["b", "a"]}, "backtest": {"net_returns": [0.1, -0.1, 0.2]}, "annualized_sharpe": 93.59487}
    new = {"experiment_id": "e", "trial_index": 2, "universe_id": "other", "symbols": ["a"], "variant_name": "v", "period_sharpe": 0.5, "cumulative_global_trials": 77, "backtest": {"net_returns": [0.0, 0.0]}}
    bare = {"trial_index": 3}
    (tmp_path / "ledger_a.jsonl").write_text("\n".join([json.dumps(old), "", json.dumps(bare), '{"trial_']))
    (tmp_path / "ledger_b.jsonl").write_text(json.dumps(new) + "\n" + json.dumps({**new, "trial_index": 4, "backtest": {"net_returns": [1.0, 2.0]}, "symbols": ["a", "b", "c"]}))
    rows = ledger.ledger_rows(spark, f"{tmp_path}/ledger_*.jsonl")
    got = {r.trial_index: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1].symbols == ["b", "a"] and got[1].universe_id == "u" and got[1].cumulative_global_trials == 1
    assert got[3].mechanism == "UNKNOWN" and got[3].cumulative_global_trials == 2 and got[2].cumulative_global_trials == 77
    assert got[1].period_sharpe == pytest.approx(1.0, rel=1e-5) and got[2].period_sharpe == 0.5
    universes = spark.createDataFrame([("U", ["a", "b"]), ("V", ["a", "b", "c", "d"])], "universe_id string, assets array<string>")
    found = {(r.universe_id, r.trial_index): (r.ledger, r.n_obs, r.subset_match, r.symbols) for r in ledger.stored_returns(rows, universes).collect()}
    assert found == {("U", 1): ("ledger_a.jsonl", 3, False, ["a", "b"]), ("V", 1): ("ledger_a.jsonl", 3, True, ["a", "b"]), ("V", 4): ("ledger_b.jsonl", 2, True, ["a", "b", "c"])}
    assert {(r.universe_id, r.trial_index) for r in ledger.stored_returns(rows, universes, subsets=False).collect()} == {("U", 1)}
    foot = ledger.basket_footprint(rows).collect()
    assert [(r.asset_key, r.trials, r.with_returns, r.labels, r.ledgers) for r in foot] == [(None, 1, 0, 0, 1), ("a", 1, 1, 1, 1), ("a,b", 1, 1, 1, 1), ("a,b,c", 1, 1, 1, 1)]


def test_sets_within_sets(spark):
    def sets(name, rows):
        return spark.createDataFrame(rows, f"{name} string, set array<string>")

    got = {(r.inner_id, r.outer_id): r.proper for r in ledger.contained(sets("inner_id", [("1", ["a"]), ("2", ["a", "b"]), ("3", ["z"]), ("4", []), ("5", ["a", "z"])]), sets("outer_id", [("x", ["a", "b"]), ("y", ["a"]), ("e", [])])).collect()}
    assert got == {("1", "x"): True, ("1", "y"): False, ("2", "x"): False}
    catalog = spark.createDataFrame([("p", ["b", "a"]), ("p", ["a", "b"]), ("q", ["a"]), ("q", ["b"])], "universe_id string, assets array<string>")
    assert align.assets_of(catalog, "p") == ["a", "b"]
    for label, error in (("q", ValueError), ("none", KeyError)):
        with pytest.raises(error):
            align.assets_of(catalog, label)


def test_running_numbers(spark):
    at = dt.datetime(2024, 1, 1, 23)
    rows = [(i, "f" if i % 3 else "g", at + dt.timedelta(hours=(i * 7) % 40)) for i in range(30)]
    got = ledger.recorded(spark.createDataFrame(rows, "id long, family string, at timestamp"), "family", "at", "id", ["id"]).collect()
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert {r.id: r.global_trial for r in got} == {r[0]: k for k, r in enumerate(order, 1)}
    assert len({r.experiment_id for r in got}) == 30 and all(r.experiment_id.startswith("exp_") and len(r.experiment_id) == 20 for r in got)


def test_small_records(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, ["a"]), ("v", 2, None)], "universe_id string, n int, assets array<string>")
    records.write_catalog(rows, str(tmp_path / "catalog.json"), "universe_id")
    assert records.read_record(str(tmp_path / "catalog.json")) == {"u": {"n": 1, "assets": ["a"]}, "v": {"n": 2, "assets": None}}
    records.write_summary(str(tmp_path / "summary.json"), per_universe=rows, total=3)
    assert records.read_record(str(tmp_path / "summary.json"))["per_universe"][1]["n"] == 2
    names = ["catalog.json", "gone.json"]
    plan = records.archive_record(str(tmp_path), names, str(tmp_path / "old"), "test", dry_run=True)
    assert records.leftovers(str(tmp_path), names) == ["catalog.json"] and plan
    moved = records.archive_record(str(tmp_path), names, str(tmp_path / "old"), "test")
    assert records.leftovers(str(tmp_path), names) == [] and records.read_record(f"{moved}/manifest.json")["absent"] == ["gone.json"]
    lock = str(tmp_path / "lock")
    with records.SingleWriter(lock):
        with pytest.raises(RuntimeError):
            records.SingleWriter(lock).__enter__()
    (tmp_path / "lock").write_text("999999999")  # a writer that died
    with records.SingleWriter(lock):
        pass
    vault = records.Vault(rows, 1)
    assert vault.evaluate(lambda df: df.count(), "e1") == 2 and vault.log[0]["remaining"] == 0
    with pytest.raises(PermissionError):
        vault.evaluate(lambda df: 0, "e2")
    spent = records.Vault(rows, 1)
    with pytest.raises(ZeroDivisionError):
        spent.evaluate(lambda df: 1 / 0, "e3")
    assert spent.remaining == 0
    klines.append_json_lines(rows, str(tmp_path / "log"))
    klines.append_json_lines(rows, str(tmp_path / "log"))
    assert klines.read_json_lines(spark, str(tmp_path / "log"), "universe_id string, n int").count() == 4
    klines.write_universes(rows, str(tmp_path / "universes"))
    assert (tmp_path / "universes" / "universe_id=u").exists()
    assert [r.n for r in klines.last_rows(rows, "n", 1).collect()] == [2]
