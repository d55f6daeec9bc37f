"""The core data problems on small fixtures: brute force, nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.operators import anomalies, dedupe, delivery_store, grid, instants, rejects, rolling

UTC = dt.timezone.utc
BAR = "bar_id long, universe_id string, symbol string, timestamp_open long, high double, low double, close double, volume double"
DAY = 86_400_000


BASE = 19_000 * DAY  # instants this late are in ms by their size


def bar(i, ms, close=1.0, volume=1.0, universe="u", symbol="a", high=None, low=None):
    return (i, universe, symbol, None if ms is None else ms + BASE, close if high is None else high, close if low is None else low, close, volume)


# -- rolling totals


def brute_rolling(rows):
    once = {}
    for i, u, s, t, _, _, c, v in rows:
        if t is not None:
            once[u, s, t] = (c, v)
    days = defaultdict(dict)
    for (u, s, t), (c, v) in once.items():
        d = days[u, s].setdefault(t // DAY, [0.0, []])
        d[0] += v if v and v > 0 else 0
        d[1] += [c] if c is not None else []
    out = {}
    for k, per in days.items():
        for d in range(min(per), max(per) + 1):
            week = [per[x] for x in range(d - 6, d + 1) if x in per]
            closes = [c for x in week for c in x[1]]
            out[(*k, d)] = (sum(x[0] for x in week), sum(closes) / len(closes) if closes else None)
    return out


def test_rolling_equals_brute_force(spark):
    random.seed(3)
    rows = []
    for i in range(600):
        s = random.choice("aab") if i % 3 else "hot"
        rows.append(bar(i, random.randrange(0, 90) * DAY + random.randrange(24) * 3_600_000, random.choice([None, 2.0, 3.5]), random.choice([None, -5.0, 0.0, 1.25, 7.5]), symbol=s))
    unique = {}
    for r in rows:
        unique[r[1], r[2], r[3]] = r
    rows = list(unique.values()) + list(unique.values())[:50]  # some bars again
    df = spark.createDataFrame(rows, BAR)
    got = {(r.universe_id, r.symbol, (r.day - dt.date(1970, 1, 1)).days): (r.volume_7d, r.close_avg_7d) for r in rolling.rolling_bars(df).collect()}
    want = brute_rolling(rows)
    assert got.keys() == want.keys()
    for k, (v, c) in want.items():
        assert got[k][0] == pytest.approx(v, abs=1e-9)
        assert got[k][1] == (None if c is None else pytest.approx(c))


def test_rolling_defined_cases(spark):
    nan = float("nan")
    rows = [bar(1, None), bar(2, 0, nan, nan), bar(3, 5 * DAY, None, None), bar(4, 0, 1.0, float("inf"), symbol=None)]
    df = spark.createDataFrame(rows, BAR).withColumn("day", F.lit("clash")).withColumn("__ms", F.lit(1))
    got = rolling.rolling_bars(df).collect()
    assert len(got) == 7 and all(r.volume_30d == 0 and (r.close_avg_7d is None or r.symbol is None) for r in got)
    assert rolling.rolling_bars(df.limit(0)).count() == 0
    assert rolling.rising_volume_days(df).count() == 0


# -- repeated deliveries

TICKET = "run_id string, trade_id long, received_at timestamp, delivery_id long"


def tickets(seed=1, n=3000):
    random.seed(seed)
    at = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = []
    for i in range(n):
        key = ("hot", 1) if i % 3 == 0 else (random.choice(["r", "s", None]), random.randrange(n // 3) if i % 7 else None)
        when = None if i % 50 == 0 else at + dt.timedelta(days=random.randrange(400), seconds=random.randrange(3))
        rows.append((*key, when, i))
    return rows


def brute_surplus(rows):
    best = {}
    far = dt.datetime(9999, 1, 1, tzinfo=UTC)
    for r in rows:
        k = (r[2] or far, r[3])
        if r[:2] not in best or k < best[r[:2]]:
            best[r[:2]] = k
    return sorted(r[3] for r in rows if (r[2] or far, r[3]) != best[r[:2]])


@pytest.mark.parametrize("segment_keys", [dedupe.SEGMENT_KEYS, 100])
def test_surplus_equals_brute_force(spark, segment_keys):
    rows = tickets()
    df = spark.createDataFrame(rows, TICKET).repartition(5).withColumn("bucket", F.lit(1)).withColumn("h", F.lit(None).cast("long"))
    got = dedupe.surplus_deliveries(df, ("run_id", "trade_id"), "received_at", "delivery_id", 86_400, segment_keys)
    assert sorted(r.delivery_id for r in got.collect()) == brute_surplus(rows)


def test_screen_lets_no_repeat_pass_and_few_others(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [("r", i, at + dt.timedelta(hours=i % 5000), i) for i in range(20_000)] + [("r", i * 100, at + dt.timedelta(days=90), 50_000 + i) for i in range(100)]
    stored = dedupe.stored_deliveries(spark.createDataFrame(rows, TICKET), ("run_id", "trade_id"), "received_at", "delivery_id", segment_keys=1 << 12)
    got = dedupe.possible_repeats(stored).unionByName(stored.filter("__sure")).collect()
    ids = {r.delivery_id for r in got}
    assert {i * 100 for i in range(100)} | {50_000 + i for i in range(100)} <= ids
    assert len(ids) < 1500


def test_one_copy_stays(spark):
    rows = [("r", 1, None, 5), ("r", 1, None, 4), (None, None, None, 1), (None, None, None, 2)]
    df = spark.createDataFrame(rows, TICKET)
    assert sorted(r.delivery_id for r in dedupe.kept_deliveries(df, ("run_id", "trade_id"), "received_at", "delivery_id").collect()) == [1, 4]
    assert dedupe.surplus_deliveries(df.limit(0), ("run_id", "trade_id"), "received_at", "delivery_id").count() == 0


# -- instants


def us(y, mo, d, h=0, mi=0, s=0, f=0):
    return int((dt.datetime(y, mo, d, h, mi, s, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + f


CASES = [
    ("2021-01-17T18:05:24+00:00", "America/New_York", us(2021, 1, 17, 18, 5, 24), "ok"),
    ("2021-01-31 16:42:46.163287-0500", None, us(2021, 1, 31, 21, 42, 46, 163287), "ok"),
    (" 2021-03-26T10:32:50 ", "Asia/Kolkata", us(2021, 3, 26, 5, 2, 50), "ok"),
    ("2021-01-28 07:11:37.5", None, us(2021, 1, 28, 7, 11, 37, 500000), "ok"),
    ("20210121T131800Z", "Asia/Tokyo", us(2021, 1, 21, 13, 18), "ok"),
    ("2021/02/03 04:29:07", "Asia/Tokyo", us(2021, 2, 2, 19, 29, 7), "ok"),
    ("01/21/2021 12:07:57 AM", "America/New_York", us(2021, 1, 21, 5, 7, 57), "ok"),
    ("01/21/2021 12:07:57 PM", "America/New_York", us(2021, 1, 21, 17, 7, 57), "ok"),
    ("28.02.2021 02:53:53", "Europe/Berlin", us(2021, 2, 28, 1, 53, 53), "ok"),
    ("01 Oct 2021 09:36:03", None, us(2021, 10, 1, 9, 36, 3), "ok"),
    ("Fri, 05 Nov 2021 00:13:02 GMT", "America/New_York", us(2021, 11, 5, 0, 13, 2), "ok"),
    ("2021-02-09 07:40:57 CST", "America/Chicago", us(2021, 2, 9, 13, 40, 57), "ok"),
    ("2021-03-29 15:09:39 IST", "Asia/Kolkata", us(2021, 3, 29, 9, 39, 39), "ok"),
    ("2021-02-07 22:27:18 -03", "America/Sao_Paulo", us(2021, 2, 8, 1, 27, 18), "ok"),
    ("1612190961.25", None, 1612190961250000, "ok"),
    ("1611235080862", "Asia/Tokyo", 1611235080862000, "ok"),
    ("1611167589000001", None, 1611167589000001, "ok"),
    ("1611167589000001999", None, 1611167589000001, "ok"),
    ("2021-11-07 01:30:00", "America/New_York", us(2021, 11, 7, 5, 30), "ambiguous"),
    ("2021-04-04 02:10:00", "Australia/Sydney", us(2021, 4, 3, 15, 10), "ambiguous"),
    ("2021-03-14 02:30:00", "America/New_York", None, "nonexistent"),
    ("2023-02-30T10:00:00Z", None, None, "unparsed"),
    ("2021-01-01 24:00:00", None, None, "unparsed"),
    ("13/01/2021 13:00:00 PM", None, None, "unparsed"),
    ("2022-09-14T", None, None, "unparsed"),
    ("2021-01-01 00:00:00 XYZ", "Europe/Berlin", None, "unparsed"),
    ("2021-01-01 00:00:00", "Mars/Base", None, "unparsed"),
    ("pending", None, None, "unparsed"),
    ("x" * 100_000, None, None, "unparsed"),
    ("", None, None, "missing"),
    (None, "Asia/Tokyo", None, "missing"),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _, _) in enumerate(CASES)], "i int, txt string, z string")
    df = df.withColumn("__v", F.lit("clash")).withColumn("__home", F.lit(0))
    got = {r.i: (r["__t_us"], r["__t_status"], r["__v"]) for r in instants.parse_instants(df, "txt", "z").collect()}
    for i, (t, z, want, status) in enumerate(CASES):
        assert got[i] == (want, status, "clash"), (t, z)
    assert instants.parse_instants(df.limit(0), "txt", "z").count() == 0


def test_policy_of_local_times(spark):
    df = spark.createDataFrame([(1, "2021-11-07 01:30:00"), (2, "2021-03-14 02:30:00"), (3, "2021-06-01 00:00:00")], "i int, t string").withColumn("z", F.lit("America/New_York"))

    def got(**policy):
        return [r["__t_us"] for r in instants.parse_instants(df, "t", "z", **policy).orderBy("i").collect()]

    summer = us(2021, 6, 1, 4)
    assert got() == [us(2021, 11, 7, 5, 30), None, summer]
    assert got(repeated="later", skipped="forward") == [us(2021, 11, 7, 6, 30), us(2021, 3, 14, 7, 30), summer]
    assert got(repeated="null") == [None, None, summer]
    with pytest.raises(ValueError):
        got(repeated="both")


def test_bar_index_decides_repeated_local_times(spark):
    at = dt.datetime(2021, 11, 8, tzinfo=UTC)
    rows = [
        (1, "r", "2021-11-07 00:15:00", 0, "America/New_York", at),
        (2, "r", "2021-11-07 01:15:00", 1, "America/New_York", at),
        (3, "r", "2021-11-07 01:15:00", 2, "America/New_York", at),
        (4, "alone", "2021-11-07 01:15:00", None, "America/New_York", dt.datetime(2021, 11, 7, 5, 20, tzinfo=UTC)),
        (5, "alone", "2021-11-07 01:15:00", 7, "America/New_York", None),
    ]
    df = spark.createDataFrame(rows, "delivery_id long, run_id string, timestamp string, bar_index long, clock_zone string, received_at timestamp")
    got = {r.delivery_id: r.utc_us for r in instants.ticket_instants(df).collect()}
    early, late = us(2021, 11, 7, 5, 15), us(2021, 11, 7, 6, 15)
    assert [got[i] for i in range(1, 6)] == [us(2021, 11, 7, 4, 15), early, late, early, early]


# -- grid


def test_grid_in_small_shards_equals_one_shard(spark):
    random.seed(2)
    rows = [bar(i, random.randrange(0, 400) * 1_800_000 + random.randrange(900_000), random.choice([None, 1.0, 2.0, float(i)]), symbol=random.choice("ab")) for i in range(150)]
    rows += [bar(900, 3_600_000 * 2000, 5.0), bar(901, None, 1.0), bar(902, 0, 1.0, universe=None), bar(903, 0, 1.0, universe="odd")]
    df = spark.createDataFrame(rows, BAR).withColumn("__period", F.lit(0))
    universes = spark.createDataFrame([("u", "1h"), ("u", "4h"), ("odd", "often"), (None, "1h")], "universe_id string, frequency string")
    one, many = (sorted(map(tuple, grid.bar_grid(df, universes, n).collect())) for n in (1 << 20, 7))
    assert one == many
    held = {}
    for i, u, s, t, _, _, c, _ in rows:
        if u == "u" and t is not None and c is not None and ((u, s, t // 3_600_000) not in held or (t, i) > held[u, s, t // 3_600_000][0]):
            held[u, s, t // 3_600_000] = ((t, i), c)
    want = []
    for s in {k[1] for k in held}:
        hours = [k[2] for k in held if k[1] == s]
        last = None
        for h in range(min(hours), max(hours) + 1):
            known = held.get(("u", s, h))
            last = known[1] if known else last
            want.append(("u", s, h * 3_600_000, last, known is None))
    assert one == sorted(want)
    assert grid.bar_grid(df.limit(0), universes).count() == 0


# -- lines

GOOD = "1750204937858,1750208537857,AAA,1,2,0.5,1.5,6.8,0.15,56,NORMAL,0"
LINES = [
    (GOOD, None),
    ('1750204937858,1750208537857,"AAA",1,2,0.5,1.5,6.8,"0.17", 56 ,NORMAL,"see ""late"" flag, twice"', None),
    (GOOD.replace("0.15", "9.75E+02").replace(",56,", ",00056,"), None),
    (GOOD.replace("1750204937858", "1750204937").replace("AAA", ""), None),
    (GOOD.replace(",0.5,", ",junk,"), None),
    (GOOD.replace("AAA", '"AAA"x'), "quoting"),
    (GOOD.replace("NORMAL", 'NOR"MAL'), "quoting"),
    (GOOD.replace("NORMAL,0", 'NORMAL,"open'), "quoting"),
    (GOOD.replace("NORMAL,0", 'NORMAL,"said "late" twice"'), "quoting"),
    (GOOD.replace("AAA", ' "AAA"'), "quoting"),
    (GOOD + ",", "column_count"),
    (GOOD[:40], "column_count"),
    ("", "column_count"),
    ("   ", "column_count"),
    (None, "column_count"),
    (GOOD.replace("AAA", "x" * 3_000_000), None),
    ("junk," * 11 + "0", "timestamp_open"),
    (GOOD.replace("1750204937858", "1e12"), "timestamp_open"),
    (GOOD.replace("1750204937858", "2051222400"), "timestamp_open"),
    (GOOD.replace("1750204937858", "2051222399"), None),
    (GOOD.replace("1750204937858", "1420070399999"), "timestamp_open"),
    (GOOD.replace("1750204937858", "17512 34433833"), "timestamp_open"),
    (GOOD.replace(",56,", ",-3,"), "trades_count"),
    (GOOD.replace(",56,", ",45.0,"), "trades_count"),
    (GOOD.replace(",56,", ",2147483648,"), "trades_count"),
    (GOOD.replace(",56,", ",,"), "trades_count"),
    (GOOD.replace("0.15", "9e999"), "quote_volume"),
    (GOOD.replace("0.15", "+1"), "quote_volume"),
    (GOOD.replace("0.15", "$1"), "quote_volume"),
    (GOOD.replace("0.15", "nan"), "quote_volume"),
    (",".join(rejects.FIELDS), "timestamp_open"),
]


def test_lines(spark):
    rows = [(0, "f", 1, ",".join(rejects.FIELDS).upper())] + [(i + 1, "f", i + 2, t) for i, (t, _) in enumerate(LINES)] + [(99, None, None, GOOD)]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string").coalesce(1).withColumn("reason", F.lit("clash"))
    got = {r.line_id: r for r in rejects.parse_lines(df).collect()}
    assert len(got) == len(rows) and got[0].kind == "header" and got[99].kind == "bar"
    for i, (text, reason) in enumerate(LINES):
        assert got[i + 1].reason == reason, (text or "")[:100]
        assert got[i + 1].kind == ("bad" if reason else "bar")
    assert got[1].timestamp_open_ms == 1750204937858 and got[1].trades_count == 56 and got[1].quote_volume == 0.15
    assert got[4].timestamp_open_ms == 1750204937000 and got[5].low is None
    assert rejects.parse_lines(df.limit(0)).count() == 0


# -- anomalies


def series(n=600, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    return [[i, i * 3_600_000 + 1_700_000_000_000, *(float(close[i] * x) for x in (1, 1.001, 0.999)), float(rng.uniform(5, 15))] for i in range(n)]


def planted():
    rows = series()
    rows[50][2] *= 1.2
    rows[50][3] = rows[50][2] * 1.001
    for i in (100, 101):
        rows[i][4] *= 0.8
    rows[150][5] *= 100
    rows[200][2] = -1.0
    rows[210][3], rows[210][4] = rows[210][4], rows[210][3]
    rows[220][5] = -3.0
    for i in range(300, 307):
        rows[i][2:5] = rows[299][2:5]
    for i in range(320, 324):  # too short a run
        rows[i][2:5] = rows[319][2:5]
    for i in range(400, 600):  # a level that changes and stays
        rows[i][2:5] = [x * 1.5 for x in rows[i][2:5]]
    cases = {50, 100, 101, 150, 200, 210, 220, *range(300, 307)}
    return rows, {rows[i][1] for i in cases}


def test_planted_cases_are_flagged_in_one_shard_and_in_many(spark):
    rows, want = planted()
    data = [(r[0], "u", s, r[1], r[3], r[4], r[2], r[5]) for r in rows for s in ("a", None)] + [(r[0], "u", "a", r[1] * 1000, r[3], r[4], r[2], r[5]) for r in rows[:40]]
    df = spark.createDataFrame(data, BAR).withColumn("rn", F.lit(0)).withColumn("shard", F.lit("x"))
    for shard_ms in (anomalies.SHARD_MS, 50 * 3_600_000):
        got = anomalies.judged_bars(df, shard_ms).collect()
        assert len(got) == 1200
        for s in ("a", None):
            assert {r.open_ms for r in got if r.symbol == s and r.flag} == want


def test_bars_with_nulls_are_judged_by_what_they_have(spark):
    nan = float("nan")
    data = [(1, "u", "a", 1_700_000_000_000, None, None, None, None), (2, "u", "a", None, 1.0, 1.0, 1.0, 1.0), (3, None, None, 1_700_000_000_000, nan, nan, nan, nan), (4, "u", "a", 1_700_003_600_000, 1.0, None, 0.0, None)]
    df = spark.createDataFrame(data, BAR)
    got = {(r.universe_id, r.open_ms): r.flag for r in anomalies.judged_bars(df).collect()}
    assert got == {("u", 1_700_000_000_000): None, (None, 1_700_000_000_000): None, ("u", 1_700_003_600_000): "range"}
    assert anomalies.implausible_bars(df.limit(0)).count() == 0


def test_posteriors_equal_the_sum_over_all_paths():
    rng, k = np.random.default_rng(1), anomalies.STATES
    logs = rng.normal(0, 2, (4, k))
    moves = anomalies.TRANSITIONS
    got, counted = anomalies.posteriors(np.zeros(4, int), logs, moves[None])
    prior = np.linalg.matrix_power(moves, 64)[0]
    want, pairs, total = np.zeros((4, k)), np.zeros((k, k)), 0.0
    for path in np.ndindex(*[k] * 4):
        p = prior[path[0]] * np.prod([moves[a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(logs[i, s] for i, s in enumerate(path)))
        total += p
        for i, s in enumerate(path):
            want[i, s] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    assert np.allclose(counted[0], pairs / total)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("segments", [1, 4])
def test_store_keeps_one_delivery_over_batches(spark, tmp_path, segments):
    store = delivery_store.DeliveryStore(spark, str(tmp_path), ("run_id", "trade_id"), "received_at", "delivery_id", 30 * 86_400, segments, 1 << 12)
    rows = tickets(seed=4, n=900)
    random.seed(9)
    random.shuffle(rows)
    kept = []
    for part in range(3):
        batch = spark.createDataFrame(rows[part * 300 : part * 300 + 300], TICKET)
        kept += [(r.run_id, r.trade_id) for r in store.ingest(batch, f"b{part}").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {r[:2] for r in rows}
    assert store.ingest(spark.createDataFrame(rows[:50], TICKET), "again").count() == 0
