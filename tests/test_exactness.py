"""Near misses: equal totals in another order, names of zones that changed their offset, signs that are content."""

import datetime as dt

from barlattice.operators import instants, rejects, rolling

BAR = "bar_id long, universe_id string, symbol string, timestamp_open long, high double, low double, close double, volume double"
DAY = 86_400_000
HOUR = 3_600_000


def test_equal_means_are_no_case_whatever_the_order(spark):
    base, rows = 19_000 * DAY, []
    parts = [0.1, 0.2, 0.3, 1e-7, 123456.789]
    for d in range(90):
        for k in range(5):
            rows.append((len(rows), "u", "s", base + d * DAY + k * HOUR, 1.0, 1.0, 1.0, parts[(k * (d % 4 + 1) + d) % 5]))
    bars = spark.createDataFrame(rows, BAR)
    assert rolling.rising_volume_days(bars).count() == 0
    more = spark.createDataFrame([*rows, (999, "u", "s", base + 60 * DAY + 9 * HOUR, 1.0, 1.0, 1.0, 1e-12)], BAR)
    assert [r.day for r in rolling.rising_volume_days(more).orderBy("day").collect()] == [str(dt.date(1970, 1, 1) + dt.timedelta(19_060 + i)) for i in range(7)]


def test_huge_and_tiny_numbers_count(spark):
    base = 19_000 * DAY
    rows = [(i, "u", "s", base + i * DAY, 1.0, 1.0, 1.0, v) for i, v in enumerate([1e300, 0.0, 2e18, 1e-30, *[0.0] * 40])]
    got = {r.day_no: r.volume_7d for r in rolling.rolling_bars(spark.createDataFrame(rows, BAR)).collect()}
    assert got[1] == 1e300 and got[9] == 2e18 + 1e-30 and got[10] == 1e-30 and got[11] == 0.0
    found = rolling.rising_volume_days(spark.createDataFrame(rows, BAR), 3, 5).count()
    assert found == sum(rows_sum(rows, d, 3) * 5 > rows_sum(rows, d, 5) * 3 for d in range(4, 44))


def rows_sum(rows, d, n):
    return sum(r[-1] for r in rows[max(0, d - n + 1) : d + 1])


def _instants(spark, rows, **options):
    df = spark.createDataFrame(rows, "i int, t string, z string")
    return {r.i: (r.__getitem__("__t_us"), r.__getitem__("__t_later_us"), r.__getitem__("__t_status")) for r in instants.parse_instants(df, "t", "z", **options).collect()}


def us(*at):
    return int(dt.datetime(*at, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def test_zone_names_that_changed_their_offset(spark):
    rows = [
        (1, "2012-06-01 12:00:00 MSK", "Europe/Moscow"),
        (2, "2016-06-01 12:00:00 MSK", "Europe/Moscow"),
        (3, "2014-10-26 01:30:00 MSK", "Europe/Moscow"),  # both offsets were called MSK within this hour
        (4, "2016-06-01 12:00:00 KST", "Asia/Pyongyang"),
        (5, "2020-06-01 12:00:00 KST", "Asia/Pyongyang"),
        (6, "2009-07-01 12:00:00 MSD", "Europe/Moscow"),
        (7, "2020-07-01 12:00:00 EST", "America/New_York"),
        (8, "2020-07-01 12:00:00 CEST", "America/New_York"),
    ]
    got = _instants(spark, rows)
    assert got[1][0] == us(2012, 6, 1, 8) and got[2][0] == us(2016, 6, 1, 9)
    assert got[3] == (us(2014, 10, 25, 21, 30), us(2014, 10, 25, 22, 30), "ambiguous")
    assert got[4][0] == us(2016, 6, 1, 3, 30) and got[5][0] == us(2020, 6, 1, 3)
    assert got[6][0] == us(2009, 7, 1, 8) and got[7][0] == us(2020, 7, 1, 17) and got[8][2] == "unparsed"
    assert _instants(spark, rows, repeated="later")[3][0] == us(2014, 10, 25, 22, 30)


def test_zone_of_the_source_from_a_lookup(spark):
    df = spark.createDataFrame([(1, "2020-07-01 12:00:00", "a", None), (2, "2020-07-01 12:00:00", "b", None), (3, "2020-07-01 12:00:00", "a", "UTC"), (4, "2020-07-01 12:00:00", None, None)], "i int, t string, source string, z string")
    zones = spark.createDataFrame([("a", "America/New_York"), ("a", "America/New_York"), ("x", "UTC")], "source string, zone string")
    got = {r.i: r["__t_us"] for r in instants.parse_instants(instants.with_source_zone(df, "source", zones, "z"), "t", "z").collect()}
    assert got == {1: us(2020, 7, 1, 16), 2: us(2020, 7, 1, 12), 3: us(2020, 7, 1, 12), 4: us(2020, 7, 1, 12)}


GOOD = "1546300800,1546304399,QORV,1,2,1,1.5,10,15.5,56,NORMAL,0"


def _lines(spark, lines):
    df = spark.createDataFrame([(i, "f", i + 2, x) for i, x in enumerate(lines)], "line_id long, file_name string, line_no int, line string")
    return {r.line_id: r for r in rejects.parse_lines(df).collect()}


def test_nul_is_content(spark):
    got = _lines(spark, [GOOD, GOOD.replace("56", "56\0"), GOOD.replace("QORV", "QO\0RV"), GOOD.replace("1546300800", "\x001546300800")])
    assert [(got[i].kind, got[i].reason) for i in range(4)] == [("bar", None), ("bad", "trades_count"), ("bar", None), ("bad", "timestamp_open")]
    assert got[2].symbol == "QO\0RV"


def test_open_quotations_do_not_reach_the_next_line(spark):
    lines = [
        GOOD.replace("QORV", '"QORV'),
        GOOD,
        GOOD.replace("QORV", '"QORV""'),
        GOOD.replace("QORV", 'QO"RV'),
        GOOD.replace("QORV", '"QORV"x'),
        GOOD.replace("QORV", '"QO""RV"'),
        GOOD.replace("QORV", '"QO,RV"'),
        GOOD.replace(",0", ',"0'),
        '"',
        '"' + "x" * 100_000,
        GOOD + '"',
        GOOD + ",1",
        GOOD.replace("QORV", '"QO""R"V"'),
        GOOD.replace("QORV", 'QO"R"V'),
    ]
    got = _lines(spark, lines)
    assert [got[i].reason for i in range(len(lines))] == ["quoting", None, "quoting", "quoting", "quoting", None, None, "quoting", "quoting", "quoting", "quoting", "column_count", "quoting", "quoting"]
    assert got[5].symbol == 'QO"RV' and got[6].symbol == "QO,RV"


def test_the_first_reason_of_values_that_only_the_reader_takes(spark):
    lines = {
        "+1546300800": "timestamp_open", "1546300800.0": "timestamp_open", "1_546_300_800": "timestamp_open", "1.5463008e9": "timestamp_open",
        "0" * 60 + "1546300800": None, " 1546300800\t": None, '"1546300800"': None, '" 1546300800 "': None, "": "timestamp_open", "9" * 60: "timestamp_open",
    }
    got = _lines(spark, [GOOD.replace("1546300800", x) for x in lines])
    assert [got[i].reason for i in range(len(lines))] == list(lines.values())
    assert all(r.timestamp_open_ms == 1546300800000 for r in got.values() if r.kind == "bar")
    counts = {"+56": "trades_count", "56.0": "trades_count", "5_6": "trades_count", "5e1": "trades_count", "2147483648": "trades_count", "2147483647": None, "٥٦": "trades_count", "0056": None, '"56"': None}
    got = _lines(spark, [GOOD.replace(",56,", f",{x},") for x in counts])
    assert [got[i].reason for i in range(len(counts))] == list(counts.values())
    quotes = {"+15.5": "quote_volume", "-0.0": "quote_volume", "1_5.5": "quote_volume", "inf": "quote_volume", "nan": "quote_volume", "1e400": "quote_volume", ".5": None, "5.": None, "1E2": None, "": "quote_volume", "0x1": "quote_volume"}
    got = _lines(spark, [GOOD.replace(",15.5,", f",{x},") for x in quotes])
    assert [got[i].reason for i in range(len(quotes))] == list(quotes.values())
    both = _lines(spark, [GOOD.replace("1546300800", "+1546300800").replace(",56,", ",x,"), GOOD.replace(",56,", ",x,") + ",more", GOOD.replace("QORV", '"Q"x').replace(",56,", ",x,")])
    assert [both[i].reason for i in range(3)] == ["timestamp_open", "column_count", "quoting"]
