"""Mixed timestamp forms and time zones to one UTC instant (problem 3).

An ordered cascade of anchored patterns turns a text into fields; the fields are
checked strictly (no 30 February, no hour 24); a wall clock without a zone takes
the zone of its source from a lookup; local times that occur twice or never at a
change of the clock follow a stated policy.  All of it is column expressions:
no Python runs per row and nothing is shuffled.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.functions.epoch import epoch_us
from barlattice.session import cut_lineage

# Forms of a time of day, of a zone and of a date.
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?: ?(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?"
_DATE_GAP = r"(?:T|t| +)"
#: (pattern, fields as year|month|day|hour|minute|second|fraction|half day|zone); the first that matches holds.
PATTERNS: tuple[tuple[str, str], ...] = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_DATE_GAP}{_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_DATE_GAP}{_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +{_CLOCK}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(?:[A-Za-z]{{3,9}}, *)?(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]*[ -](\d{{4}}) +{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
)
EPOCH = r"^([+-]?\d{9,19})(?:\.(\d{1,9}))?$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNIVERSAL = ("Z", "UTC", "GMT", "UT")
#: Characters around a value that do not belong to it.
_BLANK = r"[\s\x{85}\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+"
_OUTER = rf"^{_BLANK}|{_BLANK}$"
#: Steps of the clock in use: a repeated wall time lies this much later in UTC.
_STEPS_US = (3_600_000_000, 1_800_000_000, 7_200_000_000)


@lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    return tuple(sorted(z for z in zoneinfo.available_timezones() if z not in ("localtime", "Factory", "posixrules")))


#: Years that zone abbreviations are looked up in; before and after, the nearest use holds.
FIRST_YEAR, LAST_YEAR = 1970, 2037
_ALWAYS = (-(1 << 62), 1 << 62)


def _rules(name: str) -> bytes:
    """The content of a zone's file: zones that are links to each other have the same."""
    for folder in zoneinfo.TZPATH:
        path = Path(folder, name)
        if path.is_file():
            return path.read_bytes()
    return name.encode()


def _uses(name: str) -> list[tuple[str, int, int, int]]:
    """(abbreviation, offset, from, until) in s of the clock of a zone, in order of time; numeric names left out."""
    zone = zoneinfo.ZoneInfo(name)

    def at(s: int) -> tuple[str, dt.timedelta]:
        t = dt.datetime.fromtimestamp(s, zone)
        return t.tzname(), t.utcoffset()

    months = [int(dt.datetime(y, m, 1, tzinfo=dt.timezone.utc).timestamp()) for y in range(FIRST_YEAR, LAST_YEAR + 1) for m in range(1, 13)]
    since, now = months[0], at(months[0])
    uses = []
    for a, b in zip(months, months[1:]):
        new = at(b)
        if new != now:
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if at(middle) == now else (a, middle)
            uses.append((*now, since, b))
            since, now = b, new
    uses.append((*now, since, months[-1]))
    return [(label.upper(), int(offset.total_seconds()), a, b) for label, offset, a, b in uses if label[:1].isalpha()]


@lru_cache(maxsize=1)
def abbreviations() -> tuple[tuple[str, str, int, int, int, int | None], ...]:
    """(zone, abbreviation, from, until, offset, later offset): what the clocks of every zone are called.

    ``from`` and ``until`` are wall clock times in s: an abbreviation that stood for
    several offsets has each in its own years (between two uses, the nearer one).
    Within a repeated wall time both of whose offsets had the same name there is a
    later offset too.  Bounded by the time zone database: a few thousand rows,
    whatever the data.
    """
    rows, known = [], {}
    for name in known_zones():
        named: dict[str, list[tuple[int, int, int]]] = {}
        rules = _rules(name)
        known[rules] = known.get(rules) or _uses(name)
        for label, offset, start, end in known[rules]:
            runs = named.setdefault(label, [])
            if runs and runs[-1][0] == offset:
                runs[-1] = (offset, runs[-1][1], end)
            else:
                runs.append((offset, start, end))
        for label, runs in named.items():
            low = _ALWAYS[0]
            for (offset, _, end), (following, start, _) in zip(runs, runs[1:]):
                ends, starts = end + offset, start + following
                if starts < ends:  # the clock was put back and kept its name
                    rows += [(name, label, low, starts, offset, None), (name, label, starts, ends, offset, following)]
                    low = ends
                else:
                    rows.append((name, label, low, (ends + starts) // 2, offset, None))
                    low = (ends + starts) // 2
            rows.append((name, label, low, _ALWAYS[1], runs[-1][0], None))
    return tuple(rows)


def abbreviation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(abbreviations()), "__a_zone string, __a_name string, __a_from long, __a_until long, __a_offset int, __a_later int")


def with_source_zone(df: DataFrame, source: str, zones: DataFrame, zone: str) -> DataFrame:
    """``df`` with null values of ``zone`` filled from the lookup ``zones`` (``source``, ``zone``).

    Of several zones of one source the first in order of name holds; a source that is not listed stays null.
    """
    lookup = zones.filter(F.col("source").isNotNull()).groupBy(F.col("source").alias("__source")).agg(F.min("zone").alias("__default"))
    joined = df.join(lookup, F.col(source) == F.col("__source"), "left")
    return joined.withColumn(zone, F.coalesce(F.col(zone).cast("string"), "__default")).drop("__source", "__default")


def _fields(text: Column) -> Column:
    cascade = F.lit(None).cast("string")
    for pattern, order in reversed(PATTERNS):
        cascade = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order)).otherwise(cascade)
    return F.split(cascade, r"\|")


def _epoch_text_us(text: Column) -> Column:
    """Digits alone: an epoch in s, ms, us or ns; a fraction keeps its microseconds."""
    whole = F.regexp_extract(text, EPOCH, 1).try_cast("long")
    fraction = F.regexp_extract(text, EPOCH, 2)
    places = F.when(F.length(F.abs(whole).cast("string")) <= 11, 6).when(F.length(F.abs(whole).cast("string")) <= 14, 3).otherwise(0)
    extra = F.coalesce(F.rpad(F.substring(fraction, F.lit(1), places), 6, "0").try_cast("long"), F.lit(0))
    scaled = F.when(places == 6, extra).when(places == 3, F.call_function("div", extra, F.lit(1000))).otherwise(F.lit(0))
    return epoch_us(whole) + F.when(whole < 0, -scaled).otherwise(scaled)


def parse_instants(
    df: DataFrame,
    text: str,
    zone: str,
    prefix: str = "__t",
    default_zone: str = "UTC",
    repeated: str = "earlier",
    skipped: str = "null",
) -> DataFrame:
    """Adds the instant that ``text`` denotes, read by the clock of ``zone`` where it names no zone.

    Policy: of a repeated local time the ``earlier`` or ``later`` instant is taken, or
    none (``null``); a skipped one has no instant (``null``) or goes on by the length
    of the gap (``forward``).

    New columns: ``<prefix>_us`` (epoch microseconds), ``<prefix>_later_us`` (the later instant of a repeated local time,
    else null) and ``<prefix>_status``: ``ok``, ``ambiguous`` (a local time that
    occurs twice), ``nonexistent`` (skipped by the clock; no instant), ``unparsed``
    (no form fits, a field is out of range, or the zone is unknown), ``missing``
    (null or blank).  A null ``zone`` is ``default_zone`` (``with_source_zone`` fills
    it from a lookup by source).  A named zone abbreviation is one of the row's
    zone, with the offset it had at that date; digits alone are an epoch; with
    slashes, a date that does not start with the year is month first; with dots,
    day first.  Finer parts than a microsecond are cut off.
    """
    if repeated not in ("earlier", "later", "null") or skipped not in ("null", "forward"):
        raise ValueError("repeated is earlier, later or null; skipped is null or forward")
    spark = df.sparkSession
    value = F.regexp_replace(F.col(text).cast("string"), _OUTER, "")
    home = F.coalesce(F.col(zone).cast("string"), F.lit(default_zone))
    # the given columns travel in a struct, so that no name of theirs can clash
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__given"), value.alias("__v"), home.alias("__home0"))
    parts = packed.withColumn("__f", _fields(F.col("__v"))).withColumnRenamed("__home0", "__home")
    f = [F.col("__f")[i] for i in range(9)]
    month = F.coalesce(
        f[1].try_cast("int"),
        F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(f[1])).cast("int"),
    )
    hour = f[3].try_cast("int")
    half = F.upper(f[7])
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(None).cast("int")).otherwise(F.pmod(hour, F.lit(12)) + F.when(half == "P", 12).otherwise(0))
    date = F.format_string("%s-%02d-%s", f[0], month, F.lpad(f[2], 2, "0")).try_cast("date")
    minute, second = f[4].try_cast("int"), F.when(f[5] == "", 0).otherwise(f[5].try_cast("int"))
    legal = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    fraction = F.when(f[6] == "", F.lit(0)).otherwise(F.rpad(F.substring(f[6], 1, 6), 6, "0").try_cast("long"))
    wall = F.when(
        legal,
        F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
        + (hour.cast("long") * 3600 + minute * 60 + second) * 1_000_000
        + fraction,
    )
    named = F.upper(F.col("__z"))
    offset = F.regexp_replace("__z", ":", "")
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    offset_s = F.when(
        offset.rlike(r"^[+-]\d{2}(\d{2})?$"),
        sign * (F.substring(offset, 2, 2).try_cast("int") * 3600 + F.coalesce(F.substring(offset, 4, 2).try_cast("int"), F.lit(0)) * 60),
    )
    parts = (
        parts.withColumn("__wall", wall)
        .withColumn("__z", f[8])
        .withColumn("__abbr", F.when(F.col("__z").rlike("^[A-Za-z]+$") & ~named.isin(*UNIVERSAL), named))
    )
    names = F.broadcast(abbreviation_table(spark))  # bounded by the time zone database
    wall_s = F.call_function("div", F.col("__wall") - F.pmod("__wall", F.lit(1_000_000)), F.lit(1_000_000))
    on = (F.col("__abbr") == F.col("__a_name")) & (F.col("__home") == F.col("__a_zone")) & (wall_s >= F.col("__a_from")) & (wall_s < F.col("__a_until"))
    parts = parts.join(names, on, "left")
    shift_s = (
        F.when(F.col("__abbr").isNotNull(), F.col("__a_offset"))
        .when(named.isin(*UNIVERSAL), 0)
        .otherwise(F.when(F.abs(offset_s) <= 64_800, offset_s))
    )
    local = (F.col("__z") == "") & F.col("__wall").isNotNull() & F.expr("__home IN (" + ", ".join(f"'{z}'" for z in known_zones()) + ")")
    wall_ts = F.timestamp_micros("__wall")
    first = F.when(local, F.unix_micros(F.to_utc_timestamp(wall_ts, F.col("__home"))))
    parts = parts.withColumn("__local", local).withColumn("__first", first)

    def shows(us: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col("__home"))) == F.col("__wall")

    changing = F.col("__local") & ~F.col("__home").isin("UTC", "Etc/UTC")
    later = F.lit(None).cast("long")
    for step in reversed(_STEPS_US):
        later = F.when(shows(F.col("__first") + step), F.col("__first") + step).otherwise(later)
    exists = F.when(changing, shows(F.col("__first"))).otherwise(F.lit(True))
    zoned = F.col("__wall") - shift_s.cast("long") * 1_000_000
    zoned_later = F.when(F.col("__abbr").isNotNull(), F.col("__wall") - F.col("__a_later").cast("long") * 1_000_000)
    epoch = F.when(F.col("__v").rlike(EPOCH), _epoch_text_us(F.col("__v")))
    parts = parts.withColumn("__exists", exists).withColumn(
        f"{prefix}_later_us", F.coalesce(F.when(changing & F.col("__exists"), later), zoned_later)
    )
    twice = F.col(f"{prefix}_later_us")

    def one(first: Column) -> Column:
        return {"earlier": first, "later": F.coalesce(twice, first), "null": F.when(twice.isNull(), first)}[repeated]

    chosen = F.when(F.col("__exists"), one(F.col("__first"))).otherwise(F.col("__first") if skipped == "forward" else F.lit(None).cast("long"))
    parts = parts.withColumn(
        f"{prefix}_us",
        F.coalesce(epoch, F.when(F.col("__local"), chosen).otherwise(F.when(F.col("__z") != "", one(zoned)))),
    )
    status = (
        F.when(F.coalesce(F.col("__v"), F.lit("")) == "", "missing")
        .when(F.col("__local") & ~F.col("__exists"), "nonexistent")
        .when(F.col(f"{prefix}_later_us").isNotNull(), "ambiguous")
        .when(F.col(f"{prefix}_us").isNull(), "unparsed")
        .otherwise("ok")
    )
    return parts.withColumn(f"{prefix}_status", status).select(
        "__given.*", f"{prefix}_us", f"{prefix}_later_us", f"{prefix}_status"
    )


_HOUR_US = 3_600_000_000


def ticket_instants(tickets: DataFrame) -> DataFrame:
    """``delivery_id``, ``utc_us``, ``status`` of each ticket delivery.

    A repeated local time is decided by ``bar_index``: the run's first bar opens
    on a whole UTC hour, which the run's unambiguous deliveries tell (the hour
    most of them agree on); of the two instants the one inside its bar is taken,
    else the nearer.  Without a bar index or any unambiguous delivery of the run,
    the later instant is taken if it is not after ``received_at``, else the
    earlier.  Rows of unknown time have a null ``utc_us``.

    The parsed fields are kept in the checkpoint folder.  Only the repeated local
    times are joined with the runs; the runs' origins are counted with partial
    aggregation, so one run may hold any share of the rows.
    """
    rows = parse_instants(
        tickets.select("delivery_id", "run_id", "timestamp", "bar_index", "clock_zone", "received_at"), "timestamp", "clock_zone"
    )
    # parsed once; three branches read the parsed fields (the texts and zones stay behind)
    rows = cut_lineage(rows.select("delivery_id", "run_id", "bar_index", "received_at", "__t_us", "__t_later_us", "__t_status"))
    clear = rows.filter(F.col("__t_status") != "ambiguous").select("delivery_id", F.col("__t_us").alias("utc_us"), F.col("__t_status").alias("status"))
    twice = rows.filter(F.col("__t_status") == "ambiguous")
    hour = F.call_function("div", F.col("__t_us") - F.pmod("__t_us", F.lit(_HOUR_US)), F.lit(_HOUR_US))
    origins = (
        rows.filter((F.col("__t_status") == "ok") & F.col("bar_index").isNotNull())
        .groupBy("run_id", (hour - F.col("bar_index")).alias("__origin"))
        .count()
        .groupBy("run_id")
        .agg(F.max_by("__origin", F.struct("count", -F.col("__origin"))).alias("__origin"))
    )

    def off(us: Column) -> Column:
        h = F.call_function("div", us - F.pmod(us, F.lit(_HOUR_US)), F.lit(_HOUR_US))
        return F.abs(h - F.col("__origin") - F.col("bar_index"))

    early, late = F.col("__t_us"), F.col("__t_later_us")
    by_bar = off(late) < off(early)
    by_arrival = late <= F.unix_micros("received_at")
    use_late = F.coalesce(by_bar, by_arrival, F.lit(False))
    decided = twice.join(origins, "run_id", "left").select(
        "delivery_id", F.when(use_late, late).otherwise(early).alias("utc_us"), F.lit("ok").alias("status")
    )
    return clear.unionByName(decided)


def state_instants(states: DataFrame) -> DataFrame:
    """``state_id``, ``utc_us``, ``status``: the long if neither null nor 0, else the text.

    A saved state has no bar index.  Its bar has closed when it is saved, so of a
    repeated local time the later instant is taken if its bar (one hour) ends no
    later than ``saved_at``, else the earlier.
    """
    long = F.col("last_processed_timestamp_utc")
    rows = parse_instants(
        states.select("state_id", "last_processed_timestamp_utc", "last_processed_datetime_str", "clock_zone", "saved_at"),
        "last_processed_datetime_str",
        "clock_zone",
    )
    given = long.isNotNull() & (long != 0)
    late = F.col("__t_later_us") + _HOUR_US <= F.unix_micros("saved_at")
    text = F.when(F.coalesce(late, F.lit(False)), F.col("__t_later_us")).otherwise(F.col("__t_us"))
    us = F.when(given, epoch_us(long)).otherwise(text)
    return rows.select(
        "state_id",
        us.alias("utc_us"),
        F.when(us.isNotNull(), "ok").otherwise(F.col("__t_status")).alias("status"),
    )
