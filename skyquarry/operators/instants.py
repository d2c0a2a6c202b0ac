"""Timestamps in mixed formats, precisions, scales and zones to one UTC instant (problem 5).

Every value is read under each format that can parse it: a number as days, seconds or milliseconds from
each origin, a date of digits day first and month first. A source (a telescope, a feed) is a mixture of
formats over a spread of years; expectation-maximisation over the counts of candidate sets learns both
from all its values, and the posterior chooses among the readings of a value. Readings that stay
undecided are marked. A zone or offset in the value holds; otherwise the value is in the record's time
scale or civil zone. Civil times that occur twice or never (daylight-saving changes) are marked too; the
earlier instant is taken.

All parsing stays in the JVM, with one match of one pattern a value. What leaves it are counts per source and
set of (format, year), a bounded number a source, which a grouped Arrow pass turns into weights.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.session import cut, small

#: Offsets of time scales from UTC (later than 2017), and months.
SCALE_MS = {"TT": 69184, "TAI": 37000, "UTC": 0, "UT": 0, "UT1": 0}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_MS = 86_400_000
MJD_UNIX, JD_UNIX = 40587, 2440587.5
#: Years in which a reading is possible at all, how many years to each side a value speaks for, and the weight of a year without values.
POSSIBLE = (1900, 2100)
NEIGHBOURS, UNSEEN = 3, 0.05
#: Most sources whose weights are broadcast; beyond, they are joined by a shuffle, with the same result.
MOST_SOURCES = 20_000
CERTAIN = 0.9

_DATE = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d*)?))?\s*(AM|PM|am|pm)?"
_ZONE = r"\s*([A-Za-z_]+/[A-Za-z0-9_/+-]+|[A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[[A-Za-z0-9_/+-]+\])?"  # of an offset and its zone's name the offset holds
#: Name, pattern, and the groups of year, month, day, day of year, hour, minute, second, half of day, zone. Of ``day/month`` both orders are read.
TEXT_FORMATS = [
    ("iso", rf"{_DATE}[T ]{_TIME}{_ZONE}", dict(y=1, m=2, d=3, h=4, mi=5, s=6, ap=7, z=8)),
    ("compact", rf"(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}}(?:\.\d+)?){_ZONE}", dict(y=1, m=2, d=3, h=4, mi=5, s=6, z=7)),
    ("ordinal", rf"(\d{{4}})[-:](\d{{3}})[T: ]{_TIME}{_ZONE}", dict(y=1, doy=2, h=3, mi=4, s=5, ap=6, z=7)),
    ("month name first", rf"([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}) {_TIME}{_ZONE}", dict(y=3, mon=1, d=2, h=4, mi=5, s=6, ap=7, z=8)),
    ("month name", rf"(?:[A-Za-z]{{3,9}}, )?(\d{{1,2}})[- ]([A-Za-z]{{3,9}})[- ](\d{{4}}) {_TIME}{_ZONE}", dict(y=3, mon=2, d=1, h=4, mi=5, s=6, ap=7, z=8)),
    ("day/month", rf"(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}})[T ]{_TIME}{_ZONE}", dict(y=3, m=2, d=1, h=4, mi=5, s=6, ap=7, z=8)),
    ("date", rf"{_DATE}", dict(y=1, m=2, d=3)),
    ("date fraction", rf"{_DATE}(\.\d+)", dict(y=1, m=2, d=3, f=4)),
    ("day/month date", r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", dict(y=3, m=2, d=1)),
    ("old date", r"(\d{2})/(\d{2})/(\d{2})", dict(yy=3, m=2, d=1)),
]
SWAPPED = {"day/month": "month/day", "day/month date": "month/day date"}
_CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d*)?))?$"
_NUMBER = r"^(?i:(MJD|JD)\s*)?([+-]?\d+)(?:[.,](\d*))?$"
_CUT = "\u0001"


def _year_ms(year: int) -> int:
    return int((datetime(year, 1, 1) - datetime(1970, 1, 1)).total_seconds() * 1000)


def _clock(hour: Column, minute: Column, second: Column, half: Column) -> Column:
    """Milliseconds of day; null if impossible. A leap second counts as the next midnight's."""
    hours = F.when((half == "") & (hour < 24), hour).when((half != "") & hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.when((minute < 60) & (second < 61), hours.cast("long") * 3_600_000 + minute.cast("long") * 60_000 + F.round(second * 1000).cast("long"))


def _groups(text: Column, pattern: str, parts: list[list[int]]) -> Column:
    """For each part its groups of a match, one after another, as an array from 1, from one run of the pattern; null without a match."""
    template = _CUT + _CUT.join("".join(f"${g}" for g in groups) for groups in parts)
    found = F.split(F.regexp_replace(text, pattern, template), _CUT)
    return F.when(F.size(found) == len(parts) + 1, found)


_FIELDS = ["y", "yy", "m", "mon", "d", "doy", "h", "mi", "s", "ap", "z", "f"]


def _read_text(rows: DataFrame) -> DataFrame:
    """With ``words``, an array of struct(fmt, local ms, zone text): the readings of the text format that fits.

    All formats are alternatives of one pattern, so of a field's groups all are empty but one, and writing
    them one after another gives the field. Fields and instant are computed in steps, each as columns of
    the one before.
    """
    first, at = {}, 0
    for name, pattern, fields in TEXT_FORMATS:
        first[name] = at
        at += max(fields.values())
    whole = "^(?:" + "|".join(pattern for _, pattern, _ in TEXT_FORMATS) + ")$"
    parts = [[first[name] + fields[k] for name, _, fields in TEXT_FORMATS if k in fields] for k in _FIELDS]
    years = [[first[name] + fields.get("y", fields.get("yy"))] for name, _, fields in TEXT_FORMATS]
    text = F.col("text")
    # most junk and all numbers are refused without the pattern
    dated = text.rlike(r"^[^.,]*\d[-/:. ]|^\d{8}|^[A-Za-z]{3}") & ~text.contains(_CUT)
    rows = rows.withColumn("g", F.when(dated, _groups(text, whole, parts + years)))
    rows = rows.withColumns({k: F.get("g", F.lit(i + 1)) for i, k in enumerate(_FIELDS)} | {"which": F.array_join(F.slice("g", len(_FIELDS) + 2, len(years)), ",")})
    names = F.array(*[F.lit(name) for name, _, _ in TEXT_FORMATS])
    rows = rows.withColumn("fmt", F.get(names, F.length("which") - F.length(F.ltrim("which", F.lit(",")))))
    bare = [name for name, _, fields in TEXT_FORMATS if "h" not in fields and "f" not in fields]
    rows = rows.withColumn("c", F.when(F.col("fmt").isin(bare), _groups(F.trim("clock"), _CLOCK, [[1], [2], [3]])))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    some = lambda c: F.nullif(c, F.lit(""))
    rows = rows.withColumns(
        {
            "year": F.when(F.col("y") != "", F.col("y")).otherwise(F.concat(F.lit("19"), F.col("yy"))),
            "mo": F.when(F.col("mon") != "", F.try_element_at(months, F.lower(F.substring("mon", 1, 3)))).otherwise(F.lpad("m", 2, "0")),
            "dd": F.lpad("d", 2, "0"),
            "nth": some(F.col("doy")).try_cast("int"),
            "hour": F.coalesce(some(F.col("h")), F.get("c", F.lit(1))).try_cast("int"),
            "minute": F.coalesce(some(F.col("mi")), F.get("c", F.lit(2))).try_cast("int"),
            "second": F.coalesce(some(F.col("s")), some(F.get("c", F.lit(3))), F.lit("0")).try_cast("decimal(20,12)"),
            "part": F.when(F.col("f") != "", F.concat(F.lit("0"), F.col("f"))).try_cast("decimal(20,15)"),
        }
    )
    day = lambda m, d: F.unix_date(F.concat("year", F.lit("-"), m, F.lit("-"), d).try_cast("date")).cast("long")
    ordinal = F.when((F.col("nth") > 0) & ((F.col("nth") < 366) | F.concat("year", F.lit("-02-29")).try_cast("date").isNotNull() & (F.col("nth") == 366)), day(F.lit("01"), F.lit("01")) + F.col("nth") - 1)
    rows = rows.withColumns(
        {
            "day": F.when(F.col("nth").isNull(), day(F.col("mo"), F.col("dd"))).otherwise(ordinal),
            "other": F.when(F.col("fmt").isin(*SWAPPED), day(F.col("dd"), F.col("mo"))),
            "of_day": F.coalesce(_clock(F.col("hour"), F.col("minute"), F.col("second"), F.upper("ap")), F.round(F.col("part") * DAY_MS).cast("long")),
        }
    )
    rows = rows.withColumns({"ms": F.col("day") * DAY_MS + F.col("of_day"), "ms2": F.col("other") * DAY_MS + F.col("of_day")})
    second = F.create_map(*[F.lit(x) for pair in SWAPPED.items() for x in pair])
    words = F.array(
        F.when(F.col("ms").isNotNull(), F.struct("fmt", "ms", F.col("z").alias("zone"))),
        F.when(F.col("ms2").isNotNull(), F.struct(F.try_element_at(second, F.col("fmt")).alias("fmt"), F.col("ms2").alias("ms"), F.col("z").alias("zone"))),
    )
    return rows.withColumn("words", words)


def _read_numbers(rows: DataFrame, mode: str) -> tuple[DataFrame, list[Column]]:
    """Readings of numbers. header: epoch + value in its unit, MJD or JD. feed: MJD, JD, Unix s or ms."""
    text = F.col("text")
    rows = rows.withColumn("nb", _groups(text, _NUMBER, [[1], [2], [3]]))
    prefix, whole, part = (F.get("nb", F.lit(i)) for i in (1, 2, 3))
    value = F.concat(whole, F.lit("."), F.when(part == "", F.lit("0")).otherwise(F.substring(part, 1, 16))).try_cast("decimal(32,16)")
    rows = rows.withColumns({"value": value, "prefix": F.upper(prefix), "integral": ~text.contains(".") & ~text.contains(",")})
    value, prefix, unit, epoch = (F.col(c) for c in ("value", "prefix", "unit", "epoch"))

    def days(origin: float) -> Column:
        return F.round((value - F.lit(str(origin)).cast("decimal(12,1)")).cast("decimal(28,14)") * DAY_MS).try_cast("long")

    def reading(name: str, when: Column, ms: Column) -> Column:
        return F.when(when & value.isNotNull(), F.struct(F.lit(name).alias("fmt"), ms.alias("ms"), F.lit("").alias("zone")))

    if mode == "header":
        base = (epoch.cast("decimal(20,8)") - MJD_UNIX).cast("decimal(20,8)") * DAY_MS
        bare, free = (prefix == "") & epoch.isNotNull(), epoch.isNull() & (unit == "d")
        return rows, [
            reading("seconds since", bare & (unit == "s"), F.round(base + value.cast("decimal(28,12)") * 1000).try_cast("long")),
            reading("days since", bare & (unit == "d"), F.round(base + value.cast("decimal(28,14)") * DAY_MS).try_cast("long")),
            reading("mjd", free & (prefix != "JD"), days(MJD_UNIX)),
            reading("jd", free & (prefix != "MJD"), days(JD_UNIX)),
        ]
    counts = F.col("integral") & (prefix == "") & (value > 0)
    day_numbers = ~F.col("integral") | (prefix != "")
    return rows, [
        reading("mjd", day_numbers & (prefix != "JD"), days(MJD_UNIX)),
        reading("jd", day_numbers & (prefix != "MJD"), days(JD_UNIX)),
        reading("unix s", counts, F.try_multiply(value.try_cast("long"), F.lit(1000))),
        reading("unix ms", counts, value.try_cast("long")),
    ]


def zone_letters(zones: Iterable[str]) -> dict[str, int]:
    """'zone|letters' -> minutes east of UTC, for the names that each zone gives its winter and summer time."""
    out = {}
    for zone in sorted(set(zones)):
        for year in range(1975, 2040, 4):
            for month in (1, 7):
                moment = datetime(year, month, 1, 12, tzinfo=ZoneInfo(zone))
                if (name := moment.tzname()) and name.isalpha():
                    out[f"{zone}|{name}"] = int(moment.utcoffset().total_seconds() // 60)
    return out


def _em(counts: list[dict], rounds: int = 20) -> tuple[dict[str, float], dict[int, float]]:
    """Weights of the formats and of the years of one source from its rows (sig: candidates (fmt, year), n)."""
    weights = {c["fmt"]: 1.0 for r in counts for c in r["sig"]}
    years = {c["year"]: 1.0 for r in counts for c in r["sig"]}
    for _ in range(rounds):
        formats, seen = dict.fromkeys(weights, 0.01), dict.fromkeys(years, 0.0)
        for r in counts:
            parts = [weights[c["fmt"]] * years[c["year"]] for c in r["sig"]]
            total = sum(parts) or 1.0
            for c, p in zip(r["sig"], parts):
                formats[c["fmt"]] += r["n"] * p / total
                seen[c["year"]] += r["n"] * p / total
        n, m = sum(formats.values()), sum(seen.values())
        weights = {f: v / n for f, v in formats.items()}
        near = {y: sum(seen.get(y + k, 0.0) / (1 + abs(k)) for k in range(-NEIGHBOURS, NEIGHBOURS + 1)) for y in seen}
        years = {y: (v + UNSEEN) / (m + UNSEEN) for y, v in near.items()}
    return weights, years


def _weights(counts: pa.Table) -> pa.Table:
    """(source, w, q) of one source's counts."""
    w, q = _em(counts.to_pylist())
    return pa.table({"source": counts["source"].slice(0, 1), "w": pa.array([list(w.items())], pa.map_(pa.string(), pa.float64())), "q": pa.array([list(q.items())], pa.map_(pa.int32(), pa.float64()))})


def candidates(
    df: DataFrame,
    key: str,
    value: Column,
    source: Column,
    *,
    field: str = "",
    clock: Column | None = None,
    zone: Column | None = None,
    scale: Column | None = None,
    numbers: str | None = None,
    unit: Column | None = None,
    epoch: Column | None = None,
) -> DataFrame:
    """(field, rid, source, civil, scale, cands): every value with its possible readings; see :func:`to_utc`."""
    nothing = F.lit(None).cast("string")
    rows = df.where(F.col(key).isNotNull()).select(
        F.lit(field).alias("field"),
        F.col(key).alias("rid"),
        F.regexp_replace(value, "^\\s+|\\s+$", "").alias("text"),
        F.concat(F.lit(field + "|"), F.coalesce(source, F.lit(""))).alias("source"),
        (clock if clock is not None else nothing).alias("clock"),
        (zone if zone is not None else nothing).alias("civil"),
        F.upper(F.coalesce(scale if scale is not None else nothing, F.lit("UTC"))).alias("scale"),
        (unit if unit is not None else nothing).alias("unit"),
        (epoch if epoch is not None else F.lit(None)).cast("double").alias("epoch"),
    )
    rows = rows.where("text is not null and text <> ''").dropDuplicates(["rid"])
    rows = _read_text(rows)
    options = F.col("words")
    if numbers:
        # in a feed a whole number counts seconds or milliseconds, it is no compact date
        rows, more = _read_numbers(rows, numbers)
        options = F.concat(F.when(F.col("prefix").isNull(), options).otherwise(F.slice(options, 1, 0)), F.array(*more))
    possible = F.filter(F.array_compact(options), lambda c: c["ms"].between(_year_ms(POSSIBLE[0]), _year_ms(POSSIBLE[1])))
    return rows.select("field", "rid", "source", "civil", "scale", possible.alias("cands"))


def resolve(read: DataFrame, zones: Iterable[str] = ()) -> DataFrame:
    """(field, rid, utc_ms, fmt, posterior, ambiguous) of values with candidates; several fields may be joined to one table."""
    # kept, so that no later filter is pushed below the parsing and makes it run again
    read = cut(read).where(F.size("cands") > 0)
    year = lambda c: (F.floor(c["ms"] / (365.2425 * DAY_MS)) + 1970).cast("int")
    read = read.withColumn("sig", F.transform("cands", lambda c: F.struct(c["fmt"].alias("fmt"), year(c).alias("year"))))
    counts = read.groupBy("source", "sig").agg(F.count("*").alias("n"))
    # a source has a bounded set of formats and years, so its counts fit in a batch
    weights = cut(counts.groupBy("source").applyInArrow(_weights, "source string, w map<string,double>, q map<int,double>"))
    read = read.join(small(weights, MOST_SOURCES), "source")
    score = lambda c, i: F.try_element_at("w", c["fmt"]) * F.try_element_at("q", F.col("sig")[i]["year"])
    scored = F.transform("cands", lambda c, i: F.struct(score(c, i).alias("p"), (-i).alias("i"), c["fmt"].alias("fmt"), c["ms"].alias("ms"), c["zone"].alias("zone")))
    read = read.withColumn("scored", scored)
    read = read.select("field", "rid", "civil", "scale", F.array_max("scored").alias("best"), "scored")
    # readings that agree on the instant count together
    mass = lambda keep: F.aggregate(F.filter("scored", keep), F.lit(0.0), lambda a, c: a + c["p"])
    read = read.select("field", "rid", "civil", "scale", "best", mass(lambda c: c["ms"] == F.col("best.ms")).alias("mass"), mass(lambda c: F.lit(True)).alias("total"))

    ms, written = F.col("best.ms"), F.col("best.zone")
    offset = F.when(written.rlike(r"^[+-]\d{2}(:?\d{2})?$"), F.when(F.substring(written, 1, 1) == "-", -1).otherwise(1) * (F.substring(written, 2, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(written, r":?(\d{2})$", 1).try_cast("int"), F.lit(0)) * F.when(F.length(written) > 3, 1).otherwise(0)))
    letters = zone_letters(zones)
    minutes = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair]) if letters else F.lit(None).cast("map<string,int>")
    named = F.when(F.upper(written).isin("Z", "UT", "UTC", "GMT"), F.lit(0)).otherwise(F.try_element_at(minutes, F.concat_ws("|", "civil", F.upper(written))))
    fixed = F.coalesce(offset, F.when(written.rlike("^[A-Za-z]+$"), named))
    region = F.when(written.contains("/"), written).when((written == "") & (F.col("scale") == "LOCAL"), F.col("civil"))
    region = F.when(region.isin(*sorted(available_timezones())), region)
    shift = F.create_map(*[F.lit(x) for pair in SCALE_MS.items() for x in pair])
    at = F.timestamp_millis(ms)
    utc = F.to_utc_timestamp(at, F.col("region"))
    read = read.withColumn("region", region).withColumn("fixed", fixed)
    result = F.when(F.col("region").isNotNull(), F.unix_millis(utc)).when(written != "", ms - F.col("fixed") * 60_000).when(F.col("scale") != "LOCAL", ms - F.try_element_at(shift, F.col("scale")))
    back = F.from_utc_timestamp(utc, F.col("region"))
    again = F.from_utc_timestamp(utc + F.expr("interval 1 hour"), F.col("region"))
    fold = F.col("region").isNotNull() & ((back != at) | (again == at))
    posterior = F.col("mass") / F.col("total")
    return read.select("field", "rid", result.alias("utc_ms"), F.col("best.fmt").alias("fmt"), posterior.alias("posterior"), ((posterior < CERTAIN) | F.coalesce(fold, F.lit(False))).alias("ambiguous")).where("utc_ms is not null")


def to_utc(df: DataFrame, key: str, value: Column, source: Column, *, zones: Iterable[str] = (), **how) -> DataFrame:
    """(key, utc_ms, fmt, posterior, ambiguous) of every value that names an instant.

    ``clock`` is a time of day that completes a date without one, ``zone`` the civil zone of the record
    (one of ``zones``, whose letters such as EDT are known), ``scale`` UTC, TT, TAI or LOCAL (null is
    UTC), ``numbers`` how bare numbers read (``header``, ``feed`` or None: as junk), ``unit`` and
    ``epoch`` the unit and MJD origin of header numbers.

    Null, empty and junk values, impossible dates, dates without a time of day, unknown zones and local
    times without a zone give no row. ``ambiguous`` is true if the posterior of the reading is below
    0.9 or the civil time occurs twice or never; of equally likely readings the first (day before month) is
    taken. A repeated key counts once, null keys are left out, extra columns are ignored, an empty table
    gives an empty result, texts of any length are read whole.
    """
    return resolve(candidates(df, key, value, source, **how), zones).drop("field").withColumnRenamed("rid", key)
