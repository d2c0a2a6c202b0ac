from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skyquarry.operators.instants import to_utc


def ms(*args, micro=0):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1000)


HEADER = [
    ("2020-01-02T03:04:05", None, None, None, None, None, ms(2020, 1, 2, 3, 4, 5)),
    ("2020-01-02T03:04:05.6789", None, None, None, None, None, ms(2020, 1, 2, 3, 4, 5) + 679),
    ("2020-01-02", "03:04:05", None, None, None, None, ms(2020, 1, 2, 3, 4, 5)),
    ("2020/01/02", "03:04:05.25", None, None, None, None, ms(2020, 1, 2, 3, 4, 5) + 250),
    ("2020-01-02", None, None, None, None, None, None),
    ("2021-02-30T04:10:00", None, None, None, None, None, None),
    ("0000-00-00T00:00:00", None, None, None, None, None, None),
    ("28/06/97", "19:24:17", None, None, None, None, ms(1997, 6, 28, 19, 24, 17)),
    ("20210926T031313Z", None, "TT", None, None, None, ms(2021, 9, 26, 3, 13, 13)),
    ("20210926031313", None, None, None, None, None, ms(2021, 9, 26, 3, 13, 13)),
    ("2006-045T10:39:09", None, None, None, None, None, ms(2006, 2, 14, 10, 39, 9)),
    ("2006-366T10:39:09", None, None, None, None, None, None),
    ("Jan 26, 2023 08:18:13 PM", None, None, None, None, None, ms(2023, 1, 26, 20, 18, 13)),
    ("Jan 26, 2023 12:18:13 AM", None, None, None, None, None, ms(2023, 1, 26, 0, 18, 13)),
    ("14-SEP-2014 01:49:34", None, None, None, None, None, ms(2014, 9, 14, 1, 49, 34)),
    ("7 Nov 2008 01:01:03.118 UT", None, "LOCAL", "America/New_York", None, None, ms(2008, 11, 7, 1, 1, 3) + 118),
    ("2021-12-25.5", None, None, None, None, None, ms(2021, 12, 25, 12)),
    ("2020-07-02T03:04:05", None, "LOCAL", "America/New_York", None, None, ms(2020, 7, 2, 7, 4, 5)),
    ("2020-07-02 03:04:05 EST", None, "LOCAL", "America/New_York", None, None, ms(2020, 7, 2, 8, 4, 5)),
    ("2020-07-02 03:04:05 IST", None, None, "Asia/Kolkata", None, None, ms(2020, 7, 1, 21, 34, 5)),
    ("2020-07-02 03:04:05 XYZ", None, None, "Asia/Kolkata", None, None, None),
    ("2020-07-02T03:04:05-03:30", None, "TAI", None, None, None, ms(2020, 7, 2, 6, 34, 5)),
    ("2020-07-02T03:04:05+02", None, None, None, None, None, ms(2020, 7, 2, 1, 4, 5)),
    ("2020-07-02T03:04:05", None, "TAI", None, None, None, ms(2020, 7, 2, 3, 3, 28)),
    ("2020-07-02T03:05:14.184", None, "TT", None, None, None, ms(2020, 7, 2, 3, 4, 5)),
    ("86400.5", None, None, None, "s", 51544.0, ms(2000, 1, 2) + 500),
    ("-86400", None, None, None, "s", 51544.0, ms(1999, 12, 31)),
    ("1.5", None, None, None, "d", 51544.0, ms(2000, 1, 2, 12)),
    ("51544.25", None, None, None, "d", None, ms(2000, 1, 1, 6)),
    ("2451544.75", None, None, None, "d", None, ms(2000, 1, 1, 6)),
    ("51544.25", None, None, None, None, None, None),
    ("-1", None, None, None, None, None, None),
    ("", None, None, None, None, None, None),
    (None, None, None, None, None, None, None),
    ("x" * 5000, None, None, None, None, None, None),
]


def header(df):
    return to_utc(df, "id", F.col("v"), F.lit("T"), clock=F.col("c"), scale=F.col("s"), zone=F.col("z"), zones=["America/New_York", "Asia/Kolkata"], numbers="header", unit=F.col("u"), epoch=F.col("e"))


def test_headers(spark):
    data = [(i, *r[:6]) for i, r in enumerate(HEADER)]
    df = spark.createDataFrame(data + data[:2] + [(None, *HEADER[0][:6])], "id long, v string, c string, s string, z string, u string, e double")
    df = df.where("not v rlike '^[0-9]{14}$' or v is null").unionByName(df.where("v rlike '^[0-9]{14}$'").withColumn("v", F.concat(F.substring("v", 1, 8), F.lit("T"), F.substring("v", 9, 6))))
    got = {r.id: r for r in header(df.selectExpr("*", "1 as rid", "2 as text", "3 as fmt")).collect()}
    for i, r in enumerate(HEADER):
        assert (got[i].utc_ms if i in got else None) == r[6], r
    assert header(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "value, want",
    [("44482.25", ms(1980, 8, 31, 6)), (" 44482.250", ms(1980, 8, 31, 6)), ("44482,25", ms(1980, 8, 31, 6)), ("MJD 44482.25", ms(1980, 8, 31, 6)), ("JD2444482.75", ms(1980, 8, 31, 6)), ("2444482.75", ms(1980, 8, 31, 6)),
     ("995952222", 995952222000), ("995952222000", 995952222000), ("0", None), ("-999", None), ("NaN", None), ("Fri, 01 Jun 2007 22:59:45 GMT", ms(2007, 6, 1, 22, 59, 45)), ("1994:013:01:53:27.5", ms(1994, 1, 13, 1, 53, 27) + 500),
     ("2021-10-14 04:28:05.000 America/New_York", ms(2021, 10, 14, 8, 28, 5)), ("2021-10-14 04:28:05 Not/AZone", None), ("2022-09-30T12:37:05.000501000+02", ms(2022, 9, 30, 10, 37, 5) + 1)],
)
def test_feed(spark, value, want):
    df = spark.createDataFrame([(1, value, "0")], "id long, v string, f string")
    got = to_utc(df, "id", F.col("v"), F.col("f"), numbers="feed").collect()
    assert (got[0].utc_ms if got else None) == want


def test_marks_hours_that_occur_twice_or_never(spark):
    df = spark.createDataFrame([(1, "2021-11-07T01:30:00"), (2, "2021-03-14T02:30:00"), (3, "2021-03-14T12:30:00")], "id long, v string")
    got = {r.id: r for r in to_utc(df, "id", F.col("v"), F.lit("x"), scale=F.lit("LOCAL"), zone=F.lit("America/New_York"), zones=["America/New_York"]).collect()}
    assert got[1].ambiguous and got[1].utc_ms == ms(2021, 11, 7, 5, 30) and got[2].ambiguous and not got[3].ambiguous


def feed(spark, values):
    """{value: reading} of (value, source) pairs."""
    df = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate(values)], "id long, v string, f string")
    got = {r.id: r for r in to_utc(df, "id", F.col("v"), F.col("f"), numbers="feed").collect()}
    return [got.get(i) for i in range(len(values))]


def test_order_of_day_and_month_is_learned_by_source(spark):
    """The same text is read by what its own source says elsewhere; a source that says nothing leaves it open."""
    days = [(f"{d:02d}/03/2019 10:00:00", "day first") for d in range(13, 29)] + [(f"03/{d:02d}/2019 10:00:00", "month first") for d in range(13, 29)]
    asked = [("04/05/2019 10:00:00", s) for s in ("day first", "month first", "unknown")] + [("05/05/2019 10:00:00", "unknown"), ("31/31/2019 10:00:00", "unknown")]
    day, month, unknown, same, none = feed(spark, days + asked)[len(days) :]
    assert day.utc_ms == ms(2019, 5, 4, 10) and not day.ambiguous and day.fmt == "day/month"
    assert month.utc_ms == ms(2019, 4, 5, 10) and not month.ambiguous and month.fmt == "month/day"
    assert unknown.ambiguous and unknown.posterior == pytest.approx(0.5, abs=0.01)
    assert same.utc_ms == ms(2019, 5, 5, 10) and not same.ambiguous and none is None


def test_unit_of_counts_is_learned_from_the_years_of_a_source(spark):
    """A whole number as seconds or as milliseconds: the years in which a source's other values lie decide."""
    old = [(f"1970-02-{d:02d}T00:00:00Z", "old") for d in range(1, 20)]
    new = [(f"2001-07-{d:02d}T00:00:00Z", "new") for d in range(1, 20)]
    a, b = feed(spark, old + new + [("995952222", "old"), ("995952222", "new")])[-2:]
    assert (a.fmt, a.utc_ms) == ("unix ms", 995952222) and not a.ambiguous
    assert (b.fmt, b.utc_ms) == ("unix s", 995952222000) and not b.ambiguous


def test_offset_with_the_name_of_its_zone(spark):
    """The offset in the value holds; the name in brackets beside it only says where it comes from."""
    a, b, c = feed(spark, [("2010-10-31T01:51:35+01:00[Atlantic/Canary]", "x"), ("2018-11-04T01:07:20.500-06:00[America/Denver]", "x"), ("2018-11-04T01:07:20[", "x")])
    assert a.utc_ms == ms(2010, 10, 31, 0, 51, 35) and b.utc_ms == ms(2018, 11, 4, 7, 7, 20) + 500 and c is None and not a.ambiguous
