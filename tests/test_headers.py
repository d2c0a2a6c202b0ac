from conftest import rows
from pyspark.sql import functions as F

from skyquarry.functions import headers

CARDS = [("NAXIS", "3"), ("NAXIS1", "256"), ("NAXIS2", "256"), ("NAXIS3", "100"), ("FILTER", "''"), ("FILTER1", "'F606W  '"), ("EXPTIME", "12.5"), ("EXPTIME", "99"), ("CRPIX1", "x"), ("TIMESYS", "'utc'")]


def frame(spark, cards):
    return spark.createDataFrame([(cards,)], "cards array<struct<keyword:string,value:string>>")


def test_metadata(spark):
    df = frame(spark, CARDS)
    got = df.select(headers.first_wins(F.col("cards")).alias("h")).select(*headers.metadata(F.col("h"))).first()
    assert (got.filter, got.exposure_time, got.crpix1, got.target, got.dims) == ("F606W", 12.5, None, None, [256, 256, 100])
    assert df.select(headers.last_wins(F.col("cards")).alias("h")).first().h["EXPTIME"] == "99"
    none = frame(spark, [("NAXIS", "0")]).select(headers.first_wins(F.col("cards")).alias("h")).select(*headers.metadata(F.col("h"))).first()
    assert none.dims == [] and none.filter is None
    assert df.select(headers.dimension_text(F.array(F.lit(4096), F.lit(2))).alias("x")).first().x == "4096×2 (2D)"


def test_lookups(spark):
    cards = spark.createDataFrame([("TIMESYS", "'utc  '"), ("BITPIX", "-32"), ("OBJECT", "x"), ("TIMESYS", None)], "keyword string, value string")
    got = {(r.keyword, r.value): r.meaning for r in headers.describe(cards).collect()}
    assert got[("TIMESYS", "'utc  '")] == "Coordinated Universal Time" and got[("BITPIX", "-32")] == "32-bit float" and got[("OBJECT", "x")] is None and len(got) == 4


def test_preferred_unit(spark):
    units = spark.createDataFrame([("a", 1, "WHT", True), ("a", 2, "sci", True), ("b", 0, None, False), ("b", 3, "DQ", True), ("b", 4, "ERR", True)], "path string, ext_index int, extname string, is_image boolean")
    assert rows(headers.preferred_unit(units).select("path", "ext_index")) == [("a", 2), ("b", 3)]
