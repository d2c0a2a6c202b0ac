"""SQL functions over footprints, FITS files and archives: ``register(spark)`` makes them known to a session."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquarry.functions import regions
from skyquarry.sources import fits

UNITS = (
    T.StructType().add("ext_index", T.IntegerType()).add("data_start", T.LongType()).add("data_size", T.LongType()).add("dims", T.ArrayType(T.LongType()))
    .add("bitpix", T.IntegerType()).add("extname", T.StringType()).add("is_image", T.BooleanType())
)
ENTRIES = T.StructType().add("name", T.StringType()).add("size", T.LongType()).add("content", T.BinaryType())


@F.pandas_udf(T.BooleanType())
def region_contains(region: pd.Series, ra: pd.Series, dec: pd.Series) -> pd.Series:
    """Whether a position lies in a footprint; false for a text that is none."""
    read = {t: regions.parse(t) for t in region.dropna().unique()}
    return pd.Series([bool(read.get(t)) and abs(y) <= 90 and regions.holds(read[t], x % 360, y) for t, x, y in zip(region, ra, dec)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def region_intersects(one: pd.Series, two: pd.Series) -> pd.Series:
    """Whether two footprints overlap; false if either text is none."""
    read = {t: regions.parse(t) for s in (one, two) for t in s.dropna().unique()}
    return pd.Series([bool(read.get(a)) and bool(read.get(b)) and regions.overlap(read[a], read[b]) for a, b in zip(one, two)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def region_area(region: pd.Series) -> pd.Series:
    """Square degrees of a footprint; null for a text that is none."""
    read = {t: regions.parse(t) for t in region.dropna().unique()}
    return pd.Series([regions.area(read[t]) if read.get(t) else None for t in region], dtype=float)


@F.udtf(returnType=UNITS)
class FitsUnits:
    """Header units of a file's content."""

    def eval(self, content: bytes):
        for u in fits.units(io.BytesIO(content), len(content)):
            yield u.index, u.data_start, u.data_size, u.dims, fits.integer(u.cards, "BITPIX"), fits.string(u.cards, "EXTNAME"), u.is_image


@F.udtf(returnType=ENTRIES)
class TarEntries:
    """Regular files of an archive's content."""

    def eval(self, content: bytes):
        try:
            with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                for m in archive:
                    if m.isfile():
                        yield m.name, m.size, archive.extractfile(m).read()
        except tarfile.TarError:
            return


def register(spark: SparkSession) -> None:
    for name, f in (("region_contains", region_contains), ("region_intersects", region_intersects), ("region_area", region_area)):
        spark.udf.register(name, f)
    for name, f in (("fits_units", FitsUnits), ("tar_entries", TarEntries)):
        spark.udtf.register(name, f)
