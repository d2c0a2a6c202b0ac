"""Searches over observation tables. All are plain filters and sorts that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.functions import regions, sphere

DEFAULT_RADIUS = 0.2
PAGE_ROWS = 200


def within(ra: float, dec: float, radius: float, ra_column: str = "s_ra", dec_column: str = "s_dec") -> Column:
    """A cone. The declination band is a filter on the bare column, so it is pushed to the scan."""
    r, d = F.col(ra_column), F.col(dec_column)
    band = d.between(dec - radius - 1e-9, dec + radius + 1e-9) & d.between(-90.0, 90.0)
    return band & ~F.isnan(r) & (sphere.separation(F.lit(ra), F.lit(dec), r, d) <= radius)


def cone(df: DataFrame, ra: float, dec: float, radius: float = DEFAULT_RADIUS, ra_column: str = "s_ra", dec_column: str = "s_dec") -> DataFrame:
    """Rows within a cone, with their distance in arcsec. Rows without a position, or beyond a pole, are out."""
    found = df.where(within(ra, dec, radius, ra_column, dec_column))
    return found.withColumn("distance_arcsec", sphere.separation(F.lit(ra), F.lit(dec), F.col(ra_column), F.col(dec_column)) * 3600)


def box(df: DataFrame, ra: float, dec: float, radius: float, *not_null: str, top: int | None = 100_000, order: str = "obsid", ra_column: str = "s_ra", dec_column: str = "s_dec") -> DataFrame:
    """Rows in a box of coordinates, with given columns not null; the first ``top`` by ``order``, all for None."""
    found = df.where(F.col(ra_column).between(ra - radius, ra + radius) & F.col(dec_column).between(dec - radius, dec + radius))
    for c in not_null:
        found = found.where(F.col(c).isNotNull())
    return found if top is None else found.orderBy(order).limit(top)


def keyword_cone(df: DataFrame, columns: list[str], ra: float, dec: float, radius: float = DEFAULT_RADIUS, *, most: int = 20, distinct: bool = True) -> DataFrame:
    """The classic cone request: some columns, without repeated rows, the first ``most`` in their order."""
    found = df.where(within(ra, dec, radius)).select(*columns)
    return (found.distinct() if distinct else found).orderBy(*columns).limit(most)


def of_target(df: DataFrame, target: str, mission: str) -> DataFrame:
    """The rows of one target in one mission, in any case of letters."""
    return df.where((F.lower("target_name") == target.lower()) & (F.upper("obs_collection") == mission.upper()))


def values_equal(df: DataFrame, column: str, value) -> DataFrame:
    """The values, not the rows, of a column that equal a value: one for each row."""
    return df.select(column).where(F.col(column) == F.lit(value))


def ordered(df: DataFrame, columns: list[str], descending: list[bool], most: int | None = None) -> DataFrame:
    """Rows by up to three order columns, each up or down with nulls last, at most ``most``."""
    keys = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in zip(columns[:3], descending)]
    found = df.orderBy(*keys)
    return found if most is None else found.limit(most)


def page_after(df: DataFrame, key: str, last=None, rows: int = PAGE_ROWS) -> DataFrame:
    """The next page by a unique key, after the last key seen: it never sorts the pages before."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(max(0, rows))


def page(df: DataFrame, order: list[Column], number: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """Page ``number`` (from 1) of ``rows`` rows in a total order."""
    if rows <= 0 or number < 1:
        return df.limit(0)
    return df.orderBy(*order).offset((number - 1) * rows).limit(rows)


def paging(df: DataFrame, number: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """One row: page, page size, pages and rows in total."""
    return df.agg(F.count("*").alias("rows_total")).select(F.lit(number).alias("page"), F.lit(rows).alias("page_size"), F.ceil(F.col("rows_total") / rows).alias("pages"), "rows_total")


def group_limit(limit: int | None, page_rows: int) -> int:
    """How many groups come out: the limit, else the page's rows; never negative."""
    return max(0, limit if limit is not None else page_rows)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null in every row (one aggregate over all columns)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[i]])


def resolve(names: DataFrame, text: str) -> DataFrame:
    """Resolver rows of a name in any spelling of case; the radius defaults to 0.02 degrees."""
    hit = (F.lower("searchstring") == text.lower()) | (F.lower("canonicalname") == text.lower())
    return names.where(hit).withColumn("radius", F.coalesce("radius", F.lit(0.02)))


def footprint_cone(region: str) -> tuple[float, float, float] | None:
    """Bounding cone of a region's text."""
    shapes = regions.parse(region)
    return regions.cone(shapes) if shapes else None

