"""Entry points for observation groups: by cone, name or footprint, for one or many missions.

All compose the same plan: the missions' defaults and the caller's choices as filters (in any case of
letters), the position, the groups with their products as rows, and the first groups up to a limit.
Filters stand before the grouping, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.functions.text import matches_bands
from skyquarry.operators import crossmatch, groups
from skyquarry.plans import filters, search

#: Fixed value: groups that come out if no limit is given.
GROUP_ROWS = 400


def imagery(
    obs: DataFrame,
    missions: tuple[str, ...] = ("JWST", "HST"),
    *,
    instruments: list[str] | None = None,
    bands: list[str] | None = None,
    calib_levels: list[str] | None = None,
    product_types: list[str] | None = None,
) -> DataFrame:
    """Observations of the missions under their defaults, each of which a caller may replace."""
    chosen = filters.of_missions(list(missions))
    if calib_levels is not None:
        chosen = filters.replace(chosen, calib_levels=tuple(calib_levels))
    if product_types is not None:
        chosen = filters.replace(chosen, product_types=tuple(product_types))
    found = obs.where(chosen.predicate())
    if instruments is not None:
        found = found.where(F.lower("instrument_name").isin([i.lower() for i in instruments]))
    return found.where(matches_bands(F.col("filters"), bands)) if bands else found


def _grouped(found: DataFrame, limit: int | None, page_rows: int, order: str) -> DataFrame:
    most = search.group_limit(limit, page_rows)
    if most <= 0:  # nothing is read
        return groups.group_products(found.limit(0), order)
    return groups.first_groups(groups.group_products(found, order), most)


def by_cone(obs: DataFrame, ra: float, dec: float, radius: float, missions=("JWST", "HST"), *, limit: int | None = None, page_rows: int = GROUP_ROWS, order: str = "filter", **choices) -> DataFrame:
    """Products, as rows with group and position, of the groups within a cone."""
    return _grouped(imagery(obs, missions, **choices).where(search.within(ra, dec, radius)), limit, page_rows, order)


def by_name(obs: DataFrame, names: DataFrame, text: str, missions=("JWST", "HST"), *, radius: float | None = None, limit: int | None = None, page_rows: int = GROUP_ROWS, order: str = "filter", **choices) -> DataFrame:
    """The same around a name: every resolver row of it gives a cone of its radius (0.02 degrees by default).

    The name's cones meet the observations by a crossmatch, so no coordinate is fetched to the driver.
    """
    places = search.resolve(names, text)
    cones = places.select("lookup_id", "ra", "decl", F.lit(radius).cast("double").alias("radius") if radius is not None else F.col("radius"))
    found = imagery(obs, missions, **choices)
    hits = crossmatch.crossmatch(cones, ("lookup_id", "ra", "decl"), found, ("obsid", "s_ra", "s_dec"), F.col("radius")).select("obsid").distinct()
    return _grouped(found.join(hits, "obsid", "left_semi"), limit, page_rows, order)


def by_footprint(obs: DataFrame, region: str, mode: str = "footprint_intersects", missions=("JWST", "HST"), *, limit: int | None = None, page_rows: int = GROUP_ROWS, order: str = "filter", **choices) -> DataFrame:
    """The same for footprints that match a region; a group left without products is gone."""
    return _grouped(crossmatch.footprint_search(imagery(obs, missions, **choices), region, mode), limit, page_rows, order)


def science_images(obs: DataFrame, ra: float, dec: float, radius: float, choice: filters.Imagery = filters.SCIENCE) -> DataFrame:
    """The earliest observation of each filter among the imagery of a cone."""
    return groups.first_per_filter(obs.where(choice.predicate() & search.within(ra, dec, radius)))


def science_images_at(obs: DataFrame, names: DataFrame, text: str, choice: filters.Imagery = filters.SCIENCE) -> DataFrame:
    """The same around a name."""
    found = obs.where(choice.predicate())
    hits = crossmatch.crossmatch(search.resolve(names, text), ("lookup_id", "ra", "decl"), found, ("obsid", "s_ra", "s_dec"), F.col("radius")).select("obsid").distinct()
    return groups.first_per_filter(found.join(hits, "obsid", "left_semi"))


def science_images_in(obs: DataFrame, region: str, mode: str = "footprint_intersects", choice: filters.Imagery = filters.SCIENCE) -> DataFrame:
    """The earliest observation of each filter among those whose footprint matches a region.

    Footprints are tested before the choice, so a filter whose earliest observation misses the region is kept.
    """
    return groups.first_per_filter(crossmatch.footprint_search(obs.where(choice.predicate()), region, mode))
