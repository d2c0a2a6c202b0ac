"""Joins of positions with positions and of footprints with footprints, by zones of declination."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.functions import regions, sphere


def crossmatch(targets: DataFrame, target: tuple[str, str, str], catalog: DataFrame, entry: tuple[str, str, str], radius: Column | float, *, zone_deg: float = 0.5) -> DataFrame:
    """(target key, entry key, separation in degrees) of entries within each target's own radius.

    The sky is cut into zones of declination and each zone into cells of right ascension about as wide as
    it is high. An entry is in one cell, a target is copied to every cell it reaches; they join on (zone,
    cell), so a crowded zone is many keys and the candidates of a pair are neighbours. Cells count modulo
    the turn at 360 and a target near a pole reaches all cells. Rows without a position or with an
    impossible declination make no pair. ``zone_deg`` should be near the usual radius: smaller cells mean
    more copies of targets, larger ones more candidates.
    """
    tk, tr, td = target
    ek, er, ed = entry
    last = math.ceil(180 / zone_deg) - 1
    zone = lambda d: F.least(F.floor((d + 90) / zone_deg), F.lit(last))
    # cells of a zone, by the cosine at its edge nearer to a pole
    edge = F.greatest(F.abs(F.col("zone") * zone_deg - 90), F.abs((F.col("zone") + 1) * zone_deg - 90))
    cells = F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * 360 / zone_deg))
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    a = targets.select(F.col(tk).alias("ta"), sphere.normal_ra(F.col(tr)).alias("ra1"), F.col(td).alias("de1"), r.alias("r"))
    a = a.where("de1 between -90 and 90 and not isnan(ra1) and r > 0 and ra1 is not null")
    open_ = F.abs("de1") + F.col("r") >= 89.999
    a = a.withColumn("alpha", F.when(open_, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("r")) / F.cos(F.radians(F.when(open_, 0.0).otherwise(F.col("de1")))))))))
    a = a.withColumn("zone", F.explode(F.sequence(zone(F.greatest(F.lit(-90.0), F.col("de1") - F.col("r"))), zone(F.least(F.lit(90.0), F.col("de1") + F.col("r")))))).withColumn("n", cells)
    low, high = (F.floor((F.col("ra1") + s * (F.col("alpha") + 1e-9)) * F.col("n") / 360) for s in (-1, 1))
    reached = F.when(high - low + 1 >= F.col("n"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.transform(F.sequence(low, high), lambda c: F.pmod(c, F.col("n"))))
    a = a.withColumn("cell", F.explode(reached))
    b = catalog.select(F.col(ek).alias("eb"), sphere.normal_ra(F.col(er)).alias("ra2"), F.col(ed).alias("de2")).where("de2 between -90 and 90 and not isnan(ra2) and ra2 is not null")
    b = b.withColumn("zone", zone(F.col("de2"))).withColumn("cell", F.least(F.floor(F.col("ra2") * cells / 360), cells - 1))
    turn = F.abs(F.pmod(F.col("ra2") - F.col("ra1") + 180, F.lit(360.0)) - 180)
    distance = sphere.separation(F.col("ra1"), F.col("de1"), F.col("ra2"), F.col("de2"))
    near = F.abs(F.col("de2") - F.col("de1")) <= F.col("r") + 1e-9
    return a.join(b, ["zone", "cell"]).where(near & (turn <= F.col("alpha") + 1e-9)).withColumn("separation", distance).where(F.col("separation") <= F.col("r")).select(F.col("ta").alias(tk), F.col("eb").alias(ek), "separation")


#: Ways in which a candidate footprint matches a source footprint.
MODES = ("center_inside", "footprint_intersects", "footprint_contained")


def match_footprint(source: list[regions.Shape], candidate: str | None, mode: str, ra: float | None = None, dec: float | None = None, band: tuple[float, float] | None = None) -> bool:
    """One candidate against a parsed source. Without a readable footprint only its position can match.

    ``band``, the source's declinations, spares the geometry of footprints that lie outside.
    """
    shapes = regions.parse(candidate)
    if mode == "center_inside":
        if shapes:
            ra, dec = regions.cone(shapes)[:2]
        elif ra is None or dec is None or ra != ra or dec != dec or abs(dec) > 90:
            return False
        return regions.holds(source, ra, dec)
    if not shapes:
        return False
    if band:
        low, high = regions.band(shapes)
        if low > band[1] or high < band[0]:
            return False
    return regions.overlap(source, shapes) if mode == "footprint_intersects" else regions.contained(source, shapes)


def footprint_search(df: DataFrame, region: str, mode: str = "footprint_intersects") -> DataFrame:
    """Rows whose footprint matches a region: the exact test in Arrow batches, over all rows.

    Footprints whose own declinations (``regions.band``) don't meet those of the region are refused
    first; how far they reach from s_dec doesn't matter. A region that can't be read gives no rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    source = regions.parse(region)
    if not source:
        return df.limit(0)
    band = regions.band(source)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[match_footprint(source, t, mode, a, d, band) for t, a, d in zip(pdf.s_region, pdf.s_ra, pdf.s_dec)]]

    return df.mapInPandas(keep, df.schema)


def region_columns(df: DataFrame, region: str) -> DataFrame:
    """With area (square degrees) and bounding cone of each region; nulls where it can't be read."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf[region]:
                shapes = regions.parse(text)
                rows.append((len(shapes), regions.area(shapes), *regions.cone(shapes)) if shapes else (None,) * 5)
            yield pdf.assign(**dict(zip(("n_shapes", "region_area", "cone_ra", "cone_dec", "cone_radius"), zip(*rows) if rows else [()] * 5)))

    extra = "n_shapes double, region_area double, cone_ra double, cone_dec double, cone_radius double"
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(measure, f"{schema}, {extra}")
