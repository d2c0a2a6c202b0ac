"""Spherical geometry as Column expressions; all angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SQUARE_DEGREES = (180 / math.pi) ** 2


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle between two positions (haversine, clamped)."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return 2 * F.degrees(F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), h)))))


def dot_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle between two positions from the dot product, in radians."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    dot = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(F.radians(ra2 - ra1))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def normal_ra(ra: Column) -> Column:
    """Right ascension in [0, 360)."""
    return F.pmod(ra, F.lit(360.0))


def wrapped(degrees: Column) -> Column:
    """Angle in [-180, 180]."""
    rest = degrees % 360
    return F.when(rest > 180, rest - 360).when(rest < -180, rest + 360).otherwise(rest)


def circle_area(radius: Column) -> Column:
    """Square degrees of a cap."""
    return 2 * math.pi * (1 - F.cos(F.radians(radius))) * SQUARE_DEGREES


def polygon_area(vertices: Column) -> Column:
    """Square degrees of a polygon, an array of struct(ra, dec): a fan of spherical triangles (L'Huilier).

    Null for fewer than three vertices or an area that is not positive.
    """

    def side(p: Column, q: Column) -> Column:
        return F.radians(separation(p["ra"], p["dec"], q["ra"], q["dec"]))

    def triangle(k: Column) -> Column:
        first, b, c = F.get(vertices, F.lit(0)), F.get(vertices, k), F.get(vertices, k + 1)
        sides = F.array(side(b, c), side(first, c), side(first, b))
        half = F.aggregate(sides, F.lit(0.0), lambda a, s: a + s) / 2
        product = F.aggregate(sides, F.tan(half / 2), lambda a, s: a * F.tan((half - s) / 2))
        return F.when(product > 0, 4 * F.atan(F.sqrt(product))).otherwise(0.0)

    fans = F.transform(F.sequence(F.lit(1), F.size(vertices) - 2), triangle)
    total = F.abs(F.aggregate(fans, F.lit(0.0), lambda a, t: a + t)) * SQUARE_DEGREES
    return F.when(F.size(vertices) >= 3, F.when((total > 0) & ~F.isnan(total), total))


def mean_position(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Aggregates: direction of the mean unit vector as (ra, dec)."""
    a, d = F.radians(ra), F.radians(dec)
    x, y, z = F.avg(F.cos(d) * F.cos(a)), F.avg(F.cos(d) * F.sin(a)), F.avg(F.sin(d))
    return normal_ra(F.degrees(F.atan2(y, x))), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
