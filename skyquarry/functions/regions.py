"""Footprints written as text (``CIRCLE`` and ``POLYGON`` shapes): parsing and plain-Python geometry.

One parser serves every operator. A text that can't be read whole as circles and polygons is no region.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Shape:
    """A circle (one vertex and a radius) or a polygon (radius 0); all in degrees."""

    vertices: tuple[tuple[float, float], ...]
    radius: float = 0.0

    @property
    def is_circle(self) -> bool:
        return self.radius > 0


def _number(token: str) -> float | None:
    try:
        value = float(token)
    except ValueError:
        return None
    return value if "_" not in token else None


def parse(text: str | None) -> list[Shape] | None:
    """Shapes of a region, or None. Keywords in any case, an optional frame word, several shapes."""
    tokens = (text or "").split()
    if not tokens:
        return None
    shapes, at = [], 0
    while at < len(tokens):
        word = tokens[at].upper()
        if word not in ("CIRCLE", "POLYGON"):
            return None
        at += 1
        if at < len(tokens) and _number(tokens[at]) is None:
            at += 1
        numbers: list[float] = []
        while at < len(tokens) and tokens[at].upper() not in ("CIRCLE", "POLYGON") and not (word == "CIRCLE" and len(numbers) == 3):
            value = _number(tokens[at])
            if value is None or not math.isfinite(value):
                return None
            numbers.append(value)
            at += 1
        if word == "CIRCLE":
            if len(numbers) != 3 or not numbers[2] > 0:
                return None
            shapes.append(Shape(((numbers[0], numbers[1]),), numbers[2]))
        else:
            if len(numbers) % 2:
                return None
            points = list(zip(numbers[::2], numbers[1::2]))
            if points and points[0] == points[-1]:
                points.pop()
            if len(points) < 3:
                return None
            shapes.append(Shape(tuple(points)))
    return shapes


def separation(ra1: float, dec1: float, ra2: float, dec2: float) -> float:
    """Degrees between two positions (haversine)."""
    a, b = math.radians(dec1), math.radians(dec2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(ra2 - ra1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(max(0.0, h)))))


def centre(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Spherical mean: direction of the sum of unit vectors."""
    x = y = z = 0.0
    for ra, dec in points:
        a, d = math.radians(ra), math.radians(dec)
        x += math.cos(d) * math.cos(a)
        y += math.cos(d) * math.sin(a)
        z += math.sin(d)
    return math.degrees(math.atan2(y, x)) % 360, math.degrees(math.atan2(z, math.hypot(x, y)))


def samples(shapes: list[Shape], interior: bool = True) -> list[tuple[float, float]]:
    """Four cardinal points of every circle, the vertices of every polygon and, if asked, the centres."""
    out = []
    for s in shapes:
        if s.is_circle:
            (ra, dec), r = s.vertices[0], s.radius
            step = r / max(1e-6, math.cos(math.radians(dec)))
            out += [(ra, max(-90.0, min(90.0, dec + r))), (ra, max(-90.0, min(90.0, dec - r))), ((ra + step) % 360, dec), ((ra - step) % 360, dec)]
            middle = (ra, dec)
        else:
            out += list(s.vertices)
            middle = centre(list(s.vertices))
        if interior:
            out.append(middle)
    return out


def cone(shapes: list[Shape]) -> tuple[float, float, float]:
    """Bounding cone (ra, dec, radius) of sample points."""
    points = samples(shapes)
    ra, dec = centre(points)
    return ra, dec, max(1e-6, max(separation(ra, dec, *p) for p in points))


def reach(shapes: list[Shape]) -> tuple[float, float, float]:
    """A cone (ra, dec, radius) that surely holds every point of every shape."""
    ra, dec = centre([v for s in shapes for v in s.vertices])
    return ra, dec, 1e-6 + max(separation(ra, dec, *v) + s.radius for s in shapes for v in s.vertices)


def band(shapes: list[Shape]) -> tuple[float, float]:
    """Declinations between which all sample points and edges lie, a little widened; all if one is impossible.

    Edges are straight in right ascension and declination, so a polygon's vertices bound it.
    """
    found = [dec for _, dec in samples(shapes)]
    if any(abs(dec) > 90 for s in shapes for _, dec in s.vertices):
        return -math.inf, math.inf
    return min(found) - 1e-6, max(found) + 1e-6


def _wrapped(degrees: float) -> float:
    return (degrees + 180.0) % 360.0 - 180.0


def _flat(points, ra0: float, dec0: float) -> list[tuple[float, float]]:
    scale = math.cos(math.radians(dec0))
    return [(_wrapped(ra - ra0) * scale, dec - dec0) for ra, dec in points]


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(p, a, b) -> bool:
    eps = 1e-9
    if abs(_turn(a, b, p)) >= eps:
        return False
    return min(a[0], b[0]) - eps <= p[0] <= max(a[0], b[0]) + eps and min(a[1], b[1]) - eps <= p[1] <= max(a[1], b[1]) + eps


def shape_holds(shape: Shape, ra: float, dec: float) -> bool:
    """Circle by separation; polygon by crossing parity in the plane tangent at the point, edges included."""
    if shape.is_circle:
        return separation(*shape.vertices[0], ra, dec) <= shape.radius + 1e-9
    middle = centre(list(shape.vertices))
    if separation(*middle, ra, dec) > 1e-6 + max(separation(*middle, *v) for v in shape.vertices):
        return False  # on the far side of the sphere the plane would show the polygon turned inside out
    flat = _flat(shape.vertices, ra, dec)
    inside = False
    for a, b in zip(flat, flat[-1:] + flat[:-1]):
        if _on((0.0, 0.0), a, b):
            return True
        if (a[1] > 0) != (b[1] > 0) and a[0] - a[1] * (b[0] - a[0]) / (b[1] - a[1]) > 0:
            inside = not inside
    return inside


def holds(shapes: list[Shape], ra: float, dec: float) -> bool:
    return any(shape_holds(s, ra, dec) for s in shapes)


def _edges(shapes: list[Shape]):
    for s in shapes:
        if not s.is_circle:
            yield from zip(s.vertices, s.vertices[1:] + s.vertices[:1])


def _crosses(a, b, c, d) -> bool:
    a, b, c, d = _flat((a, b, c, d), *centre([a, b, c, d]))
    if _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0:
        return True
    return _on(c, a, b) or _on(d, a, b) or _on(a, c, d) or _on(b, c, d)


def overlap(one: list[Shape], two: list[Shape]) -> bool:
    """Sample points of either inside the other, circles by their centres, or crossing edges."""
    if any(holds(two, *p) for p in samples(one)) or any(holds(one, *p) for p in samples(two)):
        return True
    for a in (s for s in one if s.is_circle):
        for b in (s for s in two if s.is_circle):
            if separation(*a.vertices[0], *b.vertices[0]) <= a.radius + b.radius + 1e-9:
                return True
    return any(_crosses(*e, *f) for e in _edges(one) for f in _edges(two))


def contained(outer: list[Shape], inner: list[Shape]) -> bool:
    """All sample points of ``inner`` inside ``outer``."""
    return all(holds(outer, *p) for p in samples(inner))


def area(shapes: list[Shape]) -> float | None:
    """Square degrees: caps for circles, fans of spherical triangles for polygons; None unless positive."""
    total = 0.0
    for s in shapes:
        if s.is_circle:
            total += 2 * math.pi * (1 - math.cos(math.radians(s.radius)))
            continue
        fan = 0.0
        first = s.vertices[0]
        for b, c in zip(s.vertices[1:], s.vertices[2:]):
            sides = [math.radians(separation(*p, *q)) for p, q in ((b, c), (first, c), (first, b))]
            half = sum(sides) / 2
            product = math.tan(half / 2)
            for side in sides:
                product *= math.tan((half - side) / 2)
            fan += 4 * math.atan(math.sqrt(product)) if product > 0 else 0.0
        total += abs(fan)
    total *= (180 / math.pi) ** 2
    return total if math.isfinite(total) and total > 0 else None
