"""Points near points and points in regions (problem 2).

Both are sweeps over strips of latitude, each cut into cells of longitude. Rows are range-partitioned by
strip and cell; both overlap (a row that reaches into the next strip or cell is copied there), and a cell is
sorted by longitude inside its partition. A sweep then reads the cells in longitude order and keeps only
the rows still within reach as its active set, so a task holds one batch and one window. A strip in which
rows crowd is many cells and spreads over as many partitions as it needs. Candidates are verified by the
exact distance or the exact shape. Each pair has one owner: the strip of its upper point and the cell of its
right one (near), the strip and cell of the position (inside).

Footprints are read once: the borders of their partitions come from a cheap look at the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.functions import regions
from skyquarry.session import usable

#: Candidate pairs verified at once; bounds a task's memory in dense fields.
BLOCK = 1_000_000
_KEY = 1024.0  # one cell's place on the line of sweep keys; longitudes with wrapped copies stay below 720
#: Cells of a strip are so many windows wide: fewer mean more copies, more mean larger cells.
CELL_WINDOWS = 32
_CELLS = 1 << 32


def _window(strip, height: float, radius: float):
    """Widest difference in longitude (degrees) of two points within ``radius`` with one of them in ``strip``."""
    low = strip * height - 90.0
    top = np.maximum(np.abs(low - radius), np.abs(low + height + radius))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = math.sin(math.radians(radius) / 2) / np.cos(np.radians(np.minimum(top, 89.9999)))
        return np.where((top >= 89.9) | (x >= 1), 180.0, np.minimum(180.0, 2 * np.degrees(np.arcsin(np.minimum(1.0, x))) + 1e-6))


def _window_column(strip: Column, height: float, radius: float) -> Column:
    low = strip * height - 90.0
    top = F.greatest(F.abs(low - radius), F.abs(low + height + radius))
    x = F.lit(math.sin(math.radians(radius) / 2)) / F.cos(F.radians(F.least(top, F.lit(89.9999))))
    wide = F.least(F.lit(180.0), 2 * F.degrees(F.asin(F.least(F.lit(1.0), x))) + 1e-6)
    return F.when((top >= 89.9) | (x >= 1), F.lit(180.0)).otherwise(wide)


def _expand(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j) with lo[i] <= j < hi[i]; a block may exceed BLOCK by one row's pairs."""
    counts = np.maximum(hi - lo, 0)
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = counts[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start:stop], n)
        yield i, j
        start = stop


def _sweep_near(height: float, radius: float):
    limit = math.sin(math.radians(radius) / 2) ** 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            if not len(pdf):
                continue
            old = 0 if kept is None else len(kept)
            if old:
                pdf = pd.concat([kept, pdf], ignore_index=True)
            group, lon, lat = pdf.group.to_numpy(), pdf.lon.to_numpy(), pdf.lat.to_numpy()
            # copies into the next strip, the next cell and past the turn: two of one kind meet where they come from
            ids, copy = pdf.rid.to_numpy(), pdf.copy_of.to_numpy()
            window = _window(group // _CELLS, height, radius)
            key = np.cumsum(np.r_[0, group[1:] != group[:-1]]) * _KEY + lon
            lo = np.maximum(np.arange(len(pdf)) + 1, old)
            hi = np.searchsorted(key, key + window + 1e-7, "right")
            a, c = np.radians(lat), np.cos(np.radians(lat))
            for i, j in _expand(lo, hi):
                ok = ((copy[i] & copy[j]) == 0) & (ids[i] != ids[j]) & ((copy[j] & 4 == 0) | (lon[j] - lon[i] < 180.0))
                i, j = i[ok], j[ok]
                h = np.sin((a[i] - a[j]) / 2) ** 2 + c[i] * c[j] * np.sin(np.radians(lon[i] - lon[j]) / 2) ** 2
                near = h <= limit
                i, j = i[near], j[near]
                if len(i):
                    yield pd.DataFrame({"id_a": np.minimum(ids[i], ids[j]), "id_b": np.maximum(ids[i], ids[j])})
            kept = pdf[(group == group[-1]) & (lon + window + 1e-7 >= lon[-1])]

    return run


def near_pairs(df: DataFrame, key: str, ra: str, dec: str, radius_deg: float, *, strip_deg: float | None = None) -> DataFrame:
    """(id_a, id_b) of every two keys at most ``radius_deg`` apart on the sphere, the smaller first.

    Right ascensions count modulo 360. Rows with a null key, a null, NaN or infinite coordinate or a
    declination beyond 90 degrees make no pair. Rows that repeat a key count once; ties at the limit
    count as near. Extra columns are ignored and an empty table gives no pairs.
    """
    if not 0 < radius_deg < 90:
        raise ValueError("radius_deg must lie between 0 and 90")
    height = max(strip_deg or 0.0, 4 * radius_deg)
    points = (
        df.select(F.col(key).alias("rid"), F.pmod(F.col(ra).cast("double"), F.lit(360.0)).alias("lon"), F.col(dec).cast("double").alias("lat"))
        .where(F.col("rid").isNotNull() & usable("lon") & usable("lat") & (F.abs("lat") <= 90))
        .dropDuplicates(["rid"])
    )
    own = F.floor((F.col("lat") + 90.0) / height)
    above = F.col("lat") + radius_deg + 1e-9 >= (own + 1) * height - 90.0
    place = lambda strip, copy: F.struct(strip.alias("strip"), F.lit(copy).alias("copy"))
    placed = points.select("rid", "lon", "lat", F.explode(F.array_compact(F.array(place(own, 0), F.when(above, place(own + 1, 1))))).alias("p"))
    placed = placed.select("rid", "lon", "lat", "p.strip", "p.copy").withColumn("window", _window_column(F.col("strip"), height, radius_deg))
    turned = F.when(F.col("lon") <= F.col("window"), F.array(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0)))
    rows = placed.withColumn("turn", F.explode(turned)).withColumn("lon", F.col("lon") + F.when(F.col("turn") == 4, 360.0).otherwise(0.0))
    width = CELL_WINDOWS * F.col("window")
    cell = F.floor(F.col("lon") / width)
    right = F.col("lon") + F.col("window") + 1e-7 >= (cell + 1) * width
    at = lambda cell, copy: F.struct((F.col("strip") * _CELLS + cell).alias("group"), (F.col("copy") + F.col("turn") + copy).alias("copy_of"))
    rows = rows.select("rid", "lon", "lat", F.explode(F.array_compact(F.array(at(cell, 0), F.when(right, at(cell + 1, 2))))).alias("g")).select("rid", "lon", "lat", "g.*")
    cells = rows.repartitionByRange("group").sortWithinPartitions("group", "lon")
    kind = dict(points.dtypes)["rid"]
    return cells.mapInPandas(_sweep_near(height, radius_deg), f"id_a {kind}, id_b {kind}")


def _pack(shapes: list[regions.Shape]) -> bytes:
    """Shapes as doubles: for each the number of vertices, the radius and the vertices."""
    out: list[float] = []
    for s in shapes:
        out += [len(s.vertices), s.radius]
        for v in s.vertices:
            out += v
    return np.array(out).tobytes()


def _strips_of(height: float, width: float):
    top, last = math.ceil(180.0 / height) - 1, math.ceil(360.0 / width) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, text in zip(pdf.rid, pdf.region):
                shapes = regions.parse(text)
                if not shapes or any(abs(v[1]) > 90 for s in shapes for v in s.vertices):
                    continue
                ra, dec, r = regions.reach(shapes)
                if r >= 90 or abs(dec) + r >= 89.9:
                    parts = [(0.0, 360.0)]
                else:
                    half = math.degrees(math.asin(min(1.0, math.sin(math.radians(r)) / math.cos(math.radians(dec))))) + 1e-6
                    parts = [(ra - half, ra + half)]
                    if ra - half < 0:
                        parts = [(0.0, ra + half), (ra - half + 360, 360.0)]
                    elif ra + half > 360:
                        parts = [(ra - half, 360.0), (0.0, ra + half - 360)]
                packed = _pack(shapes)
                low = max(0, math.floor((max(-90.0, dec - r) + 90) / height))
                high = min(top, math.floor((min(90.0, dec + r) + 90) / height))
                for strip in range(low, high + 1):
                    for lo, hi in parts:
                        for cell in range(math.floor(lo / width), min(last, math.floor(hi / width)) + 1):
                            out.append((strip * _CELLS + cell, rid, lo, hi, packed))
            yield pd.DataFrame(out, columns=["group", "rid", "lon", "upto", "shapes"])

    return run


class _Shapes:
    """Edges and circles of packed regions as flat arrays, with where each region's own begin."""

    def __init__(self, packed):
        circles, edges, circle_at, edge_at, polygon, n_edges = [], [], [0], [0], 0, 0
        for each in packed:
            flat, at = np.frombuffer(each), 0
            while at < len(flat):
                n, radius = int(flat[at]), flat[at + 1]
                points = flat[at + 2 : at + 2 + 2 * n].reshape(n, 2)
                if radius > 0:
                    circles.append((*points[0], radius))
                else:
                    edges.append(np.column_stack([points, np.roll(points, -1, 0), np.full(n, polygon)]))
                    polygon, n_edges = polygon + 1, n_edges + n
                at += 2 + 2 * n
            circle_at.append(len(circles))
            edge_at.append(n_edges)
        self.circles = np.array(circles).reshape(-1, 3)
        self.edges = np.concatenate(edges) if edges else np.zeros((0, 5))
        self.circle_at, self.edge_at = np.array(circle_at), np.array(edge_at)

    def holds(self, lon: np.ndarray, lat: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Exact test of pairs of a position and one of the regions."""
        hit = np.zeros(len(lon), bool)
        for k, c in _expand_all(self.circle_at[region], self.circle_at[region + 1]):
            y, x = np.radians(lat[k]), np.radians(self.circles[c])
            h = np.sin((y - x[:, 1]) / 2) ** 2 + np.cos(y) * np.cos(x[:, 1]) * np.sin((np.radians(lon[k]) - x[:, 0]) / 2) ** 2
            hit[k[2 * np.degrees(np.arcsin(np.minimum(1, np.sqrt(h)))) <= self.circles[c, 2] + 1e-9]] = True
        for k, e in _expand_all(self.edge_at[region], self.edge_at[region + 1]):
            scale = np.cos(np.radians(lat[k]))
            ax, bx = (((self.edges[e, x] - lon[k] + 180) % 360 - 180) * scale for x in (0, 2))
            ay, by = (self.edges[e, y] - lat[k] for y in (1, 3))
            cross = (ay > 0) != (by > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cross &= ax - ay * (bx - ax) / (by - ay) > 0
            # parity of each polygon of each pair
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (self.edges[e[1:], 4] != self.edges[e[:-1], 4])])
            odd = np.add.reduceat(cross, first) % 2 == 1
            hit[k[first][odd]] = True
            eps = 1e-9
            edge = (np.abs((bx - ax) * -ay + (by - ay) * ax) < eps) & (np.minimum(ax, bx) <= eps) & (np.maximum(ax, bx) >= -eps) & (np.minimum(ay, by) <= eps) & (np.maximum(ay, by) >= -eps)
            hit[k[edge]] = True
        return hit


def _expand_all(lo: np.ndarray, hi: np.ndarray):
    return (block for block in _expand(lo, hi) if len(block[0]))


def _sweep_inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept = None
    for pdf in batches:
        if not len(pdf):
            continue
        point = pdf.upto.isna()
        dots, areas = pdf[point], pdf[~point]
        if kept is not None:
            areas = pd.concat([kept, areas], ignore_index=True)
        if len(dots) and len(areas):
            # cells by their place among those of the batch
            cells = np.unique(np.r_[dots.group.to_numpy(), areas.group.to_numpy()])
            at = np.searchsorted(cells, dots.group.to_numpy()) * _KEY + dots.lon.to_numpy()
            base = np.searchsorted(cells, areas.group.to_numpy()) * _KEY
            lo = np.searchsorted(at, base + areas.lon.to_numpy() - 1e-9, "left")
            hi = np.searchsorted(at, base + areas.upto.to_numpy() + 1e-9, "right")
            lon, lat, dot = dots.lon.to_numpy(), dots.lat.to_numpy(), dots.rid.to_numpy()
            rid, packed = areas.rid.to_numpy(), areas.shapes.to_numpy()
            for i, j in _expand(lo, hi):
                if len(i):
                    first = np.r_[True, i[1:] != i[:-1]]
                    ok = _Shapes(packed[i[first]]).holds(lon[j], lat[j], np.cumsum(first) - 1)
                    yield pd.DataFrame({"id_a": dot[j[ok]], "id_b": rid[i[ok]]})
        last = pdf.iloc[-1]
        kept = areas[(areas.group == last.group) & (areas.upto >= last.lon - 1e-9)]


def points_in_regions(
    points: DataFrame, point_key: str, ra: str, dec: str, areas: DataFrame, area_key: str, region: str, *, strip_deg: float = 0.5, cell_deg: float = 2.0
) -> DataFrame:
    """(id_a = point, id_b = region's key) of every position inside any shape of a region.

    A position is in one cell of one strip; a region is copied to the cells that it may reach. Positions with a
    missing or impossible coordinate, null keys and texts that are no region (or have a vertex beyond a
    pole) give nothing. A pair comes out once, however often its rows are repeated; a key with several
    regions holds what any of them holds. Keys must be whole numbers.
    """
    top, last = math.ceil(180.0 / strip_deg) - 1, math.ceil(360.0 / cell_deg) - 1
    strip = lambda lat: F.least(F.floor((lat + 90.0) / strip_deg), F.lit(top))
    group = strip(F.col("lat")) * _CELLS + F.least(F.floor(F.col("lon") / cell_deg), F.lit(last))
    dots = (
        points.select(F.col(point_key).alias("rid"), F.pmod(F.col(ra).cast("double"), F.lit(360.0)).alias("lon"), F.col(dec).cast("double").alias("lat"))
        .where(F.col("rid").isNotNull() & usable("lon") & usable("lat") & (F.abs("lat") <= 90))
        .dropDuplicates(["rid"])
        .withColumn("group", group)
    )
    texts = areas.select(F.col(area_key).alias("rid"), F.col(region).alias("region")).where(
        F.col("rid").isNotNull() & F.upper("region").rlike("CIRCLE|POLYGON")
    )
    shapes = texts.mapInPandas(_strips_of(strip_deg, cell_deg), "group long, rid long, lon double, upto double, shapes binary")
    both = dots.select("group", F.col("rid").cast("long"), "lon", "lat", F.lit(None).cast("double").alias("upto"), F.lit(None).cast("binary").alias("shapes")).unionByName(
        shapes.select("group", "rid", "lon", F.lit(None).cast("double").alias("lat"), "upto", "shapes")
    )
    # borders of the ranges from the first position in each text: they decide the balance, never the result
    found = F.split(F.regexp_replace("region", r"(?is)^\s*(?:circle|polygon)\s+(?:[a-z]\S*\s+)?(\S+)\s+(\S+).*$", "$1 $2"), " ")
    lon, lat = F.get(found, F.lit(0)).try_cast("double"), F.get(found, F.lit(1)).try_cast("double")
    rough = texts.where(lat.between(-90, 90)).select(F.pmod(lon, F.lit(360.0)).alias("lon"), lat.alias("lat")).select(group.alias("group"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = rough.agg(F.percentile_approx("group", [k / parts for k in range(1, parts)], 10 * parts).alias("b")).first().b if parts > 1 else None
    borders = sorted(set(borders or []))  # numbers of partitions less one
    index = F.lit(0)
    if borders:
        index = F.size(F.filter(F.lit(borders), lambda x: x <= F.col("group")))
    rows = both.repartitionById(len(borders) + 1, index).sortWithinPartitions("group", "lon", F.col("upto").desc_nulls_last())
    return rows.mapInPandas(_sweep_inside, "id_a long, id_b long").distinct()
