import math
import random

from conftest import rows

from skyquarry.functions import regions
from skyquarry.operators.nearby import near_pairs, points_in_regions

NAN = float("nan")


def sphere_points(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            ra, dec = rnd.uniform(0, 360), rnd.uniform(-90, 90)
        elif kind == 1:
            ra, dec = rnd.choice([0.0, 359.999, 0.3, -0.2, 720.1]), rnd.uniform(-1, 1)
        elif kind == 2:
            ra, dec = rnd.uniform(0, 360), rnd.choice([1, -1]) * rnd.uniform(89, 90)
        else:
            ra, dec = 40 + rnd.uniform(0, 2), 10 + rnd.uniform(0, 2)
        out.append((i, ra, dec))
    return out


def test_near_against_all_pairs(spark):
    points = sphere_points(500, 1)
    df = spark.createDataFrame(points, "id long, ra double, dec double").repartition(3)
    for r in (0.02, 0.4, 3.0):
        want = {(a[0], b[0]) for i, a in enumerate(points) for b in points[i + 1 :] if regions.separation(*a[1:], *b[1:]) <= r}
        got = rows(near_pairs(df, "id", "ra", "dec", r))
        assert len(got) == len(set(got)) and set(got) == want


def test_near_edges(spark):
    data = [(1, 10.0, 5.0), (1, 10.0, 5.0), (2, 10.0, 5.0), (3, None, 5.0), (4, NAN, 5.0), (5, 10.0, 95.0), (None, 10.0, 5.0), (6, 370.0, 5.0), (7, 10.0, NAN), (8, float("inf"), 5.0)]
    df = spark.createDataFrame(data, "id long, ra double, dec double").selectExpr("*", "1 as strip", "2 as lon", "3 as rid")
    assert set(rows(near_pairs(df, "id", "ra", "dec", 0.001))) == {(1, 2), (1, 6), (2, 6)}
    assert near_pairs(df.limit(0), "id", "ra", "dec", 0.001).count() == 0


def test_near_when_all_share_one_place(spark):
    df = spark.range(300).selectExpr("id", "1.0D as ra", "2.0D as dec")
    assert near_pairs(df, "id", "ra", "dec", 0.001).count() == 300 * 299 // 2


def test_inside_against_all_pairs(spark):
    rnd = random.Random(2)
    points = sphere_points(400, 3)
    texts = []
    for i in range(120):
        _, ra, dec = points[rnd.randrange(len(points))]
        if i % 3 == 0:
            texts.append((i, f"CIRCLE ICRS {ra} {dec} {rnd.uniform(0.1, 3)}"))
        else:
            dec = max(-80, min(80, dec))
            w = rnd.uniform(0.1, 2)
            texts.append((i, " ".join(["POLYGON", *(f"{ra + w * math.cos(t)} {dec + w * math.sin(t)}" for t in (0.1, 1.3, 2.9, 4.4))])))
    texts += [(900, "POLYGON 1 2 3"), (901, None), (902, "POSITION 1 2"), (903, ""), (904, "CIRCLE 1 2"), (905, "circle fk5 359.9 0.1 0.5 polygon 10 10 11 10 11 11 10 11 10 10")]
    want = {(p[0], i) for i, t in texts for p in points if (s := regions.parse(t)) and abs(p[2]) <= 90 and regions.holds(s, p[1] % 360, p[2])}
    a = spark.createDataFrame(points, "id long, ra double, dec double")
    b = spark.createDataFrame(texts + texts[:5], "rid long, reg string")
    got = rows(points_in_regions(a, "id", "ra", "dec", b, "rid", "reg"))
    assert len(got) == len(set(got)) and set(got) == want
    assert points_in_regions(a.limit(0), "id", "ra", "dec", b, "rid", "reg").count() == 0
    assert points_in_regions(a, "id", "ra", "dec", b.limit(0), "rid", "reg").count() == 0


def test_a_crowded_strip_spreads_over_partitions(spark):
    """A third of all rows within one strip: its cells go to many tasks, and no pair at their borders is lost or doubled."""
    import numpy as np
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(7)
    r = 2 / 3600
    hot = [(i, float(rnd.uniform(0, 360)), 10.0 + float(rnd.uniform(0, r))) for i in range(4000)]
    hot += [(4000 + i, p[1] + 0.9 * r, p[2]) for i, p in enumerate(hot[:500])]
    cold = [(10_000 + i, float(rnd.uniform(0, 360)), float(rnd.uniform(-89, 89))) for i in range(6000)]
    df = spark.createDataFrame(hot + cold, "id long, ra double, dec double")
    got = near_pairs(df, "id", "ra", "dec", r)
    found = [tuple(x) for x in got.collect()]
    by = sorted(hot + cold, key=lambda p: p[1] % 360)
    want = set()
    for i, a in enumerate(by):
        for step in range(1, len(by)):
            b = by[(i + step) % len(by)]
            if (b[1] - a[1]) % 360 > 0.05:
                break
            if regions.separation(*a[1:], *b[1:]) <= r:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    dec = {p[0]: p[2] for p in by}
    low = lambda pairs: {x for x in pairs if abs(dec[x[0]]) < 80}  # noqa: E731 - nearer to a pole 0.05 degrees are no window
    assert len(found) == len(set(found)) and low(found) == low(want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        where = got.withColumn("part", F.spark_partition_id()).where("id_a < 5000").select("part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert where >= 2
