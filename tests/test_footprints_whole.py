import random

from skyquarry.functions import regions
from skyquarry.operators import crossmatch

SOURCE = "POLYGON ICRS 140 -20 170 -20 170 20 140 20"


def test_footprints_that_reach_far_from_their_position(spark):
    data = [
        (1, "POLYGON ICRS 150 10 160 10 160 80 150 80", 155.0, 60.0),  # reaches 50 degrees from s_dec
        (2, "CIRCLE ICRS 155 40 25", 155.0, 40.0),
        (3, "CIRCLE ICRS 155 0 1", 155.0, -85.0),  # a wrong position
        (4, "CIRCLE ICRS 155 40 5", 155.0, 40.0),
        (5, None, 155.0, 5.0),
        (6, None, 155.0, 60.0),
    ]
    df = spark.createDataFrame(data, "obsid long, s_region string, s_ra double, s_dec double")
    want = {"footprint_intersects": {1, 2, 3}, "footprint_contained": {3}, "center_inside": {3, 5}}
    for mode in crossmatch.MODES:
        assert {r.obsid for r in crossmatch.footprint_search(df, SOURCE, mode).collect()} == want[mode], mode


def test_the_band_refuses_no_match():
    rnd = random.Random(3)

    def shape():
        ra, dec = rnd.uniform(0, 360), rnd.choice((-1, 1)) * rnd.uniform(0, 90)
        if rnd.random() < 0.4:
            return f"CIRCLE ICRS {ra} {dec} {rnd.uniform(0.1, 30)}"
        d = rnd.uniform(0.5, 40)
        points = [(ra + x * d, max(-90, min(90, dec + y * d))) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        return "POLYGON ICRS " + " ".join(f"{a % 360} {b}" for a, b in points)

    polar = ["POLYGON ICRS 0 80 90 80 180 80 270 80", "CIRCLE ICRS 10 90 1", "CIRCLE ICRS 200 89 3", "CIRCLE ICRS 0 95 1"]
    texts = [*polar, *(shape() for _ in range(120))]
    found = 0
    for a in map(regions.parse, texts):
        for b in texts:
            for mode in ("footprint_intersects", "footprint_contained"):
                plain = crossmatch.match_footprint(a, b, mode)
                found += plain
                assert crossmatch.match_footprint(a, b, mode, band=regions.band(a)) == plain, (a, b, mode)
    assert found > 500
