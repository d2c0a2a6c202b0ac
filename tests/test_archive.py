import math
import struct
import tarfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skyquarry import catalog
from skyquarry.functions import fitsvalues, keys, regions, sphere, text
from skyquarry.operators import crossmatch, groups, products
from skyquarry.plans import filters, search
from skyquarry.sources import fits, sinks, tables


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()], F.lit(0).alias("_"))
    return df.select(column.alias("x")).first().x


def test_region_areas():
    assert regions.area(regions.parse("CIRCLE ICRS 254.28210020 -4.10146178 0.625")) == pytest.approx(1.227172462, abs=1e-9)
    assert regions.area(regions.parse("POLYGON J2000 0 0 1 0 1 1 0 1 0 0")) == pytest.approx(1.0, abs=0.001)
    two = "POLYGON J2000 0 0 1 0 1 1 0 1 0 0 POLYGON ICRS 10 0 11 0 11 1 10 1"
    assert regions.area(regions.parse(two)) == pytest.approx(2.0, abs=0.002)
    for bad in ("", None, "POSITION ICRS 10 20", "POLYGON 1 2 3 4 5", "POLYGON", "CIRCLE 1 2 0", "CIRCLE 1 2", "CIRCLE 1 2 3 4"):
        assert regions.parse(bad) is None


def test_region_predicates():
    unit = regions.parse("POLYGON J2000 0 0 1 0 1 1 0 1 0 0")
    ra, dec, r = regions.cone(unit)
    assert (ra, dec) == pytest.approx((0.5, 0.5), abs=1e-3) and r > 0.7
    assert regions.holds(unit, 0.5, 0.5) and regions.holds(unit, 0, 0.5) and not regions.holds(unit, 2.5, 2.5)
    assert regions.overlap(unit, regions.parse("POLYGON 0.5 0.5 1.5 0.5 1.5 1.5 0.5 1.5"))
    assert not regions.overlap(unit, regions.parse("POLYGON 2 2 3 2 3 3 2 3"))
    big = regions.parse("POLYGON 0 0 2 0 2 2 0 2")
    assert regions.contained(big, regions.parse("POLYGON 0.5 0.5 1 0.5 1 1 0.5 1")) and not regions.contained(big, regions.parse("POLYGON 1.5 1.5 3 1.5 3 3 1.5 3"))
    wrap = regions.parse("POLYGON 359 -1 1 -1 1 1 359 1")
    assert regions.holds(wrap, 0.1, 0) and regions.holds(wrap, 359.5, 0.5) and not regions.holds(wrap, 180, 0)


def test_sphere_columns(spark):
    corner = "array(named_struct('ra', 0D, 'dec', 0D), named_struct('ra', 1D, 'dec', 0D), named_struct('ra', 1D, 'dec', 1D), named_struct('ra', 0D, 'dec', 1D))"
    got = spark.range(1).select(sphere.polygon_area(F.expr(corner)).alias("x")).first().x
    assert got == pytest.approx(regions.area(regions.parse("POLYGON 0 0 1 0 1 1 0 1")), rel=1e-12)
    assert value(spark, sphere.circle_area(F.lit(0.625))) == pytest.approx(1.2271724616783)
    assert value(spark, sphere.separation(F.lit(359.5), F.lit(0.0), F.lit(0.5), F.lit(0.0))) == pytest.approx(1.0)
    assert value(spark, sphere.dot_separation(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))) == pytest.approx(math.pi / 2)
    assert value(spark, sphere.wrapped(F.lit(350.0))) == -10 and value(spark, sphere.normal_ra(F.lit(-10.0))) == 350


def test_keys(spark):
    for name, want in {"F200W": 200, "F1000W": 1000, "F150W2": 150, "F444W;F405N": 444, "f770w": 770, "CLEAR": keys.NO_WAVELENGTH, "y": 962, "UVM2": 225}.items():
        assert value(spark, keys.filter_wavelength(F.lit(name))) == want
    for collection, oid, want in (
        ("JWST", "jw02666-o007_t004_miri_f1000w", "jw02666-o007_t004_miri"), ("JWST", "jw01783-o004", "jw01783-o004"), ("HST", "hst_10775_62_wfc3_f606w", "hst_10775_62_wfc3"),
        ("HLA", "hst_10775_62_wfpc2_f814w_f606w_wf", "hst_10775_62_wfpc2"), ("PS1", "ps1_f606w", "ps1_f606w"),
    ):
        assert value(spark, keys.group_key(F.lit(collection), F.lit(oid))) == want
    times = [(59000.0, 59001.0, 60000.0, 59000.0), (0.0, 59001.0, 1.0, 59001.0), (0.0, 0.0, 60000.0, 60000.0)]
    for a, b, c, want in times:
        assert value(spark, keys.effective_time(F.lit(a), F.lit(b), F.lit(c))) == want


def test_closest_epoch(spark):
    data = [("F770W", 1, 59777.46), ("F770W", 2, 60659.21), ("F1000W", 3, 59780.0)]
    got = groups.closest_epoch(spark.createDataFrame(data, "filters string, obsid long, t_min double"))
    assert set(rows(got.select("filters", "obsid"))) == {("F770W", 1), ("F1000W", 3)}
    none = spark.createDataFrame([("g", 2, 0.0), ("g", 1, -5.0)], "filters string, obsid long, t_min double")
    assert rows(groups.closest_epoch(none).select("obsid")) == [(1,)]


def test_text(spark):
    assert value(spark, text.path_part(F.lit("NGC 628"), "x")) == "NGC_628" and value(spark, text.path_part(F.lit("__"), "x")) == "x"
    assert value(spark, text.product_locator(F.lit("http://A?a=1&amp;b=%20+C"))) == "http://a?a=1&b= +c"
    assert value(spark, text.product_locator(F.lit("50%zz"))) == "50%zz"
    assert value(spark, text.secure_url(F.lit("http://x/y?a&amp;b"), "https://s")) == "https://x/y?a&b"
    assert value(spark, text.matches_bands(F.lit("F150W;CLEAR"), ["f150w"])) and not value(spark, text.matches_bands(F.lit("F150W;CLEAR"), ["F150W2"])) and value(spark, text.matches_bands(F.lit("x"), []))
    assert value(spark, text.byte_text(F.lit(1_500_000))) == "1.5 MB"


def test_filters():
    assert len(filters.Imagery().filters()) == 4
    assert len(filters.Imagery(regions=("UV",), collections=("HST",), instruments=("x",), bands=("F1",)).filters()) == 8
    assert filters.of_missions(["HST", "SWIFT"]).calib_levels == ("2", "3", "4") and filters.of_missions(["HST"]).collections == ("HLA", "HST")
    assert filters.from_adql("select top 5 a from b where c > 1") == "select a from b where c > 1 limit 5"
    q = filters.Adql("t", ("a", "b")).where("h", ">", "1", "and").where("n", "like", "x%")
    assert q.sql() == "select a,b from t where h > 1 and n like 'x%'"
    assert search.group_limit(25, 400) == 25 and search.group_limit(None, 50) == 50 and search.group_limit(-1, 5) == 0


def test_crossmatch_against_all_pairs(spark):
    from test_nearby import sphere_points

    a, b = sphere_points(150, 8), sphere_points(400, 9)
    left, right = (spark.createDataFrame(x, f"{k} long, ra double, dec double") for x, k in ((a, "a"), (b, "b")))
    got = rows(crossmatch.crossmatch(left, ("a", "ra", "dec"), right, ("b", "ra", "dec"), 1.5).select("a", "b"))
    want = {(p[0], q[0]) for p in a for q in b if regions.separation(*p[1:], *q[1:]) <= 1.5}
    assert len(got) == len(set(got)) and set(got) == want


def test_footprints_and_locators_against_plain(spark, data):
    folder = data()
    obs = spark.read.parquet(f"{folder}/caom_obs.parquet").dropDuplicates(["obsid"])
    source = regions.parse("POLYGON ICRS 140 -20 170 -20 170 20 140 20")
    local = obs.select("obsid", "s_region", "s_ra", "s_dec").toPandas()
    for mode in crossmatch.MODES:
        want = {r.obsid for r in local.itertuples() if crossmatch.match_footprint(source, r.s_region, mode, r.s_ra, r.s_dec)}
        got = {r.obsid for r in crossmatch.footprint_search(obs.select("obsid", "s_region", "s_ra", "s_dec"), "POLYGON ICRS 140 -20 170 -20 170 20 140 20", mode).collect()}
        assert got == want and want
    prods = spark.read.parquet(f"{folder}/caom_products.parquet")
    got = {r.obsid: r.product_id for r in products.match_locators(obs, "dataurl", prods).collect()}
    import pandas as pd

    pp = prods.toPandas()
    by = {k: v for k, v in pp[pp["size"].notna() & pp.datauri.notna()].groupby("obsid")}
    norm = lambda s: __import__("urllib.parse").parse.unquote(s.replace("&amp;", "&")).lower()
    want = {}
    for o in obs.select("obsid", "dataurl").collect():
        if o.dataurl and o.obsid in by:
            url = norm(o.dataurl)
            for p in by[o.obsid].sort_values("product_id").itertuples():
                uri, name = norm(p.datauri), (p.productfilename or "").lower() if not pd.isna(p.productfilename) else ""
                if url == uri or uri in url or url in uri or (name and name in url) or uri.split("url/")[-1] in url:
                    want[o.obsid] = p.product_id
                    break
    assert got == want


def test_merge_and_pair(spark):
    s = "file string, ordinal int, keyword string, value string"
    a = spark.createDataFrame([("f", 0, "BITPIX", "8"), ("f", 1, "TELESCOP", "HST"), ("f", 2, "COMMENT", "one"), ("f", 3, "BITPIX", "9")], s)
    b = spark.createDataFrame([("f", 0, "BITPIX", "-32"), ("f", 1, "COMMENT", "two"), ("f", 2, "EXTNAME", "SCI")], s)
    got = [(r.keyword, r.value) for r in products.merge_headers(a, b).orderBy("ordinal").collect()]
    assert got == [("BITPIX", "-32"), ("TELESCOP", "HST"), ("EXTNAME", "SCI"), ("COMMENT", "one"), ("COMMENT", "two")]
    p = spark.createDataFrame([("f", 1, "science", 2, 2, 1.0), ("f", 2, "weight", 2, 2, 9.0), ("f", 3, "weight", 2, 2, 1.0), ("f", 4, "science", 5, 5, 1.0)], "file string, ext_index int, role string, width int, height int, wcs double")
    assert rows(products.pair_planes(p, lambda x, y: F.coalesce(x == y, F.lit(False)))) == [("f", 1, 3), ("f", 4, None)]
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "address string, size long")
    fresh = spark.createDataFrame([("b", 5, 1), ("b", 7, 2), ("c", 0, 1), ("d", 4, 1)], "address string, size long, at int")
    assert set(rows(products.upsert_sizes(cache, fresh, "at"))) == {("a", 1), ("b", 7), ("d", 4)}


def test_header_values(spark):
    cases = {"42": ("integer", 42), "-32": ("integer", -32), "3.14159": ("double", 3.14159), "1.5e-06": ("double", 1.5e-06), "T": ("bool", True), "'IMAGE   '": ("string", "IMAGE"), "1d": ("string", "1d"), "''": ("string", "''")}
    for raw, (kind, want) in cases.items():
        got = value(spark, fitsvalues.header_value(F.lit(raw)))
        assert got.vtype == kind and {"integer": got.i, "double": got.d, "bool": got.b, "string": got.s}[kind] == want
    w = fitsvalues.wcs({k: F.lit(v) for k, v in {"CRPIX1": 10, "CRPIX2": 20, "CRVAL1": 150, "CRVAL2": 2, "CD1_1": -1e-4, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 1e-4}.items()})
    at = value(spark, fitsvalues.to_world(w, F.lit(9.0), F.lit(19.0)))
    assert (at.ra, at.dec) == (150, 2)
    back = value(spark, fitsvalues.to_pixel(w, F.lit(150.0), F.lit(2.0)))
    assert (back.x, back.y) == pytest.approx((9, 19))
    c = fitsvalues.wcs({k: F.lit(v) for k, v in {"CRPIX1": 1, "CRPIX2": 1, "CRVAL1": 10, "CRVAL2": 20, "CDELT1": 0.25, "CDELT2": 0.5}.items()})
    at = value(spark, fitsvalues.to_world(c, F.lit(2.0), F.lit(4.0)))
    assert (at.ra, at.dec) == (10.5, 22)
    size = lambda axes, **k: value(spark, fitsvalues.data_size(F.lit(k.get("bitpix", -32)), F.array(*[F.lit(a).cast("long") for a in axes]).cast("array<long>"), F.lit(k.get("p")), F.lit(k.get("g")), F.lit(k.get("groups", False))))
    assert size([4654, 4648]) == 86527168 - 86527168 % 4 or size([4654, 4648]) == 4654 * 4648 * 4
    assert size([]) == 0 and size([0, 5, 3], groups=True, bitpix=8) == 15 and size([1 << 40, 1 << 40]) == -1 and size([2], bitpix=7) == -1
    assert value(spark, fitsvalues.padded(F.lit(2881))) == 5760


def header(*cards):
    data = "".join(c.ljust(80) for c in (*cards, "END")).encode()
    return data + b" " * (-len(data) % 2880)


def kv(k, v):
    return f"{k:<8}= {v}"


def image(kind, name, values):
    raw = struct.pack(f">{len(values)}h", *values)
    cards = [kv("XTENSION", "'IMAGE   '") if kind else kv("SIMPLE", "T"), kv("BITPIX", "16"), kv("NAXIS", "2"), kv("NAXIS1", "2"), kv("NAXIS2", str(len(values) // 2)), kv("EXTNAME", f"'{name}'          / a / comment"), kv("BZERO", "1.0"), kv("BLANK", "-1")]
    return header(*cards) + raw + b"\0" * (-len(raw) % 2880)


def test_fits_files(spark, tmp_path):
    primary = header(kv("SIMPLE", "T"), kv("BITPIX", "8"), kv("NAXIS", "0"), "COMMENT  free text")
    (tmp_path / "a.fits").write_bytes(primary + image(1, "WHT", [10, 20, 30, 40]) + image(1, "SCI", [1, 2, 3, -1]))
    (tmp_path / "b.fits").write_bytes(b"<html>no file</html>")
    (tmp_path / "c.fits").write_bytes(primary + image(1, "SCI", [1, 2, 3, 4])[:3000])
    (tmp_path / "d.fits").write_bytes(b"")
    df = fits.read_headers(spark, str(tmp_path))
    got = [(r.path[-6:-5], r.ext_index, r.header_start, r.data_start, r.data_size, r.extname, r.is_image, r.complete) for r in df.orderBy("path", "ext_index").collect()]
    assert got == [
        ("a", 0, 0, 2880, 0, None, False, True), ("a", 1, 2880, 5760, 8, "WHT", True, True), ("a", 2, 8640, 11520, 8, "SCI", True, True),
        ("c", 0, 0, 2880, 0, None, False, True), ("c", 1, 2880, 5760, 8, "SCI", True, True),
    ]
    pixels = fits.planes(spark.read.format("binaryFile").load(str(tmp_path / "a.fits"))).orderBy("ext_index").collect()
    assert pixels[0].pixels == [11, 21, 31, 41] and pixels[1].pixels[:3] == [2, 3, 4] and pixels[1].n_invalid == 1
    with open(tmp_path / "a.fits", "rb") as f:
        size = (tmp_path / "a.fits").stat().st_size
        assert fits.preferred(list(fits.units(f, size))).index == 2 and [u.index for u in fits.units(f, size, stop_at_image=True)] == [0, 1]
    assert fits.card(kv("OBJECT", "'a/b'  / c")).value == "'a/b'"


def test_table_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"fields":[{"name":"a","type":"int"},{"name":"b","type":"string"}],"data":[{"a":1,"b":"x"},{"a":"y"}]}')
    assert rows(tables.read_envelope(spark, str(tmp_path / "e.json"))) == [(1, "x"), (None, None)]
    (tmp_path / "r.json").write_text('{"resolvedCoordinate":[{"canonicalName":"M 31","ra":10.5,"decl":41}]}')
    got = tables.read_envelope(spark, str(tmp_path / "r.json")).first()
    assert (got.canonicalname, got.ra, got.dec, got.resolver) == ("M 31", 10.5, 41.0, "")
    (tmp_path / "l.txt").write_text("filename filter\nx.fits g\n")
    assert tables.read_image_list(spark, str(tmp_path / "l.txt"), "http://h").first().url == "http://hx.fits"
    (tmp_path / "x.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert rows(tables.read_xml(spark, str(tmp_path / "x.xml"), "row")) == [(1,), (2,)]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "l.txt", "in/l.txt")
    assert rows(tables.tar_entries(spark.read.format("binaryFile").load(str(tmp_path / "t.tar.gz"))).select("name", "size")) == [("in/l.txt", 25)]
    typed = tables.typed_observations(spark.createDataFrame([("7", None)], "obsid string, filters string")).first()
    assert (typed.obsid, typed.filters, typed.t_min, typed.mtflag) == (7, "", 0.0, False)
    sinks.write_csv(spark.createDataFrame([(1, 'a "q"')], "i int, t string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').first().t == 'a "q"'
    sinks.write_partitioned(spark.createDataFrame([("NGC 628", "JWST", "o1", "F1;F2", 1)], "target_name string, obs_collection string, obs_id string, filters string, x int"), str(tmp_path / "p"))
    assert (tmp_path / "p/target=NGC_628/collection=JWST/observation=o1/band=F1-F2").is_dir()


def test_streams(spark, data, tmp_path):
    from skyquarry.streaming import arrivals

    folder = data()
    schema = spark.read.parquet(f"{folder}/caom_obs.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.parquet").symlink_to(f"{folder}/caom_obs.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = arrivals.first_deliveries(stream, late="40000 days").select("obsid").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == spark.read.parquet(f"{folder}/caom_obs.parquet").select("obsid").distinct().count()


def test_cone_reaches_the_scan(spark, data):
    """The declination band is pushed to Parquet, and only what the cone leaves is shuffled."""
    plan = catalog.cone_search(spark, data())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(s_dec" in plan and "LessThanOrEqual(s_dec" in plan
    assert plan.rindex("Exchange") < plan.rindex("Filter")  # plans print from the top: the filter lies below the exchange


def test_footprint_far_from_its_centre(spark):
    """A wide footprint whose centre is far outside the region's declinations is found."""
    obs = spark.createDataFrame([(1, "CIRCLE ICRS 155 30 12", 155.0, 30.0), (2, "CIRCLE ICRS 155 60 1", 155.0, 60.0)], "obsid long, s_region string, s_ra double, s_dec double")
    assert [r.obsid for r in crossmatch.footprint_search(obs, "POLYGON ICRS 140 -20 170 -20 170 20 140 20").collect()] == [1]


def test_effective_time_of_nan(spark):
    nan = float("nan")
    rows = [(1, nan, 5.0, 7.0), (2, nan, nan, 7.0), (3, -1.0, 0.0, 7.0), (4, 3.0, nan, None), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    assert [r.t for r in df.orderBy("id").select(keys.effective_time(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()] == [5.0, 7.0, 7.0, 3.0, None]


def test_crossmatch_cells_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    sky = [(i, rng.uniform(0, 360), rng.choice([rng.uniform(-90, 90), rng.uniform(-1, 1), 89.9, -89.95, 90.0])) for i in range(1500)] + [(2000, 359.999, 0.0), (2001, 0.001, 0.0), (2002, None, 1.0), (2003, 5.0, 95.0)]
    targets = [(i, rng.uniform(0, 360), rng.choice([rng.uniform(-90, 90), 0.0, 89.8]), rng.choice([0.3, 2.0, 7.0])) for i in range(60)] + [(100, 0.0, 0.0, 1.0), (101, -0.5, 0.0, 1.0)]
    got = crossmatch.crossmatch(spark.createDataFrame(targets, "t long, a double, d double, r double"), ("t", "a", "d"), spark.createDataFrame(sky, "e long, a double, d double"), ("e", "a", "d"), F.col("r"))
    from skyquarry.functions import regions

    want = sorted((t, e) for t, a, d, r in targets for e, x, y in sky if x is not None and abs(y) <= 90 and regions.separation(a, d, x, y) <= r)
    assert sorted((x.t, x.e) for x in got.collect()) == want


def test_group_positions_cross_partitions(spark):
    """One group with most rows spans partitions; its positions still count on."""
    obs = spark.range(3000).selectExpr("id as obsid", "'JWST' as obs_collection", "if(id % 3 = 0, concat('x', id), 'a_b_c_d') as obs_id", "cast(null as string) as instrument_name", "'F200W' as filters", "double(id % 7) as t_min", "double(0) as t_max", "double(0) as t_obs_release")
    got = groups.group_products(obs.repartition(8)).where("observation_key = 'a_b_c'").collect()
    by = sorted(got, key=lambda r: r.position)
    assert [r.position for r in by] == list(range(1, 2001))
    assert [(r.time, r.obsid) for r in by] == sorted((r.time, r.obsid) for r in got)


def test_limits_of_groups(spark, data):
    from skyquarry.plans import groupsearch

    obs = catalog.observations(spark, data())
    assert groupsearch.by_cone(obs, 150.0, 2.0, 90.0, limit=0).count() == 0
    some = groupsearch.by_cone(obs, 150.0, 2.0, 90.0, limit=2).select(*groups.GROUP).distinct().count()
    assert some == 2


def test_groups_by_footprint_against_plain(spark, data):
    from skyquarry.functions import regions
    from skyquarry.plans import groupsearch

    obs = catalog.observations(spark, data())
    source = regions.parse(catalog._SEARCHED)
    want = {r.obsid for r in groupsearch.imagery(obs).collect() if (s := regions.parse(r.s_region)) and regions.overlap(source, s)}
    got = [r.obsid for r in catalog.groups_by_footprint(spark, data()).collect()]
    assert set(got) == want and len(got) == len(want)
