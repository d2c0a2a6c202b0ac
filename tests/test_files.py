"""FITS tables and science products, readers, writers, requests and SQL functions on files that the tests build."""

import json
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skyquarry.functions import headers, register, text
from skyquarry.operators import products
from skyquarry.plans import filters, search
from skyquarry.sources import fits, services, sinks, tables
from skyquarry.streaming import arrivals

BLOCK = 2880


def block(cards, data=b""):
    head = b"".join(f"{c:<80}".encode() for c in [*cards, "END"])
    return head.ljust(-(-len(head) // BLOCK) * BLOCK) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def key(name, value):
    return f"{name:<8}= {value:>20}"


def image(kind, name, w=3, h=2, extra=(), bitpix=16):
    head = [f"{'XTENSION':<8}= 'IMAGE   '" if kind == "ext" else key("SIMPLE", "T"), key("BITPIX", bitpix), key("NAXIS", 2), key("NAXIS1", w), key("NAXIS2", h)]
    head += [f"{'EXTNAME':<8}= '{name}'"] if name else []
    return block([*head, *extra], struct.pack(f">{w * h}h", *range(w * h)))


WCS = [key("CRPIX1", 1.0), key("CRPIX2", 1.0), key("CRVAL1", 150.0), key("CRVAL2", 2.0), key("CDELT1", -0.001), key("CDELT2", 0.001)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Four files: images with a weight plane, a header alone, tables, and a truncated one."""
    base = tmp_path_factory.mktemp("fits")
    empty = [key("SIMPLE", "T"), key("BITPIX", 8), key("NAXIS", 0), f"{'TELESCOP':<8}= 'ONE'", "COMMENT kept"]
    (base / "a.fits").write_bytes(block(empty) + image("ext", "SCI", extra=WCS) + image("ext", "WHT", extra=[*WCS, f"{'TELESCOP':<8}= 'TWO'"]) + image("ext", "", w=4))
    (base / "b.fits").write_bytes(block(empty))
    binary = [f"{'XTENSION':<8}= 'BINTABLE'", key("BITPIX", 8), key("NAXIS", 2), key("NAXIS1", 4 + 8 + 1 + 5 + 4 + 2), key("NAXIS2", 2), key("PCOUNT", 0), key("GCOUNT", 1), key("TFIELDS", 6)]
    columns = [("NUM", "1J"), ("X", "D"), ("OK", "L"), ("NAME", "5A"), ("PAIR", "2I"), ("SCALED", "I")]
    for i, (name, form) in enumerate(columns, 1):
        binary += [f"{f'TTYPE{i}':<8}= '{name}'", f"{f'TFORM{i}':<8}= '{form}'"]
    binary += [key("TSCAL6", 0.5), key("TZERO6", 10.0), key("TNULL1", -1)]
    data = struct.pack(">id1s5s2hh", 7, 1.5, b"T", b"abc\0\0", 1, 2, 4) + struct.pack(">id1s5s2hh", -1, float("nan"), b"\0", b"defgh", -3, 4, -20)
    ascii_ = [f"{'XTENSION':<8}= 'TABLE   '", key("BITPIX", 8), key("NAXIS", 2), key("NAXIS1", 20), key("NAXIS2", 2), key("TFIELDS", 3)]
    for i, (name, form, at) in enumerate([("S", "A6", 1), ("N", "I5", 7), ("V", "E9.2", 12)], 1):
        ascii_ += [f"{f'TTYPE{i}':<8}= '{name}'", f"{f'TFORM{i}':<8}= '{form}'", key(f"TBCOL{i}", at)]
    lines = b"alpha    12 1.50D+01" + b"beta        -2.5E-01"
    (base / "c.fits").write_bytes(block(empty) + block(binary, data) + block(ascii_, lines))
    (base / "d.fits").write_bytes(image("primary", "SCI")[:2884])
    return base


def contents(spark, folder):
    return spark.read.format("binaryFile").load(f"{folder}/*.fits").select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")


def test_planes_have_role_and_transform(spark, folder):
    got = {(r.path, r.ext_index): r for r in fits.planes(contents(spark, folder)).collect()}
    assert set(got) == {("a.fits", 1), ("a.fits", 2), ("a.fits", 3)}  # the truncated image is left out
    assert [got["a.fits", i].role for i in (1, 2, 3)] == ["science", "weight", "unknown"]
    assert got["a.fits", 1].wcs.crval1 == 150.0 and got["a.fits", 3].wcs is None
    head = {c.keyword: c.value for c in got["a.fits", 2].cards}
    assert head["TELESCOP"] == "'TWO'" and {c.keyword: c.value for c in got["a.fits", 1].cards}["TELESCOP"] == "'ONE'"
    assert sum(c.keyword == "COMMENT" for c in got["a.fits", 1].cards) == 1


def test_science_products(spark, folder):
    got = {r.name: r for r in fits.science_products(contents(spark, folder)).collect()}
    assert set(got) == {"a_SCI", "a_WHT", "a_ext2", "b", "c", "d"}
    assert got["b"].ext_index is None and got["b"].dims == [] and got["a_ext2"].dims == [4, 2]
    planes = fits.science_products(contents(spark, folder)).where("ext_index is not null").withColumnRenamed("path", "file")
    assert rows(products.preferred_plane(planes).select("file", "name")) == [("a.fits", "a_SCI")]


def test_tables(spark, folder):
    got = fits.read_table(spark, str(folder), 1).orderBy(F.col("NUM").desc_nulls_last()).collect()
    assert [tuple(r)[1:4] + tuple(r)[4:] for r in got][0] == (7, 1.5, True, "abc", [1, 2], 12.0)
    assert got[1].NUM is None and got[1].OK is None and got[1].NAME == "defgh" and got[1].PAIR == [-3, 4] and got[1].SCALED == 0.0
    got = fits.read_table(spark, f"{folder}/c.fits", 2).orderBy("S").collect()
    assert [tuple(r)[1:] for r in got] == [("alpha", 12, 15.0), ("beta", None, -0.25)]
    assert fits.read_table(spark, str(folder), 9).count() == 0


def test_headers_of_many_files_a_task(spark, folder):
    for files in ("1", "3"):
        got = fits.read_headers(spark, str(folder), filesPerTask=files)
        assert rows(got.groupBy(F.element_at(F.split("path", "/"), -1)).count()) == [("a.fits", 4), ("b.fits", 1), ("c.fits", 3), ("d.fits", 1)]
    assert fits.read_headers(spark, f"{folder}/a*.fits", maxBytes="2880").count() == 1
    cards = headers.explode_cards(fits.read_headers(spark, f"{folder}/a.fits"), "path", "ext_index")
    counts = {r.keyword: r.n for r in headers.keyword_counts(cards).collect()}
    assert counts["BITPIX"] == 4 and counts["EXTNAME"] == 2 and "COMMENT" not in counts


def test_values_as_json(spark):
    from skyquarry.functions.fitsvalues import header_value

    raw = ["T", "12", "1.5", "'a \"b\"'", None]
    got = [r.j for r in spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").orderBy("i").select(headers.value_json(header_value(F.col("v"))).alias("j")).collect()]
    assert [json.loads(j) if j else None for j in got] == [{"type": "bool", "value": True}, {"type": "integer", "value": 12}, {"type": "double", "value": 1.5}, {"type": "string", "value": 'a "b"'}, None]


def test_readers(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"fields":[{"name":"a","type":"int"}],"data":[{"a":1}]}')
    (tmp_path / "2.json").write_text('{"fields":[{"name":"a","type":"int"},{"name":"b","type":"string"}],"data":[{"a":2,"b":"x"}]}')
    assert rows(tables.read_envelope(spark, f"{tmp_path}/*.json")) == [(1, None), (2, "x")]
    (tmp_path / "t.csv").write_text('n,"q"\n1,"x\n2,\n')
    got = tables.read_csv(spark, f"{tmp_path}/t.csv")
    assert got.columns == ["n", '"q"'] and rows(got) == [("1", '"x'), ("2", None)]
    (tmp_path / "ned.txt").write_text('{"QueryTime":"x","ResultCode":3,"Supplied":"m 1","Preferred":{"Name":"M 1","Position":{"RA":83.6,"Dec":22.0},"ObjType":{"Value":"SNR"},"Redshift":{"Value":null}}}')
    assert rows(tables.read_resolver(spark, f"{tmp_path}/ned.txt")) == [("m 1", "M 1", 83.6, 22.0, "SNR", None, 3)]
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert rows(tables.column_or_empty(df, ["b", "c"])) == [("x", "")]
    assert rows(tables.stored_files(spark, str(tmp_path), "*.csv").select("name")) == [("t.csv",)]


def test_writers(spark, tmp_path):
    counts = spark.createDataFrame([("A", 2, "x, \"y\""), ("B", 5, "")], "keyword string, n long, relevance string")
    sinks.write_counts(counts.select("keyword", "n"), f"{tmp_path}/counts")
    lines = [json.loads(x) for p in sorted((tmp_path / "counts").glob("part*")) for x in p.read_text().split("\n") if x]
    assert [x["keyword"] for x in lines] == ["B", "A"]
    sinks.write_relevance(counts, f"{tmp_path}/relevance")
    assert rows(spark.read.csv(f"{tmp_path}/relevance", header=True, quote='"', escape='"')) == [("A", "2", 'x, "y"'), ("B", "5", None)]
    log = spark.createDataFrame([("hello",)], "message string").withColumn("time", F.timestamp_seconds(F.lit(0)))
    sinks.append_log(log, f"{tmp_path}/log")
    sinks.append_log(log, f"{tmp_path}/log")
    assert rows(spark.read.text(f"{tmp_path}/log")) == [("1970-01-01 00:00:00 hello",)] * 2
    cards = spark.createDataFrame([("f", 0, "Z", "1"), ("f", 1, "A", "2"), ("f", 2, "Z", "3")], "file string, ordinal int, keyword string, value string")
    sinks.write_headers(cards, f"{tmp_path}/headers")
    (line,) = [x for p in (tmp_path / "headers").glob("part*") for x in p.read_text().split("\n") if x]
    assert line == '{"file":"f","header":{"A":"2","Z":"1"}}'
    files = spark.createDataFrame([("a b/c.fits", b"xyz"), (None, b"q")], "name string, content binary")
    for _ in range(2):
        assert [(r.name, r["size"]) for r in sinks.save_files(files, f"{tmp_path}/out").collect()] == [("a_b_c.fits", 3)]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a_b_c.fits"] and (tmp_path / "out/a_b_c.fits").read_bytes() == b"xyz"


def test_requests():
    asked = json.loads(services.request("Mast.Caom.Cone", ra=1.0, dec=2.0, filters=[filters.Filter("filters", ("A", "B"), ";")], page=3))
    assert asked["service"] == "Mast.Caom.Cone" and asked["page"] == 3 and asked["pagesize"] == 200 and asked["params"]["filters"] == [{"paramName": "filters", "separator": ";", "values": ["A", "B"]}]
    assert services.service_id("Mast_Hsc_Db_v2") == "Mast.Hsc.Db.v2" and services.service_id("Download_file") == "Download/file"
    assert services.request_url("https://x/y", '{"a":1}') == "https://x/y?request=%7B%22a%22%3A1%7D"
    assert services.cone_url("https://x", 1.0, 2.0) == "https://x?RA=1.0&DEC=2.0&SR=0.2&max_records=20&outputformat=JSON"
    assert services.image_list_url("https://x", 1, 2, kinds=("stack", "stack_wt")).endswith("type=stack,stack.wt")
    assert "&red=a&green=b&blue=c" in services.colour_image_url("https://x", 1, 2, ["a", "b", "c"])
    assert len(services.FAMILY) == 56
    with pytest.raises(ValueError):
        services.run(None, "Download/file")


def test_service_crossmatch_and_counts(spark):
    sky = spark.createDataFrame([(1, 10.0, 0.0, "HST"), (2, 20.0, 0.0, "JWST")], "obsid long, s_ra double, s_dec double, obs_collection string")
    to = spark.createDataFrame([(7, 10.001, 0.0)], "k long, a double, d double")
    assert rows(services.run(sky, "Mast.Caom.Crossmatch", {"targets": to, "target": ("k", "a", "d"), "radius": 0.01}).select("k", "obsid")) == [(7, 1)]
    assert services.run(sky, "Mast.Catalogs.Filtered.DiskDetective.Count", {"filters": [filters.Filter("obs_collection", ("HST",))]}).first().n == 1
    assert rows(services.run(sky, "Mast.Missions.List")) == [("HST",), ("JWST",)]


def test_sizes_of_addresses(spark):
    obs = spark.createDataFrame([(1, "mast:HST/product/a.fits", "http://x/a.jpg"), (2, "mast:q", None), (3, "", "")], "obsid long, dataurl string, jpegurl string")
    files = spark.createDataFrame([(10, 1, 50, "mast:HST/product/a.fits", "a.fits"), (11, 1, None, "mast:z", "z")], "product_id long, obsid long, size long, datauri string, productfilename string")
    cache = spark.createDataFrame([("http://x/a.jpg", 9), ("mast:q", 0)], "address string, size long")
    got = products.content_sizes(obs, files, cache)
    assert rows(got.select("obsid", "dataurl_size", "jpegurl_size", "download_size")) == [(1, 50, 9, 50), (2, None, None, None), (3, None, None, None)]
    assert rows(products.missing_addresses(got)) == [("mast:q",)]


def test_sql_functions(spark, folder):
    register.register(spark)
    spark.createDataFrame([("CIRCLE 10 0 1", 10.5, 0.0), ("nothing", 1.0, 1.0), (None, None, None)], "r string, x double, y double").createOrReplaceTempView("places")
    got = spark.sql("select r, region_contains(r, x, y) c, region_intersects(r, 'CIRCLE 11.5 0 1') i, round(region_area(r), 3) a from places").collect()
    assert {(r.r, r.c, r.i, r.a) for r in got} == {("CIRCLE 10 0 1", True, True, 3.142), ("nothing", False, False, None), (None, False, False, None)}
    contents(spark, folder).createOrReplaceTempView("files")
    got = spark.sql("select path, ext_index, extname from files, lateral fits_units(content) where is_image").collect()
    assert {(r.path, r.ext_index, r.extname) for r in got} == {("a.fits", 1, "SCI"), ("a.fits", 2, "WHT"), ("a.fits", 3, None), ("d.fits", 0, "SCI")}


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(text.content_size(F.lit("bytes 0-9/1234"), F.lit(None).cast("string"))) == 1234 and value(text.content_size(F.lit("bytes 0-9/*"), F.lit("77"))) == 77
    assert value(text.replace_first(F.lit("a.b.c"), ".", "")) == "ab.c" and value(text.redacted(F.lit("Bearer xyz"))) == "<redacted>"
    assert value(text.is_fits_name(F.lit("A.FITS.gz"))) and not value(text.is_fits_name(F.lit("a.jpg")))
    assert value(text.colour_code(F.lit("Red"))) == "#EF4444"
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "k int, n string, m string")
    assert search.drop_null_columns(df).columns == ["k", "m"]
    assert rows(search.resolve(spark.createDataFrame([("m 1", "M1", None), ("x", "Y", 1.0)], "searchstring string, canonicalname string, radius double"), "M 1").select("radius")) == [(0.02,)]


def test_streams(spark, tmp_path):
    df = spark.sql("select * from values (1, 'HST', timestamp '2024-01-01 10:00:00'), (2, 'HST', timestamp '2024-01-01 12:00:00'), (2, 'HST', timestamp '2024-01-02 12:00:00') as t(obsid, obs_collection, ingested_at)")
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out in (("days", arrivals.arrival_counts(stream())), ("firsts", arrivals.first_deliveries(stream()))):
        out.writeStream.format("memory").queryName(name).outputMode("complete" if name == "days" else "append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("days").collect()) == [1, 2] and sorted(r.obsid for r in spark.table("firsts").collect()) == [1, 2]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.fits").write_bytes(b"abc")
    arrivals.watch_files(spark, f"{tmp_path}/w").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert [r.length for r in spark.table("seen").collect()] == [3]
