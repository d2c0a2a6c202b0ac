"""Queries of headers, files, requests and scalar functions, with their SQL; registered beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquarry.catalog import CONE, OBS, ORACLES, PRESET_SQL, _locator, observations, query
from skyquarry.functions import fitsvalues, headers, sphere, text
from skyquarry.operators import groups, products
from skyquarry.plans import filters, search
from skyquarry.sources import services, tables
from skyquarry.session import table

#: Columns of fits_headers by the keyword they were read from.
KEYWORDS = {"EXTNAME": "extname", "TELESCOP": "telescop", "INSTRUME": "instrume", "OBJECT": "target_object", "DATE-OBS": "date_obs", "TIME-OBS": "time_obs", "TSTART": "tstart", "TIMEUNIT": "timeunit", "MJDREF": "mjdref", "TIMESYS": "timesys", "EXPTIME": "exptime", "BITPIX": "bitpix"}
UNITS = "WITH units AS (SELECT DISTINCT * FROM fits_headers) "
_cards_sql = " UNION ALL ".join(f"SELECT header_id, '{k}' AS keyword, CAST({c} AS VARCHAR) AS value FROM units WHERE {c} IS NOT NULL" for k, c in KEYWORDS.items())


def _units(spark, sf_dir):
    """Header units once each, with their cards as an array and as a map."""
    card = lambda k, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("keyword"), F.col(c).cast("string").alias("value"), F.lit("").alias("comment")))
    units = table(spark, sf_dir, "fits_headers").dropDuplicates(["header_id"])
    return units.withColumn("cards", F.array_compact(F.array(*[card(k, c) for k, c in KEYWORDS.items()])))


def _cards(spark, sf_dir):
    return headers.explode_cards(_units(spark, sf_dir), "header_id")


def _present(column: str) -> str:
    return f"nullif(trim(replace({column}, '''', '')), '')"


@query(UNITS + f"SELECT header_id, {_present('telescop')} AS telescope, {_present('instrume')} AS instrument, {_present('target_object')} AS target, {_present('date_obs')} AS observation_date, {_present('time_obs')} AS exposure_start, exptime AS exposure_time, {_present('extname')} AS extension_type FROM units")
def header_metadata(spark, sf_dir):
    """Typed metadata of every header unit."""
    found = _units(spark, sf_dir).select("header_id", headers.first_wins(F.col("cards")).alias("h")).select("header_id", *headers.metadata(F.col("h")))
    return found.select("header_id", "telescope", "instrument", "target", "observation_date", "exposure_start", "exposure_time", "extension_type")


@query(UNITS + f"SELECT keyword, count(*) AS n FROM ({_cards_sql}) GROUP BY keyword")
def header_keywords(spark, sf_dir):
    """How often each keyword occurs in all header units."""
    return headers.keyword_counts(_cards(spark, sf_dir))


@query(UNITS + f", counts AS (SELECT keyword, count(*) AS n FROM ({_cards_sql}) GROUP BY keyword) SELECT keyword, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM counts UNION ALL SELECT 'EXPTIME', 7 UNION ALL SELECT 'AIRMASS', 3) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 5")
def header_keywords_merged(spark, sf_dir):
    """The five most frequent keywords after adding an earlier counter."""
    earlier = spark.createDataFrame([("EXPTIME", 7), ("AIRMASS", 3)], "keyword string, n long")
    return headers.most_common(headers.merge_counts(headers.keyword_counts(_cards(spark, sf_dir)), earlier), 5)


@query(UNITS + f"SELECT keyword, count(*) AS n, CASE keyword WHEN 'EXPTIME' THEN 'high' WHEN 'OBJECT' THEN 'medium' ELSE '' END AS relevance FROM ({_cards_sql}) GROUP BY keyword")
def header_relevance(spark, sf_dir):
    """Keywords with their relevance, empty where none is known."""
    known = spark.createDataFrame([("EXPTIME", "high"), ("OBJECT", "medium"), ("NOWHERE", "low")], "keyword string, relevance string")
    return headers.with_relevance(headers.keyword_counts(_cards(spark, sf_dir)), known)


_meaning = "CASE " + " ".join(f"WHEN keyword = '{k}' AND trim(upper(replace(value, '''', ''))) = '{v}' THEN '{m}'" for k, values in headers.OPTIONS.items() for v, m in values.items()) + " END"


@query(UNITS + f"SELECT keyword, value, {_meaning} AS meaning, count(*) AS n FROM ({_cards_sql}) WHERE keyword IN ('BITPIX', 'TIMESYS') GROUP BY ALL")
def keyword_options(spark, sf_dir):
    """Meaning of the values of categorical keywords."""
    cards = _cards(spark, sf_dir).where("keyword in ('BITPIX', 'TIMESYS')")
    return headers.describe(cards.groupBy("keyword", "value").agg(F.count("*").alias("n"))).select("keyword", "value", "meaning", "n")


@query(UNITS + f"SELECT keyword, CASE keyword WHEN 'EXPTIME' THEN 'Exposure time' ELSE 'FITS header keyword' END AS description, CASE keyword WHEN 'EXPTIME' THEN 'Exposure' ELSE 'Unknown' END AS category, count(*) AS n FROM ({_cards_sql}) GROUP BY keyword")
def keyword_categories(spark, sf_dir):
    """Description and category of every keyword met; unknown ones get the general text."""
    dictionary = spark.createDataFrame([("EXPTIME", "Exposure time", "Exposure")], "keyword string, description string, category string")
    return headers.explain_keywords(headers.keyword_counts(_cards(spark, sf_dir)), dictionary).select("keyword", "description", "category", "n")


@query(UNITS + "SELECT header_id, trim(upper(replace(timesys, '''', ''))) AS scale, CASE WHEN bitpix IN (8, 16, 32, 64, -32, -64) THEN abs(bitpix) // 8 END AS pixel_bytes, bitpix < 0 AS is_float, CASE WHEN ext_index IS NULL THEN '1024 (1D)' ELSE concat('1024×', ext_index + 1, ' (2D)') END AS dimensions FROM units")
def header_scalars(spark, sf_dir):
    """Categorical value, sample size and dimensions of every header unit."""
    dims = F.array_compact(F.array(F.lit(1024).cast("long"), F.col("ext_index") + 1))
    return _units(spark, sf_dir).select("header_id", fitsvalues.categorical(F.col("timesys")).alias("scale"), fitsvalues.pixel_bytes(F.col("bitpix")).alias("pixel_bytes"), (F.col("bitpix") < 0).alias("is_float"), headers.dimension_text(dims).alias("dimensions"))


@query(UNITS + "SELECT header_id, CAST(ceil(greatest(header_id, 0) / 2880) * 2880 AS BIGINT) AS padded FROM units")
def padded_offsets(spark, sf_dir):
    """Offsets padded to the next block; the ids stand for offsets."""
    return _units(spark, sf_dir).select("header_id", fitsvalues.padded(F.col("header_id")).alias("padded"))


_files = "f AS (SELECT file_identifier, min(header_id) AS header_id FROM fits_headers WHERE file_identifier IS NOT NULL GROUP BY file_identifier)"


@query(OBS + f", {_files} SELECT o.obsid, f.header_id FROM obs o LEFT JOIN f ON f.file_identifier = nullif(string_split(o.dataurl, '/')[-1], '')")
def attached_metadata(spark, sf_dir):
    """The first header unit of the file behind each data address."""
    first = table(spark, sf_dir, "fits_headers").where("file_identifier is not null").groupBy("file_identifier").agg(F.min("header_id").alias("header_id"))
    return products.attach_metadata(observations(spark, sf_dir).select("obsid", "dataurl"), first).select("obsid", "header_id")


# ---- presets, searches and requests


@query(OBS + " UNION ALL ".join(f"SELECT '{name}' AS preset, count(*) AS n FROM obs WHERE {condition}" for name, condition in PRESET_SQL.items()))
def preset_counts(spark, sf_dir):
    """How many observations each preset of imagery holds, in one pass."""
    obs = observations(spark, sf_dir)
    counts = obs.agg(*[F.count_if(filters.PRESETS[p].predicate()).alias(f"n{i}") for i, p in enumerate(PRESET_SQL)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("preset"), F.col(f"n{i}").alias("n")) for i, p in enumerate(PRESET_SQL)])).alias("p")).select("p.*")


@query(OBS + "SELECT obsid FROM obs WHERE " + PRESET_SQL["science"] + " AND upper(wavelength_region) = 'OPTICAL'")
def preview_template(spark, sf_dir):
    """Observations that serve for a preview of one wave band."""
    return observations(spark, sf_dir, filters.together(filters.preview())).select("obsid")


@query(OBS + "SELECT obsid, target_name FROM obs WHERE lower(target_name) = 'parallel field' AND upper(obs_collection) = 'HST'")
def target_rows(spark, sf_dir):
    """Rows of one target in one mission."""
    return search.of_target(observations(spark, sf_dir), "Parallel Field", "hst").select("obsid", "target_name")


_sep = ORACLES["cone_search"].split("WHERE", 1)[1]


@query(OBS + f"SELECT DISTINCT obs_id, instrument_name FROM obs WHERE {_sep} ORDER BY obs_id NULLS FIRST, instrument_name NULLS FIRST LIMIT 20")
def keyword_cone(spark, sf_dir):
    """The classic cone request with distinct rows and at most twenty of them."""
    return search.keyword_cone(table(spark, sf_dir, "caom_obs"), ["obs_id", "instrument_name"], *CONE)


@query(OBS + "SELECT obs_collection FROM obs WHERE obs_collection = 'HST'")
def values_equal(spark, sf_dir):
    """The values of a column that equal one, a row each."""
    return search.values_equal(observations(spark, sf_dir), "obs_collection", "HST")


@query(OBS + "SELECT obsid, t_exptime FROM obs ORDER BY t_exptime DESC NULLS LAST, obsid LIMIT 50")
def ordered_rows(spark, sf_dir):
    """Rows by order columns of their own direction."""
    return search.ordered(observations(spark, sf_dir).select("obsid", "t_exptime"), ["t_exptime", "obsid"], [True, False], 50)


@query(OBS + "SELECT obsid, obs_id FROM obs WHERE obsid > (SELECT min(obsid) + 50 FROM obs) ORDER BY obsid LIMIT 200")
def page_after_key(spark, sf_dir):
    """The next page after a key, without the pages before."""
    last = table(spark, sf_dir, "caom_obs").agg(F.min("obsid")).first()[0] + 50
    return search.page_after(observations(spark, sf_dir).select("obsid", "obs_id"), "obsid", last)


@query(OBS + "SELECT count(DISTINCT obs_collection) AS obs_collection, count(DISTINCT dataproduct_type) AS dataproduct_type, count(DISTINCT instrument_name) AS instrument_name, count(DISTINCT filters) AS filters, count(DISTINCT wavelength_region) AS wavelength_region FROM obs")
def unique_counts(spark, sf_dir):
    """How many distinct values five columns have."""
    columns = ["obs_collection", "dataproduct_type", "instrument_name", "filters", "wavelength_region"]
    return table(spark, sf_dir, "caom_obs").agg(*[F.countDistinct(c).alias(c) for c in columns])


@query(OBS + "SELECT o.obsid, o.filters, c.n AS n_of_filter FROM obs o JOIN (SELECT filters, count(*) AS n FROM obs GROUP BY filters) c ON o.filters IS NOT DISTINCT FROM c.filters")
def grouped_by_filter(spark, sf_dir):
    """Every observation beside the number of those with its filters."""
    return groups.by_filter(observations(spark, sf_dir).select("obsid", "filters", "t_min")).select("obsid", "filters", "n_of_filter")


@query()
def service_registry(spark, sf_dir):
    """All services with their family."""
    return services.registry(spark)


@query(ORACLES["cone_search"])
def service_cone(spark, sf_dir):
    """A cone by the id of its service."""
    found = services.run(observations(spark, sf_dir, search.within(*CONE)), services.service_id("Mast_Caom_Cone"), dict(zip(("ra", "dec", "radius"), CONE)))
    return found.select("obsid", F.round("distance_arcsec", 3).alias("distance_arcsec"))


@query(OBS + f"SELECT obsid FROM obs WHERE {_sep} AND upper(obs_collection) IN ('HST', 'TESS')")
def service_position(spark, sf_dir):
    """Filters and a position by the id of the service."""
    chosen = filters.Filter("obs_collection", ("HST", "TESS"))
    return services.run(observations(spark, sf_dir, chosen.predicate(), search.within(*CONE)), "Mast.Caom.Filtered.Position", {"filters": [chosen], **dict(zip(("ra", "dec", "radius"), CONE))}).select("obsid")


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT obsid FROM caom_obs WHERE {_sep})")
def service_count(spark, sf_dir):
    """A count by the id of its service."""
    return services.run(observations(spark, sf_dir, search.within(*CONE)), "Mast.Catalogs.Filtered.DiskDetective.Position.Count", dict(zip(("ra", "dec", "radius"), CONE)))


@query("SELECT DISTINCT product_id, obsid FROM caom_products WHERE obsid IN (SELECT min(obsid) FROM caom_products UNION SELECT max(obsid) FROM caom_products)")
def service_products(spark, sf_dir):
    """Products of some observations by the id of the service."""
    source = services.source_of(spark, sf_dir, "Mast.Caom.Products")
    ends = source.agg(F.min("obsid"), F.max("obsid")).first()
    return services.run(source, "Mast.Caom.Products", {"key": list(ends), "columns": "product_id,obsid"}).distinct()


@query("SELECT lookup_id, canonicalname, coalesce(radius, 0.02) AS radius FROM name_lookup WHERE lower(searchstring) = 'trulzenthor arc' OR lower(canonicalname) = 'trulzenthor arc'")
def resolved_name(spark, sf_dir):
    """Resolver rows of a name."""
    return services.run(services.source_of(spark, sf_dir, "Mast.Name.Lookup"), "Mast.Name.Lookup", {"input": "Trulzenthor ARC"}).select("lookup_id", "canonicalname", "radius")


@query("SELECT coalesce(searchstring, '') AS searchstring, coalesce(canonicalname, '') AS canonicalname, coalesce(ra, 0) AS ra, coalesce(decl, 0) AS dec, coalesce(radius, 0.02) AS radius, coalesce(cached, false) AS cached FROM name_lookup")
def typed_resolver_rows(spark, sf_dir):
    """Resolver rows with types and defaults."""
    return tables.typed_names(table(spark, sf_dir, "name_lookup")).select("searchstring", "canonicalname", "ra", "dec", "radius", "cached")


# ---- files and sizes

_match = """, a AS (SELECT obsid, kind, address, {address} AS url FROM (SELECT obsid, 'dataurl' AS kind, dataurl AS address FROM obs UNION ALL SELECT obsid, 'jpegurl', jpegurl FROM obs)),
p AS (SELECT DISTINCT obsid, product_id, size, {uri} AS uri, lower(productfilename) AS file FROM caom_products WHERE size IS NOT NULL AND datauri IS NOT NULL),
m AS (SELECT a.obsid, a.address, min(product_id) AS product_id, arg_min(size, product_id) AS size FROM (SELECT DISTINCT obsid, address, url FROM a WHERE {kinds} AND url <> '') a JOIN p ON a.obsid = p.obsid
 WHERE url = uri OR contains(url, uri) OR contains(uri, url) OR (file <> '' AND contains(url, file)) OR contains(url, string_split(uri, 'url/')[-1]) GROUP BY a.obsid, a.address)
"""


def _matched(kinds: str) -> str:
    return _match.format(address=_locator.format("address"), uri=_locator.format("datauri"), kinds=kinds)


ORACLES["locator_match"] = OBS + _matched("kind = 'dataurl'") + "SELECT obsid, address, product_id, size FROM m"
_sizes = OBS + _matched("true") + """, c AS (SELECT datauri AS address, max(size) AS size FROM caom_products WHERE size > 0 GROUP BY datauri),
s AS (SELECT o.obsid, o.dataurl, o.jpegurl, coalesce(nullif(greatest(d.size, 0), 0), cd.size) AS dataurl_size, coalesce(nullif(greatest(j.size, 0), 0), cj.size) AS jpegurl_size FROM obs o
 LEFT JOIN m d ON d.obsid = o.obsid AND d.address = o.dataurl AND o.dataurl <> '' LEFT JOIN m j ON j.obsid = o.obsid AND j.address = o.jpegurl AND o.jpegurl <> ''
 LEFT JOIN c cd ON cd.address = o.dataurl AND o.dataurl <> '' LEFT JOIN c cj ON cj.address = o.jpegurl AND o.jpegurl <> '')
"""


def _sized(spark, sf_dir):
    found = table(spark, sf_dir, "caom_products")
    cache = found.where("size > 0").groupBy(F.col("datauri").alias("address")).agg(F.max("size").alias("size"))
    return products.content_sizes(observations(spark, sf_dir).select("obsid", "dataurl", "jpegurl"), found, cache)


@query(_sizes + "SELECT obsid, dataurl_size, jpegurl_size, coalesce(dataurl_size, jpegurl_size) AS download_size FROM s")
def download_sizes(spark, sf_dir):
    """Sizes of every observation's files, by its products and else by a cache of addresses."""
    return _sized(spark, sf_dir).select("obsid", "dataurl_size", "jpegurl_size", "download_size")


@query(_sizes + "SELECT DISTINCT address FROM (SELECT dataurl AS address FROM s WHERE dataurl <> '' AND dataurl_size IS NULL UNION ALL SELECT jpegurl FROM s WHERE jpegurl <> '' AND jpegurl_size IS NULL)")
def missing_addresses(spark, sf_dir):
    """Addresses whose size is still unknown."""
    return products.missing_addresses(_sized(spark, sf_dir))


@query("SELECT DISTINCT product_id, productfilename FROM caom_products WHERE upper(producttype) = 'SCIENCE' AND (lower(productfilename) LIKE '%.fits' OR lower(productfilename) LIKE '%.fits.gz')")
def science_files(spark, sf_dir):
    """Science products in FITS."""
    return products.science_files(table(spark, sf_dir, "caom_products")).select("product_id", "productfilename").distinct()


@query("SELECT DISTINCT product_id, CASE WHEN size IS NULL THEN NULL ELSE coalesce(try_cast(string_split(concat('bytes 0-1/', size), '/')[-1] AS BIGINT), 7) END AS content_size FROM caom_products")
def content_sizes(spark, sf_dir):
    """Sizes read from the texts in which servers tell them."""
    return table(spark, sf_dir, "caom_products").select("product_id", text.content_size(F.concat(F.lit("bytes 0-1/"), F.col("size").cast("string")), F.lit(None).cast("string")).alias("content_size")).distinct()


@query("SELECT DISTINCT dataurl, coalesce(lower(dataurl) LIKE 'mast:%' OR contains(lower(dataurl), '.fit'), false) AS wanted, CASE WHEN strpos(dataurl, '/') > 0 THEN concat(left(dataurl, strpos(dataurl, '/') - 1), '|', substr(dataurl, strpos(dataurl, '/') + 1)) ELSE dataurl END AS first_cut, regexp_replace(dataurl, '[0-9]+', '#', 'g') AS digits_cut FROM caom_obs WHERE dataurl IS NOT NULL")
def address_texts(spark, sf_dir):
    """Whether an address promises a header, and two ways to rewrite it."""
    a = F.col("dataurl")
    return table(spark, sf_dir, "caom_obs").where("dataurl is not null").select("dataurl", F.coalesce(text.needs_header(a), F.lit(False)).alias("wanted"), text.replace_first(a, "/", "|").alias("first_cut"), text.replace_all(a, "[0-9]+", "#").alias("digits_cut")).distinct()


@query(OBS + "SELECT DISTINCT filters, array_to_string(list_filter(list_transform(string_split(upper(filters), ';'), lambda x: trim(x)), lambda x: x <> ''), ';') AS listed, CASE WHEN contains(lower(obs_title), 'token') OR contains(lower(obs_title), 'bearer') THEN '<redacted>' ELSE obs_title END AS title FROM obs")
def filter_texts(spark, sf_dir):
    """Filter lists written anew, and titles without credentials."""
    return observations(spark, sf_dir).select("filters", text.filter_text(text.split_filters(F.col("filters"))).alias("listed"), text.redacted(F.col("obs_title")).alias("title")).distinct()


# ---- sphere and transforms


@query(OBS + f"SELECT obsid, round(acos(greatest(-1.0, least(1.0, sin(radians(s_dec)) * sin(radians({CONE[1]})) + cos(radians(s_dec)) * cos(radians({CONE[1]})) * cos(radians(s_ra - {CONE[0]}))))), 6) AS radians, round(((s_ra % 360) + 360) % 360, 9) AS normal, round(CASE WHEN s_ra % 360 > 180 THEN s_ra % 360 - 360 WHEN s_ra % 360 < -180 THEN s_ra % 360 + 360 ELSE s_ra % 360 END, 9) AS wrapped FROM obs WHERE abs(s_dec) <= 90 AND isfinite(s_ra)")
def sphere_scalars(spark, sf_dir):
    """Separation by the dot product, and right ascensions in two ranges, of all usable positions."""
    usable = (F.abs("s_dec") <= 90) & F.col("s_ra").isNotNull() & ~F.isnan("s_ra") & (F.abs("s_ra") < float("inf"))
    r, d = F.col("s_ra"), F.col("s_dec")
    return observations(spark, sf_dir, usable).select("obsid", F.round(sphere.dot_separation(r, d, F.lit(CONE[0]), F.lit(CONE[1])), 6).alias("radians"), F.round(sphere.normal_ra(r), 9).alias("normal"), F.round(sphere.wrapped(r), 9).alias("wrapped"))


@query(OBS + "SELECT obsid, 4.0::DOUBLE AS x, 5.0::DOUBLE AS y, 0.36::DOUBLE AS arcsec FROM obs WHERE s_ra IS NOT NULL AND s_dec IS NOT NULL AND abs(s_ra) < 1e6 AND NOT isnan(s_ra) AND NOT isnan(s_dec)")
def wcs_pixels(spark, sf_dir):
    """Pixels found back from the sky, and the scale, by a linear transform centred on each observation with a position."""
    header = {"CRPIX1": F.lit(10), "CRPIX2": F.lit(20), "CRVAL1": F.col("s_ra"), "CRVAL2": F.col("s_dec"), "CDELT1": F.lit(-1e-4), "CDELT2": F.lit(1e-4)}
    placed = observations(spark, sf_dir, (F.abs("s_ra") < 1e6) & ~F.isnan("s_ra") & F.col("s_dec").isNotNull() & ~F.isnan("s_dec")).select("obsid", fitsvalues.wcs(header).alias("w"))
    back = placed.withColumn("at", fitsvalues.to_world(F.col("w"), F.lit(4.0), F.lit(5.0))).withColumn("p", fitsvalues.to_pixel(F.col("w"), F.col("at.ra"), F.col("at.dec")))
    return back.select("obsid", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), F.round(fitsvalues.pixel_scale(F.col("w"))["x"] * 3600, 6).alias("arcsec"))


@query(OBS + "SELECT obs_collection, len(list_filter(string_split(obs_id, '_'), lambda x: x <> '')) AS parts, count(*) AS n, min(obs_id) AS example FROM obs GROUP BY ALL")
def obs_id_parts(spark, sf_dir):
    """How observation ids of each collection split into parts."""
    return groups.id_parts(observations(spark, sf_dir))
