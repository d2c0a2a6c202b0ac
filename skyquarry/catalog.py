"""The queries of the archive's own operators, with their SQL, over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry import dims
from skyquarry.functions import fitsvalues, keys, sphere, text
from skyquarry.operators import crossmatch, groups, products
from skyquarry.plans import filters, groupsearch, search
from skyquarry.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: In SQL, observations delivered twice count once.
OBS = "WITH obs AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM caom_obs) "
SEP = (
    "2*degrees(asin(least(1.0,sqrt(greatest(0.0,pow(sin(radians({d2}-({d1}))/2),2)+cos(radians({d1}))*cos(radians({d2}))*pow(sin(radians({r2}-({r1}))/2),2))))))"
)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def observations(spark: SparkSession, sf_dir: str, *conditions: Column) -> DataFrame:
    """Observations once each. Redeliveries are equal, so conditions come first: they reach the scan, and only what they leave is shuffled."""
    found = table(spark, sf_dir, "caom_obs").drop("ingested_at")
    for c in conditions:
        found = found.where(c)
    return found.dropDuplicates(["obsid"])


CONE = (150.0, 2.0, 30.0)
_near = SEP.format(r1=CONE[0], d1=CONE[1], r2="s_ra", d2="s_dec") + f" <= {CONE[2]} AND abs(s_dec) <= 90 AND NOT isnan(s_ra) AND NOT isnan(s_dec)"
_science = "upper(datarights) IN ('PUBLIC') AND calib_level IN (3, 4) AND upper(dataproduct_type) IN ('IMAGE') AND upper(intenttype) IN ('SCIENCE')"



def _preset(levels: str = "3, 4", types: str = "'IMAGE'", more: str = "true") -> str:
    return f"upper(datarights) = 'PUBLIC' AND calib_level IN ({levels}) AND upper(dataproduct_type) IN ({types}) AND upper(intenttype) = 'SCIENCE' AND {more}"


def _any(column: str, *values: str) -> str:
    return f"list_has_any(string_split(upper({column}), ';'), {list(values)})"


#: Conditions of all presets in SQL.
PRESET_SQL = {
    "science": _preset(),
    "uv": _preset(more=_any("wavelength_region", "UV", "EUV")),
    "optical": _preset(more=_any("wavelength_region", "OPTICAL")),
    "infrared": _preset(more=_any("wavelength_region", "INFRARED", "IR")),
    "xray": _preset(more=_any("wavelength_region", "XRAY")),
    "hst": _preset(more=_any("obs_collection", "HST")),
    "jwst": _preset(more=_any("obs_collection", "JWST")),
    "galex": _preset(more=_any("obs_collection", "GALEX")),
    "swift": _preset("2", "'IMAGE', 'CUBE'", _any("obs_collection", "SWIFT")),
    "ps1": _preset("3", more=_any("obs_collection", "PS1")),
    "tess": _preset("2", more=_any("obs_collection", "TESS")),
    "jwst miri": _preset(more=_any("obs_collection", "JWST") + " AND " + _any("instrument_name", "MIRI/IMAGE")),
    "jwst nircam": _preset(more=_any("obs_collection", "JWST") + " AND " + _any("instrument_name", "NIRCAM/IMAGE")),
}
_wavelength = """CASE upper(coalesce(list_filter(string_split(filters, ';'), lambda x: x <> '')[1], filters))
 WHEN 'FUV' THEN 153 WHEN 'NUV' THEN 231 WHEN 'UVW2' THEN 193 WHEN 'UVM2' THEN 225 WHEN 'UVW1' THEN 260 WHEN 'U' THEN 346 WHEN 'B' THEN 439 WHEN 'V' THEN 547
 WHEN 'G' THEN 481 WHEN 'R' THEN 617 WHEN 'I' THEN 752 WHEN 'Z' THEN 866 WHEN 'Y' THEN 962 WHEN 'TESS' THEN 786
 ELSE coalesce(try_cast(nullif(regexp_extract(upper(coalesce(list_filter(string_split(filters, ';'), lambda x: x <> '')[1], filters)), '^F([0-9]+)', 1), '') AS BIGINT), 9223372036854775807) END"""
_mission = "CASE upper(obs_collection) WHEN 'HLA' THEN 'HST' ELSE upper(obs_collection) END"
_key = r"""CASE WHEN upper(obs_collection) = 'JWST' AND len(string_split(obs_id, '_')) >= 3 THEN array_to_string(string_split(obs_id, '_')[1:3], '_')
 WHEN upper(obs_collection) = 'HST' OR lower(obs_id) LIKE 'hst\_%' ESCAPE '\' THEN regexp_replace(obs_id, '(?i)_(clear|(fq?|g)[0-9]{2,4}[a-z0-9]*)(_.*)?$', '') ELSE obs_id END"""
_time = "CASE WHEN t_min > 0 AND NOT isnan(t_min) THEN t_min WHEN t_max > 0 AND NOT isnan(t_max) THEN t_max ELSE t_obs_release END"


@query(OBS + f"SELECT obsid, round({SEP.format(r1=CONE[0], d1=CONE[1], r2='s_ra', d2='s_dec')} * 3600, 3) AS distance_arcsec FROM obs WHERE {_near}")
def cone_search(spark, sf_dir):
    """Observations within a cone."""
    return search.cone(observations(spark, sf_dir, search.within(*CONE)), *CONE).select("obsid", F.round("distance_arcsec", 3).alias("distance_arcsec"))


@query(OBS + f"SELECT obsid, obs_collection, filters FROM obs WHERE {_near} AND {_science} AND list_has_any(string_split(upper(obs_collection), ';'), ['HST', 'JWST'])")
def filtered_position(spark, sf_dir):
    """Filters and a cone together."""
    chosen = filters.replace(filters.SCIENCE, collections=("HST", "JWST"))
    return observations(spark, sf_dir, chosen.predicate(), search.within(*CONE)).select("obsid", "obs_collection", "filters")


@query(OBS + f"SELECT obsid FROM obs WHERE {_science} AND list_has_any(string_split(upper(wavelength_region), ';'), ['UV', 'EUV'])")
def preset_uv(spark, sf_dir):
    """A preset of imagery."""
    return observations(spark, sf_dir, filters.PRESETS["uv"].predicate()).select("obsid")


@query(OBS + "SELECT obsid, target_name FROM obs WHERE target_name ILIKE '%nebula%'")
def free_text(spark, sf_dir):
    """A pattern in the target's name."""
    return observations(spark, sf_dir, filters.Filter("target_name", like="%nebula%").predicate()).select("obsid", "target_name")


@query(OBS + f"SELECT filters, obsid, t_min FROM (SELECT *, row_number() OVER (PARTITION BY filters ORDER BY t_min NULLS LAST, obsid) AS rn FROM obs WHERE {_near}) WHERE rn = 1")
def first_per_filter(spark, sf_dir):
    """The earliest observation of each filter in a cone."""
    return groups.first_per_filter(observations(spark, sf_dir, search.within(*CONE))).select("filters", "obsid", "t_min")


@query(OBS + ", u AS (SELECT *, coalesce(isfinite(t_min) AND t_min < 1e6, false) AS ok FROM obs), m AS (SELECT quantile_cont(t_min, 0.5) AS epoch FROM u WHERE ok AND t_min > 0) SELECT filters, obsid FROM (SELECT *, row_number() OVER (PARTITION BY filters ORDER BY CASE WHEN ok THEN abs(t_min - epoch) ELSE 'inf'::DOUBLE END, obsid) AS rn FROM u, m) WHERE rn = 1")
def closest_epoch(spark, sf_dir):
    """For each filter the observation closest to the median epoch."""
    return groups.closest_epoch(observations(spark, sf_dir).select("filters", "obsid", "t_min")).select("filters", "obsid")


@query(OBS + f"SELECT DISTINCT filters, {_wavelength} AS wavelength FROM obs WHERE filters IS NOT NULL")
def wavelength_rank(spark, sf_dir):
    """Sort wavelength of each filter text."""
    return observations(spark, sf_dir, F.col("filters").isNotNull()).select("filters", keys.filter_wavelength(F.col("filters")).alias("wavelength")).distinct()


_grouped = f", g AS (SELECT {_mission} AS mission, {_key} AS observation_key, instrument_name AS instrument, {_wavelength} AS wavelength, {_time} AS t, filters, obsid FROM obs)"


_by_filter = "wavelength, t NULLS FIRST, filters NULLS FIRST, obsid"
_by_time = "t NULLS FIRST, wavelength, filters NULLS FIRST, obsid"
_same_group = "mission, observation_key, instrument"
_in_order = "mission NULLS FIRST, observation_key NULLS FIRST, instrument NULLS FIRST"


@query(OBS + _grouped + f"SELECT {_same_group}, filters, obsid, row_number() OVER (PARTITION BY {_same_group} ORDER BY {_by_filter}) AS position FROM g")
def observation_groups(spark, sf_dir):
    """Every product with its group and its place there in order of wavelength."""
    return groups.group_products(observations(spark, sf_dir)).drop("wavelength", "time")


@query(OBS + _grouped + f"SELECT {_same_group}, filters, obsid, row_number() OVER (PARTITION BY {_same_group} ORDER BY {_by_time}) AS position FROM g")
def groups_by_time(spark, sf_dir):
    """The same in order of time."""
    return groups.group_products(observations(spark, sf_dir), "time").drop("wavelength", "time")


@query(OBS + _grouped + f"SELECT {_same_group}, count(*) AS n_products, min(t) FILTER (NOT isnan(t)) AS first_time, max(t) AS last_time, count(DISTINCT filters) AS n_filters FROM g GROUP BY ALL")
def group_summaries(spark, sf_dir):
    """Size, times and filters of every group."""
    return groups.describe_groups(groups.group_products(observations(spark, sf_dir)))


@query(OBS + _grouped + f"SELECT {_same_group}, count(*) AS n_products FROM g GROUP BY ALL ORDER BY {_in_order} LIMIT 25")
def observation_groups_limit(spark, sf_dir):
    """The first groups in order of mission, key and instrument."""
    found = groups.first_groups(groups.group_products(observations(spark, sf_dir)), search.group_limit(25, 400))
    return found.groupBy(*groups.GROUP).agg(F.count("*").alias("n_products"))


_major = "upper(datarights) = 'PUBLIC' AND calib_level IN (3, 4) AND upper(dataproduct_type) = 'IMAGE' AND upper(intenttype) = 'SCIENCE' AND upper(obs_collection) IN ('JWST', 'HST', 'HLA')"


def _groups_of(condition: str, order: str, limit: int) -> str:
    """SQL of the products of the first groups among the observations that hold ``condition``."""
    chosen = f", g AS (SELECT {_mission} AS mission, {_key} AS observation_key, instrument_name AS instrument, {_wavelength} AS wavelength, {_time} AS t, filters, obsid FROM obs WHERE {_major} AND {condition})"
    ranked = f", r AS (SELECT *, row_number() OVER (PARTITION BY {_same_group} ORDER BY {order}) AS position, dense_rank() OVER (ORDER BY {_in_order}) AS place FROM g)"
    return OBS + chosen + ranked + f" SELECT {_same_group}, filters, obsid, position FROM r WHERE place <= {limit}"


@query(_groups_of(_near.replace(f"<= {CONE[2]}", "<= 90.0") + " AND lower(instrument_name) IN ('wfc3/uvis', 'acs/wfc')", _by_filter, 400))
def groups_by_cone(spark, sf_dir):
    """Groups of two missions and some instruments within a cone."""
    return groupsearch.by_cone(observations(spark, sf_dir), *CONE[:2], 90.0, instruments=["WFC3/UVIS", "ACS/WFC"]).drop("wavelength", "time")


_named = f"EXISTS (SELECT 1 FROM name_lookup n WHERE (lower(searchstring) = 'trulzenthor arc' OR lower(canonicalname) = 'trulzenthor arc') AND abs(s_dec) <= 90 AND NOT isnan(s_ra) AND abs(s_dec - n.decl) <= 40 AND {SEP.format(r1='n.ra', d1='n.decl', r2='s_ra', d2='s_dec')} <= 40)"


@query(_groups_of(_named, _by_time, 30))
def groups_by_name(spark, sf_dir):
    """The first groups around a name, products in order of time."""
    return groupsearch.by_name(observations(spark, sf_dir), table(spark, sf_dir, "name_lookup"), "Trulzenthor Arc", radius=40.0, limit=30, order="time").drop("wavelength", "time")


@query()
def groups_by_footprint(spark, sf_dir):
    """Groups whose footprints meet a polygon; tested against plain geometry."""
    return groupsearch.by_footprint(observations(spark, sf_dir), _SEARCHED).drop("wavelength", "time")


@query(OBS + "SELECT obsid FROM obs WHERE len(list_filter(string_split_regex(upper(filters), '[;,]'), lambda x: trim(x) IN ('NUV', 'F263W'))) > 0")
def filter_band_match(spark, sf_dir):
    """Observations with any of some bands among their filters."""
    return observations(spark, sf_dir).where(text.matches_bands(F.col("filters"), ["nuv", "F263W "])).select("obsid")


@query(OBS + ", b AS (SELECT unnest(['g', 'r', 'i', 'z', 'y', 'TESS']) AS filters, unnest(['Visible', 'Visible', 'Visible', 'Visible', 'Red/Near-IR', 'Broad']) AS band) SELECT band, count(*) AS n FROM obs JOIN b USING (filters) GROUP BY band")
def band_counts(spark, sf_dir):
    """Observations in each named band."""
    return groups.band_counts(observations(spark, sf_dir))


@query(OBS + "SELECT DISTINCT c AS column_name, v AS value FROM (SELECT unnest(['obs_collection', 'dataproduct_type', 'calib_level', 'datarights', 'intenttype']) AS c, unnest([obs_collection, dataproduct_type, calib_level::VARCHAR, datarights, intenttype]) AS v FROM obs)")
def distinct_values(spark, sf_dir):
    """Distinct values of several columns."""
    return groups.unique_values(observations(spark, sf_dir), ["obs_collection", "dataproduct_type", "calib_level", "datarights", "intenttype"])


@query("SELECT DISTINCT obs_collection FROM caom_obs WHERE obs_collection IS NOT NULL")
def missions_list(spark, sf_dir):
    """All collections."""
    return table(spark, sf_dir, "caom_obs").where("obs_collection is not null").select("obs_collection").distinct()


_circle = r"regexp_extract(s_region, '(?i)^\s*circle\s+(?:[a-z]\S*\s+)?(\S+)\s+(\S+)\s+(\S+)\s*$', 3)"


@query(OBS + f"SELECT obsid, round(2*pi()*(1-cos(radians(try_cast({_circle} AS DOUBLE))))*pow(180/pi(),2), 9) AS area FROM obs WHERE try_cast({_circle} AS DOUBLE) > 0")
def circle_area(spark, sf_dir):
    """Area of circular footprints."""
    radius = F.regexp_extract("s_region", r"(?i)^\s*circle\s+(?:[a-z]\S*\s+)?(\S+)\s+(\S+)\s+(\S+)\s*$", 3).try_cast("double")
    return observations(spark, sf_dir).select("obsid", radius.alias("r")).where("r > 0").select("obsid", F.round(sphere.circle_area(F.col("r")), 9).alias("area"))


@query()
def region_areas(spark, sf_dir):
    """Area and bounding cone of every readable footprint; tested against a plain version."""
    return crossmatch.region_columns(observations(spark, sf_dir).select("obsid", "s_region"), "s_region").drop("s_region").where("region_area is not null")


_SEARCHED = "POLYGON ICRS 140 -20 170 -20 170 20 140 20"


def _footprints(mode):
    def run(spark, sf_dir):
        obs = observations(spark, sf_dir).select("obsid", "s_region", "s_ra", "s_dec")
        return crossmatch.footprint_search(obs, _SEARCHED, mode).select("obsid")

    run.__doc__ = f"Footprints that match a polygon by {mode}."
    return run


for _mode in crossmatch.MODES:
    QUERIES[_mode if _mode.startswith("footprint") else f"footprint_{_mode}"] = _footprints(_mode)


@query(OBS + f"SELECT lookup_id, obsid, round(sep, 6) AS separation FROM (SELECT lookup_id, obsid, coalesce(radius, 0.02) AS r, {SEP.format(r1='n.ra', d1='n.decl', r2='s_ra', d2='s_dec')} AS sep FROM name_lookup n, obs WHERE abs(s_dec) <= 90 AND NOT isnan(s_ra) AND abs(s_dec - n.decl) <= coalesce(radius, 0.02)) WHERE sep <= r")
def crossmatch_names(spark, sf_dir):
    """Observations within the radius of each catalogued name."""
    names = table(spark, sf_dir, "name_lookup")
    found = crossmatch.crossmatch(names, ("lookup_id", "ra", "decl"), observations(spark, sf_dir), ("obsid", "s_ra", "s_dec"), F.coalesce("radius", F.lit(0.02)))
    return found.select("lookup_id", "obsid", F.round("separation", 6).alias("separation"))


@query(OBS + ", s AS (SELECT obsid, count(*) AS n, sum(size) AS total FROM (SELECT DISTINCT product_id, obsid, size FROM caom_products WHERE size > 0) GROUP BY obsid) SELECT obsid, coalesce(n, 0) AS n_products, total AS total_size FROM obs LEFT JOIN s USING (obsid)")
def product_sizes(spark, sf_dir):
    """Number and size of each observation's products."""
    return products.product_sizes(observations(spark, sf_dir), table(spark, sf_dir, "caom_products"))


@query()
def locator_match(spark, sf_dir):
    """The first product that fits each data address; tested against a plain version."""
    return products.match_locators(observations(spark, sf_dir), "dataurl", table(spark, sf_dir, "caom_products"))


@query(OBS + "SELECT obsid, 'jpegurl' AS kind, jpegurl AS url FROM obs WHERE jpegurl <> '' UNION ALL SELECT obsid, 'dataurl', dataurl FROM obs WHERE dataurl <> ''")
def union_urls(spark, sf_dir):
    """Preview and data addresses, one row each."""
    return products.product_urls(observations(spark, sf_dir))


@query(OBS + "SELECT obsid, 'dataurl' AS kind, dataurl AS url FROM obs WHERE dataurl <> '' AND obs_collection IS DISTINCT FROM 'TESS'")
def preview_urls(spark, sf_dir):
    """Data addresses for a preview, without those of TESS."""
    return products.product_urls(observations(spark, sf_dir), preview=True)


@query(OBS + ", r AS (SELECT obsid, obs_id, filters, instrument_name, t_min, t_max, contains(coalesce(nullif(jpegurl, ''), dataurl, ''), 'http') AS web FROM obs) SELECT obsid, 'direct' AS route FROM r WHERE web UNION ALL SELECT min(obsid), 'service' FROM r a WHERE NOT web AND NOT EXISTS (SELECT 1 FROM r b WHERE b.web AND a.obs_id IS NOT DISTINCT FROM b.obs_id AND a.filters IS NOT DISTINCT FROM b.filters AND a.instrument_name IS NOT DISTINCT FROM b.instrument_name AND a.t_min IS NOT DISTINCT FROM b.t_min AND a.t_max IS NOT DISTINCT FROM b.t_max) GROUP BY obs_id, filters, instrument_name, t_min, t_max")
def preview_routing(spark, sf_dir):
    """Direct addresses of previews and, apart from them, those of the service."""
    return products.preview_routes(observations(spark, sf_dir))


@query(OBS + "SELECT obsid, CASE WHEN contains(dataurl, 'http') THEN 'direct' ELSE 'service' END AS route FROM obs")
def product_routing(spark, sf_dir):
    """Route to the data of every observation."""
    return products.product_routes(observations(spark, sf_dir))


@query(OBS + "SELECT obsid, s_ra, s_dec FROM obs WHERE s_ra BETWEEN 100 AND 200 AND s_dec BETWEEN -50 AND 50 AND proposal_id IS NOT NULL")
def tap_box(spark, sf_dir):
    """A box of coordinates with a column that must not be null."""
    return search.box(table(spark, sf_dir, "caom_obs"), 150.0, 0.0, 50.0, "proposal_id", top=None).select("obsid", "s_ra", "s_dec").distinct()


@query("SELECT DISTINCT obsid, t_exptime FROM caom_obs WHERE t_exptime > 100 AND t_exptime < 200 AND obs_collection LIKE 'H%'")
def tap_range(spark, sf_dir):
    """An ADQL statement with an open range, run as Spark SQL."""
    obs = table(spark, sf_dir, "caom_obs")
    statement = filters.Adql("{obs}", ("obsid", "t_exptime")).where("t_exptime", ">", "100", "and").where("t_exptime", "<", "200", "and").where("obs_collection", "like", "H%")
    return spark.sql(statement.sql(), obs=obs).distinct()


@query(OBS + "SELECT obsid, t_exptime FROM obs WHERE jpegurl IS NOT NULL ORDER BY obsid LIMIT 200 OFFSET 200")
def paging(spark, sf_dir):
    """The second page of observations."""
    return search.page(observations(spark, sf_dir, F.col("jpegurl").isNotNull()).select("obsid", "t_exptime"), [F.col("obsid")], 2)


@query(OBS + "SELECT 2 AS page, 200 AS page_size, CAST(ceil(count(*) / 200) AS BIGINT) AS pages, count(*) AS rows_total FROM obs")
def paging_counts(spark, sf_dir):
    """What a page says of the whole."""
    return search.paging(observations(spark, sf_dir), 2)


@query(OBS + f"SELECT obsid, {_time} AS effective_time FROM obs")
def effective_time(spark, sf_dir):
    """Effective time of every observation."""
    return observations(spark, sf_dir).select("obsid", keys.effective_time(F.col("t_min"), F.col("t_max"), F.col("t_obs_release")).alias("effective_time"))


@query(OBS + r"SELECT DISTINCT filters, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(filters), '[^A-Za-z0-9._-]', '_', 'g'), '__+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'none') AS part FROM obs WHERE filters IS NOT NULL")
def path_sanitise(spark, sf_dir):
    """Filters as part of a storage path."""
    return observations(spark, sf_dir).where("filters is not null").select("filters", text.path_part(F.col("filters"), "none").alias("part")).distinct()


_locator = "lower(url_decode(replace(replace({}, '&amp;', '&'), '+', '%2B')))"


@query(f"SELECT DISTINCT datauri, {_locator.format('datauri')} AS locator FROM caom_products WHERE datauri IS NOT NULL")
def url_normalise(spark, sf_dir):
    """Product locators for comparison; tested against a plain version."""
    return table(spark, sf_dir, "caom_products").where("datauri is not null").select("datauri", text.product_locator(F.col("datauri")).alias("locator")).distinct()


@query("SELECT DISTINCT header_id, CASE WHEN trim(upper(replace(extname, '''', ''))) IN ('WHT', 'WEIGHT', 'WEIGHTS', 'IVM', 'VAR_POISSON', 'VAR_RNOISE') OR regexp_matches(upper(file_identifier), '(^|[^A-Z0-9])(WHT|WEIGHT|IVM)([^A-Z0-9]|$)') THEN 'weight' WHEN trim(upper(replace(extname, '''', ''))) IN ('ERR', 'ERROR', 'RMS', 'UNCERT', 'UNCERTAINTY') OR regexp_matches(upper(file_identifier), '(^|[^A-Z0-9])(ERR|ERROR|RMS)([^A-Z0-9]|$)') THEN 'error' WHEN trim(upper(replace(extname, '''', ''))) IN ('DQ', 'DQUALITY', 'QUALITY', 'MASK') OR regexp_matches(upper(file_identifier), '(^|[^A-Z0-9])(DQ|QUALITY|MASK)([^A-Z0-9]|$)') THEN 'dataQuality' WHEN trim(upper(replace(extname, '''', ''))) IN ('SCI', 'SCIENCE', 'IMAGE', 'RATE') OR regexp_matches(upper(file_identifier), '(^|[^A-Z0-9])(SCI|SCIENCE)([^A-Z0-9]|$)') THEN 'science' ELSE 'unknown' END AS role FROM fits_headers")
def role_classify(spark, sf_dir):
    """Role of every header unit."""
    return table(spark, sf_dir, "fits_headers").select("header_id", fitsvalues.role([F.col("extname")], F.col("file_identifier")).alias("role")).distinct()


@query(r"SELECT DISTINCT header_id, CASE WHEN trim(tstart) IN ('T', 'true', 'F', 'false') THEN 'bool' WHEN regexp_full_match(trim(tstart), '[+-]?[0-9]+') AND try_cast(trim(tstart) AS BIGINT) IS NOT NULL THEN 'integer' WHEN tstart IS NULL THEN NULL WHEN regexp_full_match(trim(tstart), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'double' ELSE 'string' END AS vtype FROM fits_headers")
def fits_value_type(spark, sf_dir):
    """Type of raw header values."""
    return table(spark, sf_dir, "fits_headers").select("header_id", fitsvalues.header_value(F.col("tstart"))["vtype"].alias("vtype")).distinct()


@query("SELECT DISTINCT header_id, CAST(CASE WHEN bitpix IN (8, 16, 32, 64, -32, -64) AND ext_index IS NOT NULL THEN abs(bitpix) // 8 * 1024 * (ext_index + 1) ELSE -1 END AS BIGINT) AS bytes FROM fits_headers")
def fits_data_size(spark, sf_dir):
    """Size of the data segment of each header unit, as an image of 1024 x (ext_index + 1); -1 without BITPIX."""
    axes = F.array(F.lit(1024).cast("long"), F.col("ext_index") + 1)
    none = F.lit(None).cast("long")
    return table(spark, sf_dir, "fits_headers").select("header_id", fitsvalues.data_size(F.col("bitpix"), axes, none, none, F.lit(False)).alias("bytes")).distinct()


@query(OBS + "SELECT obsid, round(s_ra - 1e-4 * (5 - 10), 9) AS ra, round(s_dec + 1e-4 * (6 - 20), 9) AS dec FROM (SELECT obsid, CASE WHEN s_dec IS NOT NULL THEN s_ra END AS s_ra, CASE WHEN s_ra IS NOT NULL THEN s_dec END AS s_dec FROM obs)")
def wcs_world(spark, sf_dir):
    """Sky position of a pixel by a linear transform centred on each observation; null without a position."""
    header = {"CRPIX1": F.lit(10), "CRPIX2": F.lit(20), "CRVAL1": F.col("s_ra"), "CRVAL2": F.col("s_dec"), "CDELT1": F.lit(-1e-4), "CDELT2": F.lit(1e-4)}
    found = observations(spark, sf_dir).select("obsid", fitsvalues.to_world(fitsvalues.wcs(header), F.lit(4.0), F.lit(5.0)).alias("w"))
    return found.select("obsid", F.round("w.ra", 9).alias("ra"), F.round("w.dec", 9).alias("dec"))


@query(r"SELECT word AS keyword, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{M}]*')) AS word FROM documents) GROUP BY word")
def keyword_frequency(spark, sf_dir):
    """Frequency of every word of the texts: letters of any script with their marks."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(words.alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query(OBS + "SELECT obsid, obs_collection, turn FROM (SELECT *, row_number() OVER (PARTITION BY obs_collection ORDER BY obsid) AS turn FROM obs) ORDER BY turn, obs_collection LIMIT 100")
def round_robin_sample(spark, sf_dir):
    """The first hundred observations when collections take turns."""
    return groups.round_robin(observations(spark, sf_dir).select("obsid", "obs_collection"), "obs_collection", [F.col("obsid")], 100)


_vec = "avg(cos(radians(s_dec))*cos(radians(s_ra))) AS x, avg(cos(radians(s_dec))*sin(radians(s_ra))) AS y, avg(sin(radians(s_dec))) AS z"


@query(OBS + f"SELECT obs_collection, round(((degrees(atan2(y, x)) % 360) + 360) % 360, 6) AS ra, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS dec FROM (SELECT obs_collection, {_vec} FROM obs WHERE abs(s_dec) <= 90 AND NOT isnan(s_ra) GROUP BY obs_collection)")
def spherical_mean(spark, sf_dir):
    """Mean position of each collection."""
    ra, dec = sphere.mean_position(F.col("s_ra"), F.col("s_dec"))
    good = observations(spark, sf_dir).where("abs(s_dec) <= 90 and not isnan(s_ra)")
    return good.groupBy("obs_collection").agg(F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query(OBS + "SELECT filters FROM (SELECT DISTINCT filters FROM obs WHERE obs_collection = 'PS1' AND filters IN ('y', 'z', 'i', 'r', 'g')) ORDER BY strpos('yzirg', filters) LIMIT 3")
def rgb_pick(spark, sf_dir):
    """Three filters for a colour image."""
    return groups.rgb_pick(observations(spark, sf_dir).where("obs_collection = 'PS1'"))


@query(OBS + "SELECT obs_id, min(t_min) FILTER (isfinite(t_min)) AS first_start, max(t_min) FILTER (isfinite(t_min)) AS last_start, coalesce(array_to_string(list_sort(list(DISTINCT filters) FILTER (filters IS NOT NULL)), ','), '') AS filters, coalesce(array_to_string(list_sort(list(DISTINCT instrument_name) FILTER (instrument_name IS NOT NULL)), ','), '') AS instruments, count(*) AS n FROM obs GROUP BY obs_id")
def obs_id_summary(spark, sf_dir):
    """Filters, instruments and times of each observation id."""
    return groups.id_summary(observations(spark, sf_dir))


_jwst_colour = "CASE WHEN isnan({p}) THEN NULL WHEN {p} < 1.2 THEN 'Blue' WHEN {p} < 2 THEN 'Cyan' WHEN {p} < 3 THEN 'Green' WHEN {p} < 5 THEN 'Yellow' WHEN {p} < 10 THEN 'Orange' WHEN {p} < 18 THEN 'Red' ELSE 'Deep Red / Far-IR' END".format(p="pivotwavelength")
_hst_colour = "CASE WHEN {p} < 3200 THEN 'Ultraviolet' WHEN {p} < 4500 THEN 'Blue' WHEN {p} < 5000 THEN 'Cyan' WHEN {p} < 5700 THEN 'Green' WHEN {p} < 6200 THEN 'Yellow' WHEN {p} < 7000 THEN 'Red' ELSE 'Deep Red / Near-IR' END".format(p="pivotwavelengthangstroms")
_hst_regime = "CASE WHEN {p} < 3200 THEN 'Ultraviolet' WHEN {p} < 4000 THEN 'Near-Ultraviolet / Violet' WHEN {p} < 5000 THEN 'Blue' WHEN {p} < 5900 THEN 'Green / Visual' WHEN {p} < 7000 THEN 'Red' ELSE 'Near-Infrared' END".format(p="pivotwavelengthangstroms")


@query(f"SELECT 'JWST' AS mission, filter_name, {_jwst_colour} AS colour, wavelengthregime AS regime FROM jwst_filter_meta UNION ALL SELECT 'HST', filter_name, {_hst_colour}, {_hst_regime} FROM hst_filter_meta")
def filter_colours(spark, sf_dir):
    """Display colour and regime of each filter of both missions."""
    return dims.filters(spark, sf_dir).select("mission", "filter_name", "colour", "regime")


_listed = "SELECT obsid, CASE WHEN obs_collection = 'JWST' THEN 'JWST' ELSE 'HST' END AS mission, trim(f) AS f FROM (SELECT obsid, obs_collection, unnest(string_split(filters, ';')) AS f FROM obs WHERE obs_collection IN ('JWST', 'HST', 'HLA'))"


@query(OBS + f"SELECT obsid, 'JWST' AS mission, m.filter_name, m.filtertype, m.instruments, m.pivotwavelength AS pivot_um FROM ({_listed}) o JOIN jwst_filter_meta m ON mission = 'JWST' AND o.f = m.filter_name UNION ALL SELECT obsid, 'HST', m.filter_name, m.filtertype, m.instruments, m.pivotwavelengthangstroms / 10000 FROM ({_listed}) o JOIN hst_filter_meta m ON mission = 'HST' AND upper(o.f) = m.filter_name")
def filter_metadata(spark, sf_dir):
    """Metadata of each filter in an observation's list, by mission and filter."""
    own = F.col("obs_collection").isin("JWST", "HST", "HLA")
    return dims.of_observations(observations(spark, sf_dir, own), dims.filters(spark, sf_dir)).select("obsid", "mission", "filter_name", "filtertype", "instruments", "pivot_um")


@query("SELECT lookup_id, ra, decl, coalesce(radius, 0.02) AS radius FROM name_lookup")
def lookup_defaults(spark, sf_dir):
    """Resolver rows with the default radius."""
    return table(spark, sf_dir, "name_lookup").select("lookup_id", "ra", "decl", F.coalesce("radius", F.lit(0.02)).alias("radius"))


@query("SELECT obs_collection, count(*) AS n, count(DISTINCT obsid) AS n_obs FROM caom_obs GROUP BY obs_collection")
def counts(spark, sf_dir):
    """Rows and observations of each collection."""
    return table(spark, sf_dir, "caom_obs").groupBy("obs_collection").agg(F.count("*").alias("n"), F.countDistinct("obsid").alias("n_obs"))
