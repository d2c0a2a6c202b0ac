"""The queries of the data-preparation problems that belong to the core, over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.functions import keys
from skyquarry.operators.impute import fill_missing
from skyquarry.operators.instants import candidates, resolve
from skyquarry.operators.intervals import periods_and_gaps
from skyquarry.operators.nearby import near_pairs, points_in_regions
from skyquarry.operators.packed import split_packed
from skyquarry.operators.units import to_common_unit
from skyquarry.session import cut, small, table, usable

#: All true times of the archive lie between these MJD.
FIRST_MJD, LAST_MJD = 43000.0, 62500.0
NEAR_ARCSEC = 2.0


def good_time(column: str) -> Column:
    return usable(column) & F.col(column).between(FIRST_MJD, LAST_MJD)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name of the packed filters and instruments in its own row."""
    return split_packed(table(spark, sf_dir, "caom_obs"), "obsid", ["filters", "instrument_name"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations near each other and catalogued positions inside footprints."""
    obs, names = table(spark, sf_dir, "caom_obs"), table(spark, sf_dir, "name_lookup")
    near = near_pairs(obs, "obsid", "s_ra", "s_dec", NEAR_ARCSEC / 3600)
    inside = points_in_regions(names, "lookup_id", "ra", "decl", obs, "obsid", "s_region")
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(inside.select(F.lit("inside").alias("kind"), "id_a", "id_b"))


def p3_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missing time of an observation with the value filled in and where it came from."""
    obs = table(spark, sf_dir, "caom_obs")
    key = keys.group_key(F.col("obs_collection"), F.col("obs_id"))
    return fill_missing(
        obs,
        "obsid",
        [keys.mission(F.col("obs_collection")), key],
        {f: F.when(good_time(f), F.col(f)) for f in ("t_min", "t_max", "t_obs_release")},
        {"ingested": F.unix_micros("ingested_at") / 86_400e6, "t_exptime": F.when(usable("t_exptime") & (F.col("t_exptime") > 0), F.col("t_exptime"))},
        {c: F.col(c) for c in ("obs_collection", "proposal_id", "proposal_type", "calib_level", "dataproduct_type")},
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missing time of an observation and its donor."""
    return p3_filled(spark, sf_dir).select("obsid", "field", "donor")


def _pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, filter_name, proper, pivot_nm) of both filter tables.

    A table is a sequence along the numbers in its filters' names, over which the pivot rises steadily: the
    level is the number times the step that most of the table's pivots have to it, in the table's own unit.
    """
    tables = []
    for tab, column, own in (("jwst_filter_meta", "pivotwavelength", 1e3), ("hst_filter_meta", "pivotwavelengthangstroms", 0.1)):
        number = F.regexp_extract("filter_name", "^[A-Za-z]+([0-9]+)", 1).try_cast("double")
        rows = table(spark, sf_dir, tab).select(F.concat_ws("|", F.lit(tab), "filter_name").alias("k"), F.lit(tab).alias("tab"), F.col(column).alias("pivot"), "remark", F.log10(F.when(number > 0, number)).alias("at"))
        step = rows.where(usable("pivot") & (F.col("pivot") > 0)).agg(F.percentile(F.log10(F.col("pivot") * own) - F.col("at"), 0.5).alias("step"))
        tables.append(rows.crossJoin(F.broadcast(step)).withColumn("level", F.col("at") + F.col("step")).drop("step"))  # one row
    pivot = F.col("pivot")
    nm = to_common_unit(tables[0].unionByName(tables[1]), "k", F.col("tab"), F.col("at"), pivot, pivot, F.col("remark"), level=F.col("level"))
    tab, name = F.split_part("k", F.lit("|"), F.lit(1)), F.split_part("k", F.lit("|"), F.lit(2))
    own = F.when(tab == "jwst_filter_meta", 1e3).otherwise(0.1)
    proper = F.coalesce(F.abs(F.col("scale_nm") / own - 1) < 1e-6, F.lit(False))
    return nm.select(tab.alias("tab"), name.alias("filter_name"), F.col("lo_nm").alias("pivot_nm"), proper.alias("proper"))


def p4_common(spark: SparkSession, sf_dir: str, pivots: DataFrame | None = None) -> DataFrame:
    """Every band of the observations in nm with the unit found and how."""
    obs = table(spark, sf_dir, "caom_obs")
    pivots = (pivots or _pivots(spark, sf_dir)).where("pivot_nm is not null").groupBy(F.upper("filter_name").alias("name"), (F.col("tab") == "jwst_filter_meta").alias("jwst")).agg(F.max("pivot_nm").alias("pivot_nm"))
    first = F.upper(F.trim(F.translate(F.col("filters"), "[](){}\"'", "         ")))
    several = F.regexp_replace(F.col("filters"), "[;,|+&/\\t\\s\\])}]+$", "").rlike("[;,|+&/\\t]")
    first = F.regexp_replace(first, "^[;,|+&/\\s]+|[;,|+&/\\s]+$", "")
    rows = obs.select("obsid", "em_min", "em_max", "em_unit", "t_min", F.upper("obs_collection").alias("collection"), first.alias("name"), F.coalesce(several, F.lit(False)).alias("several"))
    rows = rows.withColumn("jwst", F.col("collection") == "JWST").join(F.broadcast(pivots), ["name", "jwst"], "left")  # a row per filter of two fixed tables
    return to_common_unit(
        rows,
        "obsid",
        F.concat_ws("|", keys.mission(F.col("collection")), "name"),
        F.col("t_min"),
        F.col("em_min"),
        F.col("em_max"),
        F.col("em_unit"),
        level=F.when(F.col("collection").isin("JWST", "HST", "HLA"), F.log10("pivot_nm")),
        chained=~F.col("several"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands and pivots that stood in another unit, in hundredths of a nanometre."""
    found = cut(_pivots(spark, sf_dir))
    bands = p4_common(spark, sf_dir, found).where(~F.col("own") & F.col("lo_nm").isNotNull())
    cnm = lambda c: F.round(F.col(c) * 100).cast("long")
    pivots = found.where(~F.col("proper") & F.col("pivot_nm").isNotNull())
    return bands.select(F.lit("caom_obs").alias("tab"), F.col("obsid").cast("string").alias("rec_key"), cnm("lo_nm").alias("lo_cnm"), cnm("hi_nm").alias("hi_cnm")).unionByName(
        pivots.select("tab", F.col("filter_name").alias("rec_key"), cnm("pivot_nm").alias("lo_cnm"), cnm("pivot_nm").alias("hi_cnm"))
    )


def p5_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that names an instant, as UTC, with its format and whether the reading is ambiguous."""
    sites = table(spark, sf_dir, "obs_sites").select("site_code", "zone_name").dropDuplicates(["site_code"])
    zones = [r.zone_name for r in sites.select("zone_name").distinct().collect() if r.zone_name]  # at most the IANA zones, a few hundred
    headers = table(spark, sf_dir, "fits_headers").join(small(sites, 10_000), "site_code", "left")
    wire = table(spark, sf_dir, "coam_wire")
    civil = dict(zone=F.col("zone_name"), scale=F.col("timesys"))
    telescope = F.upper(F.trim("telescop"))
    read = candidates(headers, "header_id", F.col("date_obs"), telescope, field="date_obs", clock=F.col("time_obs"), **civil)
    read = read.unionByName(candidates(headers, "header_id", F.col("tstart"), telescope, field="tstart", numbers="header", unit=F.col("timeunit"), epoch=F.col("mjdref"), **civil))
    read = read.unionByName(candidates(wire, "wire_id", F.col("t_min"), F.col("feed"), field="t_min", numbers="feed"))
    return resolve(read, zones).select("field", F.col("rid").alias("rec_id"), "utc_ms", "fmt", "posterior", "ambiguous")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that names an instant, in milliseconds since 1970 UTC."""
    return p5_instants(spark, sf_dir).select("field", "rec_id", "utc_ms")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous observing periods, and the gaps between them, of each target in each proposal."""
    obs = table(spark, sf_dir, "caom_obs")
    spans = obs.where(good_time("t_min") & good_time("t_max") & (F.col("t_min") <= F.col("t_max")) & F.col("target_name").rlike("\\S")).select(
        "proposal_id", "target_name", F.round(F.col("t_min") * 86400).alias("start"), F.round(F.col("t_max") * 86400).alias("end")
    )
    return periods_and_gaps(spans, ("proposal_id", "target_name"), "start", "end")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_filled": p3_filled,
    "p4_found": p4_found,
    "p4_common": p4_common,
    "p5_found": p5_found,
    "p5_instants": p5_instants,
    "p7_found": p7_found,
}

#: Only where SQL is quick on whole tables; the others are tested against brute force.
ORACLES = {
    "p3_found": r"""
WITH obs AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM caom_obs),
g AS (SELECT *, CASE upper(obs_collection) WHEN 'HLA' THEN 'HST' ELSE upper(obs_collection) END AS mission,
 CASE WHEN upper(obs_collection) = 'JWST' AND len(string_split(obs_id, '_')) >= 3 THEN array_to_string(string_split(obs_id, '_')[1:3], '_')
  WHEN upper(obs_collection) = 'HST' OR lower(obs_id) LIKE 'hst\_%' ESCAPE '\' THEN regexp_replace(obs_id, '(?i)_(clear|(fq?|g)[0-9]{2,4}[a-z0-9]*)(_.*)?$', '') ELSE obs_id END AS key FROM obs),
v AS (SELECT obsid, mission, key, field, CASE WHEN NOT isnan(value) AND value BETWEEN 43000 AND 62500 THEN value END AS value FROM
 (SELECT obsid, mission, key, unnest(['t_min', 't_max', 't_obs_release']) AS field, unnest([t_min, t_max, t_obs_release]) AS value FROM g)),
n AS (SELECT mission, key, field, count(value) AS n FROM v WHERE mission IS NOT NULL AND key IS NOT NULL GROUP BY ALL)
SELECT obsid, field, CASE WHEN n.n > 0 THEN 'group' ELSE 'none' END AS donor FROM v LEFT JOIN n USING (mission, key, field) WHERE value IS NULL
""",
    "p7_found": """
WITH iv AS (
  SELECT proposal_id, target_name, CAST(round(t_min * 86400) AS BIGINT) AS s, CAST(round(t_max * 86400) AS BIGINT) AS e
  FROM caom_obs
  WHERE NOT isnan(t_min) AND NOT isnan(t_max) AND t_min BETWEEN 43000 AND 62500 AND t_max BETWEEN 43000 AND 62500
    AND t_min <= t_max AND regexp_matches(target_name, '\\S') AND proposal_id IS NOT NULL),
m AS (
  SELECT *, max(e) OVER (PARTITION BY proposal_id, target_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
n AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY proposal_id, target_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (
  SELECT proposal_id, target_name, island, min(s) AS start_s, max(e) AS end_s FROM n GROUP BY ALL)
SELECT proposal_id, target_name, 'period' AS kind, start_s, end_s FROM p
UNION ALL
SELECT proposal_id, target_name, 'gap' AS kind, prev AS start_s, start_s AS end_s
FROM (SELECT *, lag(end_s) OVER (PARTITION BY proposal_id, target_name ORDER BY island) AS prev FROM p) WHERE prev IS NOT NULL
""",
}
