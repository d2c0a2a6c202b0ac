"""Filter dimensions of both missions, keyed by (mission, filter), as one name may be a filter of either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.functions import text
from skyquarry.session import small, table


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mission, filter_name, instruments, pivot_um, bandwidth_um, filtertype, regime, use, remark, colour) of both tables, as stored."""
    jwst, hst = table(spark, sf_dir, "jwst_filter_meta"), table(spark, sf_dir, "hst_filter_meta")
    pivot = F.col("pivotwavelengthangstroms")
    one = jwst.select(
        F.lit("JWST").alias("mission"), "filter_name", "instruments", F.col("pivotwavelength").alias("pivot_um"), F.col("bandwidth").alias("bandwidth_um"), "filtertype",
        F.col("wavelengthregime").alias("regime"), F.col("scienceuse").alias("use"), "remark", text.stepped(F.col("pivotwavelength"), text.JWST_COLOURS).alias("colour"),
    )
    two = hst.select(
        F.lit("HST").alias("mission"), "filter_name", "instruments", (pivot / 10000).alias("pivot_um"), (F.col("bandwidthangstroms") / 10000).alias("bandwidth_um"), "filtertype",
        text.stepped(pivot, text.HST_REGIMES).alias("regime"), F.col("scienceuse").alias("use"), "remark", text.stepped(pivot, text.HST_COLOURS).alias("colour"),
    )
    return one.unionByName(two)


def of_observations(obs: DataFrame, known: DataFrame) -> DataFrame:
    """(obsid, every column of ``known``) for each filter in the ``;`` list of an observation of either mission.

    Names of the first mission compare as written, those of the other in upper case.
    """
    jwst = F.col("obs_collection") == "JWST"
    names = F.when(jwst, text.split_filters(F.col("filters"), upper=False)).otherwise(text.split_filters(F.col("filters")))
    parts = obs.select("obsid", F.when(jwst, "JWST").otherwise("HST").alias("mission"), F.explode(names).alias("filter_name"))
    return parts.join(small(known, 5_000), ["mission", "filter_name"])
