"""Choices among observations and observation groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquarry.functions import keys
from skyquarry.session import cut, small, usable

#: Named bands and the filters they hold; a filter may be in several.
BANDS = {
    "UV/Blue": ["F212N", "F336W", "F250M", "F140M", "F150W2"],
    "Visible": ["F555W", "F502N", "F606W", "F631N", "F656N", "F673N", "F675W", "g", "r", "i", "z"],
    "Red/Near-IR": ["F814W", "F850LP", "F953N", "F108N", "F110W", "F110M", "F113N", "F160W", "F164N", "F166N", "F187N", "F190N", "F215N", "F222M", "F237M", "y"],
    "Mid-IR": ["F560W", "F770W", "F1130W", "F2100W"],
    "Broad": ["TESS", "MIRVIS", "detection"],
}
#: Fixed value: starts (MJD) from here on stand for missing ones.
NO_START = 1e6
#: Columns that make two observations the same.
IDENTITY = ["obs_id", "filters", "instrument_name", "t_min", "t_max"]


def _pick(df: DataFrame, by: Column, order: list[Column]) -> DataFrame:
    """One row for each ``by``: the least by ``order``. A map-side aggregate, so hot groups are no problem."""
    best = df.select(by.alias("_by"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct("*").alias("row")).alias("_s"))
    return best.groupBy("_by").agg(F.min("_s").alias("_s")).select("_s.row.*")


def first_per_filter(df: DataFrame) -> DataFrame:
    """The earliest observation of each filter text; ties by obsid, missing times last."""
    return _pick(df, F.col("filters"), [F.col("t_min").isNull(), F.col("t_min"), F.col("obsid")])


def closest_epoch(df: DataFrame) -> DataFrame:
    """For each filter the observation closest to the median start; starts up to 0 don't count for the median.

    Starts that are missing, not finite or from ``NO_START`` on don't count for it either, and their
    observations come after all others, in order of obsid. Without any positive start the first by obsid is taken.
    """
    known = usable("t_min") & (F.col("t_min") < NO_START)
    median = df.where(known & (F.col("t_min") > 0)).agg(F.percentile("t_min", 0.5).alias("epoch"))
    with_epoch = df.crossJoin(F.broadcast(median))  # one row
    distance = F.when(known, F.abs(F.col("t_min") - F.col("epoch")))
    return _pick(with_epoch, F.col("filters"), [F.coalesce(distance, F.lit(float("inf"))), F.col("obsid")]).drop("epoch")


GROUP = ["mission", "observation_key", "instrument"]


def group_products(df: DataFrame, order: str = "filter") -> DataFrame:
    """Rows of observations with their group (mission, observation_key, instrument), wavelength, time and position.

    ``position`` counts a group's products from 1 in order of wavelength, time, filter text and obsid, or
    of time first (``order="time"``); missing times and texts come first. Products stay rows: a group of
    any size is spread over the partitions of one range sort, in which ranks are counted apart and
    completed by the counts of the partitions before, so no group is gathered in one task.
    """
    wavelength = keys.filter_wavelength(F.col("filters"))
    time = keys.effective_time(F.col("t_min"), F.col("t_max"), F.col("t_obs_release"))
    rows = df.select(
        keys.mission(F.col("obs_collection")).alias("mission"), keys.group_key(F.col("obs_collection"), F.col("obs_id")).alias("observation_key"),
        F.col("instrument_name").alias("instrument"), wavelength.alias("wavelength"), time.alias("time"), "filters", "obsid",
    )
    by = ["wavelength", "time", "filters", "obsid"] if order == "filter" else ["time", "wavelength", "filters", "obsid"]
    placed = cut(rows.repartitionByRange(*GROUP, *by).withColumn("part", F.spark_partition_id()))  # both uses must see the same partitions
    before = placed.groupBy(*GROUP, "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part", *GROUP).orderBy(*by)))
    here = before.where("before is not null").select(*[F.col(g).alias(f"_{g}") for g in GROUP], F.col("part").alias("_part"), "before")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP] + [F.col("part") == F.col("_part")]
    found = ranked.join(small(here, 100_000), same, "left")  # a row for each border that a group crosses
    return found.select(*rows.columns, (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long").alias("position"))


def describe_groups(products: DataFrame) -> DataFrame:
    """(group, n_products, first_time, last_time, n_filters) of rows with a group: bounded summaries, summed map-side."""
    return products.groupBy(*GROUP).agg(
        F.count("*").alias("n_products"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.countDistinct("filters").alias("n_filters")
    )


def first_groups(products: DataFrame, limit: int) -> DataFrame:
    """The products of the first ``limit`` groups in order of mission, key and instrument; none for a limit up to 0."""
    if limit <= 0:
        return products.limit(0)
    first = products.select(*GROUP).distinct().orderBy(*GROUP).limit(limit)
    return products.join(small(first, 10_000), [products[g].eqNullSafe(first[g]) for g in GROUP], "left_semi")


def by_filter(df: DataFrame) -> DataFrame:
    """Rows with how many rows their filter has and when the first of them starts; the rows themselves stay apart."""
    counts = df.groupBy("filters").agg(F.count("*").alias("n_of_filter"), F.min("t_min").alias("first_start"))
    theirs = small(counts.withColumnRenamed("filters", "_f"), 50_000)
    return df.join(theirs, F.col("filters").eqNullSafe(F.col("_f"))).drop("_f")


def id_summary(df: DataFrame) -> DataFrame:
    """Times, and distinct filters and instruments in order, of each observation id; unusable times don't count."""
    start = F.when(usable("t_min"), F.col("t_min"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731 - distinct filters of one observation
    return df.groupBy("obs_id").agg(F.min(start).alias("first_start"), F.max(start).alias("last_start"), listed("filters").alias("filters"), listed("instrument_name").alias("instruments"), F.count("*").alias("n"))


def id_parts(df: DataFrame) -> DataFrame:
    """(obs_collection, parts, n, example): into how many parts the ids of a collection split."""
    parts = F.size(F.filter(F.split("obs_id", "_"), lambda x: x != ""))
    return df.groupBy("obs_collection", F.when(F.col("obs_id").isNotNull(), parts).cast("long").alias("parts")).agg(F.count("*").alias("n"), F.min("obs_id").alias("example"))


def band_counts(df: DataFrame) -> DataFrame:
    """Observations in each named band."""
    pairs = [(b, f) for b, fs in BANDS.items() for f in fs]
    bands = df.sparkSession.createDataFrame(pairs, "band string, filters string")
    return df.join(F.broadcast(bands), "filters").groupBy("band").agg(F.count("*").alias("n"))  # a fixed table


def unique_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of several columns as (column_name, value), in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.*").distinct()


def round_robin(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows when groups take turns, each in its order; (rows, turn).

    A group can give at most ``n`` of them, so the top n of each are kept first (partial per task).
    """
    turn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", by).limit(n)


def rgb_pick(df: DataFrame, filters: str = "yzirg") -> DataFrame:
    """Up to three single-letter filters in the order of ``filters``."""
    at = F.instr(F.lit(filters), F.col("filters"))
    letters = df.where((F.length("filters") == 1) & (at > 0)).select("filters").distinct()
    return letters.orderBy(at).limit(3)
