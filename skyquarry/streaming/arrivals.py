"""Streams of arriving observations and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, key: str = "obsid", time: str = "ingested_at", late: str = "400 days") -> DataFrame:
    """Each key once: redeliveries within ``late`` of the watermark are dropped, so state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrival_counts(stream: DataFrame, time: str = "ingested_at", window: str = "1 day", late: str = "400 days") -> DataFrame:
    """Arrivals a window and collection; rows later than ``late`` don't count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "obs_collection").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "obs_collection", "n")


def watch_files(spark: SparkSession, folder: str, pattern: str = "*.fits") -> DataFrame:
    """A stream of (path, length, content) of files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
