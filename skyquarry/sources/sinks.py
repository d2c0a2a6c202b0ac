"""Writers: partitioned storage, CSV and JSON, counters and size caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.functions.text import path_part


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Observations under target / collection / observation / filter, each made safe as a path."""
    levels = {"target": "target_name", "collection": "obs_collection", "observation": "obs_id", "band": "filters"}
    for name, column in levels.items():
        df = df.withColumn(name, path_part(F.replace(F.col(column), F.lit(";"), F.lit("-")), "unknown"))
    df.repartition(*levels).write.mode(mode).partitionBy(*levels).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside a value are doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """Counters (keyword, n) as JSON lines by falling count."""
    counts.orderBy(F.desc("n"), "keyword").write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Log lines (time, message) appended as text."""
    df.select(F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.col("message")).alias("value")).write.mode("append").text(path)


def write_headers(cards: DataFrame, path: str) -> None:
    """One JSON object a file, keyword to value with keywords in order; of repeated ones the first counts.

    ``cards`` is (file, ordinal, keyword, value).
    """
    single = cards.groupBy("file", "keyword").agg(F.min_by("value", "ordinal").alias("value"))
    sorted_ = F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "value"))))  # one file's header
    single.groupBy("file").agg(sorted_.alias("header")).write.mode("overwrite").json(path)


def write_relevance(counts: DataFrame, path: str) -> None:
    """Keywords with count and relevance as CSV by falling count."""
    counts.select("keyword", "n", "relevance").orderBy(F.desc("n"), "keyword").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) rows as files of their own under a folder of shared storage; gives (name, path, size).

    Each file is written whole beside its place and then moved there, so a task that is run again leaves the
    same files. Names are made safe as paths; an existing file is replaced.
    """
    import uuid

    import pandas as pd

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.name, pdf.content):
                part = f"{base}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{base}/{name}")
                rows.append((name, f"{base}/{name}", len(content)))
            yield pd.DataFrame(rows, columns=["name", "path", "size"])

    safe = files.where("name is not null and content is not null").select(path_part(F.col("name"), "file").alias("name"), "content")
    return safe.mapInPandas(run, "name string, path string, size long")
