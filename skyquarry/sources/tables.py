"""Readers of delivered tables: JSON envelopes, plain CSV, image lists, XML rows and archives of files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that a response declares for its fields.
WIRE_TYPES = {"string": "string", "int": "bigint", "float": "double", "boolean": "boolean"}


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON responses ``{fields: [{name, type}], data: [{...}]}``; the fields that any of them declares give the schema.

    Fields that a row lacks and values that don't fit their type are null. A response with
    ``resolvedCoordinate`` gives its coordinates instead; any other gives an empty table.
    """
    raw = spark.read.text(path, wholetext=True)
    head = raw.select(F.from_json("value", "fields array<struct<name:string,type:string>>, resolvedCoordinate array<map<string,string>>").alias("h")).select("h.*")
    declared = head.where("fields is not null").select(F.posexplode("fields").alias("at", "f")).where("f.name <> ''")
    # the fields of all files, each with its first place and type; a table has a bounded number of them
    union = declared.groupBy("f.name").agg(F.min(F.struct("at", F.lower("f.type").alias("type"))).alias("d")).orderBy("d.at", "name").collect()
    if union:
        fields = [(r.name, WIRE_TYPES.get(r.d["type"] or "", "string")) for r in union]
        rows = raw.select(F.explode(F.from_json("value", "data array<map<string,string>>")["data"]).alias("r"))
        return rows.select(*[F.col("r")[n].try_cast(t).alias(n) for n, t in fields])
    resolved = head.where("resolvedCoordinate is not null").select(F.explode("resolvedCoordinate").alias("r"))
    names = ("searchString", "canonicalName", "resolver", "objectType")
    numbers = (("ra", "ra"), ("decl", "dec"), ("radius", "radius"))
    return resolved.select(*[F.coalesce(F.col("r")[n], F.lit("")).alias(n.lower()) for n in names], *[F.col("r")[a].try_cast("double").alias(b) for a, b in numbers])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header line, split at commas without quoting; all columns are text."""
    return spark.read.csv(path, header=True, quote="", sep=",")


def read_image_list(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """A table split at blanks, with the address of each image."""
    df = spark.read.csv(path, header=True, sep=" ", quote="")
    return df.withColumn("url", F.concat(F.lit(base_url), F.col("filename")))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """All rows of an XML response."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def tar_entries(files: DataFrame) -> DataFrame:
    """(path, name, size, content) of the regular files in (path, content) archives, plain or compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                        for m in archive:
                            if m.isfile():
                                yield pd.DataFrame([(path, m.name, m.size, archive.extractfile(m).read())], columns=["path", "name", "size", "content"])
                except tarfile.TarError:
                    continue

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, content binary")


#: Columns of an observation with the value that stands for a missing one.
TYPED = {
    "calib_level": ("bigint", 0), "datarights": ("string", ""), "dataurl": ("string", ""), "dataproduct_type": ("string", ""), "distance": ("double", 0.0),
    "em_max": ("double", 0.0), "em_min": ("double", 0.0), "filters": ("string", ""), "instrument_name": ("string", ""), "intenttype": ("string", ""),
    "jpegurl": ("string", ""), "mtflag": ("boolean", False), "objid": ("bigint", 0), "obs_collection": ("string", ""), "obs_id": ("string", ""),
    "obs_title": ("string", ""), "obsid": ("bigint", 0), "project": ("string", ""), "proposal_id": ("string", ""), "proposal_pi": ("string", ""),
    "proposal_type": ("string", ""), "provenance_name": ("string", ""), "s_dec": ("double", 0.0), "s_ra": ("double", 0.0), "s_region": ("string", ""),
    "sequence_number": ("bigint", 0), "srcden": ("double", 0.0), "t_exptime": ("double", 0.0), "t_max": ("double", 0.0), "t_min": ("double", 0.0),
    "t_obs_release": ("double", 0.0), "target_classification": ("string", ""), "target_name": ("string", ""), "wavelength_region": ("string", ""),
}


def typed_observations(df: DataFrame) -> DataFrame:
    """Observations from untyped rows: every column cast, missing columns and values replaced by their default."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.coalesce(F.col(f"`{have[c]}`").try_cast(t) if c in have else F.lit(None).cast(t), F.lit(d).cast(t)).alias(c) for c, (t, d) in TYPED.items()])


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has."""
    return df.select(*[c for c in columns if c in df.columns])


def column_or_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as text, empty where the table lacks one."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


#: Columns of a resolver row with the value that stands for a missing one.
RESOLVED = {
    "searchstring": ("string", ""), "canonicalname": ("string", ""), "resolver": ("string", ""), "objecttype": ("string", ""), "cached": ("boolean", False),
    "resolvertime": ("bigint", 0), "searchradius": ("double", 0.0), "ra": ("double", 0.0), "dec": ("double", 0.0), "radius": ("double", 0.02),
}


def typed_names(df: DataFrame) -> DataFrame:
    """Resolver rows typed, with defaults; the declination is called ``dec`` whether it came as that or as ``decl``."""
    have = {("dec" if c.lower() == "decl" else c.lower()): c for c in df.columns}
    return df.select(*[F.coalesce(F.col(f"`{have[c]}`").try_cast(t) if c in have else F.lit(None).cast(t), F.lit(d).cast(t)).alias(c) for c, (t, d) in RESOLVED.items()])


_RESOLVER = (
    "QueryTime string, ResultCode int, Version string, StatusCode int, Interpreted struct<Name:string>, Supplied string, NameResolver string, "
    "Preferred struct<Redshift:struct<Value:double,Uncertainty:double,RefCode:string,QualityFlag:string>,Name:string,"
    "Position:struct<RA:double,Dec:double,PosAngle:int,UncSemiMinor:double,UncSemiMajor:double,RefCode:string>,ObjType:struct<Value:string,RefCode:string>>"
)


def read_resolver(spark: SparkSession, path: str) -> DataFrame:
    """(supplied, name, ra, dec, object_type, redshift, result_code) of nested JSON replies of the second resolver, one a file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _RESOLVER).alias("r")).select("r.*")
    return raw.select(F.coalesce("Supplied", "Interpreted.Name").alias("supplied"), F.col("Preferred.Name").alias("name"), F.col("Preferred.Position.RA").alias("ra"), F.col("Preferred.Position.Dec").alias("dec"), F.col("Preferred.ObjType.Value").alias("object_type"), F.col("Preferred.Redshift.Value").alias("redshift"), F.col("ResultCode").alias("result_code"))


def stored_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size) of the files in a folder of products that hold anything; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.where("length > 0").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
