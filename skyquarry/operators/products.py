"""Products of observations: sizes, addresses and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.functions.text import is_fits_name, product_locator
from skyquarry.operators.groups import IDENTITY


def product_sizes(obs: DataFrame, products: DataFrame) -> DataFrame:
    """(obsid, n_products, total_size): sized products of each observation; zero and missing sizes don't count."""
    sized = products.where(F.col("size") > 0).select("product_id", "obsid", "size").distinct()
    sums = sized.groupBy("obsid").agg(F.count("*").alias("n_products"), F.sum("size").alias("total_size"))
    return obs.select("obsid").join(sums, "obsid", "left").select("obsid", F.coalesce("n_products", F.lit(0)).alias("n_products"), "total_size")


def match_locators(obs: DataFrame, address: str, products: DataFrame) -> DataFrame:
    """(obsid, address, product_id, size): the first product, by id, whose locator fits the address.

    Products are joined by obsid; then the locators must be equal, contain one another, or the address
    must contain the file's name or the rest of the locator after ``url/``.
    """
    a = obs.select("obsid", F.col(address).alias("address"), product_locator(F.col(address)).alias("url")).where("url <> ''")
    p = products.where("size is not null and datauri is not null").select("obsid", "product_id", "size", product_locator(F.col("datauri")).alias("uri"), F.lower("productfilename").alias("file"))
    rest = F.element_at(F.split("uri", "url/"), -1)
    url, uri = F.col("url"), F.col("uri")
    fits = (url == uri) | url.contains(uri) | uri.contains(url) | ((F.col("file") != "") & url.contains(F.col("file"))) | url.contains(rest)
    pairs = a.join(p, "obsid").where(fits)
    return pairs.groupBy("obsid", "address").agg(F.min(F.struct("product_id", "size")).alias("b")).select("obsid", "address", "b.product_id", "b.size")


def preview_routes(obs: DataFrame) -> DataFrame:
    """(obsid, route) to each preview: direct for a web address, service for the others.

    The address is the preview's, or the data's where there is none; a missing one counts as empty, so the
    service has to find it. Of the same observation (IDENTITY) delivered under several ids the service gets
    the smallest obsid, and none if any of them is direct.
    """
    address = F.coalesce(F.nullif("jpegurl", F.lit("")), "dataurl", F.lit(""))
    rows = obs.select("obsid", *IDENTITY, address.contains("http").alias("web"))
    direct = rows.where("web")
    others = rows.where("not web").groupBy(*IDENTITY).agg(F.min("obsid").alias("obsid"))
    same = [others[c].eqNullSafe(direct[c]) for c in IDENTITY]
    left = others.join(direct, same, "left_anti")
    return direct.select("obsid", F.lit("direct").alias("route")).unionAll(left.select("obsid", F.lit("service").alias("route")))


def product_routes(obs: DataFrame, kind: str = "fits") -> DataFrame:
    """(obsid, route) of every observation by the address of one kind of product, ``fits`` or ``jpeg``; missing ones go to the service."""
    address = F.coalesce(F.col({"fits": "dataurl", "jpeg": "jpegurl"}[kind]), F.lit(""))
    return obs.select("obsid", F.when(address.contains("http"), "direct").otherwise("service").alias("route"))


def product_urls(obs: DataFrame, preview: bool = False) -> DataFrame:
    """(obsid, kind, url): the addresses of previews and of data, one row each.

    For a preview of the search itself only data addresses count, without those of TESS.
    """

    def of(column: str) -> DataFrame:
        return obs.where(F.col(column) != "").select("obsid", F.lit(column).alias("kind"), F.col(column).alias("url"), "obs_collection")

    if preview:
        return of("dataurl").where(~F.col("obs_collection").eqNullSafe("TESS")).drop("obs_collection")
    return of("jpegurl").unionAll(of("dataurl")).drop("obs_collection")


def enrich_sizes(obs: DataFrame, address: str, by_product: DataFrame, cache: DataFrame, keep: list[str] = []) -> DataFrame:
    """Size of each address: from its product, else from a cache of (address, size)."""
    found = by_product.select("obsid", "address", F.col("size").alias("by_product"))
    known = cache.where("size > 0").select(F.col("address"), F.col("size").alias("by_cache")).dropDuplicates(["address"])
    rows = obs.select("obsid", F.col(address).alias("address"), *keep)
    return rows.join(found, ["obsid", "address"], "left").join(known, "address", "left").select("obsid", "address", *keep, F.coalesce("by_product", "by_cache").alias("size"))


def upsert_sizes(cache: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """The cache after fresh (address, size, order) rows: positive sizes only, the last of each address wins."""
    last = fresh.where("size > 0").groupBy("address").agg(F.max_by("size", order).alias("size"))
    return cache.join(last, "address", "left_anti").select("address", "size").unionByName(last)


def merge_headers(primary: DataFrame, extension: DataFrame) -> DataFrame:
    """Merged (file, ordinal, keyword, value): the extension's value at the first place of a keyword.

    Input rows are (file, ordinal, keyword, value). COMMENT, HISTORY and blank keywords are kept from
    both and come last; of repeated keywords the primary's first and the extension's last count.
    """
    both = primary.withColumn("part", F.lit(0)).unionByName(extension.withColumn("part", F.lit(1)))
    many = F.col("keyword").isin("COMMENT", "HISTORY", "")
    place = F.struct("part", "ordinal")
    rank = F.when(F.col("part") == 1, F.struct(F.lit(1).alias("p"), F.col("ordinal").alias("o"))).otherwise(F.struct(F.lit(0).alias("p"), (-F.col("ordinal")).alias("o")))
    single = both.where(~many).groupBy("file", "keyword").agg(F.min(place).alias("at"), F.max_by("value", rank).alias("value")).withColumn("last", F.lit(0))
    rows = single.select("file", "last", "at", "keyword", "value").unionByName(both.where(many).select("file", F.lit(1).alias("last"), place.alias("at"), "keyword", "value"))
    listed = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("last", "at", "keyword", "value"))).alias("h"))  # one file's header
    return listed.select("file", F.posexplode("h").alias("ordinal", "h")).select("file", "ordinal", "h.keyword", "h.value")


def pair_planes(planes: DataFrame, wcs_equal) -> DataFrame:
    """(file, ext_index, weight_index) of science planes with the weight plane of equal size, of equal sky transform first.

    ``planes`` has file, ext_index, role, width, height and wcs; ``wcs_equal`` compares two wcs columns.
    """
    s, w = planes.where("role = 'science'").alias("s"), planes.where("role = 'weight'").alias("w")
    size = (F.col("s.file") == F.col("w.file")) & (F.col("s.width") == F.col("w.width")) & (F.col("s.height") == F.col("w.height"))
    rank = F.struct((~wcs_equal(F.col("s.wcs"), F.col("w.wcs"))).alias("unlike"), F.col("w.ext_index").alias("x"))
    return s.join(w, size, "left").groupBy(F.col("s.file").alias("file"), F.col("s.ext_index").alias("ext_index")).agg(F.min(F.when(F.col("w.ext_index").isNotNull(), rank)).alias("b")).select("file", "ext_index", F.col("b.x").alias("weight_index"))


def content_sizes(obs: DataFrame, products: DataFrame, cache: DataFrame) -> DataFrame:
    """Observations with ``dataurl_size`` and ``jpegurl_size``, and the preferred one of them, ``download_size``.

    A size comes from the observation's product that fits the address, else from a cache of (address,
    size); sizes that are not positive count as missing. Both kinds of addresses are matched in one pass.
    """
    kinds = ("dataurl", "jpegurl")
    each = obs.select("obsid", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("address")) for k in kinds])).alias("a")).select("obsid", "a.*").where("address <> ''")
    by_product = match_locators(each, "address", products).where("size > 0").select("obsid", "address", "size")
    sized = enrich_sizes(each.select("obsid", "address", "kind"), "address", by_product, cache, keep=["kind"])
    sizes = sized.groupBy("obsid").agg(*[F.max(F.when(F.col("kind") == k, F.col("size"))).alias(f"{k}_size") for k in kinds])
    return obs.join(sizes, "obsid", "left").withColumn("download_size", F.coalesce("dataurl_size", "jpegurl_size"))


def missing_addresses(sized: DataFrame) -> DataFrame:
    """(address) of every address without a size, once: what is left to ask for."""
    parts = [sized.where((F.col(k) != "") & F.col(f"{k}_size").isNull()).select(F.col(k).alias("address")) for k in ("dataurl", "jpegurl")]
    return parts[0].unionAll(parts[1]).distinct()


def attach_metadata(obs: DataFrame, metadata: DataFrame, file: str = "file_identifier") -> DataFrame:
    """Observations with the metadata of the file that their data address ends in; null where there is none."""
    name = F.element_at(F.split("dataurl", "/"), -1)
    return obs.withColumn("_file", F.when(name != "", name)).join(metadata.withColumnRenamed(file, "_file"), "_file", "left").drop("_file")


def science_files(products: DataFrame) -> DataFrame:
    """Products that are science files in FITS."""
    return products.where((F.upper("producttype") == "SCIENCE") & is_fits_name(F.col("productfilename")))


def preferred_plane(planes: DataFrame) -> DataFrame:
    """One plane a file: the first of science, else the first of unknown role."""
    ranked = F.struct((F.col("role") != "science").alias("other"), F.col("ext_index").alias("i"))
    return planes.where(F.col("role").isin("science", "unknown")).groupBy("file").agg(F.min_by(F.struct("*"), ranked).alias("r")).select("r.*")
