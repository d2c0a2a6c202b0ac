"""Header maps and keyword dictionaries: typed metadata from raw headers, and lookups of keywords.

A header is an array of struct(keyword, value) in file order, or a map made from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.session import small

#: The keywords of each metadata column in order of preference; the first with a value counts.
ALIASES = {
    "filter": ["FILTER", "FILTER1", "FILTNAM", "FILTNAM1"],
    "wavelength_region": ["WAVEBAND", "WAVELNTH", "SPECBAND"],
    "central_wavelength": ["WAVELEN", "CENTRWV", "PHOTPLAM"],
    "observation_date": ["DATE-OBS", "DATE_OBS", "DATEOBS"],
    "exposure_start": ["TIME-OBS", "TIME_OBS", "TIMEOBS"],
    "exposure_time": ["EXPTIME", "EXPOSURE", "INTTIME"],
    "crpix1": ["CRPIX1"], "crpix2": ["CRPIX2"], "crval1": ["CRVAL1"], "crval2": ["CRVAL2"], "cdelt1": ["CDELT1"], "cdelt2": ["CDELT2"],
    "wcs_axes": ["WCSAXES"], "equinox": ["EQUINOX"], "ctype1": ["CTYPE1"], "ctype2": ["CTYPE2"], "cunit1": ["CUNIT1"], "cunit2": ["CUNIT2"],
    "cd1_1": ["CD1_1"], "cd1_2": ["CD1_2"], "cd2_1": ["CD2_1"], "cd2_2": ["CD2_2"], "pc1_1": ["PC1_1"], "pc1_2": ["PC1_2"], "pc2_1": ["PC2_1"], "pc2_2": ["PC2_2"],
    "telescope": ["TELESCOP", "TELESCOPE"],
    "instrument": ["INSTRUME", "INSTRUMENT"],
    "detector": ["DETECTOR", "DETNAM"],
    "observation_id": ["OBS_ID", "OBSID", "OBSERVID"],
    "target": ["OBJECT", "TARGNAME", "TARGET"],
    "calibration_level": ["CALIB_LV", "CAL_VER", "CALVER"],
    "photometric_calibration": ["PHOTCAL", "PHOT_CAL"],
    "astrometric_calibration": ["ASTRCAL", "ASTR_CAL", "WCS_CAL"],
    "processing_software": ["ORIGIN", "CREATOR", "SOFTWARE"],
    "processing_date": ["DATE", "PROCDATE"],
    "zero_point": ["ZEROPNT", "ZPOINT", "ZP"],
    "magnitude_zero": ["MAGZPT", "MAGZERO"],
    "photometric_system": ["PHOTSYS", "PHOTOMET"],
    "data_quality": ["DATAQUAL", "QUALITY", "DQ_FLAG"],
    "seeing": ["SEEING", "FWHM"],
    "airmass": ["AIRMASS", "SECZ"],
    "sky_background": ["SKYLEVEL", "BACKGRND", "SKY"],
    "read_noise": ["RDNOISE", "READNOIS"],
    "gain": ["GAIN", "EGAIN"],
    "extension_type": ["XTENSION", "EXTNAME"],
    "fits_version": ["SIMPLE", "FITS_VER"],
    "original_format": ["ORIGFMT", "FORMAT"],
}
NUMERIC = {
    "central_wavelength", "exposure_time", "crpix1", "crpix2", "crval1", "crval2", "cdelt1", "cdelt2", "wcs_axes", "equinox", "cd1_1", "cd1_2", "cd2_1", "cd2_2",
    "pc1_1", "pc1_2", "pc2_1", "pc2_2", "zero_point", "magnitude_zero", "seeing", "airmass", "sky_background", "read_noise", "gain",
}
#: What the categorical keywords may hold.
OPTIONS = {
    "XTENSION": {"IMAGE": "image extension", "BINTABLE": "binary table", "TABLE": "ASCII table", "IUEIMAGE": "IUE image (legacy)"},
    "BITPIX": {"8": "8-bit unsigned integer", "16": "16-bit integer", "32": "32-bit integer", "64": "64-bit integer", "-32": "32-bit float", "-64": "64-bit float"},
    "TIMESYS": {
        "UTC": "Coordinated Universal Time", "UT1": "Universal Time", "TAI": "International Atomic Time", "TT": "Terrestrial Time", "TDB": "Barycentric Dynamical Time",
        "TCG": "Geocentric Coordinate Time", "TCB": "Barycentric Coordinate Time", "GPS": "GPS time",
    },
    "RADESYS": {"ICRS": "ICRS", "FK5": "FK5", "FK4": "FK4", "FK4-NO-E": "FK4 without E-terms", "GAPPT": "Geocentric apparent place"},
}


def first_wins(cards: Column) -> Column:
    """Map of keyword to value in which the first of repeated keywords counts."""
    keys = F.array_distinct(F.transform(cards, lambda c: c["keyword"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(cards, lambda c: c["keyword"] == k), F.lit(0))["value"])))


def last_wins(cards: Column) -> Column:
    """Map of keyword to value in which the last of repeated keywords counts."""
    return first_wins(F.reverse(cards))


def _present(header: Column, keyword: str) -> Column:
    return F.nullif(F.trim(F.replace(F.try_element_at(header, F.lit(keyword)), F.lit("'"), F.lit(""))), F.lit(""))


def metadata(header: Column) -> list[Column]:
    """Typed metadata columns of a header map, and its dimensions (empty for none)."""
    out = []
    for name, keywords in ALIASES.items():
        value = F.coalesce(*[_present(header, k) for k in keywords])
        out.append((value.try_cast("double") if name in NUMERIC else value).alias(name))
    axes = F.coalesce(_present(header, "NAXIS").try_cast("int"), F.lit(0))
    dims = F.when(axes > 0, F.transform(F.sequence(F.lit(1), axes), lambda i: F.try_element_at(header, F.concat(F.lit("NAXIS"), i.cast("string"))).try_cast("long")))
    return [*out, F.coalesce(F.array_compact(dims), F.array().cast("array<bigint>")).alias("dims")]


def dimension_text(dims: Column) -> Column:
    """Such as ``4096×4096 (2D)``; null for no dimensions."""
    return F.when(F.size(dims) > 0, F.concat(F.array_join(dims.cast("array<string>"), "×"), F.lit(" ("), F.size(dims).cast("string"), F.lit("D)")))


def options(spark: SparkSession) -> DataFrame:
    """(keyword, value, meaning) of the categorical keywords."""
    return spark.createDataFrame([(k, v, m) for k, values in OPTIONS.items() for v, m in values.items()], "keyword string, value string, meaning string")


def describe(cards: DataFrame) -> DataFrame:
    """(…, meaning) of rows with keyword and value; the value is compared without quotes and in upper case."""
    known = F.broadcast(options(cards.sparkSession).withColumnRenamed("value", "_v"))  # a fixed table
    bare = F.upper(F.trim(F.replace("value", F.lit("'"), F.lit(""))))
    return cards.withColumn("_v", bare).join(known, ["keyword", "_v"], "left").drop("_v")


def preferred_unit(units: DataFrame, file: str = "path") -> DataFrame:
    """The header unit of each file to show: the first science image, else the first image."""
    science = F.upper(F.coalesce("extname", F.lit(""))).isin("SCI", "SCIENCE")
    rank = F.struct((~science).alias("other"), F.col("ext_index").alias("i"))
    return units.where("is_image").groupBy(F.col(file).alias("_f")).agg(F.min_by(F.struct("*"), rank).alias("r")).select("r.*")


#: Cards that carry no keyword of their own.
NO_KEYWORDS = ("", "HISTORY", "COMMENT", "END")


def explode_cards(units: DataFrame, *keep: str) -> DataFrame:
    """(keep..., ordinal, keyword, value, comment) of header units with an array of cards."""
    cards = units.select(*keep, F.posexplode("cards").alias("ordinal", "c"))
    return cards.select(*keep, "ordinal", "c.keyword", "c.value", "c.comment")


def values_of(cards: Column, keyword: str) -> Column:
    """All values of a keyword in a header, in its order."""
    return F.transform(F.filter(cards, lambda c: c["keyword"] == keyword), lambda c: c["value"])


def value_json(value: Column) -> Column:
    """A typed header value (struct of :func:`fitsvalues.header_value`) as JSON text of its type and value."""
    text = F.coalesce(value["i"].cast("string"), value["d"].cast("string"), value["b"].cast("string"), F.to_json(F.struct(value["s"].alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value["s"].alias("v")))) - 6))
    return F.when(value["vtype"].isNotNull(), F.concat(F.lit('{"type":"'), value["vtype"], F.lit('","value":'), text, F.lit("}")))


def value_from_json(text: Column) -> Column:
    """struct(type, value as text) of such JSON."""
    return F.from_json(text, "type string, value string")


def keyword_counts(cards: DataFrame) -> DataFrame:
    """(keyword, n) over all header units; blank, comment and end cards don't count."""
    return cards.where(F.col("keyword").isNotNull() & ~F.col("keyword").isin(*NO_KEYWORDS)).groupBy("keyword").agg(F.count("*").alias("n"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Counters added up."""
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy("keyword").agg(F.sum("n").alias("n"))


def most_common(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent keywords, ties by name."""
    return counts.orderBy(F.desc("n"), "keyword").limit(n)


def with_relevance(counts: DataFrame, relevance: DataFrame) -> DataFrame:
    """Counters with the relevance of each keyword, empty where none is known."""
    known = relevance.groupBy("keyword").agg(F.max("relevance").alias("relevance"))
    return counts.join(known, "keyword", "left").withColumn("relevance", F.coalesce("relevance", F.lit("")))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, description, category) of a JSON dictionary ``{keyword: {description, category}}``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<description:string,category:string>>").alias("m"))
    return raw.select(F.explode("m").alias("keyword", "e")).select("keyword", "e.description", "e.category")


def explain_keywords(cards: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows with a keyword beside its description and category; unknown ones get a general text and the category Unknown."""
    known = small(dictionary.dropDuplicates(["keyword"]), 50_000)
    found = cards.join(known, "keyword", "left")
    return found.withColumns({"description": F.coalesce("description", F.lit("FITS header keyword")), "category": F.coalesce("category", F.lit("Unknown"))})
