"""The queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.llm.bpe import count_tokens, encode
from skyquarry.llm.mixing import mix
from skyquarry.llm.names import match_names
from skyquarry.llm.subjects import subjects_of
from skyquarry.session import cut, small, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that every freely typed target name means, 0 for none."""
    names = table(spark, sf_dir, "name_lookup")
    literal = small(names.select(F.col("canonicalname").alias("target_name")).where("target_name is not null").distinct(), 50_000)
    typed = table(spark, sf_dir, "caom_obs").select("obsid", "target_name").where(F.col("obsid").isNotNull() & F.col("target_name").rlike("\\S"))
    typed = typed.join(literal, "target_name", "left_anti").dropDuplicates(["obsid"])
    found = match_names(typed, "target_name", names, "lookup_id", ["canonicalname", "searchstring"])
    return typed.join(found.withColumnRenamed("name", "target_name"), "target_name").select("obsid", F.coalesce("lookup_id", F.lit(0)).alias("lookup_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf_dir: str, total: float | None = None):
    sizes = cut(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]))
    return mix(sizes, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"), "target_share", "max_repeats", total=total), sizes


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, sf_dir)[0][0]


def _report(spark: SparkSession, chosen: DataFrame, sources) -> DataFrame:
    plan = spark.createDataFrame([(s.source, s.share, s.size, s.epochs, s.clamped) for s in sources], "source string, target_share double, size long, epochs double, clamped boolean")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_used"))
    total = used.agg(F.sum("used").alias("total"))
    rows = plan.join(used, "source", "left").crossJoin(F.broadcast(total))  # a row per source beside one row
    return rows.select("source", "target_share", (F.coalesce("used", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("used", F.lit(0)).alias("tokens"), "size", "epochs", F.coalesce("most_used", F.lit(0)).alias("most_used"), "clamped")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in the mixture."""
    (chosen, sources), _ = _mixture(spark, sf_dir)
    return _report(spark, chosen, sources)


def _corpus_size(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    sizes = cut(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]))
    return sizes, float(sizes.agg(F.sum("n_tokens")).first()[0] or 0)


def _whole(spark: SparkSession, sf_dir: str):
    """A mixture as large as the whole corpus: sources too small for their share are clamped, and the others take the excess."""
    sizes, total = _corpus_size(spark, sf_dir)
    return mix(sizes, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"), "target_share", "max_repeats", total=total)


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture as large as the corpus and how often each is used."""
    return _whole(spark, sf_dir)[0]


def p9_whole_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in the mixture as large as the corpus, and which are clamped."""
    return _report(spark, *_whole(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of every document."""
    return subjects_of(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "doc_labels"), "doc_id", "subject")


QUERIES = {"p6_found": p6_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_whole": p9_whole, "p9_whole_shares": p9_whole_shares, "p10_found": p10_found}
ORACLES: dict[str, str] = {}
