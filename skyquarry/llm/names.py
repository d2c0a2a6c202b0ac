"""Free-typed names to the entries of a reference list (problem 6).

A set-similarity join with prefix filter. A name becomes a set of tokens. An identifier (catalogue and
number, or a coordinate name) is one token, as another number is another object. Of any other name the
words that only say what kind of object it is, or which visit or copy of it, are left out, and the rest
becomes the set of its letter pairs, adjacent and with one letter between, which survives typing errors.
Which words are left out is learned: those that several entries of the list share, and those that stand
beside the own words of several different entries in what was typed.

Tokens are ordered by global rarity, only the rarest tokens of each set (as many as the threshold leaves)
are joined, pairs are cut by length and position, Jaccard is verified exactly and the best entry kept.
Work is done once per distinct token set; only the reading of texts is Python, all else stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.session import cut, small

#: Least Jaccard similarity of two sets of tokens.
THRESHOLD = 1 / 3
#: A word that so many entries share names a kind of object; one met beside so many entries' own words is an addition.
SHARED, BESIDE = 3, 2


def plain(text: str) -> str:
    """Lower case, without accents, with one kind of minus, outer blanks cut."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[\u2010-\u2015\u2212]", "-", text).lower().strip()


def identifier(text: str) -> tuple[str, str] | None:
    """(catalogue, number) of a plain text that names an object by number or position; catalogue may be empty."""
    at = re.search(r"(?:^|[^a-z0-9])(?:([a-z]{2,5}?)[\s._-]*)?(j)?[\s._]*(\d{4}(?:\.\d+)?)\s*([-+pm])\s*(\d{4}(?:\.\d+)?)(?!\d)", text)
    if at and (at[1] or at[2]):
        return at[1] or "", f"j{at[3]}{'-' if at[4] in '-m' else '+'}{at[5]}"
    inner = re.fullmatch(r"[a-z]+\d+\s*\((.+)\)", text)
    text = inner[1] if inner else text
    text = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", text).replace(". ", " ")
    text = re.sub(r"^the\s+", "", text)
    m = re.fullmatch(r"([a-z]{2,5})[\s._-]*(?:(?:no|nr|number|#)[\s._-]*)?0*(\d+)(?:[\s._-]*[a-z(\[].*)?", text)
    return (m[1], m[2]) if m else None


def words(text: str) -> list[str]:
    """The runs of letters of a plain text."""
    return re.findall(r"[^\W\d_]+", text)


def tokens(core: str) -> list[str]:
    """The letter pairs of a core, adjacent and with one letter between, its ends marked; the plain version of :func:`_tokens`."""
    if not core:
        return []
    p = f"^{core}$"
    return sorted({p[k : k + 2] for k in range(len(p) - 1)} | {f"{p[k]}_{p[k + 2]}" for k in range(len(p) - 2)})


def _tokens(core: Column) -> Column:
    p = F.concat(F.lit("^"), core, F.lit("$"))
    near = F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda k: F.substring(p, k, F.lit(2)))
    apart = F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda k: F.concat(F.substring(p, k, F.lit(1)), F.lit("_"), F.substring(p, k + 2, F.lit(1))))
    return F.when(core != "", F.array_distinct(F.concat(near, apart)))


def _read(reference: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, name in zip(pdf.rid, pdf.name):
                text = plain(name)
                found = identifier(text)
                if found is None:
                    rows.append((rid, None, words(text)))
                    continue
                rows.append((rid, f"{found[0]} {found[1]}", []))
                if reference and found[1].startswith("j"):
                    rows.append((rid, f" {found[1]}", []))  # a position also counts without its catalogue
            yield pd.DataFrame(rows, columns=["rid", "ident", "words"])

    return run


def general_words(typed: DataFrame, entries: DataFrame) -> DataFrame:
    """(word) that don't tell objects apart, from (rid, words) of what was typed and of the reference.

    Words that ``SHARED`` entries hold, and two of them written as one; and words outside the reference
    that stand beside the own words of ``BESIDE`` or more entries. Least and greatest own word of a text
    tell whether there are two, so no pairs are formed.
    """
    listed = entries.select("rid", F.explode(F.array_distinct("words")).alias("word"))
    counts = listed.groupBy("word").agg(F.countDistinct("rid").alias("n"))
    shared = counts.where(F.col("n") >= SHARED).select("word")
    follows = entries.select("rid", F.posexplode("words").alias("at", "word"), "words").select("word", F.get("words", F.col("at") + 1).alias("next")).where("next is not null").distinct()
    known = small(shared, 100_000)
    joined = follows.join(known, "word").join(known.withColumnRenamed("word", "next"), "next").select(F.concat("word", "next").alias("word"))
    own = small(counts.where(F.col("n") < SHARED).select("word", F.lit(True).alias("own")), 100_000)
    seen = typed.select("rid", F.explode(F.array_distinct("words")).alias("word")).join(own, "word", "left")
    beside = seen.where("own").groupBy("rid").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    additions = seen.where("own is null").join(beside, "rid").groupBy("word").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("word")
    return shared.unionByName(joined).unionByName(additions).distinct()


def _cores(texts: DataFrame, general: DataFrame) -> DataFrame:
    """(rid, core): the words that remain, in their order, as one."""
    left = texts.select("rid", F.posexplode("words").alias("at", "word")).join(small(general, 100_000), "word", "left_anti")
    return left.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), "").alias("core"))


def match_names(typed: DataFrame, name: str, reference: DataFrame, key: str, spellings: list[str], *, threshold: float = THRESHOLD) -> DataFrame:
    """(name, lookup_id, jaccard): each distinct typed text with its best entry; lookup_id null if none.

    Ties go to the smaller key. Null and blank texts give no row. Null spellings and keys of the reference
    are ignored, repeated entries count once, extra columns are ignored. An empty reference leaves every
    text unmatched; texts of any length are read whole.
    """
    texts = cut(typed.select(F.col(name).alias("name")).where(F.col("name").rlike("\\S")).distinct().withColumn("sid", F.monotonically_increasing_id()))
    entries = reference.select(F.col(key).cast("long").alias("rid"), F.explode(F.array(*[F.col(s) for s in spellings])).alias("name")).where("rid is not null and name is not null").distinct()
    entries = entries.withColumn("eid", F.monotonically_increasing_id())
    entries = cut(entries)
    schema = "rid long, ident string, words array<string>"
    left = cut(texts.select(F.col("sid").alias("rid"), "name").mapInPandas(_read(False), schema))
    right = cut(entries.select(F.col("eid").alias("rid"), "name").mapInPandas(_read(True), schema))
    by_entry = right.join(small(entries.select(F.col("eid").alias("rid"), F.col("rid").alias("lookup")), 100_000), "rid")
    general = cut(general_words(left.where("ident is null"), by_entry.where("ident is null").select(F.col("lookup").alias("rid"), "words")))

    def sets(read: DataFrame) -> DataFrame:
        """(rid, form): what the text is compared by, an identifier or a core."""
        cores = _cores(read.where("ident is null"), general).where("core <> ''").select("rid", F.struct(F.lit(False).alias("number"), F.col("core").alias("text")).alias("form"))
        return read.where("ident is not null").select("rid", F.struct(F.lit(True).alias("number"), F.col("ident").alias("text")).alias("form")).unionByName(cores)

    left_sets, right_sets = cut(sets(left)), sets(right).join(small(entries.select(F.col("eid").alias("rid"), F.col("rid").alias("lookup")), 100_000), "rid")
    tokens_of = F.when(F.col("form.number"), F.array(F.concat(F.lit("id "), F.col("form.text")))).otherwise(_tokens(F.col("form.text")))
    # distinct sets of either side; of entries with equal sets the smallest key counts
    a = cut(left_sets.select("form").distinct().select("form", tokens_of.alias("x")).withColumn("aid", F.monotonically_increasing_id()))
    b = cut(right_sets.groupBy("form").agg(F.min("lookup").alias("lookup")).select("form", "lookup", tokens_of.alias("y")).withColumn("bid", F.monotonically_increasing_id()))
    rarity = a.select(F.explode("x").alias("t")).unionAll(b.select(F.explode("y").alias("t"))).groupBy("t").agg(F.count("*").alias("df"))

    def prefixes(sets: DataFrame, sid: str, toks: str) -> DataFrame:
        n = F.size("ordered")
        ordered = sets.select(F.col(sid).alias("s"), F.explode(toks).alias("t")).join(rarity, "t").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ordered"))
        keep = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
        return ordered.select("s", n.alias("n"), F.posexplode(F.slice("ordered", 1, keep)).alias("at", "o")).select("s", "n", "at", F.col("o.t").alias("t"))

    parts = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = prefixes(a, "aid", "x").toDF("aid", "n", "i", "t").repartition(parts, "t")  # candidates are more than their sets tell, so the tasks are not merged
    q = prefixes(b, "bid", "y").toDF("bid", "m", "j", "t").repartition(parts, "t")
    need = F.ceil((F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-9)
    reach = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    pairs = (
        p.join(q, "t")
        .where((F.col("m") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("m") * threshold - 1e-9))
        .groupBy("aid", "bid", "n", "m").agg(F.max(reach).alias("reach"))
        .where(F.col("reach") >= need)
    )
    full = pairs.join(a.select("aid", "x"), "aid").join(small(b.select("bid", "lookup", "y"), 50_000), "bid")
    both = F.size(F.array_intersect("x", "y"))
    full = full.withColumn("jaccard", both / (F.size("x") + F.size("y") - both)).where(F.col("jaccard") >= threshold)
    best = full.groupBy("aid").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "lookup")).alias("b")).select("aid", F.col("b.lookup").alias("lookup_id"), (-F.col("b.j")).alias("jaccard"))
    matched = a.join(best, "aid").select("form", "lookup_id", "jaccard")
    by_text = left_sets.join(matched, "form").select(F.col("rid").alias("sid"), "lookup_id", "jaccard")
    return texts.join(by_text, "sid", "left").select("name", "lookup_id", "jaccard")
