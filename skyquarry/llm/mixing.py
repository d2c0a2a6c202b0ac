"""Mixtures of sources by target shares, with capped repetition (problem 9).

Capped water-filling: every source gets its share of the total; sources that would need more than their
most repetitions are clamped there and the excess goes to the others in proportion, until all fit. A
source's epochs are whole repetitions of all its records and a seeded sample for the fraction. The
sample takes records in the order of a hash of their key up to a threshold, found from two rounds of
histograms of the hash (4096 cells a source), so no source is ever sorted or gathered. Only one row a
target reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquarry.session import small

CELLS = 4096
#: Most sources whose plan is broadcast; beyond, it is joined by a shuffle, with the same result.
MOST_SOURCES = 50_000


@dataclass
class Allocation:
    source: str
    share: float
    size: int
    most: float
    tokens: float = 0.0
    clamped: bool = False

    @property
    def epochs(self) -> float:
        return min(self.most, self.tokens / self.size) if self.size else 0.0


def largest_total(sources: list[Allocation]) -> float:
    """The largest total at which every source that has any size still reaches its share."""
    return min((s.most * s.size / s.share for s in sources if s.share > 0 and s.size > 0), default=0.0)


def water_fill(sources: list[Allocation], total: float) -> list[Allocation]:
    """Sets ``tokens`` and ``clamped`` of each source for a mixture of ``total`` (less if all are clamped)."""
    for s in sources:
        s.tokens, s.clamped = 0.0, False
    while True:
        free = [s for s in sources if not s.clamped and s.share > 0]
        left = total - sum(s.tokens for s in sources if s.clamped)
        weight = sum(s.share for s in free)
        if not free or left <= 0:
            break
        over = False
        for s in free:
            s.tokens = left * s.share / weight
            if s.tokens > s.most * s.size * (1 + 1e-12):
                s.tokens, s.clamped, over = s.most * s.size, True, True
        if not over:
            break
    return sources


def _hash(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(CELLS * CELLS))


def _edge(cells: DataFrame, source: str, cell: str) -> DataFrame:
    """(source, cell, left): of (source, cell, n, want) the first cell that does not fit whole below ``want``, and what is left for it."""
    run = F.sum("n").over(Window.partitionBy(source).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = cells.withColumn("run", run).where(F.col("run") > F.col("want"))
    return over.groupBy(source).agg(F.min(F.struct(cell, (F.col("want") - F.col("run") + F.col("n")).alias("left"))).alias("e")).select(source, f"e.{cell}", "e.left")


def mix(sizes: DataFrame, key: str, source: str, size: str, targets: DataFrame, share: str, most: str, *, total: float | None = None, seed: int = 42) -> tuple[DataFrame, list[Allocation]]:
    """The mixture (key, source, size, repeats) and the allocation of every source.

    ``total`` is the wanted total size; None takes the largest at which every share is met exactly.
    Records of a source without a target, or of a null source, are not used; a target without records
    stays at zero and its share goes to the others; a null or negative share counts as 0, null repeats
    as 1. Targets are one row a source (the largest share of repeated ones). ``sizes`` should be cut or
    cheap, as it is read several times. Extra columns are ignored; empty tables give an empty mixture.
    """
    have = sizes.where(F.col(source).isNotNull()).groupBy(source).agg(F.sum(size).alias("_size"))
    wanted = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(share).alias("_share"), F.max(most).alias("_most"))
    rows = wanted.join(have, source, "left").select(source, "_share", "_most", "_size").collect()  # a row per target
    sources = [Allocation(r[0], max(0.0, r[1] or 0.0), int(r[3] or 0), float(1 if r[2] is None else max(0, r[2]))) for r in rows]
    sources.sort(key=lambda s: s.source)
    water_fill(sources, largest_total(sources) if total is None else total)

    whole = lambda s: math.floor(s.epochs + 1e-9)
    plan = sizes.sparkSession.createDataFrame([(s.source, whole(s), max(0.0, s.epochs - whole(s)) * s.size) for s in sources], f"`{source}` string, whole long, want double")
    used = sizes.select(key, source, F.col(size).alias("size")).join(small(plan, MOST_SOURCES), source).withColumn("h", _hash(key, seed)).withColumn("cell", F.floor(F.col("h") / CELLS))
    part = used.where("want > 0")
    coarse = _edge(part.groupBy(source, "cell", "want").agg(F.sum("size").alias("n")), source, "cell")
    at_edge = part.join(small(coarse, MOST_SOURCES), [source, "cell"]).withColumn("fine", F.col("h") % CELLS)
    fine = _edge(at_edge.groupBy(source, "fine", F.col("left").alias("want")).agg(F.sum("size").alias("n")), source, "fine").drop("left")
    limits = coarse.join(fine, source, "left").select(source, (F.col("cell") * CELLS + F.coalesce("fine", F.lit(0))).alias("upto"))
    chosen = used.join(small(limits, MOST_SOURCES), source, "left")
    chosen = chosen.withColumn("repeats", F.col("whole") + F.when(F.col("h") < F.col("upto"), 1).otherwise(0))
    return chosen.where("repeats > 0").select(key, source, F.col("size").alias(size), "repeats"), sources
