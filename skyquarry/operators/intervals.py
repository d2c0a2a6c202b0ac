"""Continuous periods and gaps of intervals that overlap, nest, touch or leave holes (problem 7).

All intervals are range-sorted by entity and start. Each partition is summarised by its last entity and
the island that is open at its end; the summaries (one row per partition) are combined from left to
right into the state that enters each partition; a second scan carries that state and labels islands.
An entity may span any number of partitions, so an entity with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.session import cut


def _islands(first: np.ndarray, start: np.ndarray, end: np.ndarray, entry: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Per row: whether it opens an island, and the largest end before it in its entity.

    ``first`` marks the first row of an entity; ``entry`` is the end that row 0 inherits, if any.
    """
    group = np.cumsum(first)
    reach = pd.Series(end).groupby(group).cummax().to_numpy()
    before = np.empty_like(reach)
    before[1:] = reach[:-1]
    opens = first.copy()
    if entry is not None and not first[0]:
        head = group == group[0]
        reach = np.where(head, np.maximum(reach, entry), reach)
        before[1:] = reach[:-1]
        before[0] = entry
    opens |= start > before
    return opens, before


def _scan(entry: dict[int, tuple] | None):
    """With no entry states: one summary row per partition. With them: the labelled pieces and gaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, whole, part = None, True, None  # state: (entity, island's start, largest end)
        for pdf in batches:
            if not len(pdf):
                continue
            if part is None:
                part = int(pdf.part.iloc[0])
                state = entry.get(part) if entry else None
            start, end = pdf.start.to_numpy(), pdf.end.to_numpy()
            a, b = pdf.a.to_numpy(object), pdf.b.to_numpy(object)
            first = np.ones(len(pdf), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if state is not None and (a[0], b[0]) == state[0]:
                first[0] = False
            opens, before = _islands(first, start, end, state[2] if state is not None and not first[0] else None)
            at = np.cumsum(opens)
            labels = np.r_[state[1] if state is not None else 0, start[opens]][at]
            if entry is not None:
                pieces = pd.DataFrame({"a": a, "b": b, "label": labels, "end": end}).groupby(["a", "b", "label"], sort=False, as_index=False).end.max()
                yield pieces.assign(kind="period").rename(columns={"label": "start"})[["a", "b", "kind", "start", "end"]]
                hole = opens & ~first
                if hole.any():
                    yield pd.DataFrame({"a": a[hole], "b": b[hole], "kind": "gap", "start": before[hole], "end": start[hole]})
            else:
                whole = whole and not first[1:].any() and (state is None or not first[0])
            reach = max(end[np.cumsum(first) == np.cumsum(first)[-1]].max(), state[2] if state is not None and not first.any() else end[-1])
            state = ((a[-1], b[-1]), int(labels[-1]), int(reach))
        if entry is None and state is not None:
            yield pd.DataFrame({"part": [part], "a": [state[0][0]], "b": [state[0][1]], "label": [state[1]], "end": [state[2]], "whole": [whole]})

    return run


def combine(summaries: list) -> dict[int, tuple]:
    """State that enters each partition, from the summaries in order of partition."""
    out: dict[int, tuple] = {}
    state = None
    for s in sorted(summaries, key=lambda s: s.part):
        if state is not None:
            out[s.part] = state
        mine = ((s.a, s.b), s.label, s.end)
        if state is not None and s.whole and state[0] == mine[0]:
            # the whole partition is of the entity that comes in: its island may continue the open one
            mine = (mine[0], state[1] if s.label <= state[2] else s.label, max(state[2], s.end))
        state = mine
    return out


def periods_and_gaps(df: DataFrame, entity: tuple[str, str], start_s: str, end_s: str) -> DataFrame:
    """(entity columns, kind, start_s, end_s): each maximal ``period`` and each ``gap`` between two of them.

    ``start_s`` and ``end_s`` are whole seconds; intervals that share an end point belong together and
    an instant (start = end) is an interval. Rows with a null in entity, start or end, or with start
    after end, are left out; repeated rows change nothing; ties are in any order. Both ends are
    inclusive. Extra columns are ignored; an empty table gives an empty result.
    """
    a, b = entity
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(start_s).cast("long").alias("start"), F.col(end_s).cast("long").alias("end"))
    rows = rows.where("a is not null and b is not null and start <= end")
    placed = rows.repartitionByRange("a", "b", "start").sortWithinPartitions("a", "b", "start").withColumn("part", F.spark_partition_id())
    placed = cut(placed)  # both scans must see the same partitions
    kinds = dict(rows.dtypes)
    summary = f"part int, a {kinds['a']}, b {kinds['b']}, label long, end long, whole boolean"
    entry = combine(placed.mapInPandas(_scan(None), summary).collect())  # a row per partition
    pieces = placed.mapInPandas(_scan(entry), f"a {kinds['a']}, b {kinds['b']}, kind string, start long, end long")
    return (
        pieces.groupBy("a", "b", "kind", "start").agg(F.max("end").alias("end"))
        .select(F.col("a").alias(a), F.col("b").alias(b), "kind", F.col("start").alias("start_s"), F.col("end").alias("end_s"))
    )
