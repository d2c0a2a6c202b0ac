"""Filling missing values from records of the same group or of a similar kind (problem 3).

Numeric fields are discretised into bins of equal frequency, categorical ones into their most frequent
values and a rest. A Chow-Liu tree (the maximum spanning tree of the pairwise mutual information) is
learned from the contingency counts of all rows; the value of another record of the same group enters as
a field of its own, so the tree learns how far a group determines its members. Messages are passed over
the tree for every record with a missing value; the posterior of the missing field is decoded to its
mode, and a bin to a number: the value of the group if that has one in this bin, else the bin's median.

Counts are summed inside the tasks and of bounded size (fields x fields x bins x bins); quantiles and
frequent values come from mergeable sketches. Groups are summarised by a map-side aggregate and joined
back, so a group with a third of all rows is never gathered. Both numeric and categorical fields are filled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.session import cut

#: Bins of a numeric field and kept values of a categorical one (the rest is one value). Model parameters: they
#: set how fine the tree sees a field, not which rows are read. Measured on held-out values in tests/test_impute.py.
BINS = 32
CATEGORIES = 24


@dataclass
class Tree:
    """The fitted tree: node order with parents first, and smoothed joint tables."""

    names: list[str]
    sizes: list[int]
    order: list[int]
    parent: list[int]
    prior: list[np.ndarray]
    given: list[np.ndarray | None]  # P(node | parent), rows: parent's state


def chow_liu(names: list[str], sizes: list[int], single: list[np.ndarray], joint: dict[tuple[int, int], np.ndarray], smooth: float = 0.5) -> Tree:
    """Maximum spanning tree of mutual information (Prim), rooted at node 0; ties go to the earlier node."""
    n = len(names)
    info = np.zeros((n, n))
    for (i, j), table in joint.items():
        total = table.sum()
        if total > 0:
            p = table / total
            outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                info[i, j] = info[j, i] = np.nansum(np.where(p > 0, p * np.log(p / outer), 0.0))
    parent, best, order = [-1] * n, np.full(n, -1.0), [0]
    link = np.zeros(n, int)
    left = set(range(1, n))
    while left:
        last = order[-1]
        for v in left:
            if info[last, v] > best[v]:
                best[v], link[v] = info[last, v], last
        v = max(sorted(left), key=lambda k: best[k])
        parent[v] = int(link[v])
        order.append(v)
        left.remove(v)
    prior = [(s + smooth) / (s + smooth).sum() for s in single]
    given: list[np.ndarray | None] = [None] * n
    for v in order[1:]:
        u = parent[v]
        table = joint[u, v] if u < v else joint[v, u].T
        # smoothed towards the field's own distribution, so an unseen parent state falls back to it
        table = table + smooth * prior[v]
        given[v] = table / table.sum(1, keepdims=True)
    return Tree(names, sizes, order, parent, prior, given)


def posteriors(tree: Tree, states: np.ndarray, wanted: list[int]) -> list[np.ndarray]:
    """Posterior of each wanted node for every row of ``states`` (-1: not observed), by message passing."""
    rows = len(states)
    evidence = []
    for v, size in enumerate(tree.sizes):
        e = np.ones((rows, size))
        seen = states[:, v] >= 0
        e[seen] = 0.0
        e[seen, states[seen, v]] = 1.0
        evidence.append(e)
    up: list[np.ndarray | None] = [None] * len(tree.sizes)
    belief = [e.copy() for e in evidence]  # evidence and messages from below
    for v in reversed(tree.order[1:]):
        message = belief[v] @ tree.given[v].T
        message /= message.max(1, keepdims=True) + 1e-300
        up[v] = message
        belief[tree.parent[v]] *= message
    down: list[np.ndarray | None] = [None] * len(tree.sizes)
    root = tree.order[0]
    down[root] = np.broadcast_to(tree.prior[root], belief[root].shape)
    for v in tree.order[1:]:
        u = tree.parent[v]
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(up[v] > 0, belief[u] / up[v], 0.0) * down[u]
        message = rest @ tree.given[v]
        down[v] = message / (message.max(1, keepdims=True) + 1e-300)
    out = []
    for v in wanted:
        p = belief[v] * down[v]
        out.append(p / np.maximum(p.sum(1, keepdims=True), 1e-300))
    return out


@dataclass
class Codes:
    """How raw columns become states: inner edges of bins, kept categories, and the middle of each bin."""

    edges: dict[str, np.ndarray]
    kept: dict[str, dict[str, int]]
    middles: dict[str, list[float | None]]

    def size(self, column: str) -> int:
        return len(self.edges[column]) + 1 if column in self.edges else len(self.kept[column]) + 1

    def states(self, column: str, values: pd.Series) -> np.ndarray:
        if column in self.edges:
            x = values.to_numpy(float)
            return np.where(np.isnan(x), -1, np.searchsorted(self.edges[column], np.nan_to_num(x), "right")).astype(np.int16)
        codes = values.map(self.kept[column]).fillna(len(self.kept[column])).to_numpy()
        return np.where(values.isna().to_numpy(), -1, codes).astype(np.int16)


def _quantiles(grid: list[float] | None) -> tuple[np.ndarray, list[float | None]]:
    """Edges and middles of bins from quantiles at 1/2n, 2/2n, ...: every second one is an edge."""
    grid = list(grid or [])
    edges = np.array(sorted(set(grid[1::2])))
    inside = np.searchsorted(edges, grid, "right") if len(grid) else np.array([], int)
    middles: list[float | None] = []
    for b in range(len(edges) + 1):
        own = [g for g, i in zip(grid, inside) if i == b]
        middles.append(own[len(own) // 2] if own else None)
    return edges, middles


def fill_missing(
    df: DataFrame,
    key: str,
    group: list[Column],
    targets: dict[str, Column],
    numeric: dict[str, Column],
    categorical: dict[str, Column],
    *,
    bins: int = BINS,
    categories: int = CATEGORIES,
) -> DataFrame:
    """(key, field, donor, value, certainty): one row for each target value that is missing.

    ``targets`` maps each field to fill to its usable value (null where missing); texts and booleans are
    categories, whose value comes out in an additional column ``category``. ``group`` identifies the group
    of a record (any null: the record has no group). ``donor`` is ``group`` if another record of the group has
    a usable value of the field, which then is evidence in the tree, else ``none``: then the value comes
    from records of similar time and kind alone. A value is the group's if that lies in the most likely
    bin, else the bin's median; a category is the most likely one. If no record has a usable value of a
    field at all, the value is null. A record counts once, however often its key is repeated; null keys are
    left out; extra columns are ignored; an empty table gives an empty result.
    """
    fields = list(targets)
    n_t, n_n, n_c = len(targets), len(numeric), len(categorical)
    kinds = dict(df.select(*[c.alias(f"t_{i}") for i, c in enumerate(targets.values())]).dtypes)
    named = {i for i in range(n_t) if kinds[f"t_{i}"] in ("string", "boolean")}  # targets that are categories
    base = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("rid"),
        F.when(F.greatest(*[g.isNull().cast("int") for g in group], F.lit(0)) == 0, F.to_json(F.array(*[g.cast("string") for g in group]))).alias("grp"),
        *[c.cast("string" if i in named else "double").alias(f"t_{i}") for i, c in enumerate(targets.values())],
        *[c.cast("double").alias(f"n_{i}") for i, c in enumerate(numeric.values())],
        *[c.cast("string").alias(f"c_{i}") for i, c in enumerate(categorical.values())],
    ).dropDuplicates(["rid"])
    base = cut(base)
    gaps = F.greatest(*[F.col(f"t_{i}").isNull().cast("int") for i in range(n_t)], F.lit(0)) == 1

    # summary of each group: two extremes and a count; the others' value needs no more (see below)
    groups = base.where("grp is not null").groupBy("grp").agg(
        *[x for i in range(n_t) for x in (F.count(f"t_{i}").alias(f"k_{i}"), F.min(f"t_{i}").alias(f"lo_{i}"), F.max(f"t_{i}").alias(f"hi_{i}"))]
    )
    joined = base.join(groups, "grp", "left")
    for i in range(n_t):
        # for a missing value the middle of the group; for training the extreme that is not the record's own
        own, lo, hi = F.col(f"t_{i}"), F.col(f"lo_{i}"), F.col(f"hi_{i}")
        other = F.when(own.isNull(), lo if i in named else (lo + hi) / 2).when(F.col(f"k_{i}") > 1, F.when(own == lo, hi).otherwise(lo))
        joined = joined.withColumn(f"g_{i}", F.when(F.col(f"k_{i}") > 0, other))

    # quantiles and frequent categories: bounded sketches, one row to the driver
    at = [(k + 1) / (2 * bins) for k in range(2 * bins - 1)]
    counted = [f"t_{i}" for i in range(n_t) if i not in named] + [f"n_{i}" for i in range(n_n)]
    listed = [f"t_{i}" for i in sorted(named)] + [f"c_{i}" for i in range(n_c)]
    sketch = base.agg(F.lit(0), *[F.percentile_approx(c, at, 2000).alias(c) for c in counted], *[F.expr(f"approx_top_k({c}, {categories})").alias(c) for c in listed]).first()
    codes = Codes({}, {}, {})
    for c in counted:
        codes.edges[c], codes.middles[c] = _quantiles(sketch[c])
    for c in listed:
        codes.kept[c] = {v: k for k, v in enumerate(sorted(r["item"] for r in sketch[c] or [] if r["item"] is not None))}
    for i in range(n_t):
        (codes.kept if i in named else codes.edges)[f"g_{i}"] = (codes.kept if i in named else codes.edges)[f"t_{i}"]
    names = [f"t_{i}" for i in range(n_t)] + [f"g_{i}" for i in range(n_t)] + [f"n_{i}" for i in range(n_n)] + [f"c_{i}" for i in range(n_c)]
    raw = cut(joined.select("rid", *names))  # read for the counts and for the messages
    sizes = [codes.size(v) for v in names]

    tree = _fit(raw.drop("rid"), codes, names, sizes)

    kind = dict(base.dtypes)["rid"]
    category = ", category string" if named else ""
    filled = raw.where(gaps).mapInPandas(_decoder(tree, codes, fields, named), f"rid {kind}, field string, donor string, value double, certainty double{category}")
    return filled.withColumnRenamed("rid", key)


def _fit(raw: DataFrame, codes: Codes, names: list[str], sizes: list[int]) -> Tree:
    """Contingency counts of every two fields, summed in each task before the shuffle, and the tree."""
    offsets = np.cumsum([0, *sizes])
    width = int(offsets[-1])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                hot = np.zeros((len(pdf), width), np.float32)
                for v, name in enumerate(names):
                    state = codes.states(name, pdf[name])
                    seen = state >= 0
                    hot[np.flatnonzero(seen), offsets[v] + state[seen]] = 1
                total += hot.T @ hot
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "c": total[i, j]})

    counts = raw.mapInPandas(count, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c"))
    table = np.zeros((width, width))
    for r in counts.collect():  # at most (fields x bins) squared cells, whatever the number of rows
        table[r.i, r.j] = r.c
    cells = [slice(offsets[v], offsets[v + 1]) for v in range(len(sizes))]
    single = [np.diag(table)[c] for c in cells]
    joint = {(i, j): table[cells[i], cells[j]] for i in range(len(sizes)) for j in range(i + 1, len(sizes))}
    return chow_liu(names, sizes, single, joint)


def _decoder(tree: Tree, codes: Codes, fields: list[str], named: set[int]):
    wanted = list(range(len(fields)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            states = np.column_stack([codes.states(v, pdf[v]) for v in tree.names])
            for i, post in zip(wanted, posteriors(tree, states, wanted)):
                gap = states[:, i] < 0
                if not gap.any():
                    continue
                # the group speaks where its node is observed: then it sends the tree a message about the value
                speaks = states[gap, len(fields) + i] >= 0
                out = {"rid": pdf.rid.to_numpy()[gap], "field": fields[i], "donor": np.where(speaks, "group", "none")}
                if i in named:
                    choices = np.array([*codes.kept[f"t_{i}"], None], object)
                    p = post[gap][:, : max(1, len(choices) - 1)]  # the rest of the values has no name
                    given = pdf[f"g_{i}"].to_numpy(object)[gap]
                    mode = choices[p.argmax(1)]
                    rare = speaks & (states[gap, len(fields) + i] == len(choices) - 1)
                    yield pd.DataFrame({**out, "value": np.nan, "certainty": np.maximum(p.max(1), 0.0), "category": np.where(rare, given, mode)})
                    continue
                middles = codes.middles[f"t_{i}"]
                known = np.array([m is not None for m in middles])
                p = np.where(known, post[gap], -1.0)
                mode = p.argmax(1)
                value = np.array([np.nan if m is None else m for m in middles])[mode]
                same = speaks & (states[gap, len(fields) + i] == mode)
                rows = pd.DataFrame({**out, "value": np.where(same, pdf[f"g_{i}"].to_numpy(float)[gap], value), "certainty": np.maximum(p.max(1), 0.0)})
                yield rows.assign(category=None) if named else rows

    return run
