"""Splitting of texts that hold several values (problem 1).

The separators of a column are not declared, they are learned. Every text is cut into atoms at all
candidate characters; quoted spans are atomic. The atoms and the places between them form a lattice in
which each place either separates two values or lies inside one. Three things are learned by
expectation-maximisation from all texts of the column: the frequency of each value, the probability that
a character separates, and the probability that a value holding the character is written without quotes.
They start from weak priors. The frequencies start from the values that are certain (texts of one atom and
quoted spans), each round runs forward-backward over every lattice and sums the expected counts, and the
last pass is Viterbi. Where names that hold a separating character are always quoted, the third
probability says so, and an unquoted join over that character becomes as unlikely as it is in the column.
Each distinct text is one witness, however often it is delivered and however many places it has, and a
join counts by what other texts say of it (its expected count less one), never by itself alone.

A value may span any number of atoms. Joins of up to ``SHORT`` atoms are edges of their own, looked up
among the frequencies. Longer ones are summed (or maximised) over all their starts in one pass, as a new
value's score adds up over its atoms; one whose posterior reaches ``LEAST`` becomes an edge in the next round. So
the lattice grows with the length of a text, not with its square, and no join is left out.

Work is done once per distinct text of a column (pre-aggregated with counts), so hot texts cost nothing
extra; the rows then meet their split by an equi-join on the text, whose skew AQE splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.session import cut

#: Characters that may separate, with the prior probabilities that one separates and that a value with it inside goes
#: without quotes. Both weigh as much as two occurrences; what a column's texts say soon outweighs them.
CANDIDATES = {**dict.fromkeys(";,|+&\t", (0.9, 0.02)), "/": (0.5, 0.5)}
PRIOR_WEIGHT = 2.0
BRACKETS = {"[": "]", "(": ")", "{": "}"}
QUOTES = "\"'"
#: Share of values not met before, and letters a new value is spelled with.
NEW, LETTERS = 0.1, 40.0
#: Joins that are edges from the start (not a limit, see above), and the posterior from which a longer one becomes an edge.
SHORT, LEAST = 3, 1e-6
LOW = -math.inf


def strip_brackets(text: str) -> str:
    """Without outer blanks and without brackets that enclose the whole text."""
    text = text.strip(" \t\r\n")
    while len(text) > 1 and BRACKETS.get(text[0]) == text[-1]:
        depth, quote = 0, ""
        for at, c in enumerate(text):
            if quote:
                quote = "" if c == quote else quote
            elif c in QUOTES and (at == 0 or text[at - 1] in " \t[({;,|+&/"):
                quote = c
            elif c == text[0]:
                depth += 1
            elif c == BRACKETS[text[0]]:
                depth -= 1
                if not depth:
                    break
        if at != len(text) - 1:
            break
        text = text[1:-1].strip(" \t\r\n")
    return text


def atoms(text: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """The atoms of a text with a flag for quoted ones, and the separators between each two of them.

    Empty atoms are skipped; the separators around them are kept together, which forces a split there.
    """
    text = strip_brackets(text)
    found: list[tuple[str, bool]] = []
    between: list[str] = []
    seps, at, n = "", 0, len(text)
    while at < n:
        c = text[at]
        if c in CANDIDATES:
            seps += c
            at += 1
        elif c == " ":
            at += 1
        else:
            quoted = False
            if c in QUOTES:
                end = at + 1
                while end < n:
                    if text[end] == c:
                        if end + 1 < n and text[end + 1] == c:
                            end += 2
                            continue
                        break
                    end += 1
                after = end + 1
                while after < n and text[after] == " ":
                    after += 1
                if end < n and (after >= n or text[after] in CANDIDATES):
                    value, quoted = text[at + 1 : end].replace(c + c, c).strip(), True
                    end += 1
            if not quoted:
                end = at
                while end < n and text[end] not in CANDIDATES:
                    end += 1
                value = strip_brackets(text[at:end])
            if value:
                if found:
                    between.append(seps)
                found.append((value, quoted))
                seps = ""
            at = end
    return found, between


def spans(found: list[tuple[str, bool]], between: list[str], short: int) -> Iterator[tuple[int, int, str, str]]:
    """Edges of the lattice of up to ``short`` atoms: first atom, end, value and the characters joined inside."""
    for i, (value, quoted) in enumerate(found):
        yield i, i + 1, value, ""
        inner = ""
        if quoted:
            continue
        for j in range(i + 1, min(len(found), i + short)):
            if found[j][1] or len(between[j - 1]) != 1:
                break
            inner += between[j - 1]
            value += between[j - 1] + found[j][0]
            yield i, j + 1, value, inner


def _log_sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log1p(math.exp(-abs(a - b))) if top > LOW and min(a, b) > LOW else top


class Model:
    """What is known of one column: the mass of all values, and of each character how often it separates and how
    often a value with it inside goes without quotes."""

    def __init__(self, total: float, separates: dict[str, float], unquoted: dict[str, float]):
        self.total = max(total, 1e-9)
        self.split = {c: math.log(max(1e-9, p)) for c, p in separates.items()}
        self.join = {c: math.log(max(1e-9, 1 - p)) + math.log(max(1e-9, unquoted[c])) for c, p in separates.items()}

    def known(self, count: float) -> float:
        return math.log((1 - NEW) * count / self.total) if count > 0 else LOW


class Lattice:
    """One text's lattice under a model. edges: (i, j, value, characters inside, count so far)."""

    def __init__(self, n_atoms: int, between: list[str], quoted: list[bool], edges, model: Model, short: int):
        self.n, self.between, self.short = n_atoms, between, short
        n, letter = n_atoms, -math.log(LETTERS)
        self.end = [0.0] * (n + 1)  # of a value that ends at j: its separator separates
        self.place = [0.0] * (n + 1)  # of a value that goes on over place i
        self.open = [False] * (n + 1)  # whether a value may go on over place i
        for i in range(1, n):
            if len(between[i - 1]) == 1:
                c = between[i - 1]
                self.end[i] = model.split[c]
                self.open[i] = not quoted[i - 1] and not quoted[i]
                self.place[i] = letter + model.join[c]
        self.atoms = [""] * n
        edges = list(edges)
        for i, j, value, _, _ in edges:
            if j == i + 1:
                self.atoms[i] = value
        self.sum = [0.0]  # of atoms and places up to j, without place j
        for j in range(1, n + 1):
            self.sum.append(self.sum[-1] + (self.place[j - 1] if j > 1 else 0.0) + letter * len(self.atoms[j - 1]))
        self.fresh = math.log(NEW) + letter
        self.into: list[list[tuple[int, float, str, str]]] = [[] for _ in range(n + 1)]
        for i, j, value, inner, count in edges:
            score = model.known(count) + sum(model.join[c] for c in inner)
            if j - i <= short:  # a longer new value is part of the pass over all starts
                score = _log_sum(score, self.new(i, j))
            if score > LOW:
                self.into[j].append((i, score + self.end[j], value, inner))
        run, self.long = 1, False
        for i in range(1, n):
            run = run + 1 if self.open[i] else 1
            self.long |= run > short

    def new(self, i: int, j: int) -> float:
        """Log score of atoms i to j as a value not met before."""
        return self.fresh + self.sum[j] - self.sum[i] - (self.place[i] if i else 0.0)

    def _start(self, i: int) -> float:
        return -self.sum[i] - (self.place[i] if i else 0.0)

    def expected(self) -> Iterator[tuple[float, int, int, str, str]]:
        """(posterior, i, j, value, inner) of every edge, and of every longer join from ``LEAST`` on."""
        n, short = self.n, self.short
        forward, backward, over = [0.0] + [LOW] * n, [LOW] * n + [0.0], [LOW] * (n + 1)
        reach, first = LOW, 0
        firsts = [0] * (n + 1)
        for j in range(1, n + 1):
            for i, score, _, _ in self.into[j]:
                forward[j] = _log_sum(forward[j], forward[i] + score)
            if self.long:
                if j > 1 and not self.open[j - 1]:
                    reach, first = LOW, j - 1
                firsts[j] = first
                if j - short - 1 >= first:
                    reach = _log_sum(reach, forward[j - short - 1] + self._start(j - short - 1))
                over[j] = reach + self.fresh + self.sum[j] + self.end[j]
                forward[j] = _log_sum(forward[j], over[j])
        reach, last = LOW, n
        for i in range(n - 1, -1, -1):
            if self.long:
                if i < n - 1 and not self.open[i + 1]:
                    reach, last = LOW, i + 1
                if i + short + 1 <= last:
                    reach = _log_sum(reach, self.fresh + self.sum[i + short + 1] + self.end[i + short + 1] + backward[i + short + 1])
                backward[i] = _log_sum(backward[i], reach + self._start(i))
            # edges that start at i lie in into[j] of later j, whose backward is complete
            for j, score in self._from(i):
                backward[i] = _log_sum(backward[i], backward[j] + score)
        whole = forward[n]
        for j in range(1, n + 1):
            for i, score, value, inner in self.into[j]:
                yield math.exp(min(0.0, forward[i] + score + backward[j] - whole)), i, j, value, inner
            if self.long and over[j] + backward[j] - whole > math.log(LEAST):
                for i in range(firsts[j], j - short):
                    p = math.exp(min(0.0, forward[i] + self.new(i, j) + self.end[j] + backward[j] - whole))
                    if p >= LEAST:
                        yield p, i, j, self.value(i, j), "".join(self.between[i : j - 1])

    def _from(self, i: int) -> list[tuple[int, float]]:
        if not hasattr(self, "_out"):
            self._out: list[list[tuple[int, float]]] = [[] for _ in range(self.n + 1)]
            for j, edges in enumerate(self.into):
                for k, score, _, _ in edges:
                    self._out[k].append((j, score))
        return self._out[i]

    def value(self, i: int, j: int) -> str:
        return self.atoms[i] + "".join(self.between[k - 1] + self.atoms[k] for k in range(i + 1, j))

    def best(self) -> list[str]:
        """Viterbi path."""
        top = [0.0] + [LOW] * self.n
        back = [(-1, "")] * (self.n + 1)
        reach, at, first = LOW, 0, 0
        for j in range(1, self.n + 1):
            for i, score, value, _ in self.into[j]:
                if top[i] + score > top[j]:
                    top[j], back[j] = top[i] + score, (i, value)
            if self.long:
                if j > 1 and not self.open[j - 1]:
                    reach, first = LOW, j - 1
                i = j - self.short - 1
                if i >= first and top[i] + self._start(i) > reach:
                    reach, at = top[i] + self._start(i), i
                score = reach + self.fresh + self.sum[j] + self.end[j]
                if score > top[j]:
                    top[j], back[j] = score, (at, self.value(at, j))
        out, j = [], self.n
        while j > 0:
            i, value = back[j]
            out.append(value)
            j = i
        return out[::-1]


_SPANS = "tid long, field string, k int, seps array<string>, quoted array<boolean>, i int, j int, value string, joined string, certain boolean"


def _spans_of(short: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tid, field, text in zip(pdf.tid, pdf.field, pdf.text):
                found, between = atoms(text)
                for i, j, value, inner in spans(found, between, short):
                    head = i == 0 and j == 1  # what belongs to the text as a whole stands at its first atom
                    sure = (len(found) == 1 or found[i][1]) and j == i + 1
                    rows.append((tid, field, len(found), between if head else [], [q for _, q in found] if head else [], i, j, value, inner, sure))
            yield pd.DataFrame(rows, columns=["tid", "field", "k", "seps", "quoted", "i", "j", "value", "joined", "certain"])

    return run


def split_packed(df: DataFrame, key: str, fields: list[str], *, rounds: int = 3, short: int = SHORT) -> DataFrame:
    """(key, field, pos, item) of every text in ``fields`` that holds two or more values.

    Nulls, empty texts, texts of separators only and texts of one value give no row. Rows that repeat a
    key with the same texts count once; repeats of a value inside a text are kept; extra columns of any
    name are ignored; rows with a null key are left out, as no result could name them. An empty table
    gives an empty result. A text of any length is split whole. ``short`` changes speed, not the result.
    """
    source = df.select(F.col(key).alias("rid"), *[F.col(f).alias(f"f{n}") for n, f in enumerate(fields)]).where(F.col("rid").isNotNull())
    cells = source.select(
        "rid", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{n}").alias("text")) for n, f in enumerate(fields)])).alias("c")
    ).select("rid", "c.field", "c.text").where(F.col("text").isNotNull() & (F.trim("text") != ""))
    texts = cut(cells.select("field", "text").distinct().withColumn("tid", F.monotonically_increasing_id()))

    edges = cut(texts.mapInPandas(_spans_of(short), _SPANS))
    counts = edges.where("certain").groupBy("field", "value").agg(F.count("*").cast("double").alias("c"))
    separates, unquoted = ({f: {c: prior[k] for c, prior in CANDIDATES.items()} for f in fields} for k in (0, 1))
    inside = F.explode(F.array(*[F.when(F.col("value").contains(c), F.lit(c)) for c in CANDIDATES]))
    quoted = edges.where("certain").select("field", inside.alias("c")).where("c is not null").groupBy("field", "c").agg(F.count("*").alias("n"))
    in_quotes = {(r.field, r.c): r.n for r in quoted.collect()}  # fields x candidates
    lattices = edges.where("k > 1").drop("certain")
    longer = None

    def scored(counts: DataFrame) -> DataFrame:
        found = lattices.join(counts, ["field", "value"], "left").groupBy("tid").agg(
            F.first("field").alias("field"),
            F.first("k").alias("k"),
            F.flatten(F.collect_list("seps")).alias("seps"),
            F.flatten(F.collect_list("quoted")).alias("quoted"),
            F.collect_list(F.struct("i", "j", "value", "joined", F.coalesce("c", F.lit(0.0)).alias("c"))).alias("edges"),
        )
        if longer is None:
            return found.withColumn("longer", F.lit(None).cast("array<struct<i:int,j:int,value:string,joined:string,c:double>>"))
        more = longer.join(counts, ["field", "value"], "left").groupBy("tid").agg(F.collect_list(F.struct("i", "j", "value", "joined", F.coalesce("c", F.lit(0.0)).alias("c"))).alias("longer"))
        return found.join(more, "tid", "left")

    def models(counts: DataFrame) -> dict[str, Model]:
        total = {r.field: r.t for r in counts.groupBy("field").agg(F.sum("c").alias("t")).collect()}  # a row per field
        return {f: Model(total.get(f, 0.0), separates[f], unquoted[f]) for f in fields}

    for _ in range(rounds):
        rows = cut(scored(counts).mapInPandas(_expect(models(counts), short), "kind string, field string, value string, c double, tid long, i int, j int, joined string"))
        sums: dict[tuple, float] = {}
        for r in rows.where("kind in ('split', 'join', 'plain')").groupBy("kind", "field", "value").agg(F.sum("c").alias("c")).collect():  # fields x candidates
            sums[r.kind, r.field, r.value] = r.c
        for f in fields:
            for c, prior in CANDIDATES.items():
                yes, no, plain = (sums.get((kind, f, c), 0.0) for kind in ("split", "join", "plain"))
                separates[f][c] = (yes + PRIOR_WEIGHT * prior[0]) / (yes + no + PRIOR_WEIGHT)
                unquoted[f][c] = (plain + PRIOR_WEIGHT * prior[1]) / (plain + in_quotes.get((f, c), 0.0) + PRIOR_WEIGHT)
        longer = rows.where("kind = 'long'").select("tid", "field", "value", "i", "j", "joined")
        counts = (
            edges.where("certain and k = 1").select("field", "value", F.lit(1.0).alias("c"), F.lit(0.0).alias("w"))
            .unionByName(rows.where("kind in ('value', 'wide')").select("field", "value", F.when(F.col("kind") == "value", F.col("c")).otherwise(0.0).alias("c"), F.when(F.col("kind") == "wide", F.col("c")).otherwise(0.0).alias("w")))
            .groupBy("field", "value").agg((F.sum("c") + F.greatest(F.lit(0.0), F.sum("w") - 1)).alias("c"))
        )
    chosen = scored(counts).mapInPandas(_decode(models(counts), short), "tid long, items array<string>")
    by_text = texts.join(chosen, "tid").where(F.size("items") > 1).select("field", "text", "items")
    packed = cells.where(F.col("text").rlike("[;,|+&/\\t]"))
    return (
        packed.join(by_text, ["field", "text"])
        .select(F.col("rid").alias(key), "field", F.posexplode("items").alias("pos", "item"))
        .select(key, "field", (F.col("pos") + 1).cast("int").alias("pos"), "item")
        .distinct()
    )


def _lattice(row, models: dict[str, Model], short: int) -> Lattice:
    found = [*row.edges, *(row.longer if row.longer is not None else ())]
    return Lattice(row.k, list(row.seps), list(row.quoted), ((e["i"], e["j"], e["value"], e["joined"], e["c"]) for e in found), models[row.field], short)


def _expect(models, short: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple[str, str, str], float] = {}
            longer: dict[tuple, tuple] = {}
            for row in pdf.itertuples(index=False):
                lattice = _lattice(row, models, short)
                ends = [0.0] * (lattice.n + 1)
                for p, i, j, value, inner in lattice.expected():
                    ends[j] += p
                    if p > LEAST:
                        where = ("wide" if inner else "value", row.field, value)
                        sums[where] = sums.get(where, 0.0) + p
                        for c in set(inner):
                            where = ("plain", row.field, c)
                            sums[where] = sums.get(where, 0.0) + p / lattice.n
                        if j - i > short:
                            longer[row.tid, i, j] = ("long", row.field, value, 0.0, row.tid, i, j, inner)
                for j, between in enumerate(lattice.between, 1):
                    if len(between) == 1:
                        for kind, p in (("split", ends[j]), ("join", 1 - ends[j])):
                            where = (kind, row.field, between)
                            sums[where] = sums.get(where, 0.0) + p / lattice.n
            rows = [(*k, v, 0, 0, 0, "") for k, v in sums.items()] + list(longer.values())
            yield pd.DataFrame(rows, columns=["kind", "field", "value", "c", "tid", "i", "j", "joined"])

    return run


def _decode(models, short: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"tid": pdf.tid, "items": [_lattice(r, models, short).best() for r in pdf.itertuples(index=False)]})

    return run
