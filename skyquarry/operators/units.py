"""Quantities recorded in different units (problem 4): wavelength bands to nanometres.

The unit of a record is a hidden state. The records of a device (one filter of one archive, or one table
of filters) form a sequence in time; each value, seen through a unit, must lie near the smooth underlying
level of its device. The level is a moving mean over the labelled records before and after, which may
drift; where one is known from elsewhere (such as a pivot) the mean is taken of the departures from it.
Viterbi decodes the sequence of units from the jumps of the logarithm of the values; a unit written
beside a value pins the state there. How often the unit stays from record to record is learned from
neighbours with labels. Where two units both lie near the level, the sequence decides.

All sequences are range-sorted by device and time, so one with a third of all rows spans partitions. Each
partition gives summaries of bounded size: the moving sums at its borders, then the max-plus vectors (or the
matrix, if one unlabelled sequence fills it) of its first and last run. Combined from both sides on the
driver, a row per partition, they are the state in which a last scan decodes every partition exactly. A
readable unit needs no decoding; such records are only read for the level, and converted in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.session import cut, usable

#: Units of wavelength (factor to nm) and their reciprocals (nm = factor / value).
LENGTHS = {"nm": 1.0, "A": 0.1, "um": 1e3, "mm": 1e6, "cm": 1e7, "m": 1e9, "am": 1e-9, "pm": 1e-3}
RECIPROCALS = {
    "Hz": 2.99792458e17, "kHz": 2.99792458e14, "MHz": 2.99792458e11, "GHz": 2.99792458e8, "THz": 2.99792458e5,
    "cm-1": 1e7, "eV": 1239.841984332, "keV": 1.239841984332, "MeV": 1.239841984332e-3,
}
#: Spellings of each base unit, lower case, without blanks and ``^``.
SPELLINGS = {
    "cm-1": ["cm-1", "1/cm", "percm", "kayser"], "keV": ["kev", "kiloelectronvolt", "kiloelectronvolts"], "MeV": ["mev"],
    "eV": ["ev", "electronvolt", "electronvolts"], "THz": ["thz", "terahertz"], "GHz": ["ghz", "gigahertz"], "MHz": ["mhz", "megahertz"],
    "kHz": ["khz", "kilohertz"], "Hz": ["hz", "hertz"], "A": ["å", "angstrom", "angstroms", "ångström", "ångströms"],
    "um": ["um", "µm", "μm", "micron", "microns", *(f"micromet{e}" for e in ("er", "ers", "re", "res"))],
    **{u: [u, *(f"{name}met{e}" for e in ("er", "ers", "re", "res"))] for u, name in (("nm", "nano"), ("pm", "pico"), ("mm", "milli"), ("cm", "centi"), ("m", ""))},
}
#: States of the hidden chain: units met without a label.
STATES = ["nm", "A", "um", "m", "am", "Hz", "GHz", "THz", "cm-1", "eV", "keV"]
#: Standard deviation of a value about its level (log10), the memory of the moving mean, and the weight of a given level in it.
SPREAD, MEMORY, GIVEN = 0.02, 0.9, 1.0
_WORDS = sorted({w for words in SPELLINGS.values() for w in words}, key=lambda w: (-len(w), w))
#: A number or a power as multiplier, then a unit that is a word of its own.
_PATTERN = (
    r"(?:([0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?)(?:\^([-+]?[0-9]+))?\s*)?(?<![\p{L}])(cm\s?\^?-1|per cm|"
    + "|".join(w for w in _WORDS if w not in ("cm-1", "percm"))
    + r")(?![\p{L}0-9^]|-[0-9])"
)


def unit_of(text: Column) -> Column:
    """struct(unit, times): base unit and multiplier named in a free text; nulls if none is named.

    ``A`` alone must be the whole text, but for brackets and a word that says vacuum.
    """
    t = F.lower(F.trim(text))
    alone = t.rlike(r"^[\s\[(]*a[\])\s]*(?:\(vac(?:uum)?\))?$")
    units = {w: unit for unit, ws in SPELLINGS.items() for w in ws}
    words = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    word = F.translate(F.regexp_extract(t, _PATTERN, 3), " ^", "")
    unit = F.when(alone, F.lit("A")).otherwise(F.try_element_at(words, word))
    base = F.regexp_extract(t, _PATTERN, 1).try_cast("double")
    power = F.regexp_extract(t, _PATTERN, 2).try_cast("double")
    times = F.coalesce(F.pow(base, power), base, F.lit(1.0))
    return F.struct(unit.alias("unit"), F.when(unit.isNotNull(), times).alias("times"))


def to_nm(value: Column, unit: Column, times: Column) -> Column:
    """Wavelength in nm of a value in ``times`` x ``unit``; null for no or an unknown unit."""
    lengths = F.create_map(*[x for k, v in LENGTHS.items() for x in (F.lit(k), F.lit(v))])
    reciprocals = F.create_map(*[x for k, v in RECIPROCALS.items() for x in (F.lit(k), F.lit(v))])
    v = value * times
    return F.coalesce(v * F.try_element_at(lengths, unit), F.try_element_at(reciprocals, unit) / v)


def _log_nm(log_value: np.ndarray) -> np.ndarray:
    """log10 of the wavelength under each state; rows x states."""
    out = np.empty((len(log_value), len(STATES)))
    for k, unit in enumerate(STATES):
        out[:, k] = log_value + math.log10(LENGTHS[unit]) if unit in LENGTHS else math.log10(RECIPROCALS[unit]) - log_value
    return out


def viterbi(emission: np.ndarray, move: np.ndarray, entry: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """Most likely states of one run. ``entry`` scores its first state, ``exit_`` its last one, ``move`` every step."""
    n = len(emission)
    back = np.empty((n, len(entry)), np.int16)
    score = entry + emission[0]
    for t in range(1, n):
        steps = score[:, None] + move
        back[t] = steps.argmax(0)
        score = steps.max(0) + emission[t]
    path = np.empty(n, np.int16)
    path[-1] = (score + exit_).argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _moves(prior: np.ndarray, stay: float) -> np.ndarray:
    return np.log(stay * np.eye(len(prior)) + (1 - stay) * prior[None, :] + 1e-12)


def _sums(device: np.ndarray, z: list[float], labelled: list[bool], entry: tuple | None):
    """Moving sums (of departures, of weights) of labelled rows before each row, and at the end."""
    num, den, last = (entry[1], entry[2], entry[0]) if entry else (0.0, 0.0, None)
    nums, dens = [], []
    for d, x, known in zip(device, z, labelled):
        if d != last:
            num = den = 0.0
            last = d
        nums.append(num)
        dens.append(den)
        if known:
            num, den = MEMORY * num + x, MEMORY * den + 1
    return np.array(nums), np.array(dens), (last, num, den)


class _Part:
    """One partition's rows in order."""

    def __init__(self, pdf: pd.DataFrame):
        self.part = int(pdf.part.iloc[0])
        self.device = pdf.device.to_numpy(object)
        self.value = pdf.log_value.to_numpy(float)
        self.state = pdf.state.to_numpy()
        self.given = pdf.level.to_numpy(float)
        self.labelled = self.state != -1
        self.base = np.nan_to_num(self.given)
        self.z = np.where(self.labelled, pdf.log_nm.to_numpy(float) - self.base, 0.0)
        self.first, self.last = self.device[0], self.device[-1]
        self.whole = self.first == self.last and bool((self.device == self.first).all())

    def runs(self):
        """(start, end) of every run of unlabelled rows of one device."""
        change = np.r_[True, (self.device[1:] != self.device[:-1]) | (self.labelled[1:] != self.labelled[:-1]), True]
        cuts = np.flatnonzero(change)
        return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if not self.labelled[a]]

    def emissions(self, before: tuple | None, after: tuple | None, spread: float):
        """log10 of the wavelength, level and emission of every unlabelled row."""
        z, known = self.z.tolist(), self.labelled.tolist()
        n1, d1, _ = _sums(self.device, z, known, before)
        n2, d2, _ = _sums(self.device[::-1], z[::-1], known[::-1], after)
        weight = d1 + d2[::-1] + np.where(np.isnan(self.given), 0.0, GIVEN)
        with np.errstate(invalid="ignore", divide="ignore"):
            level = self.base + (n1 + n2[::-1]) / weight
        nm = _log_nm(self.value)
        emission = -0.5 * np.clip((nm - level[:, None]) / spread, -60, 60) ** 2
        emission[np.isnan(level)] = 0.0
        return nm, level, emission


def _parts(f):
    """mapInPandas over whole partitions, whose size the range sort bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            yield f(_Part(whole := pd.concat(held, ignore_index=True)), whole)

    return run


def _level_summary(p: _Part, pdf: pd.DataFrame) -> pd.DataFrame:
    z, known = p.z.tolist(), p.labelled.tolist()
    tail, head = _sums(p.device, z, known, None)[2], _sums(p.device[::-1], z[::-1], known[::-1], None)[2]
    at = np.flatnonzero(p.state >= 0)
    pair = (np.diff(at) == 1) & (p.device[at[1:]] == p.device[at[:-1]])
    same = int((pair & (p.state[at[1:]] == p.state[at[:-1]])).sum())
    shares = np.bincount(p.state[at], minlength=len(STATES)).tolist()
    return pd.DataFrame([(p.part, p.first, p.last, p.whole, int(p.labelled.sum()), *head[1:], *tail[1:], same, int(pair.sum()), shares)], columns=_LEVELS)


_LEVELS = ["part", "first", "last", "whole", "n", "head_num", "head_den", "tail_num", "tail_den", "same", "pairs", "shares"]
_LEVELS_SCHEMA = "part int, first string, last string, whole boolean, n long, head_num double, head_den double, tail_num double, tail_den double, same long, pairs long, shares array<long>"


def carry_sums(rows: list) -> dict[int, tuple]:
    """part -> (moving sums of the device before it, of the device after it), each None or (device, num, den)."""
    rows = sorted(rows, key=lambda r: r.part)

    def pass_(rows, own, entering):
        out, state = {}, None
        for r in rows:
            out[r.part] = state
            device, num, den = own(r)
            if r.whole and state and state[0] == entering(r):
                fade = MEMORY ** min(r.n, 1000)
                num, den = num + fade * state[1], den + fade * state[2]
            state = (device, num, den)
        return out

    before = pass_(rows, lambda r: (r.last, r.tail_num, r.tail_den), lambda r: r.first)
    after = pass_(rows[::-1], lambda r: (r.first, r.head_num, r.head_den), lambda r: r.last)
    return {r.part: (before[r.part], after[r.part]) for r in rows}


def _through(emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Max-plus matrix of a run: best score from the state before it to its last state."""
    m = move + emission[0]
    for e in emission[1:]:
        m = (m[:, :, None] + move[None]).max(1) + e
    return m


def _start(p: _Part, a: int, prior: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Entry of a run that starts inside the partition: after a label of its device, or at the device's first row."""
    if a and p.device[a - 1] == p.device[a] and p.state[a - 1] >= 0:
        return move[p.state[a - 1]]
    return np.log(prior + 1e-12)


def _stop(p: _Part, b: int, move: np.ndarray) -> np.ndarray:
    """Exit of a run that ends inside the partition."""
    if b < len(p.device) and p.device[b] == p.device[b - 1] and p.state[b] >= 0:
        return move[:, p.state[b]]
    return np.zeros(len(move))


def _run_summary(sums, prior, move, spread):
    def f(p: _Part, pdf: pd.DataFrame) -> pd.DataFrame:
        emission = p.emissions(*sums[p.part], spread)[2]
        head, tail, through = [], [], []
        pin = lambda s: int(s) if s >= 0 else -1
        runs, n = p.runs(), len(p.device)
        if runs and runs[0] == (0, n):
            through = _through(emission, move).ravel().tolist()
        if runs and runs[0][0] == 0 and runs[0][1] < n:
            head = (_through(emission[: runs[0][1]], move) + _stop(p, runs[0][1], move)).max(1).tolist()
        if runs and runs[-1][1] == n and runs[-1][0] > 0:
            a = runs[-1][0]
            score = _start(p, a, prior, move) + emission[a]
            for e in emission[a + 1 :]:
                score = (score[:, None] + move).max(0) + e
            tail = score.tolist()
        return pd.DataFrame([(p.part, p.first, p.last, pin(p.state[0]), pin(p.state[-1]), bool(p.labelled[0]), bool(p.labelled[-1]), head, tail, through)], columns=_RUNS)

    return f


_RUNS = ["part", "first", "last", "pin_first", "pin_last", "known_first", "known_last", "head", "tail", "through"]
_RUNS_SCHEMA = "part int, first string, last string, pin_first int, pin_last int, known_first boolean, known_last boolean, head array<double>, tail array<double>, through array<double>"


def carry_runs(rows: list, prior: np.ndarray, move: np.ndarray) -> dict[int, tuple]:
    """part -> (entry of a run open at its start, exit of a run open at its end), by max-plus over the summaries."""
    rows = sorted(rows, key=lambda r: r.part)
    k = len(prior)
    fresh, entry, exit_, state = np.log(prior + 1e-12), {}, {}, None
    for r in rows:  # state: (device, scores of the states of the last row so far, or None after a label without a state)
        seen = state is not None and state[0] == r.first and state[1] is not None
        entry[r.part] = (state[1][:, None] + move).max(0) if seen else fresh
        if r.known_last:
            scores = np.where(np.arange(k) == r.pin_last, 0.0, -1e9) if r.pin_last >= 0 else None
        elif r.through:
            m = np.array(r.through).reshape(k, k)
            scores = (state[1][:, None] + m).max(0) if seen else (m - move + fresh).max(0)
        else:
            scores = np.array(r.tail)
        state = (r.last, scores - scores.max() if scores is not None else None)
    state = None
    for r in rows[::-1]:  # state: (device, best score of what follows by the state before it)
        exit_[r.part] = state[1] if state is not None and state[0] == r.last else np.zeros(k)
        if r.known_first:
            ahead = move[:, r.pin_first] if r.pin_first >= 0 else np.zeros(k)
        elif r.through:
            ahead = (np.array(r.through).reshape(k, k) + exit_[r.part][None, :]).max(1)
        else:
            ahead = np.array(r.head)
        state = (r.first, ahead - ahead.max())
    return {r.part: (entry[r.part], exit_[r.part]) for r in rows}


def _decode(sums, borders, prior, move, spread):
    def f(p: _Part, pdf: pd.DataFrame) -> pd.DataFrame:
        nm, level, emission = p.emissions(*sums[p.part], spread)
        entry, exit_ = borders[p.part]
        path, n = np.zeros(len(p.device), np.int16), len(p.device)
        for a, b in p.runs():
            path[a:b] = viterbi(emission[a:b], move, entry if a == 0 else _start(p, a, prior, move), exit_ if b == n else _stop(p, b, move))
        rows = np.flatnonzero(~p.labelled)
        fit = np.abs(nm[rows, path[rows]] - level[rows]) <= 5 * spread  # false without a level
        unit = np.where(fit, np.array(STATES, object)[path[rows]], None)
        return pd.DataFrame({"rid": pdf.rid.to_numpy()[rows], "unit": unit, "lo": pdf.lo.to_numpy()[rows], "hi": pdf.hi.to_numpy()[rows]})

    return f


def to_common_unit(df: DataFrame, key: str, device: Column, order: Column, low: Column, high: Column, label: Column, *, level: Column | None = None, spread: float = SPREAD, chained: Column | None = None) -> DataFrame:
    """(key, unit, lo_nm, hi_nm, own, source, scale_nm) of every record with both ends of a band, in nanometres.

    ``unit`` is the unit with its multiplier left out, ``own`` whether the value stood in nm already,
    ``scale_nm`` the length of the recorded unit in nm (null for reciprocal units) and ``source`` how the
    unit was found: ``text``, ``sequence``, or null if it stays undecided (no readable label, and no level of
    the device or no unit under which the value fits it, or not ``chained``); then the band is null.
    ``level`` is a level (log10 nm) known from elsewhere; ``chained`` says which records belong to the
    sequence of their device. Records with a null key, or an end that is null, NaN, infinite or not
    positive, are left out. A repeated key counts once. Ends may come in either order; records of equal
    order go by key. Extra columns are ignored and an empty table gives an empty result.
    """
    rows = (
        df.select(F.col(key).alias("rid"), F.coalesce(device.cast("string"), F.lit("")).alias("device"), order.cast("double").alias("at"), low.cast("double").alias("lo"), high.cast("double").alias("hi"), unit_of(label).alias("u"), (level if level is not None else F.lit(None)).cast("double").alias("level"), (chained if chained is not None else F.lit(True)).alias("chained"))
        .where(F.col("rid").isNotNull() & usable("lo") & usable("hi") & (F.col("lo") > 0) & (F.col("hi") > 0))
        .select("*", "u.*")
        .drop("u")
        .dropDuplicates(["rid"])
        .withColumn("known", to_nm(F.sqrt(F.col("lo") * F.col("hi")), F.col("unit"), F.col("times")))
    )
    rows = cut(rows)
    known = F.col("known").isNotNull()
    states = F.create_map(*[x for i, s in enumerate(STATES) for x in (F.lit(s), F.lit(i))])
    # a label with a multiplier (0.1 nm, 1e-6 m) stands for the state of the same size; -1: no label, -2: a label that is no state
    factor = to_nm(F.lit(1.0), F.col("unit"), F.col("times"))
    state = F.coalesce(
        F.when(F.col("times") == 1, F.try_element_at(states, F.col("unit"))),
        *[F.when(F.col("unit").isin(*LENGTHS) & (F.abs(factor / LENGTHS[s] - 1) < 1e-6), F.lit(i)) for i, s in enumerate(STATES) if s in LENGTHS],
        F.when(known, F.lit(-2)).otherwise(F.lit(-1)),
    )
    chain = rows.where("chained").select(
        "device", "at", "rid", F.log10(F.sqrt(F.col("lo") * F.col("hi"))).alias("log_value"), F.log10("known").alias("log_nm"), "level", state.alias("state"),
        F.when(~known, F.col("lo")).alias("lo"), F.when(~known, F.col("hi")).alias("hi"),
    )
    placed = chain.repartitionByRange("device", "at", "rid").sortWithinPartitions("device", "at", "rid").withColumn("part", F.spark_partition_id())
    placed = cut(placed).drop("at")  # all scans must see the same partitions

    levels = placed.drop("lo", "hi", "rid").mapInPandas(_parts(_level_summary), _LEVELS_SCHEMA).collect()  # a row per partition
    shares = np.sum([r.shares for r in levels], 0) if levels else np.zeros(len(STATES))
    prior = (shares + 1.0) / (shares + 1.0).sum()
    move = _moves(prior, (sum(r.same for r in levels) + 1) / (sum(r.pairs for r in levels) + 2))
    sums = carry_sums(levels)
    runs = placed.drop("lo", "hi", "rid").mapInPandas(_parts(_run_summary(sums, prior, move, spread)), _RUNS_SCHEMA).collect()  # a row per partition
    kind = dict(rows.dtypes)["rid"]
    decoded = placed.mapInPandas(_parts(_decode(sums, carry_runs(runs, prior, move), prior, move, spread)), f"rid {kind}, unit string, lo double, hi double")

    columns = ["rid", "unit", "times", "lo", "hi", "source"]
    direct = rows.where(known | ~F.col("chained")).withColumn("source", F.when(known, F.lit("text"))).withColumn("unit", F.when(known, F.col("unit")))
    found = decoded.withColumn("times", F.lit(1.0)).withColumn("source", F.when(F.col("unit").isNotNull(), F.lit("sequence")))
    both = direct.select(columns).unionByName(found.select(columns))
    one, two = (to_nm(F.col(c), F.col("unit"), F.col("times")) for c in ("lo", "hi"))
    own = F.coalesce(F.col("unit").isin(*LENGTHS) & (F.abs(to_nm(F.lit(1.0), F.col("unit"), F.col("times")) - 1) < 1e-9), F.lit(False))
    return both.select(F.col("rid").alias(key), "unit", F.least(one, two).alias("lo_nm"), F.greatest(one, two).alias("hi_nm"), own.alias("own"), "source", F.when(F.col("unit").isin(*LENGTHS), to_nm(F.lit(1.0), F.col("unit"), F.col("times"))).alias("scale_nm"))
