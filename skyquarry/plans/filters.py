"""Declarative observation filters: values are alternatives within a filter, filters hold together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """One column against alternatives; ``separator`` for columns that list values, ``like`` for a pattern."""

    column: str
    values: tuple[str, ...] = ()
    separator: str | None = None
    like: str | None = None

    def predicate(self) -> Column:
        c = F.col(self.column).cast("string")
        if self.like is not None:
            return c.ilike(self.like)
        wanted = [v.upper() for v in self.values]
        if self.separator:
            return F.arrays_overlap(F.split(F.upper(c), self.separator), F.array(*map(F.lit, wanted)))
        return F.upper(c).isin(wanted)


def together(filters: list[Filter]) -> Column:
    return reduce(lambda a, b: a & b, (f.predicate() for f in filters), F.lit(True))


@dataclass(frozen=True)
class Imagery:
    """Choice of imagery. Rights and intent always filter, the others if they are not empty."""

    rights: str = "PUBLIC"
    intent: str = "science"
    calib_levels: tuple[str, ...] = ("3", "4")
    product_types: tuple[str, ...] = ("IMAGE",)
    regions: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()

    def filters(self) -> list[Filter]:
        plain = [("datarights", (self.rights,)), ("calib_level", self.calib_levels), ("dataproduct_type", self.product_types), ("intenttype", (self.intent,))]
        listed = [("wavelength_region", self.regions), ("obs_collection", self.collections), ("instrument_name", self.instruments), ("filters", self.bands)]
        return [Filter(c, v) for c, v in plain if v] + [Filter(c, v, ";") for c, v in listed if v]

    def predicate(self) -> Column:
        return together(self.filters())


SCIENCE = Imagery()
PRESETS = {
    "science": SCIENCE,
    "uv": replace(SCIENCE, regions=("UV", "EUV")),
    "optical": replace(SCIENCE, regions=("OPTICAL",)),
    "infrared": replace(SCIENCE, regions=("INFRARED", "IR")),
    "xray": replace(SCIENCE, regions=("XRAY",)),
    "hst": replace(SCIENCE, collections=("HST",)),
    "jwst": replace(SCIENCE, collections=("JWST",)),
    "galex": replace(SCIENCE, collections=("GALEX",)),
    "swift": replace(SCIENCE, collections=("SWIFT",), calib_levels=("2",), product_types=("IMAGE", "CUBE")),
    "ps1": replace(SCIENCE, collections=("PS1",), calib_levels=("3",)),
    "tess": replace(SCIENCE, collections=("TESS",), calib_levels=("2",)),
    "jwst miri": replace(SCIENCE, collections=("JWST",), instruments=("MIRI/IMAGE",)),
    "jwst nircam": replace(SCIENCE, collections=("JWST",), instruments=("NIRCAM/IMAGE",)),
}


def preview(region: str = "OPTICAL") -> list[Filter]:
    """Filters of preview images of one wave band."""
    return SCIENCE.filters() + [Filter("wavelength_region", (region,))]


@dataclass(frozen=True)
class Mission:
    collections: tuple[str, ...]
    calib_levels: tuple[str, ...]
    product_types: tuple[str, ...] = ("IMAGE",)


MISSIONS = {
    "JWST": Mission(("JWST",), ("3", "4")),
    "HST": Mission(("HST", "HLA"), ("3", "4")),
    "PS1": Mission(("PS1",), ("3",)),
    "GALEX": Mission(("GALEX",), ("2",)),
    "SWIFT": Mission(("SWIFT",), ("2",), ("IMAGE", "CUBE")),
    "TESS": Mission(("TESS",), ("2",)),
}


def of_missions(names: list[str]) -> Imagery:
    """Imagery of several missions: the sorted unions of their defaults."""
    chosen = [MISSIONS[n] for n in names]
    union = lambda attribute: tuple(sorted({v for m in chosen for v in getattr(m, attribute)}))
    return Imagery(collections=union("collections"), calib_levels=union("calib_levels"), product_types=union("product_types"))


@dataclass
class Adql:
    """A select statement built from predicates; ``then`` joins a predicate to the next (and, or)."""

    table: str
    fields: tuple[str, ...] = ("*",)
    top: int | None = None
    parts: list[str] = field(default_factory=list)

    def where(self, column: str, operator: str, value: str, then: str | None = None) -> "Adql":
        if operator.lower() not in ("=", "<", ">", "<=", ">=", "like", "between", "is"):
            raise ValueError(f"unknown operator {operator}")
        text = f"'{value}'" if operator.lower() == "like" else value
        self.parts.append(f"{column} {operator} {text}" + (f" {then}" if then else ""))
        return self

    def sql(self) -> str:
        condition = f" where {' '.join(self.parts)}" if self.parts else ""
        return f"select {','.join(self.fields)} from {self.table}{condition}" + (f" limit {self.top}" if self.top is not None else "")


def from_adql(query: str) -> str:
    """Spark SQL of an ADQL statement: TOP n becomes LIMIT n."""
    m = re.match(r"(?is)^\s*select\s+top\s+(\d+)\s+(.*?);?\s*$", query)
    return f"select {m[2]} limit {m[1]}" if m else query
