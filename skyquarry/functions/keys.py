"""Keys and sort keys of observations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyquarry.session import usable

#: Sort wavelengths of filters that have names instead of numbers, in nm.
NAMED_WAVELENGTHS = {
    "FUV": 153, "NUV": 231, "UVW2": 193, "UVM2": 225, "UVW1": 260, "U": 346, "B": 439, "V": 547,
    "G": 481, "R": 617, "I": 752, "Z": 866, "Y": 962, "TESS": 786,
}
NO_WAVELENGTH = 9223372036854775807
#: A part of an observation id that names a filter.
FILTER_TOKEN = r"^(CLEAR|(FQ?|G)[0-9]{2,4}[A-Z0-9]*)$"


def _parts(obs_id: Column) -> Column:
    return F.filter(F.split(obs_id, "_"), lambda x: x != "")


def jwst_key(obs_id: Column) -> Column:
    """The first three parts of the id; the id itself if it has fewer."""
    parts = _parts(obs_id)
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "_")).otherwise(obs_id)


def hst_key(obs_id: Column) -> Column:
    """The parts before the first one, other than the leading part, that names a filter."""
    parts = _parts(obs_id)
    marks = F.transform(parts, lambda x, i: (i > 0) & F.upper(x).rlike(FILTER_TOKEN))
    at = F.array_position(marks, True)
    return F.when(F.size(parts) == 0, obs_id).otherwise(F.array_join(F.when(at > 0, F.slice(parts, 1, at.cast("int") - 1)).otherwise(parts), "_"))


def group_key(collection: Column, obs_id: Column) -> Column:
    """Key of the observation group that an observation belongs to."""
    name = F.upper(collection)
    return F.when(name == "JWST", jwst_key(obs_id)).when((name == "HST") | F.lower(obs_id).startswith("hst_"), hst_key(obs_id)).otherwise(obs_id)


def mission(collection: Column) -> Column:
    """Mission of a collection: HLA holds products of HST."""
    name = F.upper(collection)
    return F.when(name == "HLA", "HST").otherwise(name)


def filter_wavelength(filters: Column) -> Column:
    """Sort key of a filter text by its first component; never a wavelength, as its unit differs by mission."""
    first = F.upper(F.coalesce(F.get(F.filter(F.split(filters, ";"), lambda x: x != ""), F.lit(0)), filters))
    named = F.create_map(*[x for k, v in NAMED_WAVELENGTHS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    digits = F.regexp_extract(first, "^F([0-9]+)", 1).try_cast("long")
    return F.coalesce(F.try_element_at(named, first), digits, F.lit(NO_WAVELENGTH))


def effective_time(t_min: Column, t_max: Column, t_release: Column) -> Column:
    """Start if positive, else end if positive, else release. NaN, which Spark orders above all, is not positive."""
    positive = lambda t: usable(t) & (t > 0)
    return F.when(positive(t_min), t_min).when(positive(t_max), t_max).otherwise(t_release)
