"""FITS header values, sizes, roles and world coordinates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that tell the role of a header unit, most specific role first.
ROLE_TERMS = {
    "weight": ["WHT", "WEIGHT", "WEIGHTS", "IVM", "VAR_POISSON", "VAR_RNOISE"],
    "error": ["ERR", "ERROR", "RMS", "UNCERT", "UNCERTAINTY"],
    "dataQuality": ["DQ", "DQUALITY", "QUALITY", "MASK"],
    "science": ["SCI", "SCIENCE", "IMAGE", "RATE"],
}
ROLE_FILE_TOKENS = {"weight": ["WHT", "WEIGHT", "IVM"], "error": ["ERR", "ERROR", "RMS"], "dataQuality": ["DQ", "QUALITY", "MASK"], "science": ["SCI", "SCIENCE"]}
BLOCK = 2880


def header_value(raw: Column) -> Column:
    """struct(vtype, s, i, d, b) of a raw header value: bool, integer, double or string without quotes."""
    t = F.trim(raw)
    bool_ = F.when(t.isin("T", "true"), True).when(t.isin("F", "false"), False)
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))
    real = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    bare = F.trim(F.replace(t, F.lit("'"), F.lit("")))
    kind = F.when(bool_.isNotNull(), "bool").when(whole.isNotNull(), "integer").when(real.isNotNull(), "double").when(raw.isNotNull(), "string")
    text = F.when(kind == "string", F.when(bare == "", t).otherwise(bare))
    return F.struct(kind.alias("vtype"), text.alias("s"), F.when(kind == "integer", whole).alias("i"), F.when(kind == "double", real).alias("d"), bool_.alias("b"))


def categorical(raw: Column) -> Column:
    """A keyword's categorical value: quotes and blanks cut, upper case."""
    return F.upper(F.trim(F.replace(raw, F.lit("'"), F.lit(""))))


def pixel_bytes(bitpix: Column) -> Column:
    return F.when(bitpix.isin(8, 16, 32, 64, -32, -64), F.abs(bitpix) / 8).cast("long")


def data_size(bitpix: Column, axes: Column, pcount: Column, gcount: Column, groups: Column) -> Column:
    """Bytes of a data segment, -1 if invalid or beyond 64 bits. axes: array of NAXISn, empty for none."""
    used = F.when(F.coalesce(groups, F.lit(False)), F.slice(axes, 2, F.greatest(F.size(axes) - 1, F.lit(0)))).otherwise(axes)
    elements = F.when(F.size(axes) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(used, F.lit(1).cast("long"), lambda a, n: F.try_multiply(a, n.cast("long"))))
    p, g = F.coalesce(pcount, F.lit(0)).cast("long"), F.coalesce(gcount, F.lit(1)).cast("long")
    total = F.try_multiply(F.try_multiply(F.try_add(elements, p), g), pixel_bytes(bitpix))
    bad = (p < 0) | (g < 0) | F.coalesce(F.exists(used, lambda n: n.isNull() | (n < 0)), F.lit(False))
    return F.when(bad, F.lit(-1).cast("long")).otherwise(F.coalesce(total, F.lit(-1).cast("long")))


def padded(offset: Column) -> Column:
    """The next multiple of a block."""
    return F.when(offset <= 0, F.lit(0)).otherwise(F.ceil(offset / BLOCK) * BLOCK).cast("long")


def role(terms: list[Column], filename: Column) -> Column:
    """Role of a header unit by the exact terms of its header, then by tokens of its file name."""
    exact = F.array_compact(F.array(*[F.trim(F.upper(F.replace(t, F.lit("'"), F.lit("")))) for t in terms]))
    tokens = F.split(F.upper(F.coalesce(filename, F.lit(""))), r"[^\p{L}\p{N}]+")
    out = None
    for name, words in ROLE_TERMS.items():
        hit = F.arrays_overlap(exact, F.array(*map(F.lit, words))) | F.arrays_overlap(tokens, F.array(*map(F.lit, ROLE_FILE_TOKENS[name])))
        hit = F.coalesce(hit, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def wcs(h: dict[str, Column]) -> Column:
    """struct of the linear sky transform from header columns (by keyword): CD matrix, else CDELT with PC."""
    get = lambda k: h.get(k, F.lit(None)).cast("double")
    full = F.lit(True)
    for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2"):
        full = full & get(k).isNotNull()
    step = {"1": get("CDELT1"), "2": get("CDELT2")}
    stepped = step["1"].isNotNull() & step["2"].isNotNull()
    cells = []
    for i in "12":
        for j in "12":
            turn = F.coalesce(get(f"PC{i}_{j}"), F.lit(1.0 if i == j else 0.0))
            cells.append(F.when(full, get(f"CD{i}_{j}")).otherwise(step[i] * turn).alias(f"cd{i}_{j}"))
    base = [get(k).alias(k.lower()) for k in ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2")]
    text = [F.coalesce(h.get(k, F.lit(None)).cast("string"), F.lit(d)).alias(k.lower()) for k, d in (("CTYPE1", "RA---TAN"), ("CTYPE2", "DEC--TAN"))]
    ok = (full | stepped) & get("CRPIX1").isNotNull() & get("CRPIX2").isNotNull() & get("CRVAL1").isNotNull() & get("CRVAL2").isNotNull()
    return F.when(ok, F.struct(*base, *cells, *text))


def to_world(w: Column, x: Column, y: Column) -> Column:
    """struct(ra, dec) of a pixel counted from 0."""
    dx, dy = x + 1 - w["crpix1"], y + 1 - w["crpix2"]
    return F.struct((w["crval1"] + w["cd1_1"] * dx + w["cd1_2"] * dy).alias("ra"), (w["crval2"] + w["cd2_1"] * dx + w["cd2_2"] * dy).alias("dec"))


def to_pixel(w: Column, ra: Column, dec: Column) -> Column:
    """struct(x, y) counted from 0; null for a singular matrix."""
    det = w["cd1_1"] * w["cd2_2"] - w["cd1_2"] * w["cd2_1"]
    a, d = ra - w["crval1"], dec - w["crval2"]
    x = (w["cd2_2"] * a - w["cd1_2"] * d) / det + w["crpix1"] - 1
    y = (w["cd1_1"] * d - w["cd2_1"] * a) / det + w["crpix2"] - 1
    return F.when(F.abs(det) > 2.220446049250313e-16, F.struct(x.alias("x"), y.alias("y")))


def pixel_scale(w: Column) -> Column:
    """struct(x, y) of degrees a pixel."""
    return F.struct(F.hypot(w["cd1_1"], w["cd2_1"]).alias("x"), F.hypot(w["cd1_2"], w["cd2_2"]).alias("y"))


def corners(w: Column, width: Column, height: Column) -> Column:
    """The four corners' positions, counter-clockwise from pixel (0, 0)."""
    zero, right, top = F.lit(0.0), width.cast("double") - 1, height.cast("double") - 1
    return F.when((width > 0) & (height > 0), F.array(*[to_world(w, x, y) for x, y in ((zero, zero), (right, zero), (right, top), (zero, top))]))


def same_wcs(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    close = F.lit(True)
    for k in ("crpix1", "crpix2", "crval1", "crval2", "cd1_1", "cd1_2", "cd2_1", "cd2_2"):
        close = close & (F.abs(a[k] - b[k]) <= tolerance)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(close)
