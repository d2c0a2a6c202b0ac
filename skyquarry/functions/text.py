"""Text functions of catalogues and products as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display colours by pivot; upper limits are exclusive, the last has none.
JWST_COLOURS = [(1.2, "Blue"), (2.0, "Cyan"), (3.0, "Green"), (5.0, "Yellow"), (10.0, "Orange"), (18.0, "Red"), (None, "Deep Red / Far-IR")]
HST_COLOURS = [(3200, "Ultraviolet"), (4500, "Blue"), (5000, "Cyan"), (5700, "Green"), (6200, "Yellow"), (7000, "Red"), (None, "Deep Red / Near-IR")]
HST_REGIMES = [(3200, "Ultraviolet"), (4000, "Near-Ultraviolet / Violet"), (5000, "Blue"), (5900, "Green / Visual"), (7000, "Red"), (None, "Near-Infrared")]
JWST_HEX = {"Blue": "#3B82F6", "Cyan": "#22D3EE", "Green": "#22C55E", "Yellow": "#FACC15", "Orange": "#FB923C", "Red": "#EF4444", "Deep Red / Far-IR": "#B91C1C"}


def colour_code(colour: Column) -> Column:
    """Hex code of a display colour; the bluest and reddest share those of their neighbours."""
    known = {**JWST_HEX, "Deep Red / Near-IR": JWST_HEX["Deep Red / Far-IR"]}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), colour)


def stepped(value: Column, steps: list[tuple[float | None, str]]) -> Column:
    """Name of the first step whose limit lies above the value."""
    out = None
    for limit, name in steps:
        if limit is None:
            return F.when(value.isNotNull(), out.otherwise(F.lit(name)))
        out = F.when(value < limit, name) if out is None else out.when(value < limit, name)
    return out


def path_part(value: Column, fallback: str) -> Column:
    """A text as part of a storage path: letters, digits, ``-_.``; the fallback if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(value), r"[^\p{L}\p{N}\p{M}._-]", "_"), "__+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def product_locator(value: Column) -> Column:
    """A product's address for comparison: entities and valid percent escapes decoded, lower case."""
    plain = F.replace(value, F.lit("&amp;"), F.lit("&"))
    return F.lower(F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain))


def secure_url(value: Column, service: str) -> Column:
    """Address to load a product from: web addresses over https, others by the service with an escaped uri."""
    web = F.replace(F.replace(value, F.lit("&amp;"), F.lit("&")), F.lit("http://"), F.lit("https://"))
    return F.when(F.lower(value).startswith("http"), web).otherwise(F.concat(F.lit(service + "?uri="), F.url_encode(value)))


def byte_text(size: Column) -> Column:
    """Human-readable size in decimal units."""
    out = F.when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
    for name, unit in (("KB", 1e3), ("MB", 1e6), ("GB", 1e9)):
        out = out.when(size < unit * 1000, F.concat(F.format_number(size / unit, 1), F.lit(" " + name)))
    return out.otherwise(F.concat(F.format_number(size / 1e12, 1), F.lit(" TB")))


def split_filters(filters: Column, upper: bool = True) -> Column:
    """Non-empty components of a ``;`` list."""
    parts = F.transform(F.split(filters, ";"), lambda x: F.upper(F.trim(x)) if upper else F.trim(x))
    return F.filter(parts, lambda x: x != "")


def matches_bands(filters: Column, bands: list[str]) -> Column:
    """Whether any component (by ``;`` or ``,``) is one of the bands, in any case; true for no bands."""
    wanted = sorted({b.strip().upper() for b in bands if b.strip()})
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.exists(F.split(F.upper(filters), "[;,]"), lambda x: F.trim(x).isin(wanted)), F.lit(False))


def needs_header(address: Column) -> Column:
    """Whether a product's address promises FITS metadata. The scheme is a fixed value of the archive's locators."""
    low = F.lower(address)
    return low.startswith("mast:") | low.contains(".fits") | low.contains(".fit")


def replace_first(value: Column, old: str, new: str) -> Column:
    """The first place of a literal text replaced."""
    at = F.instr(value, old)
    return F.when(at > 0, F.concat(F.substring(value, 1, at - 1), F.lit(new), F.substring(value, at + len(old), F.length(value)))).otherwise(value)


def replace_all(value: Column, pattern: str, new: str) -> Column:
    """Every match of a pattern replaced."""
    return F.regexp_replace(value, pattern, new)


def redacted(value: Column) -> Column:
    """Header values that hold a token or bearer credential are hidden."""
    low = F.lower(value)
    return F.when(low.contains("token") | low.contains("bearer"), F.lit("<redacted>")).otherwise(value)


def content_size(content_range: Column, content_length: Column) -> Column:
    """Size of a file from the total of its Content-Range, else its Content-Length; null for neither."""
    total = F.element_at(F.split(content_range, "/"), -1).try_cast("long")
    return F.coalesce(total, content_length.try_cast("long"))


def filter_text(names: Column) -> Column:
    """A list of filters as one text."""
    return F.array_join(names, ";")


def is_fits_name(name: Column) -> Column:
    """Whether a file's name is that of a FITS file, plain or compressed."""
    low = F.lower(name)
    return low.endswith(".fits") | low.endswith(".fits.gz")
