"""FITS files as tables: header units, header values and image planes.

``spark.read.format("skyquarry_fits")`` (after :func:`register`) reads one row per header unit; files share a
partition up to a number of files, data segments are skipped by seeking. Paths may be of any file system
that pyarrow opens, so every executor reads from the shared storage. Pixels are decoded by :func:`planes`,
images of a product by :func:`science_products`, tables by :func:`read_table`.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyquarry.functions import fitsvalues, headers

BLOCK, CARD = 2880, 80
#: Sample types by BITPIX.
PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
HDU_SCHEMA = (
    "path string, ext_index int, header_start long, data_start long, data_size long, naxis int, dims array<long>, bitpix int, extname string, "
    "is_image boolean, complete boolean, cards array<struct<keyword:string,value:string,comment:string>>"
)


@dataclass
class Card:
    keyword: str
    value: str
    comment: str = ""


def card(line: str) -> Card | None:
    """One 80-byte card; a slash inside quotes is no comment. None for the END card."""
    keyword = line[:8].rstrip()
    if keyword == "END":
        return None
    if keyword in ("COMMENT", "HISTORY", "") or line[8:10] != "= ":
        return Card(keyword, line[8:].strip())
    quoted, at = False, 10
    while at < len(line) and (quoted or line[at] != "/"):
        quoted ^= line[at] == "'"
        at += 1
    return Card(keyword, line[10:at].strip(), line[at + 1 :].strip())


def block_cards(data: bytes) -> tuple[list[Card], int] | None:
    """Cards of the header at the start of ``data`` and its padded length; None if it is no whole header."""
    out = []
    if data[:8].rstrip() not in (b"SIMPLE", b"XTENSION"):
        return None
    for at in range(0, len(data) - CARD + 1, CARD):
        found = card(data[at : at + CARD].decode("ascii", "replace"))
        if found is None:
            return out, -(-(at + CARD) // BLOCK) * BLOCK
        out.append(found)
    return None


def first(cards: list[Card], keyword: str) -> str | None:
    return next((c.value for c in cards if c.keyword == keyword), None)


def integer(cards: list[Card], keyword: str) -> int | None:
    try:
        return int((first(cards, keyword) or "").strip("' "))
    except ValueError:
        return None


def number(cards: list[Card], keyword: str) -> float | None:
    try:
        return float((first(cards, keyword) or "").strip("' "))
    except ValueError:
        return None


def string(cards: list[Card], keyword: str) -> str | None:
    value = first(cards, keyword)
    return value.replace("'", "").strip() if value is not None else None


def data_bytes(cards: list[Card]) -> int:
    """Length of the data segment, -1 if the header is invalid or the length leaves 64 bits."""
    axes, bitpix = integer(cards, "NAXIS") or 0, integer(cards, "BITPIX")
    p, g = integer(cards, "PCOUNT") or 0, integer(cards, "GCOUNT")
    g = 1 if g is None else g
    if bitpix not in PIXELS or min(axes, p, g) < 0:
        return -1
    elements = 1 if axes else 0
    for k in range(2 if (first(cards, "GROUPS") or "").strip() == "T" else 1, axes + 1):
        n = integer(cards, f"NAXIS{k}")
        if n is None or n < 0:
            return -1
        elements *= n
    size = abs(bitpix) // 8 * g * (p + elements)
    return size if size < 1 << 63 else -1


@dataclass
class Unit:
    index: int
    header_start: int
    data_start: int
    data_size: int
    cards: list[Card]
    complete: bool

    @property
    def dims(self) -> list[int]:
        return [integer(self.cards, f"NAXIS{k}") or 0 for k in range(1, (integer(self.cards, "NAXIS") or 0) + 1)]

    @property
    def is_image(self) -> bool:
        table = (string(self.cards, "XTENSION") or "").upper() in ("BINTABLE", "TABLE")
        return not table and len(self.dims) >= 2 and all(n > 0 for n in self.dims) and self.data_size > 0


def units(file, size: int, most: int | None = None, stop_at_image: bool = False, most_bytes: int | None = None) -> Iterator[Unit]:
    """Header units of an open file, all or the first ``most`` (of ``most_bytes``), read block by block; data segments are skipped."""
    start, index, used = 0, 0, 0
    while start < size and (most is None or index < most) and (most_bytes is None or used < most_bytes):
        file.seek(start)
        data, found = b"", None
        while found is None:
            block = file.read(BLOCK)
            data += block
            if len(block) < BLOCK and not block_cards(data) or data[:8].rstrip() not in (b"SIMPLE", b"XTENSION"):
                return
            found = block_cards(data)
        cards, length = found
        used += length
        amount = data_bytes(cards)
        unit = Unit(index, start, start + length, amount, cards, amount >= 0 and start + length + amount <= size)
        yield unit
        if amount < 0 or stop_at_image and unit.is_image:
            return
        start += length + -(-amount // BLOCK) * BLOCK
        index += 1


def preferred(found: list[Unit]) -> Unit | None:
    """The first image named science, else the first image."""
    images = [u for u in found if u.is_image]
    return next((u for u in images if (string(u.cards, "EXTNAME") or "").upper() in ("SCI", "SCIENCE")), images[0] if images else None)


def pixels(unit: Unit, data: bytes) -> tuple[np.ndarray, int]:
    """Physical values as float32 (BSCALE, BZERO applied) and how many are invalid (BLANK, NaN, infinite)."""
    bitpix = integer(unit.cards, "BITPIX")
    raw = np.frombuffer(data, PIXELS[bitpix])
    scale, zero, blank = number(unit.cards, "BSCALE"), number(unit.cards, "BZERO"), integer(unit.cards, "BLANK")
    values = raw.astype(np.float64)
    values = values * (1.0 if scale is None else scale) + (0.0 if zero is None else zero)
    if bitpix > 0 and blank is not None:
        values[raw == blank] = np.nan
    return values.astype(np.float32), int((~np.isfinite(values)).sum())


def row(path: str, unit: Unit) -> tuple:
    return (
        path, unit.index, unit.header_start, unit.data_start, unit.data_size, integer(unit.cards, "NAXIS"), unit.dims, integer(unit.cards, "BITPIX"),
        string(unit.cards, "EXTNAME"), unit.is_image, unit.complete, [(c.keyword, c.value, c.comment) for c in unit.cards],
    )


class FilePartition(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _file_system(path: str):
    """File system and path in it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str, suffixes: tuple[str, ...] = (".fits", ".fit", ".fits.gz")) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, at any depth, or of those that a pattern names; empty files are left out."""
    from pyarrow import fs

    system, inner = _file_system(path)
    if any(c in inner for c in "*?["):
        folder = inner[: min(inner.index(c) for c in "*?[" if c in inner)].rsplit("/", 1)[0] or "/"
        found = [f for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if fnmatch.fnmatch(f.path, inner)]
    else:
        info = system.get_file_info(inner)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found = found if info.type != fs.FileType.Directory else [f for f in found if f.path.lower().endswith(suffixes)]
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size)


class FitsReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options["maxHeaders"]) if "maxHeaders" in options else None
        self.stop = options.get("stopAtImage", "false").lower() == "true"
        self.bytes = int(options["maxBytes"]) if "maxBytes" in options else None
        self.files = max(1, int(options.get("filesPerTask", "32")))

    def partitions(self):
        found = list_files(self.path)
        return [FilePartition(found[i : i + self.files]) for i in range(0, len(found), self.files)]

    def read(self, partition):
        for path, size in partition.files if partition is not None else ():
            system, inner = _file_system(path)
            with system.open_input_file(inner) as file:
                for unit in units(file, size, self.most, self.stop, self.bytes):
                    yield row(path, unit)


class FitsSource(DataSource):
    """Options: path (file, pattern or folder), maxHeaders and maxBytes of headers a file (default: all), stopAtImage, filesPerTask."""

    @classmethod
    def name(cls):
        return "skyquarry_fits"

    def schema(self):
        return HDU_SCHEMA

    def reader(self, schema):
        return FitsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def read_headers(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row per header unit of the files, all of them unless ``maxHeaders`` is given; truncated and foreign files give the units that can be read."""
    register(spark)
    return spark.read.format("skyquarry_fits").options(**options).load(path)


def merged(primary: list[Card], own: list[Card]) -> list[Card]:
    """An extension's cards over those of the primary header: its own values at the first place of a keyword.

    Of repeated keywords the primary's first and the extension's last count; comments of both come last.
    """
    many = ("COMMENT", "HISTORY", "")
    out: dict[str, Card] = {}
    for c in primary:
        if c.keyword not in many:
            out.setdefault(c.keyword, c)
    for c in own:
        if c.keyword not in many:
            out[c.keyword] = c
    return [*out.values(), *(c for c in [*primary, *own] if c.keyword in many)]


#: Header keywords whose terms tell the role of a unit.
ROLE_KEYWORDS = ("EXTNAME", "BTYPE", "IMAGETYP", "HDUCLAS1", "HDUCLAS2")
_CARDS = "array<struct<keyword:string,value:string,comment:string>>"


def with_role_and_wcs(df: DataFrame, file: str = "path") -> DataFrame:
    """Rows with ``cards``, and their role and linear sky transform (``wcs``, null without one) beside them."""
    header = headers.first_wins(F.col("cards"))
    df = df.withColumn("_h", header)
    get = lambda k: F.trim(F.replace(F.try_element_at("_h", F.lit(k)), F.lit("'"), F.lit("")))
    name = F.element_at(F.split(file, "/"), -1)
    columns = {k: get(k).try_cast("double") for k in ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CDELT1", "CDELT2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "PC1_1", "PC1_2", "PC2_1", "PC2_2")}
    columns |= {k: get(k) for k in ("CTYPE1", "CTYPE2")}
    return df.withColumns({"role": fitsvalues.role([get(k) for k in ROLE_KEYWORDS], name), "wcs": fitsvalues.wcs(columns)}).drop("_h")


def planes(files: DataFrame) -> DataFrame:
    """Image planes with pixels, role and sky transform of (path, content) rows, as ``binaryFile`` gives them.

    ``cards`` is the plane's header over that of the file. Incomplete units are left out.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                primary: list[Card] = []
                for u in units(io.BytesIO(content), len(content)):
                    primary = primary or u.cards
                    if u.is_image and u.complete:  # a frame a plane, as a file may hold any number
                        values, invalid = pixels(u, content[u.data_start : u.data_start + u.data_size])
                        cards = [(c.keyword, c.value, c.comment) for c in (merged(primary, u.cards) if u.index else u.cards)]
                        yield pd.DataFrame([(path, u.index, string(u.cards, "EXTNAME"), u.dims, values.tolist(), invalid, cards)], columns=["path", "ext_index", "extname", "dims", "pixels", "n_invalid", "cards"])

    found = files.select("path", "content").mapInPandas(decode, f"path string, ext_index int, extname string, dims array<long>, pixels array<float>, n_invalid long, cards {_CARDS}")
    return with_role_and_wcs(found)


def science_products(files: DataFrame) -> DataFrame:
    """(path, name, ext_index, dims, cards, role, wcs): one row for each image unit of (path, content) rows.

    Images are the primary unit and extensions of kind IMAGE. The name is the file's with ``primary``, the
    extension's name or its place. A file without an image gives one row of its primary header, with no unit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content):
                base = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                primary: list[Card] | None = None
                before = len(rows)
                for u in units(io.BytesIO(content), len(content)):
                    primary = u.cards if primary is None else primary
                    kind = (string(u.cards, "XTENSION") or "").upper()
                    if u.is_image and u.complete and (u.index == 0 or kind == "IMAGE"):
                        suffix = "primary" if u.index == 0 else string(u.cards, "EXTNAME") or f"ext{u.index - 1}"
                        rows.append((path, f"{base}_{suffix}", u.index, u.dims, [(c.keyword, c.value, c.comment) for c in (merged(primary, u.cards) if u.index else u.cards)]))
                if len(rows) == before and primary is not None:
                    rows.append((path, base, None, [], [(c.keyword, c.value, c.comment) for c in primary]))
            yield pd.DataFrame(rows, columns=["path", "name", "ext_index", "dims", "cards"]).astype({"ext_index": "Int32"})

    found = files.select("path", "content").mapInPandas(run, f"path string, name string, ext_index int, dims array<long>, cards {_CARDS}")
    return with_role_and_wcs(found)


#: Letters of binary table formats with their sample types, and the column types they become.
TABLE_TYPES = {"L": ("S1", "boolean"), "B": (">u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}
ASCII_TYPES = {"A": "string", "I": "bigint", "F": "double", "E": "double", "D": "double"}


@dataclass
class Column_:
    """A column of a FITS table: its name, format letter, repeats (or characters), place in the row and Spark type."""

    name: str
    letter: str
    repeat: int
    at: int
    width: int
    kind: str
    scale: float
    zero: float
    null: int | None


def table_columns(cards: list[Card]) -> list[Column_]:
    """Columns of a binary or ASCII table unit, in order; names are made unique, formats that are no values are left out."""
    ascii_ = (string(cards, "XTENSION") or "").upper() == "TABLE"
    out, at, seen = [], 0, set()
    for k in range(1, (integer(cards, "TFIELDS") or 0) + 1):
        form = (string(cards, f"TFORM{k}") or "").upper()
        name = string(cards, f"TTYPE{k}") or f"col{k}"
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        scale, zero, null = number(cards, f"TSCAL{k}"), number(cards, f"TZERO{k}"), integer(cards, f"TNULL{k}")
        scaled = (scale is not None and scale != 1) or bool(zero)
        if ascii_:
            m = re.match(r"([AIFED])(\d+)", form)
            if m:
                kind = "double" if scaled and m[1] == "I" else ASCII_TYPES[m[1]]
                out.append(Column_(name, m[1], 1, (integer(cards, f"TBCOL{k}") or 1) - 1, int(m[2]), kind, 1.0 if scale is None else scale, zero or 0.0, null))
            continue
        m = re.match(r"(\d*)([LXBIJKAEDCMPQ])", form)
        if not m:
            break
        repeat, letter = int(m[1] or 1), m[2]
        width = -(-repeat // 8) if letter == "X" else repeat * {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "A": 1, "C": 8, "M": 16, "P": 8, "Q": 16}[letter]
        if letter in TABLE_TYPES and repeat:
            kind = "double" if scaled and letter in "BIJKE" else TABLE_TYPES[letter][1]
            out.append(Column_(name, letter, repeat, at, width, kind if letter == "A" or repeat == 1 else f"array<{kind}>", 1.0 if scale is None else scale, zero or 0.0, null))
        at += width
    return out


def table_rows(unit: Unit, data: bytes) -> Iterator[tuple]:
    """Rows of a table unit in the order of :func:`table_columns`; undefined values are None."""
    columns = table_columns(unit.cards)
    ascii_ = (string(unit.cards, "XTENSION") or "").upper() == "TABLE"
    length, count = integer(unit.cards, "NAXIS1") or 0, integer(unit.cards, "NAXIS2") or 0
    for r in range(count):
        line = data[r * length : (r + 1) * length]
        yield tuple(_ascii_value(c, line[c.at : c.at + c.width]) if ascii_ else _binary_value(c, line[c.at : c.at + c.width]) for c in columns)


def _ascii_value(c: Column_, raw: bytes):
    text = raw.decode("ascii", "replace").strip()
    if c.letter == "A":
        return text
    try:
        value = int(text) if c.letter == "I" else float(text.upper().replace("D", "E"))
    except ValueError:
        return None
    if c.null is not None and value == c.null:
        return None
    return value * c.scale + c.zero if c.kind == "double" else value


def _binary_value(c: Column_, raw: bytes):
    if c.letter == "A":
        return raw.split(b"\0")[0].decode("ascii", "replace").rstrip()
    if c.letter == "L":
        values = [{84: True, 70: False}.get(b) for b in raw]
    else:
        values = [None if c.null is not None and x == c.null else x * c.scale + c.zero if c.kind.endswith(("double", "double>")) and (c.scale != 1 or c.zero) else x for x in np.frombuffer(raw, TABLE_TYPES[c.letter][0]).tolist()]
    return values[0] if c.repeat == 1 else values


def read_table(spark: SparkSession, path: str, ext_index: int, files_per_task: int = 8) -> DataFrame:
    """Rows of the table in header unit ``ext_index`` of each file, with the file as ``path``.

    Binary and ASCII tables. The columns are those of the first file that has the table; a file whose table lacks
    one gives nulls there. Repeated elements become arrays, scaled numbers doubles. Columns of bits, complex numbers
    and arrays of variable length are left out. Only its header is read on the driver.
    """
    files = list_files(path)
    schema = None
    for name, size in files:
        if (unit := _unit_of(name, size, ext_index)) is not None:
            schema = [(c.name, c.kind) for c in table_columns(unit.cards)]
            break
    if not schema:
        return spark.createDataFrame([], "path string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, size in zip(pdf.path, pdf["size"]):
                if (unit := _unit_of(name, size, ext_index)) is None or not unit.complete:
                    continue
                system, inner = _file_system(name)
                own = [c.name for c in table_columns(unit.cards)]
                with system.open_input_file(inner) as file:
                    file.seek(unit.data_start)
                    rows = table_rows(unit, file.read(unit.data_size))
                    while block := list(itertools.islice(rows, 10_000)):
                        columns = dict(zip(own, zip(*block)))
                        yield pd.DataFrame({"path": name, **{c: pd.Series(list(columns.get(c, [None] * len(block))), dtype=object) for c, _ in schema}})

    listed = spark.createDataFrame(files, "path string, size long").repartition(max(1, -(-len(files) // files_per_task)))
    return listed.mapInPandas(read, "path string, " + ", ".join(f"`{c}` {t}" for c, t in schema))


def _unit_of(path: str, size: int, index: int) -> Unit | None:
    system, inner = _file_system(path)
    with system.open_input_file(inner) as file:
        return next((u for u in units(file, size) if u.index == index and (string(u.cards, "XTENSION") or "").upper() in ("BINTABLE", "TABLE")), None)
