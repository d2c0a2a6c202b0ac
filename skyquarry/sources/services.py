"""The archive's services as scans over registered tables: a request names a service and its parameters.

A service belongs to a family that says what it does; ``TABLES`` says which table it reads. Tables that a
user holds under other names, or catalogues of their own, are given with the request.
"""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.operators import crossmatch
from skyquarry.plans import filters, search
from skyquarry.session import table

#: The ids of all services by family.
FAMILIES = {
    "filtered": [
        "Mast.Catalogs.Filtered.Tic", "Mast.Catalogs.Filtered.Tic.Rows", "Mast.Catalogs.Filtered.Ctl", "Mast.Catalogs.Filtered.Ctl.Rows",
        "Mast.Catalogs.Filtered.Wfc3Psf.Uvis", "Mast.Catalogs.Filtered.Wfc3Psf.Ir", "Mast.Catalogs.Filtered.DiskDetective", "Mast.Caom.Filtered",
        "Mast.Jwst.Filtered.Nircam", "Mast.Jwst.Filtered.Niriss", "Mast.Jwst.Filtered.Nirspec", "Mast.Jwst.Filtered.Miri", "Mast.Jwst.Filtered.Fgs",
        "Mast.Jwst.Filtered.GuideStar", "Mast.Jwst.Filtered.Wss",
    ],
    "position": [
        "Mast.Catalogs.Filtered.Tic.Position", "Mast.Catalogs.Filtered.Tic.Position.Rows", "Mast.Catalogs.Filtered.Ctl.Position",
        "Mast.Catalogs.Filtered.Ctl.Position.Rows", "Mast.Catalogs.Filtered.DiskDetective.Position", "Mast.Caom.Filtered.Position",
    ],
    "count": ["Mast.Catalogs.Filtered.DiskDetective.Count", "Mast.Catalogs.Filtered.DiskDetective.Position.Count"],
    "cone": [
        "Mast.Catalogs.Tic.Cone", "Mast.Catalogs.Ctl.Cone", "Mast.Catalogs.DiskDetective.Cone", "Mast.Catalogs.GaiaDR1.Cone", "Mast.Catalogs.GaiaDR2.Cone",
        "Mast.Catalogs.GaiaDR3.Cone", "Mast.Catalogs.Tgas.Cone", "Mast.Caom.Cone", "Mast.Hsc.Db.v2", "Mast.Hsc.Db.v3", "Mast.Galex.Catalog", "Vo.Hesarc.DatascopeListable",
    ],
    "crossmatch": [
        "Mast.Tic.Crossmatch", "Mast.Ctl.Crossmatch", "Mast.Caom.Crossmatch", "Mast.GaiaDR1.Crossmatch", "Mast.GaiaDR2.Crossmatch", "Mast.GaiaDR3.Crossmatch",
        "Mast.Tgas.Crossmatch", "Mast.Galex.Crossmatch", "Mast.Sdss.Crossmatch", "Mast.2Mass.Crossmatch", "Mast.Hsc.Crossmatch.MagAper2v3", "Mast.Hsc.Crossmatch.MagAutov3",
    ],
    "keyed": [
        "Mast.Caom.Products", "Mast.HscMatches.Db.v2", "Mast.HscMatches.Db.v3", "Mast.HscSpectra.Db.All", "Mast.Name.Lookup", "Mast.Missions.List", "Vo.Generic.Table",
    ],
    "download": ["Download/bundle", "Download/file"],
}
FAMILY = {service: family for family, services in FAMILIES.items() for service in services}
#: Tables of a data directory that services read if the request names no other.
TABLES = {"Mast.Caom.Products": "caom_products", "Mast.Name.Lookup": "name_lookup"}
#: Key, and the default that a request has where it says nothing.
KEYS = {"Mast.Caom.Products": "obsid", "Mast.HscMatches.Db.v2": "match_id", "Mast.HscMatches.Db.v3": "match_id"}
DEFAULTS = {"format": "json", "page": 1, "pagesize": 200, "timeout": 600, "removenullcolumns": True}


def service_id(name: str) -> str:
    """Id of a service written with underscores."""
    return name.replace("_", "/" if name.startswith("Download") else ".")


def registry(spark: SparkSession) -> DataFrame:
    """(service, family) of all services."""
    return spark.createDataFrame(sorted(FAMILY.items()), "service string, family string")


def source_of(spark: SparkSession, sf_dir: str, service: str) -> DataFrame:
    """The table that a service reads; observations delivered twice count once."""
    name = TABLES.get(service)
    if name is None and service.split(".")[1] in ("Caom", "Missions"):
        name = "caom_obs"
    if name is None:
        raise ValueError(f"no table is registered for {service}; give one")
    return table(spark, sf_dir, name)


def run(source: DataFrame, service: str, params: dict | None = None, *, position: tuple[str, str] = ("s_ra", "s_dec"), page: int | None = None, rows: int = search.PAGE_ROWS, order: str = "obsid") -> DataFrame:
    """Rows of a service over its table.

    ``params``: ``filters`` (a list of :class:`filters.Filter`), ``ra``, ``dec``, ``radius``, ``columns``,
    ``targets`` with ``target`` (key, ra, dec) for a crossmatch, ``key`` values for a keyed scan, ``input`` for a
    name. ``page`` sorts by ``order``; without it all rows come out. Downloads have no rows.
    """
    params = params or {}
    family = FAMILY.get(service)
    if family is None or family == "download":
        raise ValueError(f"{service} gives no rows")
    ra, dec = position
    found = source.where(filters.together(list(params.get("filters", []))))
    if family == "crossmatch":
        return crossmatch.crossmatch(params["targets"], params["target"], found, (order, ra, dec), params.get("radius", search.DEFAULT_RADIUS))
    if family in ("cone", "position", "count") and "ra" in params:
        found = search.cone(found, params["ra"], params["dec"], params.get("radius", search.DEFAULT_RADIUS), ra, dec)
    if family == "count":
        return found.agg(F.count("*").alias("n"))
    if service == "Mast.Missions.List":
        return found.where("obs_collection is not null").select("obs_collection").distinct()
    if service == "Mast.Name.Lookup":
        return search.resolve(found, params["input"])
    if service in KEYS:
        found = found.where(F.col(KEYS[service]).isin(list(params["key"])))
    if params.get("columns", "*") != "*":
        found = found.select(*[c.strip() for c in params["columns"].split(",")])
    return found if page is None else search.page(found, [F.col(order)], page, rows)


def request(service: str, **params) -> str:
    """The JSON text of a request: the service, its parameters and the general ones."""
    general = {k: params.pop(k, v) for k, v in DEFAULTS.items()}
    if listed := params.pop("filters", None):
        params["filters"] = [{"paramName": f.column, "values": list(f.values), **({"separator": f.separator} if f.separator else {}), **({"freeText": f.like} if f.like else {})} for f in listed]
    return json.dumps({"service": service, "params": params, **general}, sort_keys=True)


def request_url(base: str, text: str) -> str:
    return f"{base}?request={quote(text, safe='')}"


def cone_url(base: str, ra: float, dec: float, radius: float = search.DEFAULT_RADIUS, most: int = 20) -> str:
    """The classic keyword form of a cone request."""
    return f"{base}?RA={ra}&DEC={dec}&SR={radius}&max_records={most}&outputformat=JSON"


def image_list_url(base: str, ra: float, dec: float, size: int = 8000, kinds: tuple[str, ...] = ("stack",)) -> str:
    """Request for the list of images that cover a position; kinds such as ``stack_wt`` are written with points."""
    return f"{base}?ra={ra}&dec={dec}&size={size}&type={','.join(k.replace('_', '.') for k in kinds)}"


def colour_image_url(base: str, ra: float, dec: float, names: list[str], size: int = 8000, kind: str = "jpg", output: int | None = None) -> str:
    """Address of a colour image of three files, in the order red, green, blue."""
    channels = "".join(f"&{c}={n}" for c, n in zip(("red", "green", "blue"), names))
    return f"{base}?size={size}&format={kind}&ra={ra}&dec={dec}{channels}" + (f"&output_size={output}" if output else "")
