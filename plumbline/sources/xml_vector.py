"""Vector formats in XML, read by row tags and written a document a task: KML, KMZ, GPX, GML and LandXML.

Readers give Spark's XML source the tag of one feature: a file is streamed by one task, which holds a feature at a time.
Writers make a document for each task, so what they wrote is read by as many tasks. Text loses spaces at its ends, as XML
readers trim it, and characters that XML doesn't know are not written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from plumbline.functions import crs
from plumbline.functions import geometry as g
from plumbline.operators.table import Refused
from plumbline.sources import splittable
from plumbline.sources.binary_vector import expand_archives
from plumbline.storage import shared_path

_PARTS = "array<array<array<array<double>>>>"


# What all have in common.


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)


def escaped(c: Column) -> Column:
    """Text as XML may hold it, in elements and in attributes; null becomes empty."""
    out = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _element(name: str, c: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), c, F.lit(f"</{name}>"))


def _optional(name: str, c: Column) -> Column:
    return F.when(c.isNotNull(), _element(name, escaped(c))).otherwise(F.lit(""))


def _write_documents(values: DataFrame, path: str, head: str, foot: str) -> None:
    """The rows of ``value`` as text, a whole document for each task that has rows."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for b in batches:
            if b.num_rows:
                yield b if started else pa.RecordBatch.from_pydict({"value": [head, *b.column(0).to_pylist()]})
                started = True
        if started:
            yield pa.RecordBatch.from_pydict({"value": [foot]})

    values.mapInArrow(framed, "value string").write.text(path)


def _numbers(text: Column, separator: str = r"\s+") -> Column:
    return F.transform(F.filter(F.split(F.trim(text), separator), lambda t: F.length(t) > 0), lambda t: t.try_cast("double"))


def _tuples(text: Column) -> Column:
    """Positions from ``x,y[,z] x,y[,z] ...``; those without two numbers are left out."""
    each = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: F.length(t) > 0), lambda t: F.transform(F.split(t, ","), lambda v: v.try_cast("double")))
    return F.filter(each, lambda p: F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())


def _joined(path: Column, inner: str, outer: str = " ", order: Callable[[Column], Column] = lambda p: p) -> Column:
    return F.array_join(F.transform(path, lambda p: F.array_join(F.transform(order(p), lambda v: v.cast("string")), inner)), outer)


def _single_or_multi(kind: str, parts: Column) -> Column:
    """A geometry of a list of components of one kind; null where there are none."""
    return F.when(F.size(parts) > 0, g.geometry(F.when(F.size(parts) > 1, f"Multi{kind}").otherwise(kind), parts))


def _listed(c: Column, of: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{of}>"))


# KML and KMZ.

_RING = "struct<LinearRing:struct<coordinates:string>>"
_SHAPES = {
    "Point": "struct<coordinates:string>", "LineString": "struct<coordinates:string>",
    "Polygon": f"struct<outerBoundaryIs:{_RING},innerBoundaryIs:array<{_RING}>>",
}
_DATA = "struct<_name:string,value:string>"
_SIMPLE = "struct<_name:string,_VALUE:string>"
_PLACEMARK_FIELDS = {
    "_id": "string", "name": "string", "description": "string", "styleUrl": "string", **{k: f"array<{v}>" for k, v in _SHAPES.items()},
    "MultiGeometry": f"struct<{','.join(f'{k}:array<{v}>' for k, v in _SHAPES.items())}>",
    "ExtendedData": f"struct<Data:array<{_DATA}>,SchemaData:struct<SimpleData:array<{_SIMPLE}>>>",
}
_PLACEMARK = f"struct<{','.join(f'{k}:{v}' for k, v in _PLACEMARK_FIELDS.items())}>"


def _kml_parts(kind: str, shapes: Column) -> Column:
    """Components of KML elements of one kind."""
    if kind == "Polygon":
        return F.transform(shapes, lambda s: F.concat(
            F.array(_tuples(s["outerBoundaryIs"]["LinearRing"]["coordinates"])),
            F.transform(_listed(s["innerBoundaryIs"], _RING), lambda b: _tuples(b["LinearRing"]["coordinates"])),
        ))
    real = F.filter(F.transform(shapes, lambda s: _tuples(s["coordinates"])), lambda p: F.size(p) > 0)
    return F.transform(real, lambda p: F.array(p))


def _placemarks(rows: DataFrame, p: Column, *more: Column) -> DataFrame:
    shapes = []
    for kind, of in _SHAPES.items():
        both = F.concat(_listed(p[kind], of), _listed(p["MultiGeometry"][kind], of))
        shapes.append(_single_or_multi(kind, _kml_parts(kind, both)))
    data = F.transform(_listed(p["ExtendedData"]["Data"], _DATA), lambda d: F.struct(d["_name"].alias("key"), d["value"].alias("value")))
    simple = F.transform(_listed(p["ExtendedData"]["SchemaData"]["SimpleData"], _SIMPLE), lambda d: F.struct(d["_name"].alias("key"), d["_VALUE"].alias("value")))
    # A name that stands twice keeps its last value.
    named = F.filter(F.concat(data, simple), lambda d: d["key"].isNotNull())
    last = F.filter(named, lambda d, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda e: e["key"] == d["key"]))
    out = rows.select(*more, p["_id"].alias("id"), p["name"].alias("name"), p["description"].alias("description"), p["styleUrl"].alias("style"), F.map_from_entries(last).alias("properties"), F.array_compact(F.array(*shapes)).alias("__s"))
    return out.select("*", F.explode_outer("__s").alias("geom")).drop("__s")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of any depth: points, lines, polygons and collections of them with their data; longitude first.

    A collection of one kind is a multi geometry; one of several kinds gives a row for each kind. A placemark without a
    shape gives a row without one. Collections inside of collections are not read.
    """
    rows = _rows(spark, path, "Placemark", ", ".join(f"{k} {v}" for k, v in _PLACEMARK_FIELDS.items()))
    return _placemarks(rows.select(F.struct("*").alias("__p")), F.col("__p"))


def read_kml_folders(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """Placemarks in folders, with ``layer``: the folders' names from the outermost on, joined by " / ".

    An outermost folder is a row, so what one holds must fit a task. Folders deeper than ``depth`` levels are not
    read; placemarks outside of folders have no layer and come from ``read_kml``.
    """
    inner = f"name string, Placemark array<{_PLACEMARK}>"
    schema = inner
    for _ in range(depth - 1):
        schema = f"{inner}, Folder array<struct<{schema}>>"
    level = _rows(spark, path, "Folder", schema).select(F.struct("*").alias("__f"), F.array(F.col("name")).alias("__path"))
    out = None
    for k in range(depth):
        own = level.select("__path", F.explode("__f.Placemark").alias("__p"))
        layer = F.array_join(F.array_compact("__path"), " / ").alias("layer")
        found = _placemarks(own, F.col("__p"), layer)
        out = found if out is None else out.unionByName(found)
        if k < depth - 1:
            level = level.select("__path", F.explode("__f.Folder").alias("__f")).select("__f", F.concat("__path", F.array("__f.name")).alias("__path"))
    return out


def _components(geom: Column, point: Callable, line: Callable, polygon: Callable) -> Column:
    """An XML text for each component of a geometry."""
    kind = F.regexp_replace(geom["type"], "^Multi", "")
    return F.transform(geom["parts"], lambda rs: F.when(kind == "Point", point(rs)).when(kind == "LineString", line(rs)).otherwise(polygon(rs)))


def _kml_geometry(geom: Column) -> Column:
    at = lambda r: _element("coordinates", _joined(r, ","))
    ring = lambda r: _element("LinearRing", at(r))

    def polygon(rs: Column) -> Column:
        holes = F.transform(F.slice(rs, 2, F.greatest(F.size(rs) - 1, F.lit(0))), lambda r: _element("innerBoundaryIs", ring(r)))
        return _element("Polygon", F.concat(_element("outerBoundaryIs", ring(F.get(rs, 0))), F.array_join(holes, "")))

    each = _components(geom, lambda rs: _element("Point", at(F.get(rs, 0))), lambda rs: _element("LineString", at(F.get(rs, 0))), polygon)
    body = F.array_join(each, "")
    return F.when(geom.isNull(), "").when(geom["type"].startswith("Multi"), _element("MultiGeometry", body)).otherwise(body)


def placemark(geom: str, properties: list[str], name: str | None = None) -> Column:
    data = F.concat(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit('<Data name="'), escaped(F.lit(c)), F.lit('"><value>'), escaped(F.col(c)), F.lit("</value></Data>"))).otherwise(F.lit(""))
        for c in properties
    ]) if properties else F.lit("")
    label = _optional("name", F.col(name)) if name else F.lit("")
    return _element("Placemark", F.concat(label, F.when(data != "", _element("ExtendedData", data)).otherwise(F.lit("")), _kml_geometry(F.col(geom))))


_KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
_KML_FOOT = "</Document></kml>"


def write_kml(df: DataFrame, path: str, geom: str = "geom", name: str | None = None) -> None:
    """Features in degrees as placemarks; other columns are their data, and nulls are left out."""
    _write_documents(df.select(placemark(geom, [c for c in df.columns if c not in (geom, name)], name).alias("value")), path, _KML_HEAD, _KML_FOOT)


def write_kmz(df: DataFrame, path: str, geom: str = "geom", name: str | None = None, rows: int = 50_000, mode: str = "append") -> None:
    """As ``write_kml``, in archives of at most ``rows`` placemarks each, which are there all or not at all."""
    values = df.select(placemark(geom, [c for c in df.columns if c not in (geom, name)], name).alias("value"))
    splittable.write_archives(values, path, "doc.kml", _KML_HEAD, _KML_FOOT, rows, ".kmz", mode)


def unpacked_kmz(spark: SparkSession, path: str) -> str:
    """The KML documents of archives as text in the shared folder, which every KML reader takes; refused where there are none."""
    members = expand_archives(spark, path).where(F.lower("name").endswith(".kml"))
    out = shared_path(spark, "kml")
    # A file has one root, so documents of a task stand side by side in one, without what comes before their roots.
    bare = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}|<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", "")
    _write_documents(members.select(bare.alias("value")), out, "<documents>", "</documents>")
    if spark.read.text(out).limit(1).count() == 0:
        raise Refused("no archive holds a .kml document")
    return out


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    return read_kml(spark, unpacked_kmz(spark, path))


# GPX.

_AT = "struct<_lat:double,_lon:double,ele:double>"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Waypoints as points, routes as lines and tracks as multi lines, a part for each segment.

    Lines have two points at least; points without both coordinates, and what is left without any, are not read.
    """
    at = lambda p: F.array_compact(F.array(p["_lon"], p["_lat"], p["ele"]))
    known = lambda p: p["_lon"].isNotNull() & p["_lat"].isNotNull()
    path_of = lambda c: F.transform(F.filter(_listed(c, _AT), known), at)
    points = _rows(spark, path, "wpt", "_lat double, _lon double, ele double, name string, desc string")
    spot = F.array_compact(F.array("_lon", "_lat", "ele"))
    wpt = points.where("_lat is not null and _lon is not null").select("name", "desc", g.geometry("Point", F.array(F.array(F.array(spot)))).alias("geom"))
    routes = _rows(spark, path, "rte", f"name string, desc string, rtept array<{_AT}>")
    rte = routes.select("name", "desc", g.line(path_of(F.col("rtept"))).alias("geom")).where(F.size(g.positions(F.col("geom"))) > 1)
    tracks = _rows(spark, path, "trk", f"name string, desc string, trkseg array<struct<trkpt:array<{_AT}>>>")
    segments = F.filter(F.transform(_listed(F.col("trkseg"), f"struct<trkpt:array<{_AT}>>"), lambda s: path_of(s["trkpt"])), lambda p: F.size(p) > 1)
    trk = tracks.select("name", "desc", g.geometry("MultiLineString", F.transform(segments, lambda p: F.array(p))).alias("geom")).where(F.size("geom.parts") > 0)
    return wpt.unionByName(rte).unionByName(trk)


def write_gpx(df: DataFrame, path: str, geom: str = "geom", name: str | None = None, routes: bool = False) -> None:
    """Features in degrees: points as waypoints, lines as tracks (or single ones as routes), borders of polygons as tracks."""
    geo, label = F.col(geom), _optional("name", F.col(name)) if name else F.lit("")

    def spot(tag: str, p: Column, inner: Column | None = None) -> Column:
        height = F.when(F.size(p) > 2, _element("ele", F.get(p, 2).cast("string"))).otherwise(F.lit(""))
        return F.concat(F.lit(f'<{tag} lat="'), p[1].cast("string"), F.lit('" lon="'), p[0].cast("string"), F.lit('">'), height, inner if inner is not None else F.lit(""), F.lit(f"</{tag}>"))

    many = lambda tag, r: F.array_join(F.transform(r, lambda p: spot(tag, p)), "")
    points = F.array_join(F.transform(g.positions(geo), lambda p: spot("wpt", p, label)), "")
    track = _element("trk", F.concat(label, F.array_join(F.transform(g.rings(geo), lambda r: _element("trkseg", many("trkpt", r))), "")))
    route = _element("rte", F.concat(label, many("rtept", g.positions(geo))))
    is_route = (geo["type"] == "LineString") & F.lit(routes)
    order = F.when(geo["type"].endswith("Point"), 0).when(is_route, 1).otherwise(2)
    values = df.where(geo.isNotNull()).select(order.alias("k"), F.when(order == 0, points).when(order == 1, route).otherwise(track).alias("value"))
    # The format wants waypoints before routes before tracks.
    _write_documents(values.sortWithinPartitions("k").select("value"), path, '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="plumbline" xmlns="http://www.topografix.com/GPX/1/1">', "</gpx>")


# GML.

#: Elements of shapes, what they are made of, and the elements that hold the parts of collections.
_GML_KINDS = {"Point": "Point", "LineString": "LineString", "Curve": "LineString", "Polygon": "Polygon", "Surface": "Polygon"}
_GML_MULTI = ("MultiPoint", "MultiLineString", "MultiCurve", "MultiPolygon", "MultiSurface", "MultiGeometry")
_GML_MEMBERS = ("pointMember", "lineStringMember", "polygonMember", "geometryMember", "curveMember", "surfaceMember", "pointMembers", "surfaceMembers")


def _several(of: DataType, c: Column) -> tuple[DataType, Column]:
    """An element that stands once or more often, as an array."""
    if isinstance(of, ArrayType):
        return of.elementType, F.coalesce(c, F.array().cast(of))
    return of, F.array_compact(F.array(c))


def _text(of: DataType, c: Column) -> Column:
    return c["_VALUE"] if isinstance(of, StructType) else c.cast("string")


def _field(of: StructType, name: str) -> DataType | None:
    return of[name].dataType if isinstance(of, StructType) and name in of.names else None


def _gml_path(of: DataType, c: Column, swap: Column, size: Column) -> Column | None:
    """Positions of an element that has them as ``posList``, ``pos`` or ``coordinates``, itself or further in."""
    if not isinstance(of, StructType):
        return None
    own = F.coalesce(c["@srsDimension"].try_cast("int"), size) if "@srsDimension" in of.names else size
    turned = lambda p: F.when(swap & (F.size(p) > 1), F.concat(F.array(p[1], p[0]), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))))).otherwise(p)
    found = []
    if (t := _field(of, "posList")) is not None:
        v = F.filter(_numbers(_text(t, c["posList"])), lambda x: x.isNotNull())
        n = F.coalesce(c["posList"]["@srsDimension"].try_cast("int"), own) if isinstance(t, StructType) and "@srsDimension" in t.names else own
        n = F.when(n > 1, n).otherwise(2)
        found.append(F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / n).cast("int") - 1), lambda i: turned(F.slice(v, i * n + 1, n)))))
    if (t := _field(of, "pos")) is not None:
        each, spots = _several(t, c["pos"])
        found.append(F.nullif(F.filter(F.transform(spots, lambda s: turned(_numbers(_text(each, s)))), lambda p: F.size(p) > 1), F.array().cast("array<array<double>>")))
    if (t := _field(of, "coordinates")) is not None:
        found.append(F.transform(_tuples(_text(t, c["coordinates"])), turned))
    if not found:
        for f in of.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
            if isinstance(inner, StructType):
                each, nested = _several(f.dataType, c[f.name])
                if _gml_path(each, F.lit(None), swap, own) is not None:
                    # The pieces of a curve follow one another, and each begins where the last one ended.
                    pieces = F.transform(nested, lambda s: _gml_path(each, s, swap, own))
                    found.append(F.aggregate(pieces, F.array().cast("array<array<double>>"), lambda acc, p: F.concat(acc, F.when((F.size(acc) > 0) & (F.get(p, 0) == F.get(acc, F.size(acc) - 1)), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))))
    return F.coalesce(*found) if found else None


def _gml_rings(of: DataType, c: Column, swap: Column, size: Column) -> Column:
    """Rings of a polygon, the outer one first; those of fewer than four positions are left out."""
    lists = []
    for name in ("exterior", "outerBoundaryIs", "interior", "innerBoundaryIs"):
        if (t := _field(of, name)) is not None:
            each, borders = _several(t, c[name])
            ring = _field(each, "LinearRing")
            if ring is not None:
                lists.append(F.transform(borders, lambda b: _gml_path(ring, b["LinearRing"], swap, size)))
    if not lists:
        for f in of.fields if isinstance(of, StructType) else []:
            each, nested = _several(f.dataType, c[f.name])
            if isinstance(each, StructType) and not f.name.startswith("@"):
                lists.append(F.flatten(F.transform(nested, lambda s: _gml_rings(each, s, swap, size))))
    return F.filter(F.concat(*lists), lambda r: F.size(r) > 3) if lists else F.array().cast("array<array<array<double>>>")


def _gml_shape(kind: str, of: DataType, c: Column, swap: Column, size: Column) -> Column:
    """The components of one shape: none where it has no usable positions."""
    if _GML_KINDS[kind] == "Polygon":
        rings = _gml_rings(of, c, swap, size)
        return F.when(F.size(rings) > 0, F.array(rings)).otherwise(F.array().cast(_PARTS))
    path = _gml_path(of, c, swap, size)
    if path is None:
        return F.array().cast(_PARTS)
    if kind == "Point":
        path = F.slice(path, 1, 1)
    return F.when(F.size(path) > (0 if kind == "Point" else 1), F.array(F.array(path))).otherwise(F.array().cast(_PARTS))


def _gml_geometries(of: StructType, c: Column, srs: Column) -> list[Column]:
    """A geometry for each kind of shape that a property's type allows; null where a row has another one."""
    geographic = [k for k in range(4000, 5000) if (s := crs.crs_from_epsg(k)) is not None and s.kind == "geographic"]

    def swapped(name: Column) -> Column:
        code = F.regexp_extract(name, r"(\d+)\s*$", 1).try_cast("int")
        by_authority = name.rlike(r"(?i)^urn:|^http://www\.opengis\.net/def/") & ~name.rlike("(?i)CRS84")
        return F.coalesce(by_authority & code.isin(geographic), F.lit(False))

    def shape_of(t: DataType, s: Column, name: str, outer: Column) -> tuple[Column, Column, Column]:
        own = F.coalesce(s["@srsName"], outer) if _field(t, "@srsName") is not None else outer
        size = F.coalesce(s["@srsDimension"].try_cast("int"), F.lit(2)) if _field(t, "@srsDimension") is not None else F.lit(2)
        return own, swapped(own), size

    out = []
    for name in of.names:
        t = of[name].dataType
        if name in _GML_KINDS and isinstance(t, StructType):
            own, swap, size = shape_of(t, c[name], name, srs)
            parts = _gml_shape(name, t, c[name], swap, size)
            out.append(F.when(F.size(parts) > 0, F.struct(g.geometry(_GML_KINDS[name], parts).alias("geom"), own.alias("srs"))))
        elif name in _GML_MULTI and isinstance(t, StructType):
            own, _, size = shape_of(t, c[name], name, srs)
            kinds: dict[str, list[Column]] = {}
            for member in _GML_MEMBERS:
                if (m := _field(t, member)) is not None:
                    each, members = _several(m, c[name][member])
                    for kind in each.names if isinstance(each, StructType) else []:
                        if kind in _GML_KINDS:
                            one, _ = _several(each[kind].dataType, members)
                            all_ = F.flatten(F.transform(members, lambda x: _several(each[kind].dataType, x[kind])[1]))
                            if isinstance(one, StructType):
                                inner = lambda x: _gml_shape(kind, one, x, shape_of(one, x, kind, own)[1], size)
                                kinds.setdefault(_GML_KINDS[kind], []).append(F.flatten(F.transform(all_, inner)))
            for kind, lists in kinds.items():
                parts = F.concat(*lists)
                out.append(F.when(F.size(parts) > 0, F.struct(g.geometry(f"Multi{kind}", parts).alias("geom"), own.alias("srs"))))
    return out


def _has_shapes(t: DataType) -> bool:
    return isinstance(t, StructType) and any(n in _GML_KINDS or n in _GML_MULTI for n in t.names if isinstance(t[n].dataType, StructType))


def read_gml(spark: SparkSession, path: str, member: str = "featureMember", srs: str | None = None) -> DataFrame:
    """Features of all types: ``layer`` (the type), ``id``, ``srs``, ``properties`` and ``geom``, easting or longitude first.

    ``member`` is the tag around a feature, without a prefix; one that holds several features is read by one task. One scan finds the structure, all values stay text.
    Positions are turned where a system is named by authority (as a URN) and is geographic; ``srs`` is the system of shapes
    that name none. A shape is told from an attribute of the same name by its structure. A collection of several kinds
    gives a row for each. Features without a readable shape are left out; refused where no feature type has one.
    """
    rows = spark.read.format("xml").option("rowTag", member).option("ignoreNamespace", "true").option("inferSchema", "false").option("attributePrefix", "@").load(path)
    features = []
    for f in rows.schema.fields:
        each, listed = _several(f.dataType, F.col(f"`{f.name}`"))
        shapes = [n for n in each.names if _has_shapes(each[n].dataType)] if isinstance(each, StructType) else []
        if not shapes:
            continue
        plain = [n for n in each.names if n not in shapes and not isinstance(each[n].dataType, (StructType, ArrayType)) and not n.startswith("@")]
        one = rows.select(F.explode(listed).alias("__f"))
        v = F.col("__f")
        filled = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v[n].cast("string").alias("value")) for n in plain]), lambda e: F.length(F.trim(e["value"])) > 0) if plain else F.array().cast("array<struct<key:string,value:string>>")
        geoms = _gml_geometries(each[shapes[0]].dataType, v[shapes[0]], F.lit(srs).cast("string"))
        features.append(one.select(
            F.lit(f.name).alias("layer"), (v["@id"] if "@id" in each.names else F.lit(None)).cast("string").alias("id"), F.map_from_entries(filled).alias("properties"), F.explode(F.array_compact(F.array(*geoms))).alias("__g"),
        ).select("layer", "id", "__g.srs", "properties", "__g.geom"))
    if not features:
        raise Refused(f"no <{member}> has a point, line or polygon")
    out = features[0]
    for f in features[1:]:
        out = out.unionByName(f)
    return out


def xml_name(name: str) -> str:
    """A column's name as an element may be called."""
    plain = re.sub(r"[^A-Za-z0-9_.-]", "_", name)
    return plain if re.match(r"[A-Za-z_]", plain) else f"_{plain}"


def write_gml(df: DataFrame, path: str, epsg: int, layer: str = "feature", geom: str = "geom", id_col: str | None = None) -> None:
    """Features as members whose system is named by authority: latitude first where it is geographic."""
    known = crs.crs_from_epsg(epsg)
    turned = known is not None and known.kind == "geographic"
    order = (lambda p: F.concat(F.array(p[1], p[0]), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))))) if turned else (lambda p: p)
    geo, srs = F.col(geom), f' srsName="urn:ogc:def:crs:EPSG::{epsg}"'
    size = F.coalesce(F.size(F.get(g.positions(geo), 0)), F.lit(2)).cast("string")

    def at(r: Column) -> Column:
        return F.concat(F.lit('<gml:posList srsDimension="'), size, F.lit('">'), _joined(r, " ", " ", order), F.lit("</gml:posList>"))

    ring = lambda r: _element("gml:LinearRing", at(r))

    def polygon(rs: Column) -> Column:
        holes = F.transform(F.slice(rs, 2, F.greatest(F.size(rs) - 1, F.lit(0))), lambda r: _element("gml:interior", ring(r)))
        return _element("gml:Polygon", F.concat(_element("gml:exterior", ring(F.get(rs, 0))), F.array_join(holes, "")), srs)

    each = _components(geo, lambda rs: _element("gml:Point", _element("gml:pos", _joined(F.get(rs, 0), " ", " ", order)), srs), lambda rs: _element("gml:LineString", at(F.get(rs, 0)), srs), polygon)
    multi = lambda tag, member: _element(f"gml:{tag}", F.array_join(F.transform(each, lambda e: _element(f"gml:{member}", e)), ""), srs)
    shape = (
        F.when(geo["type"] == "MultiPoint", multi("MultiPoint", "pointMember")).when(geo["type"] == "MultiLineString", multi("MultiCurve", "curveMember"))
        .when(geo["type"] == "MultiPolygon", multi("MultiSurface", "surfaceMember")).otherwise(F.array_join(each, ""))
    )
    others = [c for c in df.columns if c not in (geom, id_col)]
    fields = F.concat(*[_optional(f"app:{xml_name(c)}", F.col(c)) for c in others]) if others else F.lit("")
    tag = f"app:{xml_name(layer)}"
    ident = F.concat(F.lit(' gml:id="'), escaped(F.col(id_col)), F.lit('"')) if id_col else F.lit("")
    value = F.concat(F.lit(f"<gml:featureMember><{tag}"), ident, F.lit(">"), fields, F.when(geo.isNotNull(), _element("app:geometry", shape)).otherwise(F.lit("")), F.lit(f"</{tag}></gml:featureMember>"))
    _write_documents(df.select(value.alias("value")), path, '<?xml version="1.0" encoding="UTF-8"?>\n<gml:FeatureCollection xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:app="urn:plumbline:features">', "</gml:FeatureCollection>")


# LandXML: northing first, always.

_END = "struct<Start:string,End:string>"
_GEOMETRY = f"struct<Line:array<{_END}>,Curve:array<{_END}>,Spiral:array<{_END}>>"


def _north_first(text: Column) -> Column:
    p = _numbers(text)
    known = F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull()
    return F.when(known, F.array_compact(F.array(F.get(p, 1), F.get(p, 0), F.get(p, 2))))


def _chained(coord: Column) -> Column:
    """The positions along lines, curves and spirals, whose chords are taken; each one follows where the last one ended.

    XML readers gather elements by name, so pieces of several names are put in order by their ends; lines alone keep
    their order, and a gap between them is bridged. What doesn't join on is left out.
    """
    ends = lambda c: F.filter(F.transform(_listed(c, _END), lambda e: F.struct(_north_first(e["Start"]).alias("a"), _north_first(e["End"]).alias("b"))), lambda e: e["a"].isNotNull() & e["b"].isNotNull())
    lines, bent = ends(coord["Line"]), F.concat(ends(coord["Curve"]), ends(coord["Spiral"]))
    nothing = F.array().cast("array<array<double>>")
    plain = F.aggregate(lines, nothing, lambda acc, e: F.concat(acc, F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == e["a"]), F.array(e["b"])).otherwise(F.array(e["a"], e["b"]))))
    every = F.concat(lines, bent)
    # The head is a piece that follows none; a closed border may begin anywhere.
    head = F.get(F.filter(every, lambda e: ~F.exists(every, lambda o: o["b"] == e["a"])), 0)
    first = F.coalesce(head, F.get(every, 0))

    def follow(acc: Column, _: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        closed = (F.size(acc) > 1) & (last == F.get(acc, 0))
        after = F.get(F.filter(every, lambda e: e["a"] == last), 0)
        return F.when(after.isNull() | closed, acc).otherwise(F.concat(acc, F.array(after["b"])))

    mixed = F.aggregate(F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))), F.array(first["a"], first["b"]), follow)
    return F.when(F.size(bent) == 0, plain).otherwise(mixed)


def read_landxml(spark: SparkSession, path: str) -> DataFrame:
    """Survey points, parcels and lines of plans: ``layer``, ``name``, ``properties``, ``chords`` and ``geom``, easting first.

    ``chords`` counts the curves and spirals whose chords stand for them. Points without two numbers, and parcels of fewer
    than three corners, are left out. Surfaces are not read.
    """
    def kept(*names: str) -> Column:
        pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"_{n}").alias("value")) for n in names])
        return F.map_from_entries(F.filter(pairs, lambda e: F.length(e["value"]) > 0)).alias("properties")

    def of(*names: str) -> str:
        return ", ".join(f"_{n} string" for n in names)

    def bends(c: str) -> Column:
        return (F.size(_listed(F.col(c)["Curve"], _END)) + F.size(_listed(F.col(c)["Spiral"], _END))).cast("bigint").alias("chords")

    about = ("name", "code", "desc", "pntRef", "state", "featureRef")
    at = _north_first(F.col("_VALUE"))
    points = _rows(spark, path, "CgPoint", f"{of(*about)}, _VALUE string").where(at.isNotNull()).select(
        F.lit("CgPoints").alias("layer"), F.col("_name").alias("name"), kept(*about), F.lit(0).cast("bigint").alias("chords"), g.geometry("Point", F.array(F.array(F.array(at)))).alias("geom")
    )
    about = ("name", "parcelType", "state", "class", "desc", "area", "useOfParcel", "owner")
    lots = _rows(spark, path, "Parcel", f"{of(*about)}, CoordGeom {_GEOMETRY}").withColumn("__ring", _chained(F.col("CoordGeom")))
    real = F.size(F.array_distinct("__ring")) > 2
    parcels = lots.where(real).select(F.lit("Parcels").alias("layer"), F.col("_name").alias("name"), kept(*about), bends("CoordGeom"), g.polygon(g.close_ring(F.col("__ring"))).alias("geom"))
    about = ("name", "desc")
    works = _rows(spark, path, "PlanFeature", f"{of(*about)}, CoordGeom array<{_GEOMETRY}>").select("*", F.posexplode("CoordGeom").alias("__i", "__c")).withColumn("__path", _chained(F.col("__c")))
    lines = works.where(F.size("__path") > 1).select(F.lit("PlanFeatures").alias("layer"), F.col("_name").alias("name"), kept(*about), bends("__c"), g.line(F.col("__path")).alias("geom"))
    return points.unionByName(parcels).unionByName(lines)


def write_landxml(df: DataFrame, path: str, name: str, code: str | None = None, geom: str = "geom", decimals: int = 3) -> None:
    """Points as survey points, polygons as parcels (a parcel each, without holes), lines as plan features; northing first.

    ``decimals`` are those of the coordinates: three suit metres, eight degrees. Parts of multi geometries have the name
    of their feature and a number.
    """
    if not 0 <= decimals <= 15:
        raise Refused("coordinates have 0 to 15 decimals")
    geo = F.col(geom)
    fixed = lambda v: F.format_string(f"%.{decimals}f", v)
    at = lambda p: F.concat_ws(" ", fixed(p[1]), fixed(p[0]), F.when(F.size(p) > 2, fixed(F.get(p, 2))))
    marked = F.coalesce(F.concat(F.lit(' code="'), escaped(F.col(code)), F.lit('"')), F.lit("")) if code else F.lit("")

    def named(i: Column) -> Column:
        more = F.when(F.size(geo["parts"]) > 1, F.concat(F.lit("."), (i + 1).cast("string"))).otherwise(F.lit(""))
        return F.concat(F.lit(' name="'), escaped(F.col(name)), more, F.lit('"'))

    def sides(r: Column) -> Column:
        n = F.size(r)
        each = F.zip_with(F.slice(r, 1, F.greatest(n - 1, F.lit(0))), F.slice(r, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: _element("Line", F.concat(_element("Start", at(a)), _element("End", at(b)))))
        return _element("CoordGeom", F.array_join(each, ""))

    def item(rs: Column, i: Column) -> Column:
        point = F.concat(F.lit("<CgPoint"), named(i), marked, F.lit(">"), at(F.get(F.get(rs, 0), 0)), F.lit("</CgPoint>"))
        lot = F.concat(F.lit("<Parcel"), named(i), F.lit(">"), sides(F.get(rs, 0)), F.lit("</Parcel>"))
        work = F.concat(F.lit("<PlanFeature"), named(i), F.lit(">"), sides(F.get(rs, 0)), F.lit("</PlanFeature>"))
        wrapped = F.when(geo["type"].endswith("Point"), _element("CgPoints", point)).when(geo["type"].endswith("Polygon"), _element("Parcels", lot))
        return wrapped.otherwise(_element("PlanFeatures", work))

    value = F.array_join(F.transform(geo["parts"], item), "")
    _write_documents(df.where(geo.isNotNull()).select(value.alias("value")), path, '<?xml version="1.0" encoding="UTF-8"?>\n<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2">', "</LandXML>")
