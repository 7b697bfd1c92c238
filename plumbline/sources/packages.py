"""Workbooks, TopoJSON, and projection text."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import GEOMETRY
from plumbline.operators.table import Refused
from plumbline.sources.binary_formats import _GEOM, _files


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``(sheet, row, column, text)`` of a workbook's filled cells; entities aren't expanded."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        def tree(name: str) -> ElementTree.Element:
            body = z.read(name)
            if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
                raise Refused(f"{name} declares entities")
            return ElementTree.fromstring(body)

        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in tree("xl/sharedStrings.xml").findall("m:si", ns)]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in names:
            for cell in tree(name).iter(f"{{{ns['m']}}}c"):
                ref, kind = cell.get("r"), cell.get("t")
                v = cell.find("m:v", ns)
                text = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else v.text if v is not None else None
                if text is not None:
                    text = shared[int(text)] if kind == "s" else text
                    yield name[14:-4], int(re.search(r"\d+", ref)[0]) - 1, _column(ref), text


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Filled cells as ``path, sheet, row, col, text``; a workbook is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(name, *c) for c in sheet_cells(raw)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "sheet", "row", "col", "text"])

    return _files(spark, path).mapInArrow(run, "path string, sheet string, row int, col int, text string")


def sheet_table(cells: DataFrame, sheet: str, header: int = 0) -> DataFrame:
    """One sheet as a table: its header row names the columns (the only rows that reach the driver)."""
    mine = cells.where(F.col("sheet") == sheet)
    names = {r["col"]: r["text"] for r in mine.where(F.col("row") == header).collect()}
    pick = [F.max(F.when(F.col("col") == c, F.col("text"))).alias(n) for c, n in sorted(names.items())]
    return mine.where(F.col("row") > header).groupBy("path", "row").agg(*pick).drop("path", "row")


def topojson_features(text: str) -> Iterator[tuple[str, str | None, dict, tuple[str, list] | None]]:
    """``(object, id, properties, geometry)``; arcs are sums of differences, and shared between shapes."""
    t = json.loads(text)
    if t.get("type") != "Topology":
        raise Refused("this is no topology")
    move = t.get("transform")
    scale, shift = (move["scale"], move["translate"]) if move else ((1, 1), (0, 0))
    arcs = []
    for arc in t["arcs"]:
        x = y = 0
        path = []
        for p in arc:
            x, y = (x + p[0], y + p[1]) if move else (p[0], p[1])
            path.append([x * scale[0] + shift[0], y * scale[1] + shift[1]])
        arcs.append(path)

    def joined(refs: list[int]) -> list:
        out: list = []
        for r in refs:
            path = arcs[r] if r >= 0 else arcs[~r][::-1]
            out += path[1:] if out else path
        return out

    def at(p: list) -> list[float]:
        return [p[0] * scale[0] + shift[0], p[1] * scale[1] + shift[1]]

    def shape(g: dict) -> tuple[str, list] | None:
        kind = g.get("type")
        parts = {
            "Point": lambda: [[[at(g["coordinates"])]]],
            "MultiPoint": lambda: [[[at(p)]] for p in g["coordinates"]],
            "LineString": lambda: [[joined(g["arcs"])]],
            "MultiLineString": lambda: [[joined(a)] for a in g["arcs"]],
            "Polygon": lambda: [[joined(r) for r in g["arcs"]]],
            "MultiPolygon": lambda: [[joined(r) for r in p] for p in g["arcs"]],
        }
        return (kind, parts[kind]()) if kind in parts else None

    for name, o in t["objects"].items():
        for g in o["geometries"] if o.get("type") == "GeometryCollection" else [o]:
            yield name, None if g.get("id") is None else str(g["id"]), g.get("properties") or {}, shape(g)


def read_topojson(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                rows = [
                    (layer, i, [(k, None if v is None else v if isinstance(v, str) else json.dumps(v)) for k, v in p.items()], {"type": s[0], "parts": s[1]} if s else None)
                    for layer, i, p, s in topojson_features(raw.decode("utf-8"))
                ]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), _GEOM)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["layer", "id", "properties", "geom"])

    return _files(spark, path).mapInArrow(run, f"layer string, id string, properties map<string,string>, geom {GEOMETRY}")


def parse_wkt_tree(text: str) -> tuple[str, list]:
    """Projection text as ``(keyword, [text, numbers, subtrees])``, with either kind of brackets."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[A-Za-z_][\w]*|[-+]?[\d.]+(?:[eE][-+]?\d+)?|[\[\](),]', text)
    at = 0

    def node() -> object:
        nonlocal at
        t = tokens[at]
        at += 1
        if t.startswith('"'):
            return t[1:-1].replace('""', '"')
        if re.match(r"[-+\d.]", t):
            return float(t)
        if at < len(tokens) and tokens[at] in "[(":
            at += 1
            items = []
            while tokens[at] not in "])":
                if tokens[at] == ",":
                    at += 1
                    continue
                items.append(node())
            at += 1
            return (t.upper(), items)
        return t

    out = node()
    if not isinstance(out, tuple):
        raise Refused("this is no projection text")
    return out


def parse_prj(text: str) -> dict[str, object]:
    """What a .prj says: kind, name, EPSG code, projection, its parameters, ellipsoid and unit."""
    root = parse_wkt_tree(text)
    out: dict[str, object] = {"kind": "projected" if root[0] in ("PROJCS", "PROJCRS", "PROJECTEDCRS") else "geographic", "name": root[1][0], "parameters": {}}

    def walk(n: tuple, top: bool) -> None:
        key, items = n
        if key in ("AUTHORITY", "ID") and top and len(items) > 1:
            out["epsg"] = int(float(items[1]))
        if key in ("PROJECTION", "METHOD"):
            out["projection"] = items[0]
        if key == "PARAMETER":
            out["parameters"][items[0].lower().replace(" ", "_")] = items[1]
        if key in ("SPHEROID", "ELLIPSOID"):
            out["ellipsoid"] = (items[1], items[2])
        if key in ("UNIT", "LENGTHUNIT") and top:
            out["unit"] = items[0]
        for i in items:
            if isinstance(i, tuple):
                walk(i, n is root)

    walk(root, True)
    return out
