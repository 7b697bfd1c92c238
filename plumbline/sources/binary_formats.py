"""Shapefiles, GeoTIFF, PLY and DXF: files of binary or sequential records, one task a file."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import GEOMETRY
from plumbline.operators.table import Refused

_GEOM = pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# Shapefiles.


def _area(r: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in pairwise(r)) / 2


def _inside(p: list, ring: list) -> bool:
    hit = False
    for a, b in pairwise(ring):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            hit = not hit
    return hit


def _shape(raw: bytes) -> tuple[str, list] | None:
    (code,) = struct.unpack_from("<i", raw)
    kind = code % 10
    if kind == 0:
        return None
    if kind == 1:
        n = 3 if code == 11 else 2
        return "Point", [[[list(struct.unpack_from(f"<{n}d", raw, 4))]]]
    if kind == 8:
        (n,) = struct.unpack_from("<i", raw, 36)
        xy = np.frombuffer(raw, "<f8", 2 * n, 40).reshape(n, 2).tolist()
        return "MultiPoint", [[[p]] for p in xy]
    if kind not in (3, 5):
        raise Refused(f"shapes of type {code} aren't read")
    m, n = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{m}i", raw, 44), n]
    at = 44 + 4 * m
    xyz = np.frombuffer(raw, "<f8", 2 * n, at).reshape(n, 2)
    if code // 10 == 1:
        xyz = np.column_stack([xyz, np.frombuffer(raw, "<f8", n, at + 16 * n + 16)])
    paths = [xyz[a:b].tolist() for a, b in pairwise(starts)]
    if kind == 3:
        return ("LineString" if m == 1 else "MultiLineString"), [[p] for p in paths]
    # Shells run clockwise; a hole belongs to the smallest shell around its first corner.
    shells = [[p] for p in paths if _area(p) <= 0] or [[p] for p in paths]
    for hole in (p for p in paths if _area(p) > 0 and [p] not in shells):
        around = [s for s in shells if _inside(hole[0], s[0])]
        (min(around, key=lambda s: abs(_area(s[0]))) if around else shells[0]).append(hole)
    return ("Polygon" if len(shells) == 1 else "MultiPolygon"), [[r[::-1] for r in s] for s in shells]


def _dbf(raw: bytes) -> list[dict[str, str | None]]:
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while at < head - 1 and raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), raw[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, p = {}, head + i * size + 1
        for name, width in fields:
            row[name] = raw[p : p + width].decode("utf-8", "replace").strip() or None
            p += width
        out.append(row)
    return out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``path, idx, geom, properties`` from a folder's .shp files and the .dbf beside each.

    The two files of a layer meet by their base name in any case; each layer is one task's.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, shp, dbf in zip(*(b.column(c).to_pylist() for c in ("base", "shp", "dbf")), strict=True):
                rows, at = [], 100
                attributes = _dbf(dbf) if dbf is not None else []
                while at + 8 <= len(shp):
                    (words,) = struct.unpack_from(">i", shp, at + 4)
                    made = _shape(shp[at + 8 : at + 8 + 2 * words])
                    k = len(rows)
                    rows.append((name, k, {"type": made[0], "parts": made[1]} if made else None, list(attributes[k].items()) if k < len(attributes) else []))
                    at += 8 + 2 * words
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.int64(), _GEOM, pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "idx", "geom", "properties"])

    files = _files(spark, path).withColumn("base", F.lower(F.regexp_replace("path", r"\.[^./]+$", ""))).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    shp = files.where("ext = 'shp'").select("base", F.col("content").alias("shp"))
    dbf = files.where("ext = 'dbf'").select("base", F.col("content").alias("dbf"))
    return shp.join(dbf, "base", "left").select("base", "shp", "dbf").mapInArrow(shapes, f"path string, idx long, geom {GEOMETRY}, properties map<string,string>")


def shapefile_bytes(shapes: list[tuple[str, list]], rows: list[dict[str, str]], widths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The .shp, .shx and .dbf of polygons, lines or points of one kind."""
    code = {"Point": 1, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5}[shapes[0][0]] if shapes else 1
    records, index, at = b"", b"", 50
    every = [p for _, parts in shapes for rings in parts for r in rings for p in r]
    for k, (_, parts) in enumerate(shapes):
        if code == 1:
            body = struct.pack("<i2d", 1, *parts[0][0][0][:2])
        else:
            # Shells clockwise, holes counter-clockwise.
            paths = [r if code == 3 or (_area(r) < 0) == (i == 0) else r[::-1] for rings in parts for i, r in enumerate(rings)]
            flat = np.array([p[:2] for r in paths for p in r], "<f8")
            starts = np.cumsum([0, *map(len, paths)])[:-1]
            body = struct.pack("<i4d2i", code, *flat.min(axis=0), *flat.max(axis=0), len(paths), len(flat)) + starts.astype("<i4").tobytes() + flat.tobytes()
        records += struct.pack(">2i", k + 1, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    low, high = (f([p[:2] for p in every], axis=0) if every else (0.0, 0.0) for f in (np.min, np.max))

    def head(size: int) -> bytes:
        return struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, code, *low, *high, 0, 0, 0, 0)

    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"C", w, 0) for n, w in widths.items())
    size = 1 + sum(widths.values())
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(fields), size) + fields + b"\r"
    for r in rows:
        dbf += b" " + b"".join((r.get(n) or "").encode()[:w].ljust(w) for n, w in widths.items())
    return head(100 + len(records)) + records, head(100 + len(index)) + index, dbf + b"\x1a"


# GeoTIFF.


def _lzw(raw: bytes) -> bytes:
    out, bits, held, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while True:
        while held < width and at < len(raw):
            bits, held, at = bits << 8 | raw[at], held + 8, at + 1
        if held < width:
            return bytes(out)
        code = bits >> (held - width) & ((1 << width) - 1)
        held -= width
        bits &= (1 << held) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)


def _packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at] - 256 * (raw[at] > 127)
        if n >= 0:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (1 - n if n != -128 else 0)
            at += 2
    return bytes(out)


_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}


def _tags(get: Callable[[int, int], bytes]) -> tuple[str, dict[int, list]]:
    """Byte order and tags of the first image; ``get`` gives bytes of the file from a place on."""
    head = get(0, 8)
    e = "<" if head[:2] == b"II" else ">"
    if head[:2] not in (b"II", b"MM") or struct.unpack_from(f"{e}H", head, 2)[0] != 42:
        raise Refused("this is no classic TIFF file")
    (at,) = struct.unpack_from(f"{e}I", head, 4)
    (n,) = struct.unpack(f"{e}H", get(at, 2))
    entries = get(at + 2, 12 * n)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{e}HHI", entries, 12 * k)
        if kind not in _SIZES:
            continue
        size = struct.calcsize(f"{e}{_SIZES[kind]}") * count
        body = entries[12 * k + 8 : 12 * k + 12] if size <= 4 else get(struct.unpack_from(f"{e}I", entries, 12 * k + 8)[0], size)
        tags[tag] = [body[:count]] if kind == 2 else list(struct.unpack_from(f"{e}{count * len(_SIZES[kind])}{_SIZES[kind][0]}", body))
    return e, tags


class TiffLayout:
    """Where the strips or tiles of a TIFF's first image are, from its tags alone, and how to read one."""

    def __init__(self, get: Callable[[int, int], bytes]):
        e, t = _tags(get)
        self.width, self.height = t[256][0], t[257][0]
        self.samples, self.packed, self.planar = t.get(277, [1])[0], t.get(259, [1])[0], t.get(284, [1])[0]
        bits, kind, self.predictor = t.get(258, [1])[0], t.get(339, [1])[0], t.get(317, [1])[0]
        if bits not in (8, 16, 32, 64) or self.packed not in (1, 5, 8, 32773, 32946) or self.predictor not in (1, 2, 3):
            raise Refused(f"TIFF with {bits} bits, compression {self.packed}, predictor {self.predictor} isn't read")
        self.dtype = np.dtype(f"{e}{'uif'[kind - 1]}{bits // 8}")
        self.tiled = 322 in t
        self.block_width, self.block_height = (t[322][0], t[323][0]) if self.tiled else (self.width, min(t.get(278, [self.height])[0], self.height))
        self.offsets, self.sizes = (t[324], t[325]) if self.tiled else (t[273], t[279])

    def place(self, k: int) -> tuple[int, int, int]:
        """Plane, first row and first column of a block."""
        across, down = -(-self.width // self.block_width), -(-self.height // self.block_height)
        plane, at = divmod(k, across * down)
        return plane, at // across * self.block_height, at % across * self.block_width

    def block(self, k: int, body: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """``(band, first row, first column, values)`` of what one block holds."""
        plane, row, col = self.place(k)
        rows = self.block_height if self.tiled else min(self.block_height, self.height - row)
        n, bw, dtype = self.samples if self.planar == 1 else 1, self.block_width, self.dtype
        body = {1: lambda b: b, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}[self.packed](body)
        if self.predictor == 3:
            b = np.frombuffer(body, np.uint8, rows * bw * n * dtype.itemsize).reshape(rows, -1, n)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, bw * n)
            px = np.ascontiguousarray(b.transpose(0, 2, 1)).view(np.dtype(f">f{dtype.itemsize}")).reshape(rows, bw, n)
        else:
            px = np.frombuffer(body, dtype, rows * bw * n).reshape(rows, bw, n)
            if self.predictor == 2:
                px = np.cumsum(px, axis=1, dtype=dtype)
        px = px[: self.height - row, : self.width - col]
        for s in range(n):
            yield plane + s if self.planar == 2 else s, row, col, px[:, :, s]


def geotransform(raw: bytes) -> tuple[float, ...] | None:
    """From a scale and tie point or a matrix; None where the file isn't placed."""
    _, t = _tags(lambda at, n: raw[at : at + n])
    if 34264 in t:
        m = t[34264]
        return (m[3], m[0], m[1], m[7], m[4], m[5])
    if 33550 in t and 33922 in t:
        (sx, sy), (i, j, _, x, y) = t[33550][:2], t[33922][:5]
        return (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    return None


def geotiff_bytes(values: np.ndarray, transform: tuple[float, ...], deflate: bool = True) -> bytes:
    """A one-band file of one strip for each 64 rows; the narrowest type that holds all values."""
    whole = np.all(values == np.floor(values))
    low, high = values.min(), values.max()
    kinds = [(d, k) for d, k in (("<u1", 1), ("<u2", 1), ("<i2", 2), ("<i4", 2)) if whole and np.iinfo(d).min <= low and high <= np.iinfo(d).max]
    dtype, sample = kinds[0] if kinds else ("<f4", 3) if np.all(values.astype("<f4") == values) else ("<f8", 3)
    strips = [values[r : r + 64].astype(dtype).tobytes() for r in range(0, len(values), 64)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    at = 8 + np.cumsum([0, *map(len, strips)])
    tags = {
        256: ("I", [values.shape[1]]), 257: ("I", [values.shape[0]]), 258: ("H", [np.dtype(dtype).itemsize * 8]), 259: ("H", [8 if deflate else 1]), 262: ("H", [1]),
        273: ("I", at[:-1].tolist()), 277: ("H", [1]), 278: ("I", [64]), 279: ("I", list(map(len, strips))), 339: ("H", [sample]),
        33550: ("d", [transform[1], -transform[5], 0.0]), 33922: ("d", [0.0, 0.0, 0.0, transform[0], transform[3], 0.0]),
    }
    extra, start = b"", int(at[-1]) + 2 + 12 * len(tags) + 4
    entries = b""
    for tag, (kind, v) in sorted(tags.items()):
        body = struct.pack(f"<{len(v)}{kind}", *v)
        place = body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", start + len(extra))
        extra += body if len(body) > 4 else b""
        entries += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12}[kind], len(v)) + place
    return b"II*\0" + struct.pack("<I", int(at[-1])) + b"".join(strips) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


# PLY.

_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
        "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Vertices ``path, idx, x, y, z, red, green, blue`` of text and binary files; faces are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                end = raw.index(b"end_header")
                head, body = raw[:end].decode("ascii").split("\n"), raw[raw.index(b"\n", end) + 1 :]
                form = next(x.split()[1] for x in head if x.startswith("format"))
                n, fields, current = 0, [], ""
                for line in head:
                    w = line.split()
                    if w[:1] == ["element"]:
                        current = w[1]
                        n = int(w[2]) if current == "vertex" else n
                    elif w[:1] == ["property"] and current == "vertex":
                        fields.append((w[2], _PLY[w[1]]))
                if form == "ascii":
                    rows = np.array([line.split()[: len(fields)] for line in body.decode("ascii").split("\n")[:n]], float).reshape(n, len(fields))
                    v = {f: rows[:, i] for i, (f, _) in enumerate(fields)}
                else:
                    e = "<" if "little" in form else ">"
                    rec = np.frombuffer(body, np.dtype([(f, e + k) for f, k in fields]), n)
                    v = {f: rec[f] for f, _ in fields}
                colour = [pa.array(v[c].astype(np.int32)) if c in v else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.arange(n)), *(pa.array(v[c].astype(np.float64)) for c in "xyz"), *colour],
                    names=["path", "idx", "x", "y", "z", "red", "green", "blue"],
                )

    return _files(spark, path).mapInArrow(run, "path string, idx long, x double, y double, z double, red int, green int, blue int")


# DXF.


def _arc(cx: float, cy: float, r: float, start: float, end: float, tolerance: float = 0.01) -> list[list[float]]:
    """Points of an arc (degrees, counter-clockwise) within a sagitta of the tolerance."""
    sweep = (end - start) % 360 or 360.0
    step = 2 * math.acos(max(-1.0, 1 - min(tolerance, r) / r)) if r else math.pi
    n = max(2, math.ceil(math.radians(sweep) / max(step, 1e-6)))
    return [[cx + r * math.cos(math.radians(start + sweep * i / n)), cy + r * math.sin(math.radians(start + sweep * i / n))] for i in range(n + 1)]


def dxf_entities(text: str) -> Iterator[tuple[str, str, str | None, str, list]]:
    """``(entity, layer, text, geometry type, parts)`` of points, lines, polylines, arcs, circles and texts."""
    lines = text.split("\n")
    pairs = [(int(c), v.strip()) for c, v in zip(lines[::2], lines[1::2], strict=False) if c.strip().lstrip("-").isdigit()]
    section, entity, groups, held = "", None, [], None
    for code, value in [*pairs, (0, "EOF")]:
        if code == 2 and entity == "SECTION":
            section = value
        if code != 0:
            groups.append((code, value))
            continue
        if section == "ENTITIES" and entity:
            g = dict(reversed(groups))
            layer = g.get(8, "0")
            at = lambda k: [float(g.get(k, 0)), float(g.get(k + 10, 0))] + ([float(g[k + 20])] if g.get(k + 20) not in (None, "0", "0.0") else [])  # noqa: E731, B023
            if entity == "POINT":
                yield entity, layer, None, "Point", [[[at(10)]]]
            elif entity == "LINE":
                yield entity, layer, None, "LineString", [[[at(10)[:2], at(11)[:2]]]]
            elif entity in ("TEXT", "MTEXT"):
                yield entity, layer, g.get(1), "Point", [[[at(10)]]]
            elif entity == "ARC":
                yield entity, layer, None, "LineString", [[_arc(*at(10)[:2], float(g[40]), float(g[50]), float(g[51]))]]
            elif entity == "CIRCLE":
                yield entity, layer, None, "Polygon", [[_arc(*at(10)[:2], float(g[40]), 0, 360)]]
            elif entity == "LWPOLYLINE":
                xs, ys = ([float(v) for c, v in groups if c == k] for k in (10, 20))
                path = [list(p) for p in zip(xs, ys, strict=False)]
                closed = int(g.get(70, 0)) & 1
                yield entity, layer, None, "Polygon" if closed else "LineString", [[path + path[:1] if closed else path]]
            elif entity == "POLYLINE":
                held = (layer, int(g.get(70, 0)) & 1, [])
            elif entity == "VERTEX" and held:
                held[2].append(at(10)[:2])
            elif entity == "SEQEND" and held:
                layer, closed, path = held
                held = None
                yield "POLYLINE", layer, None, "Polygon" if closed else "LineString", [[path + path[:1] if closed else path]]
        entity, groups = value, []


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """Entities as features; others of the file are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(name, i, e, layer, t, {"type": k, "parts": p}) for i, (e, layer, t, k, p) in enumerate(dxf_entities(raw.decode("utf-8", "replace").replace("\r", "")))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), _GEOM)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "idx", "entity", "layer", "text", "geom"])

    return _files(spark, path).mapInArrow(run, f"path string, idx long, entity string, layer string, text string, geom {GEOMETRY}")
