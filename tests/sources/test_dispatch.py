"""Layouts of coordinate tables, evidence of formats and the one door to readers."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.table import Refused
from plumbline.sources import detect, dispatch, tables
from plumbline.sources import text_vector as tv
from plumbline.sources import xml_vector as xv


@pytest.mark.parametrize(
    ("columns", "row", "name", "roles", "confirm"),
    [
        (5, None, "pnezd", {"id": 1, "y": 2, "x": 3, "z": 4, "code": 5}, True),
        (3, None, "nez", {"y": 1, "x": 2, "z": 3}, True),
        (4, None, "id-xyz", {"id": 1, "x": 2, "y": 3, "z": 4}, True),
        (7, None, "pnezd", {"id": 1, "y": 2, "x": 3, "z": 4, "code": 5}, True),
        (2, None, None, {}, True),
    ],
)
def test_layouts_by_number_of_columns(spark, columns, row, name, roles, confirm):
    df = spark.createDataFrame([tuple(float(i) for i in range(columns))], [f"column_{i + 1}" for i in range(columns)])
    got = tables.detect_schema(df)
    assert (got.name, got.roles, got.confirm) == (name, {r: f"column_{i}" for r, i in roles.items()}, confirm)


def test_layouts_by_headers(spark):
    named = lambda rows, cols: tables.detect_schema(spark.createDataFrame(rows, cols))
    far = named([(500000.0, 10.0, 1), (1.0, 2.0, 2)], "Easting double, Northing double, Pt int")
    assert (far.name, far.confirm, far.at) == ("header-named", False, {"x": "Easting", "y": "Northing", "id": "Pt"})
    near = named([(77.0, 12.0), (None, 12.0), (-180.0, 90.0)], "X double, Y double")
    assert (near.name, near.confirm, near.roles, near.at) == ("header-geographic", True, {"lon": "X", "lat": "Y"}, {"x": "X", "y": "Y"})
    # The row that is out of range may be any.
    assert named([(77.0, 12.0)] * 99 + [(77.0, 91.0)], "X double, Y double").name == "header-named"
    # No row has both: nothing says that they are degrees.
    assert named([(None, 12.0)], "X double, Y double").name == "header-named"
    assert named([], "X double, Y double").name == "header-named"
    both = named([(1.0, 2.0, 900.0, 900.0)], "Lon double, Lat double, X double, Y double")
    assert (both.name, both.confirm, both.at) == ("header-named", False, {"x": "Lon", "y": "Lat"})
    # Headers without coordinates don't help.
    assert named([(1.0, 2.0, 3.0)], "a double, b double, c double").name == "nez"


def test_a_layout_is_confirmed_or_named(spark, tmp_path):
    (tmp_path / "t.csv").write_text("12.5,77.25,900\n13.5,78.25,\nx,1,2\n")
    path = str(tmp_path / "t.csv")
    with pytest.raises(Refused, match="nez"):
        tables.read_coordinates(spark, path)
    at = lambda **k: sorted(r[0] for r in tables.read_coordinates(spark, path, **k)[0].select(g.to_wkt(F.col("geom"))).collect())
    assert at(confirmed=True) == ["POINT (78.25 13.5)", "POINT Z (77.25 12.5 900)"]
    assert at(layout="xyz") == ["POINT (13.5 78.25)", "POINT Z (12.5 77.25 900)"]
    assert at(layout="latlonz") == at(confirmed=True)
    assert tables.read_coordinates(spark, path, "xyz")[1].count() == 1
    for wrong in ("pnezd", "?"):
        with pytest.raises(Refused):
            tables.read_coordinates(spark, path, wrong)


def test_one_door_to_readers(spark, tmp_path):
    shape = spark.createDataFrame([("a", "POINT (1 2)")], "name string, w string").select("name", tv.from_wkt(F.col("w")).alias("geom"))
    for name, write in (("gml", lambda p: xv.write_gml(shape, p, 32643)), ("kml", lambda p: xv.write_kml(shape, p)), ("geojsonl", lambda p: tv.write_geojsonl(shape, p))):
        write(str(tmp_path / name))
        assert dispatch.read_source(spark, str(tmp_path / name), name).select(g.to_wkt(F.col("geom"))).first()[0] == "POINT (1 2)"
    # Files whose roots say what they are need no name.
    assert dispatch.read_source(spark, str(tmp_path / "kml")).select(g.to_wkt(F.col("geom"))).first()[0] == "POINT (1 2)"
    (tmp_path / "x.dwg").write_bytes(b"AC1032" + bytes(20))
    (tmp_path / "odd.bin").write_bytes(b"\x00\x01")
    with pytest.raises(Refused, match="outside converter.*dxf"):
        dispatch.read_source(spark, str(tmp_path / "x.dwg"))
    with pytest.raises(Refused, match="name its format"):
        dispatch.read_source(spark, str(tmp_path / "odd.bin"))
    with pytest.raises(Refused, match="several formats"):
        dispatch.read_source(spark, str(tmp_path / "*.*"))
    with pytest.raises(Refused, match="no reader"):
        dispatch.read_source(spark, str(tmp_path), "mystery")


def test_evidence_in_headers_and_beside_files(spark):
    def archive(*names):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return raw.getvalue()

    def las(point_format, size=227, major=1):
        raw = bytearray(227)
        raw[:4], raw[24], raw[25], raw[94:96], raw[104] = b"LASF", major, 2, size.to_bytes(2, "little"), point_format
        return bytes(raw)

    def shp(length):
        return (9994).to_bytes(4, "big") + bytes(20) + (length // 2).to_bytes(4, "big") + bytes(72)

    files = {
        "a/book.zip": archive("[Content_Types].xml"), "a/k.zip": archive("doc.kml"), "a/z.zip": archive("other"),
        "a/c.las": las(0), "a/d.las": las(3 | 128), "a/e.las": las(0, 9), "a/f.las": las(65, 227, 7),
        "a/g.shp": shp(100), "a/h.shp": shp(90), "b/G.dbf": b"x", "a/G.dbf": b"x", "a/i.tif": b"II*\0" + bytes(9), "a/i.tfw": b"1",
        "a/j.json": b'{"type": "FeatureCollection", "features": []}', "a/l.json": b'{"rows": [1]}', "a/m.json": b'{"rows": [1', "a/empty.json": b"",
    }
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    got = {r["path"]: (r["format"], r["confidence"] and round(r["confidence"], 6)) for r in detect.detected(df).collect()}
    all_of = lambda *w: round(1 - math.prod(1 - x for x in w), 6)
    assert {p: v for p, v in got.items() if not p.endswith((".dbf", ".tfw"))} == {
        "a/book.zip": ("xlsx", 0.85), "a/k.zip": ("kmz", 0.85), "a/z.zip": ("zip", all_of(0.35, 0.5)),
        "a/c.las": ("las", all_of(0.35, 0.5, 0.85)), "a/d.las": ("laz", 0.85), "a/e.las": ("las", all_of(0.35, 0.5)), "a/f.las": ("las", all_of(0.35, 0.5)),
        "a/g.shp": ("shapefile", all_of(0.35, 0.5, 0.85, 0.25)), "a/h.shp": ("shapefile", all_of(0.35, 0.5)),
        "a/i.tif": ("geotiff", all_of(0.35, 0.5, 0.85, 0.25)),
        "a/j.json": ("geojson", all_of(0.35, 0.85)), "a/l.json": (None, None), "a/m.json": ("geojson", 0.35), "a/empty.json": ("geojson", 0.35),
    }
