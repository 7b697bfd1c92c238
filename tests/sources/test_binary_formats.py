import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.sources import binary_formats as bf
from plumbline.sources import splittable
from plumbline.sources import text_vector as tv


def test_shapefile(spark, tmp_path):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    hole = [[2.0, 2.0], [2.0, 4.0], [4.0, 4.0], [4.0, 2.0], [2.0, 2.0]]
    far = [[x + 50, y] for x, y in square]
    shapes = [("Polygon", [[square, hole]]), ("MultiPolygon", [[square], [far]])]
    for ext, raw in zip(("shp", "shx", "DBF"), bf.shapefile_bytes(shapes, [{"name": "a"}, {"name": None}], {"name": 8}), strict=True):
        (tmp_path / f"p.{ext}").write_bytes(raw)
    rows = bf.read_shapefile(spark, str(tmp_path)).select("idx", "geom.type", g.area(F.col("geom")).alias("a"), "properties").orderBy("idx").collect()
    assert [(r["type"], r["a"], r["properties"]["name"]) for r in rows] == [("Polygon", 96.0, "a"), ("MultiPolygon", 200.0, None)]
    raw = bf.shapefile_bytes([("Point", [[[[1.5, 2.5]]]])], [], {"n": 1})[0]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q.shp").write_bytes(raw)
    assert [r[0] for r in bf.read_shapefile(spark, str(tmp_path / "q")).select(g.to_wkt(F.col("geom"))).collect()] == ["POINT (1.5 2.5)"]


def test_geotiff(spark, tmp_path):
    t = (100.0, 2.0, 0.0, 50.0, 0.0, -2.0)
    for k, values in enumerate((np.arange(150 * 7).reshape(150, 7) % 251, np.linspace(-1, 1, 130).reshape(65, 2), np.array([[1.0, -70000.0]]))):
        for deflate in (True, False):
            raw = bf.geotiff_bytes(values.astype(float), t, deflate)
            assert bf.geotransform(raw) == t
            (tmp_path / f"{k}{deflate}.tif").write_bytes(raw)
            rows = splittable.read_geotiff(spark, str(tmp_path / f"{k}{deflate}.tif")).orderBy("row", "col").collect()
            assert np.array_equal([r["value"] for r in rows], values.ravel()) and {r["band"] for r in rows} == {1}


def test_codecs():
    assert bf._packbits(bytes([2, 1, 2, 3, 254, 9])) == b"\x01\x02\x03\x09\x09\x09"
    assert bf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_ply(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 0\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii 1.0") + "1 2 3 4 5 6\n7 8 9 10 11 12\n")
    rec = np.array([(1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)], np.dtype([*((c, "<f4") for c in "xyz"), *((c, "u1") for c in "rgb")]))
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + rec.tobytes())
    for name in "ab":
        rows = bf.read_ply(spark, str(tmp_path / f"{name}.ply")).orderBy("idx").collect()
        assert [tuple(r)[2:] for r in rows] == [(1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)]


def test_dxf(spark, tmp_path):
    e = "0\nSECTION\n2\nENTITIES\n"
    e += "0\nPOINT\n8\nCONTROL\n10\n1\n20\n2\n30\n3\n0\nLINE\n8\nROAD\n10\n0\n20\n0\n11\n5\n21\n5\n"
    e += "0\nLWPOLYLINE\n8\nPARCEL\n90\n3\n70\n1\n10\n0\n20\n0\n10\n4\n20\n0\n10\n4\n20\n4\n"
    e += "0\nARC\n8\nROAD\n10\n0\n20\n0\n40\n10\n50\n0\n51\n90\n0\nTEXT\n8\nLABELS\n10\n2\n20\n1\n40\n0.5\n1\n12/A\n0\nSPLINE\n8\nX\n0\nENDSEC\n0\nEOF\n"
    (tmp_path / "a.dxf").write_text(e)
    rows = bf.read_dxf(spark, str(tmp_path / "a.dxf")).select("entity", "layer", "text", "geom.type", g.length(F.col("geom")).alias("d"), g.area(F.col("geom")).alias("a")).collect()
    got = {r["entity"]: r for r in rows}
    assert set(got) == {"POINT", "LINE", "LWPOLYLINE", "ARC", "TEXT"} and got["TEXT"]["text"] == "12/A"
    assert got["LWPOLYLINE"]["a"] == 8 and abs(got["ARC"]["d"] - 15.708) < 0.02


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        "<osm><node id='1' lat='0' lon='0'/><node id='2' lat='0' lon='4'/><node id='3' lat='3' lon='4'><tag k='a' v='b'/></node>"
        "<way id='7'><nd ref='1'/><nd ref='2'/><nd ref='3'/><nd ref='1'/><tag k='building' v='yes'/></way><way id='8'><nd ref='3'/><nd ref='1'/></way></osm>"
    )
    rows = {r["id"]: r for r in tv.read_osm(spark, str(tmp_path / "a.osm")).select("id", "tags", g.to_wkt(F.col("geom")).alias("w")).collect()}
    assert rows["way/7"]["w"] == "POLYGON ((0 0, 4 0, 4 3, 0 0))" and rows["way/7"]["tags"] == {"building": "yes"}
    assert rows["way/8"]["w"] == "LINESTRING (4 3, 0 0)" and rows["node/3"]["tags"] == {"a": "b"} and len(rows) == 3
