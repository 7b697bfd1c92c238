import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.table import Refused
from plumbline.sources import binary_vector as bv
from plumbline.sources import splittable, tables
from plumbline.sources import text_vector as tv
from plumbline.sources import xml_vector as xv

WKT = [
    "POINT (1 2)",
    "POINT Z (1 2 3)",
    "LINESTRING (0 0, 1.5 -2, 3e2 4)",
    "POLYGON ((0 0, 10 0, 10 10, 0 0), (1 1, 2 1, 2 2, 1 1))",
    "MULTIPOINT ((1 2), (3 4))",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))",
]


@pytest.fixture()
def shapes(spark):
    return spark.createDataFrame(list(enumerate(WKT)), "id long, wkt string").withColumn("geom", tv.from_wkt(F.col("wkt")))


def test_wkt(spark, shapes, tmp_path):
    rows = shapes.select("wkt", g.to_wkt(F.col("geom")).alias("back"), F.col("geom.type").alias("t")).collect()
    assert [r["back"].replace("300 4", "3e2 4") for r in rows] == WKT
    tv.write_wkt(shapes, str(tmp_path / "w"), srid=32644)
    again = tv.read_wkt(spark, str(tmp_path / "w"))
    assert again.where("srid = '32644' and geom is not null").count() == len(WKT)
    odd = spark.createDataFrame([("MULTIPOINT (1 2, 3 4)",), ("nonsense",), (None,), ("SRID=4326;POINT(.5 -.5)",)], "w string")
    got = [r[0] for r in odd.select(g.to_wkt(tv.from_wkt(F.col("w")))).collect()]
    assert got == ["MULTIPOINT ((1 2), (3 4))", None, None, "POINT (0.5 -0.5)"]


def test_geojson(spark, shapes, tmp_path):
    shapes = shapes.withColumn("name", F.when(F.col("id") > 0, F.concat(F.lit('a "'), "id")))
    tv.write_geojsonl(shapes.drop("wkt"), str(tmp_path / "l"), id_col="id")
    lines = tv.read_geojsonl(spark, str(tmp_path / "l"))
    assert {(r["id"], r["properties"]["name"]) for r in lines.collect()} == {(str(i), f'a "{i}' if i else None) for i in range(len(WKT))}
    assert lines.join(shapes, lines["geom"] == shapes["geom"]).count() == len(WKT)
    tv.write_geojson(shapes.drop("wkt").coalesce(2), str(tmp_path / "c"))
    for f in (tmp_path / "c").glob("part-*"):
        assert not f.read_text().strip() or json.loads(f.read_text())["type"] == "FeatureCollection"
    assert tv.read_geojson(spark, str(tmp_path / "c")).where("geom is not null").count() == len(WKT)


def test_wkb_and_geoparquet(spark, shapes, tmp_path):
    back = shapes.select((bv.from_wkb(bv.to_wkb(F.col("geom"))) == F.col("geom")).alias("same"))
    assert [r["same"] for r in back.collect()] == [True] * len(WKT)
    bv.write_geoparquet(shapes, str(tmp_path / "g"))
    assert bv.read_geoparquet(spark, str(tmp_path / "g")).join(shapes, "geom").count() == len(WKT)
    assert bv.decode(bytes.fromhex("00000000013FF00000000000004000000000000000")) == ("Point", [[[[1.0, 2.0]]]])
    assert bv.decode(bytes.fromhex("01010000A0E6100000000000000000F03F00000000000000400000000000000840")) == ("Point", [[[[1.0, 2.0, 3.0]]]])


def test_kml_and_gpx(spark, tmp_path):
    (tmp_path / "a.kml").write_text(
        "<kml><Document><Folder><Placemark><name>p</name><ExtendedData><Data name='k'><value>v</value></Data></ExtendedData>"
        "<Point><coordinates>77.5,12.9,5</coordinates></Point></Placemark>"
        "<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,0</coordinates></LinearRing></outerBoundaryIs>"
        "<innerBoundaryIs><LinearRing><coordinates>1,.5 2,.5 2,1 1,.5</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark></Folder></Document></kml>"
    )
    rows = xv.read_kml(spark, str(tmp_path / "a.kml")).select("name", g.to_wkt(F.col("geom")).alias("w"), "properties").collect()
    assert {r["w"] for r in rows} == {"POINT Z (77.5 12.9 5)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))"}
    assert rows[0]["properties"] == {"k": "v"}
    (tmp_path / "a.gpx").write_text(
        "<gpx><wpt lat='1' lon='2'><name>w</name></wpt><trk><name>t</name><trkseg><trkpt lat='1' lon='2'><ele>3</ele></trkpt><trkpt lat='4' lon='5'/></trkseg></trk></gpx>"
    )
    assert {r[0] for r in xv.read_gpx(spark, str(tmp_path / "a.gpx")).select(F.col("geom.type")).collect()} == {"Point", "MultiLineString"}


def test_surpac(spark, tmp_path):
    (tmp_path / "a.str").write_text("head,date\n0, 0, 0, 0\n1, 10, 20, 5, d\n1, 11, 21, 5\n0, 0, 0, 0\n2, 1, 2, 3\n2, 3, 4, 5\n0, 0, 0, 0, END\n")
    rows = tv.read_surpac(spark, str(tmp_path)).select("string", g.to_wkt(F.col("geom")).alias("w")).orderBy("string").collect()
    assert [tuple(r) for r in rows] == [(1, "LINESTRING Z (20 10 5, 21 11 5)"), (2, "LINESTRING Z (2 1 3, 4 3 5)")]


def test_csv_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Boundary pillars,,,\n# made by hand\nSl No,NORTHING,EASTING,Code\n1,100.5,200.25,007\n2,101,201,"a, b"\n3,,202,\n')
    df, roles = tables.read_csv_table(spark, str(tmp_path / "a.csv"))
    assert roles == {"x": "EASTING", "y": "NORTHING", "id": "Sl No", "code": "Code"}
    assert [tuple(r) for r in df.orderBy("Sl No").collect()] == [(1.0, 100.5, 200.25, "007"), (2.0, 101.0, 201.0, "a, b"), (3.0, None, 202.0, None)]
    (tmp_path / "b.txt").write_text("1 10.0 20.0\n2 11.0 21.0\n")
    df, roles = tables.read_csv_table(spark, str(tmp_path / "b.txt"))
    assert df.columns == ["column_1", "column_2", "column_3"] and df.count() == 2


def test_clouds(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# c\n1 2 3 10 20 30\n4,5,6,7\n\n")
    rows = tables.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("x").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 3, None, 10, 20, 30), (4, 5, 6, 7, None, None, None)]
    pts = np.array([[1.5, 2.25, 3.125], [10.001, -5.5, 100.0]])
    (tmp_path / "a.las").write_bytes(splittable.las_bytes(pts, np.array([5, 60000]), np.array([2, 6])))
    got = splittable.read_las(spark, str(tmp_path / "a.las")).orderBy("idx").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], pts, atol=0.0006)
    assert [(r["intensity"], r["classification"], r["red"]) for r in got] == [(5, 2, None), (60000, 6, None)]
    raw = bytearray(splittable.las_bytes(pts, np.array([5, 6]), np.array([2, 6])))
    raw[104] |= 0x80
    (tmp_path / "b.las").write_bytes(raw)
    with pytest.raises(Exception, match="LAZ"):
        splittable.read_las(spark, str(tmp_path / "b.las")).count()


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 4\nnrows 3\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2 3 4\n5 6 -9999 8\n9 10 11 12\n")
    px, grid = tables.read_ascii_grid(spark, str(tmp_path / "a.asc"))
    assert grid.geotransform == (100, 10, 0, 230, 0, -10)
    assert [r["value"] for r in px.orderBy("row", "col").collect()] == [1, 2, 3, 4, 5, 6, -9999, 8, 9, 10, 11, 12]
    tables.write_ascii_grid(px.where("value > 0"), str(tmp_path / "out"), grid)
    again, same = tables.read_ascii_grid(spark, str(tmp_path / "out"))
    assert same == grid and again.join(px, ["row", "col", "value"]).count() == 12


def test_archives_and_companions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/Plan.SHP", b"x")
        z.writestr("d/plan.dbf", b"y" * 100)
    files = bv.expand_archives(spark, str(tmp_path / "a.zip"))
    assert {(r["name"], bytes(r["content"])) for r in files.collect()} == {("d/Plan.SHP", b"x"), ("d/plan.dbf", b"y" * 100)}
    groups = bv.group_companions(files.select(F.col("name").alias("path")), {"shp": ["shx", "dbf"]}).collect()
    assert [(r["base"], r["missing"]) for r in groups] == [("plan", ["shx"])]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil", b"x")
    with pytest.raises(Exception, match="unsafe"):
        bv.expand_archives(spark, str(tmp_path / "b.zip")).count()


def test_affine_fit(spark):
    rows = [(x, y, 3 + 2 * x - y, 5 + x + 4 * y) for x, y in ((0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (7.0, 3.0))]
    df = spark.createDataFrame(rows, "source_x double, source_y double, map_x double, map_y double")
    terms, rms = tables.fit_affine(df)
    assert np.allclose(terms, [3, 2, -1, 5, 1, 4]) and rms < 1e-6
    with pytest.raises(Refused):
        tables.fit_affine(df.limit(2))
