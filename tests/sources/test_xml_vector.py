"""XML formats: what is written is read again; axis orders, folders, collections, curves, odd names and odd rows."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.table import Refused
from plumbline.sources import text_vector as tv
from plumbline.sources import xml_vector as xv

SHAPES = [
    ("a<&\"'>b", "POINT (77.5 12.25)"), ("z", "POINT Z (77.5 12.25 3.5)"), ("l", "LINESTRING (1 2, 3 4.5, 5 6)"),
    ("p", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1))"), ("mp", "MULTIPOINT ((1 2), (3 4))"),
    ("ml", "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))"), ("mg", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.5 5.1, 5.6 5.1, 5.6 5.2, 5.5 5.1)))"),
]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = spark.createDataFrame([*SHAPES, ("none", None)], "name string, w string")
    return rows.select("name", F.lit(7).alias("2 n&o"), F.lit(None).cast("string").alias("empty"), tv.from_wkt(F.col("w")).alias("geom")).repartition(3)


def wkt(df, key="name"):
    return {r[0]: r[1] for r in df.select(key, g.to_wkt(F.col("geom"))).collect()}


def test_kml_and_kmz_are_read_as_written(spark, shapes, tmp_path):
    want = dict([*SHAPES, ("none", None)])
    xv.write_kml(shapes, str(tmp_path / "k"), name="name")
    back = xv.read_kml(spark, str(tmp_path / "k"))
    assert wkt(back) == want
    assert {tuple(r["properties"].items()) for r in back.collect()} == {(("2 n&o", "7"),)}
    xv.write_kmz(shapes, str(tmp_path / "z"), name="name", rows=2)
    names = os.listdir(tmp_path / "z")
    assert len(names) >= 4
    assert all(n.endswith(".kmz") and zipfile.ZipFile(tmp_path / "z" / n).namelist() == ["doc.kml"] for n in names)
    assert wkt(xv.read_kmz(spark, str(tmp_path / "z"))) == want
    with zipfile.ZipFile(tmp_path / "no.kmz", "w") as z:
        z.writestr("picture.png", b"1")
    with pytest.raises(Refused):
        xv.read_kmz(spark, str(tmp_path / "no.kmz"))


def test_kml_folders_and_mixed_collections(spark, tmp_path):
    point = lambda n: f"<Placemark><name>{n}</name><Point><coordinates>1,2</coordinates></Point></Placemark>"
    (tmp_path / "a.kml").write_text(
        f"<kml><Document><name>d</name>{point('out')}<Folder><name>Pit</name>{point('a')}<Folder><name>Bench</name>{point('b')}{point('c')}</Folder><Folder>{point('d')}</Folder></Folder>"
        f"<Folder><name>Dump</name>{point('e')}</Folder>"
        "<Placemark id='7'><name>mix</name><ExtendedData><SchemaData><SimpleData name='k'>1</SimpleData><SimpleData name='k'>2</SimpleData></SchemaData></ExtendedData>"
        "<MultiGeometry><Point><coordinates>1,2</coordinates></Point><LineString><coordinates>1,2 3,4\n5,6</coordinates></LineString></MultiGeometry></Placemark></Document></kml>"
    )
    rows = {r["name"]: r["layer"] for r in xv.read_kml_folders(spark, str(tmp_path / "a.kml")).collect()}
    assert rows == {"a": "Pit", "b": "Pit / Bench", "c": "Pit / Bench", "d": "Pit", "e": "Dump"}
    flat = xv.read_kml(spark, str(tmp_path / "a.kml"))
    assert {r["name"] for r in flat.collect()} == {"out", "a", "b", "c", "d", "e", "mix"}
    mix = flat.where("name = 'mix'").select("id", "properties", g.to_wkt(F.col("geom")).alias("w")).collect()
    assert {r["w"] for r in mix} == {"POINT (1 2)", "LINESTRING (1 2, 3 4, 5 6)"}
    assert mix[0]["properties"] == {"k": "2"} and mix[0]["id"] == "7"


def test_gpx_is_read_as_written(spark, shapes, tmp_path):
    some = shapes.where("name not in ('mg', 'mp')")
    xv.write_gpx(some, str(tmp_path / "g"), name="name", routes=True)
    back = wkt(xv.read_gpx(spark, str(tmp_path / "g")))
    want = dict(SHAPES)
    assert back == {n: want[n] for n in ("a<&\"'>b", "z", "l", "ml")} | {"p": "MULTILINESTRING ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1))"}
    (tmp_path / "a.gpx").write_text("<gpx><wpt lat='1'><name>half</name></wpt><rte><name>r</name><rtept lat='1' lon='2'/></rte><trk><trkseg/></trk><trk><trkseg><trkpt lat='1' lon='2'/></trkseg></trk></gpx>")
    assert xv.read_gpx(spark, str(tmp_path / "a.gpx")).count() == 0


@pytest.mark.parametrize("epsg", [4326, 32643])
def test_gml_is_read_as_written(spark, shapes, tmp_path, epsg):
    xv.write_gml(shapes, str(tmp_path / "m"), epsg, "lot", id_col="name")
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "m")).collect())
    assert ("12.25 77.5" in text) == (epsg == 4326)
    back = xv.read_gml(spark, str(tmp_path / "m"))
    assert wkt(back, "id") == dict(SHAPES)
    r = back.first()
    assert (r["layer"], r["srs"], r["properties"]) == ("lot", f"urn:ogc:def:crs:EPSG::{epsg}", {"_2_n_o": "7"})


def test_gml_of_others(spark, tmp_path):
    (tmp_path / "a.gml").write_text(
        "<gml:FeatureCollection xmlns:gml='http://www.opengis.net/gml' xmlns:u='urn:u'>"
        "<gml:featureMember><u:mark gml:id='m1'><u:Point>BM1</u:Point><u:geom><gml:Point srsName='urn:ogc:def:crs:EPSG::4326'><gml:pos>12 77</gml:pos></gml:Point></u:geom></u:mark></gml:featureMember>"
        "<gml:featureMember><u:mark><u:Point>BM2</u:Point><u:geom><gml:Point srsName='EPSG:4326'><gml:coordinates>77,12</gml:coordinates></gml:Point></u:geom></u:mark></gml:featureMember>"
        "<gml:featureMember><u:mark><u:Point>BM3</u:Point><u:geom><gml:Point srsName='urn:ogc:def:crs:OGC:1.3:CRS84'><gml:pos>77 12 5</gml:pos></gml:Point></u:geom></u:mark></gml:featureMember>"
        "<gml:featureMember><u:mark><u:Point>none</u:Point></u:mark></gml:featureMember>"
        "<gml:featureMember><u:road><u:shape><gml:Curve srsDimension='3'><gml:segments><gml:LineStringSegment><gml:posList>1 2 3 4 5 6</gml:posList></gml:LineStringSegment>"
        "<gml:LineStringSegment><gml:posList>4 5 6 7 8 9</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve></u:shape></u:road></gml:featureMember>"
        "<gml:featureMember><u:area><u:shape><gml:Surface><gml:patches><gml:PolygonPatch><gml:exterior><gml:LinearRing><gml:pos>0 0</gml:pos><gml:pos>1 0</gml:pos><gml:pos>1 1</gml:pos><gml:pos>0 0</gml:pos>"
        "</gml:LinearRing></gml:exterior></gml:PolygonPatch></gml:patches></gml:Surface></u:shape></u:area></gml:featureMember></gml:FeatureCollection>"
    )
    back = xv.read_gml(spark, str(tmp_path / "a.gml"), srs="EPSG:32643")
    got = {(r["layer"], r["properties"].get("Point"), r["w"], r["srs"]) for r in back.select("*", g.to_wkt(F.col("geom")).alias("w")).collect()}
    assert got == {
        ("mark", "BM1", "POINT (77 12)", "urn:ogc:def:crs:EPSG::4326"), ("mark", "BM2", "POINT (77 12)", "EPSG:4326"),
        ("mark", "BM3", "POINT Z (77 12 5)", "urn:ogc:def:crs:OGC:1.3:CRS84"), ("road", None, "LINESTRING Z (1 2 3, 4 5 6, 7 8 9)", "EPSG:32643"),
        ("area", None, "POLYGON ((0 0, 1 0, 1 1, 0 0))", "EPSG:32643"),
    }
    (tmp_path / "b.gml").write_text("<c><gml:featureMember><x><y>1</y></x></gml:featureMember></c>")
    with pytest.raises(Refused):
        xv.read_gml(spark, str(tmp_path / "b.gml"))


def test_landxml_is_read_as_written(spark, shapes, tmp_path):
    xv.write_landxml(shapes, str(tmp_path / "x"), "name", code="2 n&o")
    back = xv.read_landxml(spark, str(tmp_path / "x"))
    assert wkt(back) == {
        "a<&\"'>b": "POINT (77.5 12.25)", "z": "POINT Z (77.5 12.25 3.5)", "l": "LINESTRING (1 2, 3 4.5, 5 6)", "p": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))",
        "mp.1": "POINT (1 2)", "mp.2": "POINT (3 4)", "ml.1": "LINESTRING (1 2, 3 4)", "ml.2": "LINESTRING (5 6, 7 8)",
        "mg.1": "POLYGON ((0 0, 1 0, 1 1, 0 0))", "mg.2": "POLYGON ((5 5, 6 5, 6 6, 5 5))",
    }
    assert {r["properties"].get("code") for r in back.where("layer = 'CgPoints'").collect()} == {"7"}
    with pytest.raises(Refused):
        xv.write_landxml(shapes, str(tmp_path / "y"), "name", decimals=16)


def test_landxml_curves_gaps_and_bad_points(spark, tmp_path):
    side = lambda tag, a, b: f"<{tag}><Start>{a}</Start><End>{b}</End></{tag}>"
    (tmp_path / "a.xml").write_text(
        "<LandXML><CgPoints><CgPoint name='1' desc=''>10 20</CgPoint><CgPoint name='2'>x y</CgPoint></CgPoints><Parcels>"
        f"<Parcel name='bent' area='12'><CoordGeom>{side('Curve', '0 0', '0 4')}{side('Line', '0 4', '3 4')}{side('Curve', '3 4', '3 0')}{side('Line', '3 0', '0 0')}</CoordGeom></Parcel>"
        f"<Parcel name='gap'><CoordGeom>{side('Line', '0 0', '0 4')}{side('Line', '1 4', '3 0')}</CoordGeom></Parcel>"
        f"<Parcel name='flat'><CoordGeom>{side('Line', '0 0', '0 4')}</CoordGeom></Parcel><Parcel name='none'/></Parcels>"
        f"<PlanFeatures><PlanFeature name='w'><CoordGeom>{side('Line', '0 0', '0 1')}{side('Spiral', '0 1', '1 2')}{side('Line', '1 2', '2 2')}</CoordGeom></PlanFeature></PlanFeatures></LandXML>"
    )
    back = xv.read_landxml(spark, str(tmp_path / "a.xml"))
    got = {r["name"]: (r["w"], r["chords"]) for r in back.select("*", g.to_wkt(F.col("geom")).alias("w")).collect()}
    assert got == {
        "1": ("POINT (20 10)", 0), "bent": ("POLYGON ((4 0, 4 3, 0 3, 0 0, 4 0))", 2), "gap": ("POLYGON ((0 0, 4 0, 4 1, 0 3, 0 0))", 0), "w": ("LINESTRING (0 0, 1 0, 2 1, 2 2)", 1),
    }


def test_empty_layers_write_no_documents(spark, shapes, tmp_path):
    none = shapes.where("name = '?'")
    for k, write in enumerate((lambda p: xv.write_kml(none, p), lambda p: xv.write_gpx(none, p), lambda p: xv.write_gml(none, p, 4326), lambda p: xv.write_landxml(none, p, "name"), lambda p: xv.write_kmz(none, p))):
        write(str(tmp_path / str(k)))
        assert not [n for n in os.listdir(tmp_path / str(k)) if os.path.getsize(tmp_path / str(k) / n) and not n.startswith((".", "_"))]
