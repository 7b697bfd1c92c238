import json
import zipfile

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.sources import packages


def test_workbook(spark, tmp_path):
    m = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Name</t></si><si><r><t>P</t></r><r><t>1</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {m}><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='AB1' t='inlineStr'><is><t>X</t></is></c></row>"
                   "<row r='2'><c r='A2' t='s'><v>1</v></c><c r='AB2'><v>2.5</v></c></row></sheetData></worksheet>")  # fmt: skip
    cells = packages.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert {(r["row"], r["col"], r["text"]) for r in cells.collect()} == {(0, 0, "Name"), (0, 27, "X"), (1, 0, "P1"), (1, 27, "2.5")}
    assert [tuple(r) for r in packages.sheet_table(cells, "sheet1").collect()] == [("P1", "2.5")]


def test_topojson(spark, tmp_path):
    t = {
        "type": "Topology", "transform": {"scale": [2, 2], "translate": [100, 0]}, "arcs": [[[0, 0], [1, 0]], [[1, 0], [0, 1], [-1, 0], [0, -1]], [[1, 1], [1, 1]]],
        "objects": {"plots": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "id": 7, "arcs": [[0, 1]], "properties": {"a": 1}}, {"type": "LineString", "arcs": [~2]}, {"type": None}]}},
    }
    (tmp_path / "a.topojson").write_text(json.dumps(t))
    rows = packages.read_topojson(spark, str(tmp_path / "a.topojson")).select("id", "properties", g.to_wkt(F.col("geom")).alias("w")).collect()
    assert [r["w"] for r in rows] == ["POLYGON ((100 0, 102 0, 102 2, 100 2, 100 0))", "LINESTRING (104 4, 102 2)", None]
    assert rows[0]["id"] == "7" and rows[0]["properties"] == {"a": "1"}


def test_projection_text():
    prj = ('PROJCS["WGS 84 / UTM zone 44N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],'
           'UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]],PROJECTION["Transverse_Mercator"],PARAMETER["central_meridian",81],'
           'PARAMETER["scale_factor",0.9996],UNIT["metre",1],AUTHORITY["EPSG","32644"]]')  # fmt: skip
    out = packages.parse_prj(prj)
    assert (out["kind"], out["epsg"], out["projection"], out["unit"]) == ("projected", 32644, "Transverse_Mercator", "metre")
    assert out["parameters"] == {"central_meridian": 81.0, "scale_factor": 0.9996} and out["ellipsoid"] == (6378137.0, 298.257223563)
