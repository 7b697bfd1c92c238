"""The door to geometry operations: refusals, results, undoing."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import crs
from plumbline.functions import geometry as g
from plumbline.operators.operations import OPERATIONS, plan_operation
from plumbline.operators.table import Refused

UTM, DEGREES = crs.crs_from_epsg(32644), crs.crs_from_epsg(4326)


def square(x, y, s=10.0):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


@pytest.fixture(scope="module")
def plots(spark):
    rows = [(1, "a", ("Polygon", [[square(0.0, 0.0)]])), (2, "a", ("Polygon", [[square(10.0, 0.0)]])), (3, "b", ("MultiPolygon", [[square(5.0, 5.0)], [square(40.0, 40.0)]]))]
    return spark.createDataFrame(rows, f"idx int, k string, geom {g.GEOMETRY}")


def area(plan):
    return round(plan.features.agg(F.sum(g.area(F.col("geom"))).alias("a")).first()["a"], 3)


def test_distances_need_a_projected_system(plots):
    for op in ("buffer", "offset"):
        for system, why in ((None, "no system"), (DEGREES, "degrees")):
            with pytest.raises(Refused, match=why):
                plan_operation(plots, op, system, distance=1.0)
        with pytest.raises(Refused, match="zero"):
            plan_operation(plots, op, UTM, distance=0)
    assert abs(area(plan_operation(plots, "buffer", UTM, F.col("idx") == 1, distance=1.0)) - (100 + 40 + math.pi)) < 0.2


def test_refusals(plots):
    for given, why in (({"operation": "melt"}, "no operation"), ({"operation": "union"}, "needs cell"), ({"operation": "centroid", "protected": True}, "protected"),
                       ({"operation": "centroid", "scope": F.col("idx") > 9}, "empty"), ({"operation": "difference", "cell": 9.0, "scope": F.col("idx") == 1}, "two polygons"),
                       ({"operation": "offset", "crs": UTM, "distance": 1.0, "side": "up"}, "no side")):
        with pytest.raises(Refused, match=why):
            plan_operation(plots, **given)


def test_results_scopes_and_undoing(spark, plots):
    done = plan_operation(plots, "explode", scope=F.col("idx") == 3)
    assert done.applied().count() == 4 and done.untouched.count() == 2 and done.undone() is plots
    assert area(plan_operation(plots, "union", cell=9.0)) == 350.0 and area(plan_operation(plots, "dissolve", field="k", cell=9.0)) == 400.0
    assert area(plan_operation(plots, "convex-hull")) > 350 and area(plan_operation(plots, "envelope", scope=F.col("idx") == 3)) == 45.0**2
    turned = plan_operation(plots, "rotate", degrees=90.0)
    assert area(turned) == 400.0 and turned.notes == ["about (25, 25)"]
    assert area(plan_operation(plots, "scale", factor=2.0, anchor=(0, 0))) == 1600.0 and area(plan_operation(plots, "translate", dx=3, dy=4)) == 400.0
    mask = spark.createDataFrame([(9, ("Polygon", [[square(0.0, 0.0, 5.0)]]))], f"idx int, geom {g.GEOMETRY}")
    assert area(plan_operation(plots, "clip", mask=mask, cell=9.0)) == 25.0 and area(plan_operation(plots, "erase", mask=mask, cell=9.0)) == 375.0
    cut = spark.createDataFrame([([[-1.0, 4.0], [60.0, 4.0]],)], "path array<array<double>>")
    parts = plan_operation(plots, "split-by-line", cut=cut, cell=9.0, scope=F.col("idx") < 3)
    assert parts.features.columns == plots.columns and parts.applied().count() == 5 and area(parts) == 200.0
    assert plan_operation(plots, "centroid").features.select(F.col("geom.type")).distinct().first()[0] == "Point"
    assert set(OPERATIONS) >= {"intersection", "symmetric-difference"}


def test_offsets(spark, plots):
    rows = [(1, ("LineString", [[[[0.0, 0.0], [10.0, 0.0], [10.0, 0.0], [10.0, 10.0]]]])), (2, ("LineString", [[[[0.0, 0.0], [10.0, 0.0], [0.0, 0.1]]]])), (3, ("LineString", [[[[5.0, 5.0]]]]))]
    lines = spark.createDataFrame(rows, f"idx int, geom {g.GEOMETRY}")
    got = {r["idx"]: [[round(v, 6) for v in p] for p in r["geom"]["parts"][0][0]] for r in plan_operation(lines, "offset", UTM, distance=2.0).features.collect()}
    assert got[1] == [[0.0, 2.0], [8.0, 2.0], [8.0, 10.0]] and got[3] == [[5.0, 5.0]]
    assert len(got[2]) == 4  # a hairpin is cut off on either side
    right = {r["idx"]: r["geom"]["parts"][0][0] for r in plan_operation(lines, "offset", UTM, distance=-2.0).features.collect()}
    assert len(right[2]) == 4 and [round(v, 6) for v in right[1][1]] == [12.0, -2.0]
    sides = {s: plan_operation(plots, "offset", UTM, F.col("idx") == 1, distance=2.0, side=s).features.select(F.size("geom.parts").alias("n"), g.length(F.col("geom")).alias("l")).first() for s in ("inside", "outside", "both")}
    assert (sides["inside"]["n"], round(sides["inside"]["l"], 6)) == (1, 24.0) and sides["both"]["n"] == 2
    assert abs(sides["outside"]["l"] - (40 + 4 * math.pi)) < 0.3
