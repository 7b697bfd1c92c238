"""Label collisions, squared shapes, points inside, planned warps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import crs
from plumbline.functions import geometry as g
from plumbline.operators import labels, raster, vector
from plumbline.operators.table import Refused


@pytest.mark.parametrize("seed, spread", [(1, 40.0), (2, 9.0)])
def test_labels_are_those_of_one_after_another(spark, seed, spread):
    rnd = random.Random(seed)
    rows = [(k, "x" * rnd.randint(0, 9) if k % 17 else None, rnd.uniform(0, spread), rnd.uniform(0, spread), float(rnd.randint(0, 5))) for k in range(160)]
    rows += [(200, "none", None, 1.0, 1.0), (201, "none", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "idx int, text string, x double, y double, clearance double")
    got = {r["idx"]: r["suppressed"] for r in labels.resolve_collisions(df, 1.0, 5.0).collect()}
    placed, want = [], {}
    for k, t, x, y, c in sorted((r for r in rows if None not in (r[2], r[4])), key=lambda r: (-r[4], r[0])):
        w = len(t or "") * 0.3
        want[k] = any(abs(x - a) < w + b and abs(y - d) < 1.0 for a, d, b in placed)
        if not want[k]:
            placed.append((x, y, w))
    assert got == want | {200: False, 201: False}
    assert any(want.values()) and labels.resolve_collisions(df.limit(0), 1.0, 5.0).count() == 0


def test_skewed_squares_come_square_in_their_own_frame(spark):
    turn = lambda p, a: (p[0] * math.cos(a) - p[1] * math.sin(a) + 100, p[0] * math.sin(a) + p[1] * math.cos(a) + 50)
    skewed = [(0.0, 0.0), (20.0, 0.0), (20.4, 10.2), (0.3, 9.8), (0.0, 0.0)]
    ring = vector.squared([turn(p, 0.7) for p in skewed], 10.0)
    assert ring[0] == ring[-1] and len(ring) == 5
    for a, b, c in zip(ring, ring[1:], [*ring[2:], ring[1]]):
        assert abs((b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1])) < 1e-9
    # A real diagonal stays, and so do heights, open lines' ends and triangles.
    house = [(0.0, 0.0, 1.0), (20.0, 0.1, 2.0), (20.0, 10.0, 3.0), (10.0, 16.0, 4.0), (0.0, 10.0, 5.0), (0.0, 0.0, 1.0)]
    out = vector.squared(house, 5.0)
    assert [p[2] for p in out] == [p[2] for p in house] and abs(out[3][0] - 10) < 0.1 and abs(out[3][1] - 16) < 0.2
    assert vector.squared(house[:3], 5.0) == house[:3]
    df = spark.createDataFrame([(1, ("Polygon", [[[list(turn(p, 0.7)) for p in skewed]]])), (2, None)], f"idx int, geom {g.GEOMETRY}")
    rows = vector.regularise(df).orderBy("idx").collect()
    assert 0.1 < rows[0]["moved_by"] < 0.5 and rows[1]["geom"] is None and rows[1]["moved_by"] is None


def test_points_are_inside(spark):
    c = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 8), (10, 8), (10, 10), (0, 10), (0, 0)]
    frame = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1)]]
    rnd = random.Random(3)
    stars = [[(math.cos(k / 9 * 2 * math.pi) * r, math.sin(k / 9 * 2 * math.pi) * r) for k, r in enumerate(rnd.uniform(1, 10) for _ in range(9))] for _ in range(20)]
    shapes = [[c], frame, *[[[*s, s[0]]] for s in stars]]
    rows = [(k, ("Polygon", [[[list(map(float, p)) for p in r] for r in s]])) for k, s in enumerate(shapes)]
    rows += [(90, ("LineString", [[[[0.0, 0.0], [1.0, 1.0]]]])), (91, ("Polygon", [[[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]])), (92, None)]
    df = spark.createDataFrame(rows, f"idx int, geom {g.GEOMETRY}").withColumn("p", g.representative_point(F.col("geom")))
    got = {r["idx"]: (r["p"], r["ok"]) for r in df.select("idx", "p", g.in_polygon(F.col("p")[0], F.col("p")[1], F.col("geom")).alias("ok")).collect()}
    assert all(got[k][1] for k in range(len(shapes))) and all(got[k][0] is None for k in (90, 91, 92))


def test_a_warp_to_mercator_is_planned_from_the_edges(spark):
    utm, mercator = crs.crs_from_epsg(32644), crs.crs_from_epsg(3857)
    t = (400000.0, 50.0, 0.0, 2650000.0, 0.0, -50.0)
    pixels = spark.range(40 * 30).select(F.lit(1).alias("band"), (F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    out, w, h, to = raster.reproject(pixels, 40, 30, t, utm, mercator, no_data=-1.0)
    assert 0.7 < w * h / 1200 < 1.4 and to[1] == -to[5] and out.count() == w * h
    rows = out.where("value >= 0").collect()
    assert 900 < len(rows) <= 1250
    # A pixel's middle, taken back to UTM by hand, lies in the pixel whose value it has.
    back = crs.plan_transform(mercator, utm)
    mid = [to[0] + (F.col("col") + 0.5) * to[1], to[3] + (F.col("row") + 0.5) * to[5]]
    x, y = back(*mid, F.lit(None).cast("double"))
    for r in out.where("value >= 0").select("value", ((x - t[0]) / 50).alias("c"), ((t[3] - y) / 50).alias("r")).collect():
        assert int(r["value"]) == math.floor(r["r"]) * 40 + math.floor(r["c"])
    assert raster.reproject(pixels, 40, 30, t, utm, utm)[1:] == (40, 30, t)
    with pytest.raises((crs.NoTransform, Refused)):
        raster.reproject(pixels, 40, 30, t, utm, crs.Crs(9999, "other", "projected"))


def test_steps_of_representative_points_are_worked_out_once(spark):
    """Lambdas aren't searched for common parts: what they name is worked out again for each vertex."""
    df = spark.createDataFrame([], f"geom {g.GEOMETRY}").select(g.representative_point(F.col("geom")).alias("p"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_distinct") == 1
