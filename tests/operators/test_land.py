"""Reference systems against published coordinates, refusals, searches by brute force, and georeferencing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import crs
from plumbline.functions import geometry as g
from plumbline.operators import georeference, points, rules, spatial, tiles
from plumbline.operators.table import Refused
from plumbline.plans import land


def one(spark, *columns):
    return [float(x) for x in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()]


def test_utm_of_a_known_place(spark):
    # The CN tower as it is published: 17N 630084 4833438.
    east, north = one(spark, *crs.to_utm(F.lit(-79.387139), F.lit(43.642567)))
    assert abs(east - 630084) < 1 and abs(north - 4833438) < 1


def test_lambert_of_published_examples(spark):
    # The example of the two-parallel method of EPSG guidance note 7-2 (in US survey feet), and the way back.
    clarke = (6378206.4, 294.9786982)
    x, y = crs.lambert_conic(F.lit(-96.0), F.lit(28.5), -99.0, 27.0 + 50 / 60, 28.0 + 23 / 60, 30.0 + 17 / 60, clarke)
    foot = 1200 / 3937
    east, north = one(spark, x / foot + 2_000_000, y / foot)
    assert abs(east - 2963503.91) < 0.05 and abs(north - 254759.80) < 0.05
    lon, lat = one(spark, *crs.inverse_lambert_conic(x, y, -99.0, 27.0 + 50 / 60, 28.0 + 23 / 60, 30.0 + 17 / 60, clarke))
    assert abs(lon + 96) < 1e-9 and abs(lat - 28.5) < 1e-9


def test_transforms_are_planned_or_refused():
    wgs, web, indian = (crs.crs_from_epsg(k) for k in (4326, 3857, 4240))
    assert crs.plan_transform(wgs, wgs) is None and crs.plan_transform(None, web) is None
    assert crs.plan_transform(wgs, web) is not None
    with pytest.raises(crs.NoTransform, match="Indian 1975"):
        crs.plan_transform(indian, web)
    assert crs.plan_transform(indian, web, ((295.0, 736.0, 257.0), (0.0, 0.0, 0.0), 0.0)) is not None
    assert crs.resolved_crs(user=web, declared=wgs) == (web, "user", wgs)
    assert crs.resolved_crs(sidecar=wgs, assumed=web)[1] == "sidecar" and crs.resolved_crs()[1] == "blocked"
    assert crs.grid_unit(wgs) == "degree" and crs.grid_unit(web) == "metre" and crs.grid_unit(None) == "unknown"


def test_nearest_is_brute_force(spark):
    rng = random.Random(2)
    right = [(i, 5.0, 5.0) for i in range(300)] + [(1000 + i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(80)] + [(5000, 9e5, -4e5)]
    left = [(i, rng.uniform(-10, 60), rng.uniform(-10, 60)) for i in range(60)] + [(900, 1e6, 1e6), (901, -3e5, 20.0), (902, 5.0, 5.0)]
    a, b = spark.createDataFrame(left, "k long, lx double, ly double"), spark.createDataFrame(right, "rkey long, rx double, ry double")
    got = {r["k"]: (r["rkey"], r["distance"]) for r in spatial.nearest(a, b, "k", 0.5).collect()}
    for k, x, y in left:
        want = min((math.hypot(x - rx, y - ry), key) for key, rx, ry in right)
        assert got[k][0] == want[1] and abs(got[k][1] - want[0]) < 1e-9 * max(1, want[0])
    assert spatial.nearest(a.limit(0), b, "k", 0.5).count() == 0 and spatial.nearest(a, b.limit(0), "k", 0.5).count() == 0


def test_wide_boxes_meet_on_a_coarser_grid(spark):
    rows = [(i, i * 1.0, 0.0, i + 0.5, 0.5) for i in range(50)] + [(100, -5.0, -5.0, 1000.0, 900.0), (101, 20.2, -400.0, 20.3, 400.0)]
    df = spark.createDataFrame(rows, "idx long, minx double, miny double, maxx double, maxy double")
    df = df.withColumn("geom", g.polygon(g.box(*[F.col(c) for c in spatial.BOX])))
    got = {(r["a"], r["b"]) for r in spatial.candidate_pairs(df, 1.0).select("a", "b").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert got == want and (20, 101) in want and spatial.candidate_pairs(df, 1.0).count() == len(want)


def test_a_point_in_two_polygons_is_burnt_into_the_first(spark):
    rows = [(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0)]
    polygons = spark.createDataFrame(rows, "idx long, minx double, miny double, maxx double, maxy double")
    polygons = polygons.withColumn("geom", g.polygon(g.box(*[F.col(c) for c in spatial.BOX])))
    texts = spark.createDataFrame([("both", 1.5, 1.5), ("second", 2.5, 2.5)], "name string, x double, y double")
    got = {r["idx"]: r["burnt"] for r in spatial.burn_in(polygons, texts, 10.0, "name", "concatenate").collect()}
    assert got == {1: "both", 2: "second"}


def test_long_rings_are_searched_for_crossings(spark):
    n = 3000
    ring = [[math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)] for i in range(n)]
    crossed = [*ring[:100], ring[101], ring[100], *ring[102:]]
    rows = [(1, [*ring, ring[0]]), (2, [*crossed, crossed[0]])]
    df = spark.createDataFrame(rows, "idx long, ring array<array<double>>").select("idx", g.polygon(F.col("ring")).alias("geom"))
    assert {r["idx"] for r in rules.self_crossings(df).collect()} == {2}


def test_repairs_refuse_protected_layers_and_stay_in_scope(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "idx long, layer string").withColumn("geom", g.line(F.array(*[F.array(F.lit(float(x)), F.lit(0.0)) for x in (0, 0, 1)])))
    with pytest.raises(Refused):
        rules.plan_repair(df, "remove-duplicate-vertices", protected=("a",), layer="a")
    plan = rules.plan_repair(df, "remove-duplicate-vertices", protected=("b",))
    assert [(r["idx"], r["moved"]) for r in plan.collect()] == [(1, 0.0)]
    after = rules.apply_repair(df, plan)
    assert {r["idx"]: len(r["geom"]["parts"][0][0]) for r in after.collect()} == {1: 2, 2: 3}
    assert rules.undo_repair(after, plan).exceptAll(df.select("idx", "layer", "geom")).count() == 0


def test_affine_maps():
    turn = georeference.composed(georeference.translation(10, 0), georeference.rotation(90))
    back = georeference.inverted(turn)
    assert all(abs(a - b) < 1e-12 for a, b in zip(georeference.composed(back, turn), (1, 0, 0, 0, 1, 0), strict=True))
    assert georeference.inverted((1, 2, 0, 2, 4, 0)) is None
    assert all(abs(a - b) < 1e-12 for a, b in zip(georeference.scales(georeference.composed(georeference.scaling(3), turn)), (3, 3, 90), strict=True))


def test_fits_refuse_too_little_control(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i, 0.0, float(i)) for i in range(5)], "u double, v double, x double, y double")
    with pytest.raises(georeference.NoFit, match="line"):
        georeference.fit_control(line)
    with pytest.raises(georeference.NoFit, match="too few"):
        georeference.fit_control(line.limit(1), "similarity")


def test_anomalies_default(spark):
    z = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(z)], "idx long, kind string, z double")
    assert [r["idx"] for r in points.z_anomalies(df, ["kind"]).collect()] == [9]


def test_every_box_has_all_its_tiles(spark):
    # Boxes near the poles have many tiles.
    path = "/root/testdata/sf0.001"
    each = land.tiles_covering_boxes(spark, path).groupBy("c_custkey").agg(F.count("*").alias("n"), F.count_distinct("tile_x").alias("w"), F.count_distinct("tile_y").alias("h")).collect()
    assert len(each) == spark.read.parquet(f"{path}/customer.parquet").count()
    assert all(r.n == r.w * r.h for r in each) and max(r.n for r in each) > 5
    world = spark.createDataFrame([(-180.0, -80.0, 179.0, 80.0)], "minx double, miny double, maxx double, maxy double")
    assert tiles.tiles_covering(world, 5).select("tile_x", "tile_y").distinct().count() == 32 * 26
    assert tiles.tiles_covering(world, 5, 64).count() == 0
