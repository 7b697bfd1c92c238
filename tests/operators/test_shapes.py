import math

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import components, survey, vector


def test_contours_of_a_ramp_and_a_hill(spark):
    ramp = spark.createDataFrame([(1, r, c, float(c)) for r in range(5) for c in range(6)], "band int, row int, col int, value double")
    lines = components.contour_lines(ramp, 2.0, 1.0).orderBy("elevation").collect()
    assert [(r["elevation"], r["length"], r["closed"]) for r in lines] == [(1.0, 4.0, False), (3.0, 4.0, False), (5.0, 4.0, False)]
    hill = [(1, r, c, 10 - math.hypot(r - 4, c - 4)) for r in range(9) for c in range(9)]
    lines = components.contour_lines(spark.createDataFrame(hill, "band int, row int, col int, value double"), 5.0, 2.5).collect()
    assert [(r["elevation"], r["closed"]) for r in lines] == [(7.5, True)] and abs(lines[0]["length"] - 2 * math.pi * 2.5) < 0.5


def test_polygonize_finds_loops_and_holes(spark):
    def sides(x, y, s):
        p = [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
        return [[a, b] for a, b in zip(p, p[1:])]

    lines = [*sides(0.0, 0.0, 10.0), *sides(2.0, 2.0, 4.0), *sides(3.0, 3.0, 1.0), *sides(50.0, 0.0, 3.0), [[80.0, 0.0], [81.0, 1.0]]]
    lines[0] = [[0.0001, 0.0], [10.0, -0.0001]]
    df = spark.createDataFrame(list(enumerate(lines)), "idx long, path array<array<double>>")
    out = components.polygonize(df, 0.01, 20.0).select(g.area(F.col("geom")).alias("a"), F.size(g.rings(F.col("geom"))).alias("n")).collect()
    assert sorted((round(r["a"], 2), r["n"]) for r in out) == [(1.0, 1), (9.0, 1), (84.0, 2)]


def test_bow_tie(spark):
    loops = vector.uncrossed([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)])
    assert sorted(round(vector._area(x[0]), 6) for x in loops) == [4.0, 4.0]
    df = spark.range(1).select(g.polygon(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0))])).alias("geom"))
    row = df.select(g.area(vector.repair_crossings(F.col("geom"))).alias("a"), g.area(vector.repair_crossings(F.col("geom"), True)).alias("b")).first()
    assert (round(row["a"], 6), round(row["b"], 6)) == (8.0, 4.0)


def test_label_place_of_an_l_shape():
    x, y, d = survey.label_place([[(0, 0), (10, 0), (10, 2), (4, 2), (4, 10), (0, 10), (0, 0)]])
    assert d > 1.9 and x < 4
    assert survey.label_place([[(0, 0), (1000, 1000), (1000, 1000.5), (0, 0.5), (0, 0)]])[2] > 0.1


def test_known_geodesic():
    import numpy as np

    m, az, ok = survey.vincenty(*(np.array([v]) for v in (-5.71475, 50.06632, -3.07009, 58.64402)))
    assert ok[0] and abs(m[0] - 969954.166) < 0.5 and abs(az[0] - 9.1419) < 1e-3


def test_searching_systems(spark):
    s = survey.built_in_systems(spark)
    assert [r["code"] for r in survey.search_systems(s, "utm zone 43n").collect()] == [32643]
    assert survey.search_systems(s, "4326").first()["code"] == 4326
