"""Shared borders: snapping, inserted nodes, snap targets."""

import math
import random

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import shared

KIND = f"idx int, geom {g.GEOMETRY}"


def layer(spark, rings):
    return spark.createDataFrame([(i, ("Polygon", [[[[float(v) for v in p] for p in r] for r in rs]])) for i, rs in rings], KIND)


def shapes(df):
    return {r["idx"]: [[tuple(p) for p in ring] for ring in r["geom"]["parts"][0]] for r in df.collect()}


def test_neighbours_share_all_vertices_afterwards(spark):
    """A gap of three hundredths, and a neighbour with more vertices than the other."""
    rows = [
        (1, [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]),
        (2, [[(10.03, 0.01), (20, 0), (20, 10), (10.03, 10), (10.02, 7), (10.01, 4), (10.03, 0.01)]]),
        (3, [[(40, 40), (50, 40), (50, 50), (40, 50), (40, 40)]]),
    ]
    df = layer(spark, rows)
    snapped = shapes(shared.snap_shared_edges(df, 0.05))
    assert snapped[3] == shapes(df)[3]
    assert snapped[1][0][1] == snapped[2][0][0] == snapped[2][0][-1] == (10.015, 0.005)
    out = shared.rebuild_topology(df, 0.05, 8.0)
    facts = {r["idx"]: (r["moved"], r["inserted"]) for r in out.collect()}
    assert facts == {1: (2, 2), 2: (2, 0), 3: (0, 0)}
    got = shapes(out)
    assert set(got[2][0]) - set(got[1][0]) == {(20.0, 0.0), (20.0, 10.0)}
    assert got[1][0] == [(0, 0), (10.015, 0.005), (10.01, 4.0), (10.02, 7.0), (10.015, 10.0), (0, 10), (0, 0)]


def test_holes_heights_and_vertices_of_one_feature_stay(spark):
    ring = [(0, 0, 5), (10, 0, 5), (10, 10, 6), (0, 10, 6), (0, 0, 5)]
    hole = [(2, 2, 1), (2.01, 2, 1), (2, 4, 1), (2, 2, 1)]
    rows = [(1, [ring, hole]), (2, [[(10.02, 0, 7), (20, 0, 7), (20, 10, 7), (10.02, 0, 7)]])]
    got = shapes(shared.snap_shared_edges(layer(spark, rows), 0.05))
    assert got[1][1] == [tuple(map(float, p)) for p in hole] and got[1][0][1] == (10.01, 0.0, 5.0) and got[2][0][0] == (10.01, 0.0, 7.0)
    assert shared.rebuild_topology(layer(spark, rows).limit(0), 0.05, 5.0).count() == 0


def test_targets_are_those_of_a_plain_search(spark):
    rnd = random.Random(2)
    rows = [(i, [[(rnd.uniform(0, 60), rnd.uniform(0, 60)) for _ in range(4)]]) for i in range(12)]
    pts = [(k, rnd.uniform(0, 60), rnd.uniform(0, 60)) for k in range(150)]
    points = spark.createDataFrame(pts, "point int, x double, y double")
    want = {}
    for k, x, y in pts:
        found = []
        for i, (r,) in rows:
            for a, b in zip(r, r[1:]):
                d2 = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
                t = min(1, max(0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / d2))
                for rank, q in ((0, a), (0, b), (1, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)), (2, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))):
                    far = math.hypot(x - q[0], y - q[1])
                    if far <= 3.0:
                        found.append((rank, far, i))
        if found:
            want[k] = min(found)
    for cell in (2.0, 9.0):
        got = shared.snap_targets(points, layer(spark, rows), 3.0, cell).collect()
        kinds = ("vertex", "midpoint", "segment")
        assert {r["point"]: (kinds.index(r["kind"]), round(r["distance"], 9), r["of"]) for r in got} == {k: (v[0], round(v[1], 9), v[2]) for k, v in want.items()}
        assert {r["kind"] for r in got} == set(kinds)
    only = shared.snap_targets(points, layer(spark, rows), 3.0, 5.0, kinds=("segment",))
    assert only.count() == len(want) and only.where(F.col("kind") != "segment").count() == 0


def test_long_edges_meet_few_cells(spark):
    """A slanted edge of a thousand cells' width is in a few thousand cells, not a million."""
    df = spark.createDataFrame([(0.0, 0.0, 1000.0, 1000.0), (5.0, 5.0, 5.0, 5.0), (9.0, 0.0, 1.0, 0.5)], "ax double, ay double, bx double, by double")
    assert shared.edge_cells(df, 1.0, 0.1).count() < 5000
