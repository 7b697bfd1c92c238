"""Layers of two versions, and points that borders passed over."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import fidelity, spatial


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        (["a", "b", "c"], ["c", "x", "y"], {("c", "c", "name"), ("a", "x", "position"), ("b", "y", "position")}),
        (["a", "b"], ["b"], {("b", "b", "name"), ("a", None, None)}),
        (["a"], ["b", "c"], {("a", None, None), (None, "b", None), (None, "c", None)}),
        (["a", "a"], ["a", "b"], {("a", "a", "name"), ("a", "b", "position")}),
        ([], ["b"], {(None, "b", None)}),
        ([], [], set()),
    ],
)
def test_layers_are_paired(spark, before, after, want):
    of = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "layer string, position int")
    assert {tuple(r) for r in fidelity.paired_layers(of(before), of(after)).collect()} == want


def test_points_that_a_border_passed_over(spark):
    ring = lambda *p: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    shell, hole = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))
    box = [F.lit(v).alias(c) for c, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 10.0), ("maxy", 10.0))]
    borders = spark.range(1).select(F.lit(1).alias("idx"), *box, g.polygon(shell, hole).alias("geom"))
    borders = borders.unionByName(spark.range(1).select(F.lit(2).alias("idx"), *[F.lit(v).alias(c) for c, v in (("minx", 50.0), ("miny", 0.0), ("maxx", 51.0), ("maxy", 1.0))], g.polygon(ring((50, 0), (51, 0), (51, 1), (50, 0))).alias("geom")))
    # In a hole counts, corners don't, two at one place count twice; outside and null don't.
    points = spark.createDataFrame([(5.0, 5.0), (0.0, 0.0), (4.0, 4.0), (1.0, 1.0), (1.0, 1.0), (20.0, 1.0), (None, 1.0)], "x double, y double")
    assert {tuple(r) for r in spatial.enclosed(borders, points, 10.0).collect()} == {(1, 3), (2, 0)}
    layers = spark.createDataFrame([("p", "Point"), ("p", "LineString"), ("l", "LineString"), ("m", "MultiPoint"), ("n", None)], "layer string, t string").select("layer", F.when(F.col("t").isNotNull(), g.geometry(F.col("t"), F.array())).alias("geom"))
    assert sorted(r["layer"] for r in spatial.point_layers(layers).collect()) == ["m", "p", "p"]
