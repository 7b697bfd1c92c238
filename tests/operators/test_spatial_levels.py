"""Joins of boxes of very mixed sizes."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import spatial

LBOX, RBOX = ("la", "lb", "lc", "ld"), spatial.BOX


def boxes(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w, h = (rnd.choice((0, 0.3, 1, 4, 4.0001, 16, 70, 300)) * rnd.choice((1, rnd.random())) for _ in "wh")
        x, y = rnd.uniform(-200, 200), rnd.uniform(-200, 200)
        out.append((i, x, y, x + w, y + h))
    return out + [(n, 0.0, 0.0, 1.0, 1.0), (n + 1, -1000.0, -1000.0, 1000.0, 1000.0), (n + 2, 1.0, 1.0, 2.0, 2.0), (n + 3, None, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("size", [0.5, 1.0, 37.0])
def test_pairs_of_mixed_boxes_come_once(spark, size):
    a, b = boxes(1, 150), boxes(2, 170)
    left = spark.createDataFrame(a, "l int, la double, lb double, lc double, ld double")
    right = spark.createDataFrame(b, "r int, minx double, miny double, maxx double, maxy double")
    got = sorted(map(tuple, spatial.box_join(left, right, size, LBOX, RBOX).select("l", "r").collect()))
    want = sorted((p[0], q[0]) for p in a for q in b if None not in (p[1], q[1]) and p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert got == want and want


def test_one_country_and_many_lots(spark):
    """Lots meet the country on its level and each other on their own: what the cells' join compares stays in proportion."""
    n = 20_000
    x, y = F.col("id") % 200 * 10.0, F.floor(F.col("id") / 200) * 10.0
    lots = spark.range(n).select(F.col("id").cast("int").alias("idx"), x.alias("minx"), y.cast("double").alias("miny"), (x + 9.0).alias("maxx"), (y + 9.0).alias("maxy"))
    country = spark.createDataFrame([(-1, 0.0, 0.0, 2000.0, 1000.0)], lots.schema)
    layer = lots.unionByName(country).withColumn("geom", F.lit(1))
    pairs = spatial.candidate_pairs(layer, 10.0)
    assert pairs.where("a = -1").count() == n and pairs.count() == n
    left = layer.select(F.col("idx").alias("l"), *[F.col(c).alias(d) for c, d in zip(RBOX, LBOX)])
    used = spatial._used(layer, RBOX, 10.0)
    a, b = spatial._dealt(left, LBOX, 10.0, used, 1, 2), spatial._dealt(layer, RBOX, 10.0, used, 2, 1).drop("__cell")
    assert a.join(b, ["__lv", "__role", "cx", "cy"]).count() < 20 * n


def test_joins_start_no_job_and_use_equal_cells(spark):
    parts = spark.range(100).select(F.col("id").alias("idx"), *[F.col("id").cast("double").alias(c) for c in RBOX], F.lit(1).alias("geom"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job")
    pairs = spatial.candidate_pairs(parts, 1.0)
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext.setJobGroup("rest", "")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "cx" in plan
