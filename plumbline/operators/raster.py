"""Rasters as long tables ``(band, row, col, value)`` with a geotransform of six numbers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.crs import Crs, Shift, plan_transform
from plumbline.operators.table import Refused

NORTH = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)


def centre(t: tuple[float, ...]) -> tuple[Column, Column]:
    """The ground position of a pixel's middle."""
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    return t[0] + c * t[1] + r * t[2], t[3] + c * t[4] + r * t[5]


def valid(no_data: float | None) -> Column:
    v = F.col("value")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (F.lit(True) if no_data is None else v != no_data)


def band_statistics(pixels: DataFrame, no_data: float | None = None) -> DataFrame:
    """Per band least, greatest and mean of what is valid; 0, 0 and null where nothing is."""
    v = F.when(valid(no_data), F.col("value"))
    return pixels.groupBy("band").agg(
        F.coalesce(F.min(v), F.lit(0.0)).alias("min_value"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_value"),
        F.avg(v).alias("mean_value"), F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_blank"),
    )


def distinct_values(pixels: DataFrame, no_data: float | None = None) -> DataFrame:
    v = F.col("value")
    return pixels.where(valid(no_data)).groupBy("band").agg(
        F.count_distinct(v).alias("n_distinct"), F.bool_and(v == F.floor(v)).alias("whole_numbers")
    )


def clip_raster(pixels: DataFrame, polygons: DataFrame, no_data: float | None, t: tuple[float, ...] = NORTH) -> DataFrame:
    """Pixels whose middle is in no polygon become no data; refused where there is no such value."""
    if no_data is None:
        raise Refused("clipping needs a no-data value")
    from plumbline.operators.spatial import contained

    x, y = centre(t)
    inside = contained(pixels.select("row", "col", x.alias("x"), y.alias("y")), polygons, 64 * abs(t[1])).select("row", "col").distinct()
    marked = pixels.join(inside.withColumn("inside", F.lit(True)), ["row", "col"], "left")
    return marked.withColumn("value", F.when(F.col("inside"), F.col("value")).otherwise(F.lit(no_data))).drop("inside")


def rasterize(polygons: DataFrame, width: int, height: int, value: str, t: tuple[float, ...], key: str = "idx") -> DataFrame:
    """The value of the last polygon that holds a pixel's middle; pixels come from the boxes of polygons only."""

    def span(low: str, high: str, origin: float, step: float, n: int) -> Column:
        a, b = (F.floor((F.col(c) - origin) / step).cast("int") for c in (low, high))
        first, last = F.greatest(F.least(a, b), F.lit(0)), F.least(F.greatest(a, b), F.lit(n - 1))
        return F.when(first <= last, F.sequence(first, last))

    cols, rows = span("minx", "maxx", t[0], t[1], width), span("miny", "maxy", t[3], t[5], height)
    x, y = centre(t)
    hit = polygons.withColumn("col", F.explode(cols)).withColumn("row", F.explode(rows)).where(g.in_polygon(x, y, F.col("geom")))
    return hit.groupBy("row", "col").agg(F.max_by(value, key).alias("value"))


def warp(pixels: DataFrame, width: int, height: int, to_source: tuple[Column, Column], method: str = "nearest") -> DataFrame:
    """Resamples to a target grid: ``to_source`` gives source col and row (of pixel middles) from target ones.

    Bilinear: any blank corner makes a blank pixel.
    """
    spark = pixels.sparkSession
    grid = spark.range(width * height).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    aimed = grid.select("row", "col", to_source[0].alias("sc"), to_source[1].alias("sr"))
    source = pixels.select(F.col("row").alias("r"), F.col("col").alias("c"), "band", "value")
    if method == "nearest":
        # Halves go up.
        at = aimed.withColumn("c", F.floor(F.col("sc") + 0.5)).withColumn("r", F.floor(F.col("sr") + 0.5))
        return at.join(source, ["r", "c"]).select("band", "row", "col", "value")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    at = aimed.withColumn("k", F.explode(corners))
    fc, fr = F.col("sc") - F.floor("sc"), F.col("sr") - F.floor("sr")
    weight = F.when(F.col("k.i") == 1, fc).otherwise(1 - fc) * F.when(F.col("k.j") == 1, fr).otherwise(1 - fr)
    at = at.select("row", "col", weight.alias("w"), (F.floor("sc") + F.col("k.i")).alias("c"), (F.floor("sr") + F.col("k.j")).alias("r"))
    return (
        at.join(source, ["r", "c"])
        .groupBy("band", "row", "col")
        .agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count("value").alias("n"))
        .where("n = 4")
        .drop("n")
    )


def contour_segments(pixels: DataFrame, interval: float, base: float = 0.0, no_data: float | None = None) -> DataFrame:
    """Marching squares between pixel middles: segments of each level, in pixel coordinates.

    A corner at the level counts as above. Saddles follow the mean of the four corners.
    Cells with a blank corner have none. Neighbours meet by a join on the cell, not by sorting.
    """
    ok = pixels.where(valid(no_data))
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    cells = (
        ok.withColumn("k", F.explode(corner))
        .groupBy("band", (F.col("row") - F.col("k.j")).alias("r"), (F.col("col") - F.col("k.i")).alias("c"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.max(F.when((F.col("k.i") == i) & (F.col("k.j") == j), F.col("value"))).alias(f"v{i}{j}") for i in (0, 1) for j in (0, 1)],
        )
        .where("n = 4")
    )
    low, high = (f("v00", "v10", "v01", "v11") for f in (F.least, F.greatest))
    k0, k1 = F.ceil((low - base) / interval), F.floor((high - base) / interval)
    levels = cells.where(k0 <= k1).withColumn("k", F.explode(F.sequence(k0, k1))).withColumn("level", F.col("k") * interval + base)
    v, lv = {n: F.col(f"v{n}") for n in ("00", "10", "01", "11")}, F.col("level")
    up = {n: c >= lv for n, c in v.items()}

    def cut(a: str, b: str) -> Column:
        t = (lv - v[a]) / (v[b] - v[a])
        xa, ya, xb, yb = (float(s) for s in (*a, *b))
        return F.array(F.col("c") + xa + t * (xb - xa), F.col("r") + ya + t * (yb - ya))

    top, bottom, left, right = cut("00", "10"), cut("01", "11"), cut("00", "01"), cut("10", "11")
    case = sum((F.when(up[n], w).otherwise(0) for n, w in (("00", 8), ("10", 4), ("11", 2), ("01", 1))), F.lit(0))
    middle = (v["00"] + v["10"] + v["01"] + v["11"]) / 4 >= lv

    def segs(*pairs: tuple[Column, Column]) -> Column:
        return F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs])

    both_a, both_b = segs((left, top), (bottom, right)), segs((left, bottom), (top, right))
    found = (
        F.when(F.col("case").isin(8, 7), segs((left, top)))
        .when(F.col("case").isin(4, 11), segs((top, right)))
        .when(F.col("case").isin(2, 13), segs((bottom, right)))
        .when(F.col("case").isin(1, 14), segs((left, bottom)))
        .when(F.col("case").isin(12, 3), segs((left, right)))
        .when(F.col("case").isin(6, 9), segs((top, bottom)))
        .when(F.col("case") == 10, F.when(middle, both_b).otherwise(both_a))
        .when(F.col("case") == 5, F.when(middle, both_a).otherwise(both_b))
    )
    return levels.withColumn("case", case).withColumn("s", F.explode(found)).select(
        "band", "level", "r", "c", F.col("s.a")[0].alias("x1"), F.col("s.a")[1].alias("y1"), F.col("s.b")[0].alias("x2"), F.col("s.b")[1].alias("y2")
    )


def runs_of_value(pixels: DataFrame) -> DataFrame:
    """Row-wise runs of equal values, the blocks that ``regions`` joins."""
    by_row = Window.partitionBy("band", "row").orderBy("col")
    new = (F.lag("value").over(by_row) != F.col("value")) | (F.lag("col").over(by_row) != F.col("col") - 1) | F.lag("col").over(by_row).isNull()
    marked = pixels.withColumn("run", F.sum(new.cast("int")).over(by_row))
    return marked.groupBy("band", "row", "run").agg(F.first("value").alias("value"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def rectangle_footprint(width: int, height: int, t: tuple[float, ...]) -> list[tuple[float, float]]:
    """The ground corners of a raster, from its origin on."""
    return [(t[0] + c * t[1] + r * t[2], t[3] + c * t[4] + r * t[5]) for c, r in ((0, 0), (width, 0), (width, height), (0, height), (0, 0))]


def world_file(t: tuple[float, ...]) -> list[float]:
    """The six lines of a world file, which names the middle of the first pixel."""
    return [t[1], t[4], t[2], t[5], t[0] + t[1] / 2 + t[2] / 2, t[3] + t[4] / 2 + t[5] / 2]


def from_world_file(lines: list[float]) -> tuple[float, ...]:
    a, d, b, e, c, f = lines
    return (c - a / 2 - b / 2, a, b, f - d / 2 - e / 2, d, e)


def plan_warp(spark: SparkSession, width: int, height: int, t: tuple[float, ...], to_target: Callable[[Column, Column, Column], tuple[Column, Column]], samples: int = 16) -> tuple[int, int, tuple[float, ...]] | None:
    """Width, height and geotransform of a north-up grid that holds a raster in another system with about as many square pixels.

    Bounds come from points along all four edges, since straight edges bend; points that have no place in the
    target are left out, and None is for a raster of which none has one.
    """
    share = [k / samples for k in range(samples + 1)]
    edge = [(c, r) for s in share for c, r in ((s * width, 0.0), (s * width, float(height)), (0.0, s * height), (float(width), s * height))]
    c, r = F.col("c"), F.col("r")
    x, y = to_target(t[0] + c * t[1] + r * t[2], t[3] + c * t[4] + r * t[5], F.lit(None).cast("double"))
    finite = lambda v: ~(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")))
    at = spark.createDataFrame(edge, "c double, r double").select(x.alias("x"), y.alias("y")).where(finite(F.col("x")) & finite(F.col("y")))
    x0, x1, y0, y1 = at.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None or x1 <= x0 or y1 <= y0:
        return None
    size = math.sqrt((x1 - x0) * (y1 - y0) / (width * height))
    return max(1, math.ceil((x1 - x0) / size)), max(1, math.ceil((y1 - y0) / size)), (x0, size, 0.0, y1, 0.0, -size)


def reproject(pixels: DataFrame, width: int, height: int, t: tuple[float, ...], source: Crs, target: Crs, method: str = "nearest", no_data: float | None = None, shift: Shift | None = None) -> tuple[DataFrame, int, int, tuple[float, ...]]:
    """A raster in another system: pixels, width, height and geotransform.

    Pixels that look outside of the source, or at a blank one, are left out, or are ``no_data`` where one is given.
    """
    spark = pixels.sparkSession
    # Back by the negated parameters, as is usual for small ones.
    negated = (tuple(-v for v in shift[0]), tuple(-v for v in shift[1]), -shift[2]) if shift else None
    forth, back = plan_transform(source, target, shift), plan_transform(target, source, negated)
    if forth is None or back is None:
        return pixels, width, height, t
    plan = plan_warp(spark, width, height, t, forth)
    if plan is None:
        raise Refused("the raster has no place in the target system")
    w, h, to = plan
    x, y = back(to[0] + (F.col("col") + 0.5) * to[1], to[3] + (F.col("row") + 0.5) * to[5], F.lit(None).cast("double"))
    # From the ground to source pixels, of which middles are at halves.
    det = t[1] * t[5] - t[2] * t[4]
    dx, dy = x - t[0], y - t[3]
    aimed = ((dx * t[5] - dy * t[2]) / det - 0.5, (dy * t[1] - dx * t[4]) / det - 0.5)
    out = warp(pixels, w, h, aimed, method)
    if no_data is not None:
        # A row for each pixel of each band: as many as the result has.
        bands = pixels.select("band").distinct().select("band", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("row"))
        blank = bands.repartition("row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
        out = blank.join(out, ["band", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(no_data)))
    return out, w, h, to
