"""Georeferencing: affine maps, fits to control points, and layers moved by them.

A map is ``(a, b, c, d, e, f)``: x = a u + b v + c and y = d u + e v + f.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g

Affine = tuple[float, float, float, float, float, float]


class NoFit(ValueError):
    """Control that does not decide a map, and why."""


def applied(t: Affine, u: Column, v: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    return a * u + b * v + c, d * u + e * v + f


def composed(outer: Affine, inner: Affine) -> Affine:
    """First ``inner``, then ``outer``."""
    a, b, c, d, e, f = outer
    p, q, r, s, t, u = inner
    return (a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f)


def inverted(t: Affine) -> Affine | None:
    """The way back; None for a map that flattens the plane."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    if abs(det) < 1e-18:
        return None
    return (e / det, -b / det, (b * f - e * c) / det, -d / det, a / det, (d * c - a * f) / det)


def scales(t: Affine) -> tuple[float, float, float]:
    """Scale along u and along v, and by how many degrees u is turned."""
    return math.hypot(t[0], t[3]), math.hypot(t[1], t[4]), math.degrees(math.atan2(t[3], t[0]))


def translation(dx: float, dy: float) -> Affine:
    return (1.0, 0.0, dx, 0.0, 1.0, dy)


def rotation(degrees: float, x: float = 0.0, y: float = 0.0) -> Affine:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (c, -s, x - c * x + s * y, s, c, y - s * x - c * y)


def scaling(factor: float, x: float = 0.0, y: float = 0.0) -> Affine:
    return (factor, 0.0, x * (1 - factor), 0.0, factor, y * (1 - factor))


def geotransform(t: Affine) -> tuple[float, ...]:
    """The map as rasters state it, in the order of GDAL."""
    return (t[2], t[0], t[1], t[5], t[3], t[4])


@dataclass(frozen=True)
class Fit:
    affine: Affine
    kind: str
    n: int
    rms: float


def fit_control(points: DataFrame, kind: str = "affine") -> Fit:
    """The least-squares map of control points ``(u, v, x, y)``: affine (3 or more), similarity (2 or more).

    Sums of products are added up by Spark; the driver solves for six or four numbers. They are
    taken about the points' means, so far-off origins lose no digits. Points with a null are left out.
    """
    known = points.where(F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    n, *means = known.agg(F.count(F.lit(1)), *[F.avg(k) for k in "uvxy"]).first()
    if n < (3 if kind == "affine" else 2):
        raise NoFit(f"{kind}: {n} control points are too few")
    off = {k: F.col(k) - F.lit(m) for k, m in zip("uvxy", means, strict=True)}
    pairs = ("uu", "uv", "vv", "ux", "vx", "uy", "vy", "xx", "yy")
    s = dict(zip(pairs, known.agg(*[F.sum(off[p[0]] * off[p[1]]) for p in pairs]).first(), strict=True))
    if kind == "affine":
        m = np.array([[s["uu"], s["uv"]], [s["uv"], s["vv"]]])
        if np.linalg.det(m) < 1e-9 * max(s["uu"] * s["vv"], 1e-300):
            raise NoFit("the control points are on one line")
        a, b = np.linalg.solve(m, [s["ux"], s["vx"]])
        d, e = np.linalg.solve(m, [s["uy"], s["vy"]])
    else:
        spread = s["uu"] + s["vv"]
        if spread == 0:
            raise NoFit("the control points are at one place")
        a = e = (s["ux"] + s["vy"]) / spread
        d = (s["uy"] - s["vx"]) / spread
        b = -d
    mu, mv, mx, my = means
    affine = tuple(float(k) for k in (a, b, mx - a * mu - b * mv, d, e, my - d * mu - e * mv))
    return Fit(affine, kind, n, math.sqrt(residuals(known, affine).agg(F.avg(F.col("residual") ** 2)).first()[0]))


def residuals(points: DataFrame, t: Affine) -> DataFrame:
    x, y = applied(t, F.col("u"), F.col("v"))
    return points.withColumn("residual", F.hypot(x - F.col("x"), y - F.col("y")))


def georeferenced(df: DataFrame, t: Affine, geom: str = "geom") -> DataFrame:
    """A layer with its positions mapped; height and measure pass as they are. ``inverted`` takes it back."""

    def moved(p: Column) -> Column:
        x, y = applied(t, p[0], p[1])
        return F.concat(F.array(x, y), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))))

    return df.withColumn(geom, g.map_positions(F.col(geom), moved))
