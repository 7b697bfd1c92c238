"""Point clouds: filters, thinning, features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g


@dataclass(frozen=True)
class PointFilter:
    """All limits are inclusive; a missing class or intensity reads as 0."""

    classifications: tuple[int, ...] | None = None
    crop: tuple[float, float, float, float] | None = None
    min_z: float | None = None
    max_z: float | None = None
    min_intensity: int | None = None
    max_intensity: int | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        if self.classifications is not None:
            c &= F.coalesce("classification", F.lit(0)).isin(*self.classifications)
        if self.crop is not None:
            c &= F.col("x").between(self.crop[0], self.crop[2]) & F.col("y").between(self.crop[1], self.crop[3])
        for name, low, high in (("z", self.min_z, self.max_z), ("intensity", self.min_intensity, self.max_intensity)):
            v = F.coalesce(name, F.lit(0)) if name == "intensity" else F.col(name)
            c &= F.lit(True) if low is None else v >= low
            c &= F.lit(True) if high is None else v <= high
        return c


def filter_points(points: DataFrame, f: PointFilter) -> DataFrame:
    return points.where(f.condition())


def every_nth(points: DataFrame, n: float, f: PointFilter | None = None, idx: str = "idx") -> DataFrame:
    """By stored row number, before the filter."""
    some = points.where(F.col(idx) % max(1, int(n)) == 0)
    return some.where(f.condition()) if f else some


def thin(points: DataFrame, cell: float, three_d: bool = False, f: PointFilter | None = None, idx: str = "idx") -> DataFrame:
    """The first point, by ``idx``, of each grid cell or voxel: partial minima, then one row a cell."""
    kept = points.where(f.condition()) if f else points
    axes = ["x", "y", "z"] if three_d else ["x", "y"]
    cells = [F.floor(F.col(a) / cell).alias(f"cell_{a}") for a in axes]
    return kept.groupBy(*cells).agg(F.min(F.struct(idx, *[c for c in points.columns if c != idx])).alias("p")).select("p.*")


def preview_stride(n: int, budget: int = 250_000) -> int:
    return max(1, -(-n // budget))


def to_features(points: DataFrame) -> DataFrame:
    """Point features; 16-bit colours become 8-bit."""
    colours = [F.shiftright(c, 8).alias(c) for c in ("red", "green", "blue") if c in points.columns]
    others = [c for c in points.columns if c not in ("x", "y", "z", "red", "green", "blue")]
    return points.select(*others, *colours, g.point(F.col("x"), F.col("y"), F.col("z")).alias("geom"))


def cloud_summary(points: DataFrame) -> DataFrame:
    """Count, bounds and points by class, in one pass."""
    axes = [f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]
    return points.agg(F.count(F.lit(1)).alias("n_points"), *axes)


def z_anomalies(points: DataFrame, by: list[str], score: float = 3.5) -> DataFrame:
    """Points at least so far from the median height of their group, by median absolute deviations (groups of 8 or more)."""
    middle = points.groupBy(*by).agg(F.percentile("z", F.lit(0.5)).alias("median_z"), F.count("z").alias("n")).where("n >= 8")
    off = points.join(middle, by).withColumn("off", F.abs(F.col("z") - F.col("median_z")))
    spread = off.groupBy(*by).agg(F.percentile("off", F.lit(0.5)).alias("mad")).where("mad > 0")
    return off.join(spread, by).where(0.6745 * F.col("off") / F.col("mad") >= score)
