"""Points that keep arriving: counts by grid cell and time, and containment in a fixed layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import spatial


def cell_counts(stream: DataFrame, cell: float, time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """How many points fell into each grid cell and window; state is dropped once a window is past being late.

    Partial counts are made before the shuffle, and state holds one row for each cell and window.
    """
    at = [F.floor(F.col(a) / cell).alias(f"cell_{a}") for a in ("x", "y")]
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window), *at)
    return grouped.agg(F.count(F.lit(1)).alias("points")).select(F.col("window.start").alias("since"), "cell_x", "cell_y", "points")


def inside(stream: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Arriving points with each polygon of a fixed layer that holds them: a stream-static join on cells, without state."""
    return spatial.contained(stream, polygons, size)
