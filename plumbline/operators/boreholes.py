"""Boreholes: collars joined to their logs, and the logs' continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_collars(collars: DataFrame, order: str) -> DataFrame:
    """One collar for each hole: the first."""
    return collars.groupBy("hole_id").agg(F.min(F.struct(order, *[c for c in collars.columns if c not in ("hole_id", order)])).alias("c")).select("hole_id", "c.*")


def hole_summary(collars: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each collar with its log's size and reach; logs are added up before the join. No log: 0 and null."""
    logs = intervals.groupBy("hole_id").agg(
        F.count(F.lit(1)).alias("n_intervals"), F.min("from_depth").alias("top"), F.max("to_depth").alias("bottom"),
        F.sum(F.col("to_depth") - F.col("from_depth")).alias("logged"),
    )
    return collars.join(logs, "hole_id", "left").withColumn("n_intervals", F.coalesce("n_intervals", F.lit(0)))


def without_log(collars: DataFrame, intervals: DataFrame) -> DataFrame:
    return collars.join(intervals, "hole_id", "left_anti")


def orphan_intervals(collars: DataFrame, intervals: DataFrame) -> DataFrame:
    return intervals.join(collars, "hole_id", "left_anti")


def log_continuity(intervals: DataFrame, collars: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Gaps and overlaps between successive intervals, before the first, and after the last to the hole's depth.

    One sort within holes; a hole is a bounded group.
    """
    w = Window.partitionBy("hole_id").orderBy("from_depth", "to_depth", "lithology")
    last = F.coalesce(F.lag("to_depth").over(w), F.lit(0.0))
    step = intervals.withColumn("previous", last).withColumn("gap", F.col("from_depth") - F.col("previous"))
    kind = F.when(F.col("gap") > tolerance, "gap").when(F.col("gap") < -tolerance, "overlap")
    out = step.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "hole_id", "kind", F.least("previous", "from_depth").alias("at_from"), F.greatest("previous", "from_depth").alias("at_to")
    )
    if collars is None:
        return out
    ends = intervals.groupBy("hole_id").agg(F.max_by("to_depth", F.struct("from_depth", "to_depth")).alias("end"))
    tail = ends.join(collars, "hole_id").where(F.col("depth") > F.col("end") + tolerance)
    return out.unionByName(tail.select("hole_id", F.lit("trailing gap").alias("kind"), F.col("end").alias("at_from"), F.col("depth").alias("at_to")))
