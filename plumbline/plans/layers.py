"""Layers derived from the given tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark: SparkSession, sf_dir: str, side: float = 10.0) -> DataFrame:
    """A square for each part, fifty in a row, that share edges."""
    key = F.col("p_partkey")
    x, y = (key % 50) * 10.0, F.floor(key / 50) * 10.0
    return table(spark, sf_dir, "part").select(
        key.alias("idx"), "p_brand", "p_type", "p_size", "p_retailprice",
        x.alias("minx"), y.cast("double").alias("miny"), (x + side).alias("maxx"), (y + side).alias("maxy"),
        g.polygon(g.box(x, y, x + side, y + side)).alias("geom"),
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of ten for each part without its north-west corner of n x n (n from 1 to 4), and with a hole of one by one."""
    df = parcels(spark, sf_dir)
    x, y, n = F.col("minx"), F.col("miny"), 1.0 + F.col("p_size") % 4
    at = lambda dx, dy: g.position(x + dx, y + dy)
    shell = F.array(at(0, 0), at(10, 0), at(10, 10), at(n, 10), at(n, 10 - n), at(0, 10 - n), at(0, 0))
    hole = F.array(at(6, 3), at(6, 4), at(7, 4), at(7, 3), at(6, 3))
    return df.withColumn("geom", g.polygon(shell, hole))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), "event_type", "user_id", "ts",
        F.col("value").alias("x"), (F.col("user_id") + 0.5).alias("y"), "value",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each user: value and minute of the day, in order of time."""
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    at = F.struct("ts", "event_id", g.position(F.col("value"), minute).alias("p"))
    path = F.transform(F.array_sort(F.collect_list(at)), lambda s: s["p"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(path.alias("path")).select("user_id", "path", g.line(F.col("path")).alias("geom"))


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hole_id"), (F.col("o_totalprice") / 1000).alias("depth"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 10.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hole_id"), start.alias("from_depth"), (start + F.col("l_quantity") / 5).alias("to_depth"),
        F.col("l_returnflag").alias("lithology"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("idx"),
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("z"),
        F.col("l_linenumber").alias("classification"), (F.col("l_partkey") % 65536).alias("intensity"),
    )


DEM_WIDTH = 64


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 64 columns, and as many rows as it takes for one pixel for each event: its value."""
    return table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {DEM_WIDTH}").cast("int").alias("row"), (F.col("event_id") % DEM_WIDTH).cast("int").alias("col"), "value", F.lit(1).alias("band")
    )


def dem_rows(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // DEM_WIDTH + 1
