"""Registered queries of exchange: files written by Spark to the shared folder and read again, layers paired, borders checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import fidelity, spatial
from plumbline.plans import layers
from plumbline.plans.layers import table
from plumbline.plans.registry import query
from plumbline.sources import tables, xml_vector
from plumbline.storage import shared_path

_PLACE = "(SELECT c_custkey, c_mktsegment, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1600) / 10.0 - 80 AS lat, c_acctbal AS h FROM customer) c"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = (F.col("c_custkey") * 37 % 3600) / 10.0 - 180, (F.col("c_custkey") * 53 % 1600) / 10.0 - 80
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", g.point(lon, lat, F.col("c_acctbal")).alias("geom"))


@query("""
SELECT p_partkey AS idx, p_brand AS name, p_type AS kind, 100.0 - (1 + p_size % 4) * (1 + p_size % 4) - 1 AS area, CAST(12 AS INTEGER) AS vertices,
  (p_partkey % 50) * 10.0 AS minx, floor(p_partkey / 50) * 10.0 + 10 AS maxy FROM part""")
def files_kmz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots with holes as archives of placemarks, unpacked and read."""
    path, geom = shared_path(spark, "files"), F.col("geom")
    xml_vector.write_kmz(layers.plots(spark, sf_dir).select("idx", "p_brand", "p_type", "geom"), path, name="p_brand")
    back, box = xml_vector.read_kmz(spark, path), g.bounds(geom)
    return back.select(
        F.col("properties")["idx"].cast("bigint").alias("idx"), "name", F.col("properties")["p_type"].alias("kind"), g.area(geom).alias("area"),
        g.vertex_count(geom).cast("int").alias("vertices"), box["minx"].alias("minx"), box["maxy"].alias("maxy"),
    )


@query("""
SELECT user_id, count(*) AS vertices, round(sum(value), 3) AS lon, CAST(sum(hour(ts) * 60 + minute(ts)) AS DOUBLE) AS lat FROM events GROUP BY 1 HAVING count(*) > 1""")
def files_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's track as a route; a single place is no route."""
    path, geom = shared_path(spark, "files"), F.col("geom")
    xml_vector.write_gpx(layers.tracks(spark, sf_dir).select("user_id", "geom"), path, name="user_id", routes=True)
    total = lambda k: F.aggregate(g.ordinates(geom, k), F.lit(0.0), lambda a, v: a + v)
    return xml_vector.read_gpx(spark, path).select(F.col("name").cast("bigint").alias("user_id"), F.size(g.positions(geom)).cast("bigint").alias("vertices"), F.round(total(0), 3).alias("lon"), total(1).alias("lat"))


@query(f"""
SELECT c_custkey, c_mktsegment AS segment, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat, round(h, 3) + 0.0 AS h, 'urn:ogc:def:crs:EPSG::4326' AS srs FROM {_PLACE}""")
def files_gml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by a system whose authority has latitude first, and read back with longitude first."""
    path = shared_path(spark, "files")
    xml_vector.write_gml(_places(spark, sf_dir), path, 4326, "place", id_col="c_custkey")
    back, p = xml_vector.read_gml(spark, path), g.positions(F.col("geom"))[0]
    return back.select(F.col("id").cast("bigint").alias("c_custkey"), F.col("properties")["c_mktsegment"].alias("segment"), *[(F.round(p[i], 6 if i < 2 else 3) + 0.0).alias(k) for i, k in enumerate(("lon", "lat", "h"))], "srs")


@query("""
SELECT 'Parcels' AS layer, p_partkey AS idx, CAST(NULL AS VARCHAR) AS code, 100.0 - (1 + p_size % 4) * (1 + p_size % 4) AS area, 40.0 AS length, (p_partkey % 50) * 10.0 AS minx FROM part
UNION ALL SELECT 'CgPoints', s_suppkey, 'nation ' || s_nationkey, 0.0, 0.0, round(s_acctbal, 3) FROM supplier
UNION ALL SELECT 'PlanFeatures', user_id, NULL, 0.0, round(sum(sqrt(pow(x - lag_x, 2) + pow(y - lag_y, 2))), 3), min(x) FROM (
  SELECT user_id, x, y, lag(x) OVER w AS lag_x, lag(y) OVER w AS lag_y FROM (
    SELECT user_id, ts, event_id, round(value, 3) AS x, hour(ts) * 60 + minute(ts) AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
GROUP BY user_id HAVING count(*) > 1""")
def files_landxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of plots as parcels, suppliers as survey points and tracks as plan features, in one folder."""
    path, geom = shared_path(spark, "files"), F.col("geom")
    none = F.lit(None).cast("string")
    plots = layers.plots(spark, sf_dir).select(F.col("idx"), none.alias("code"), "geom")
    marks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("code"), g.point(F.col("s_acctbal"), F.col("s_nationkey")).alias("geom"))
    tracks = layers.tracks(spark, sf_dir).select(F.col("user_id").alias("idx"), none.alias("code"), "geom")
    xml_vector.write_landxml(plots.unionByName(marks).unionByName(tracks), path, "idx", code="code")
    line = F.when(geom["type"] == "LineString", F.round(g.length(geom), 3)).otherwise(g.length(geom))
    return xml_vector.read_landxml(spark, path).select(
        "layer", F.col("name").cast("bigint").alias("idx"), F.col("properties")["code"].alias("code"), g.area(geom).alias("area"), line.alias("length"), g.bounds(geom)["minx"].alias("minx"),
    )


# Coordinate tables without headers, layers of two versions, borders drawn from points.


@query(f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, round(lon * 1000, 2) + 500000 AS easting, round(lat * 1000, 2) + 2000000 AS northing, h AS height, c_mktsegment AS code, 'pnezd' AS layout FROM {_PLACE}""")
def files_positional_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of point numbers, northings, eastings, heights and codes that has no header."""
    path, p = shared_path(spark, "files"), g.positions(F.col("geom"))[0]
    q = g.positions(F.col("geom"))[0]
    east, north = F.round(q[0] * 1000, 2) + 500000, F.round(q[1] * 1000, 2) + 2000000
    _places(spark, sf_dir).select("c_custkey", north, east, q[2], "c_mktsegment").write.csv(path)
    found = tables.detect_schema(tables.read_csv_table(spark, path)[0])
    df, _ = tables.read_coordinates(spark, path, confirmed=True)
    return df.select(
        F.col(found.roles["id"]).cast("bigint").cast("string").alias("id"), p[0].alias("easting"), p[1].alias("northing"), p[2].alias("height"),
        F.col(found.roles["code"]).alias("code"), F.lit(found.name).alias("layout"),
    )


@query(f"""
SELECT CAST(c_custkey AS BIGINT) AS id, lon, lat, 'header-geographic' AS layout FROM {_PLACE}""")
def files_degrees_named_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose x and y are degrees."""
    path, p = shared_path(spark, "files"), g.positions(F.col("geom"))[0]
    _places(spark, sf_dir).select(F.col("c_custkey").alias("Pt"), p[0].alias("X"), p[1].alias("Y")).write.option("header", True).csv(path)
    df, _ = tables.read_csv_table(spark, path)
    found = tables.detect_schema(df)
    points, _ = tables.table_to_points(df, found.at)
    return points.select(F.col(found.roles["id"]).cast("bigint").alias("id"), p[0].alias("lon"), p[1].alias("lat"), F.lit(found.name).alias("layout"))


@query("""
WITH l AS (SELECT c_nationkey AS n, c_mktsegment || ' ' || c_nationkey AS name, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1, 2),
b AS (SELECT name, row_number() OVER (ORDER BY first) AS k FROM l WHERE n % 7 = 0), a AS (SELECT name, row_number() OVER (ORDER BY last) AS k FROM l WHERE n % 7 = 0)
SELECT name AS before, name AS after, 'name' AS paired_by FROM l WHERE n % 7 <> 0
UNION ALL SELECT b.name, 'was ' || a.name, 'position' FROM b JOIN a USING (k)""")
def layers_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer for each market segment of a nation, in order of first customers, and then of last ones with some renamed."""
    name = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))
    each = table(spark, sf_dir, "customer").groupBy("c_nationkey", name.alias("name")).agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))
    renamed = F.when(F.col("c_nationkey") % 7 == 0, F.concat(F.lit("was "), "name")).otherwise(F.col("name"))
    return fidelity.paired_layers(each.select(F.col("name").alias("layer"), F.col("first").alias("position")), each.select(renamed.alias("layer"), F.col("last").alias("position")))


@query("""
WITH p AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 0.05 + l_quantity * 0.18 END AS dx, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber + 0.5 + l_suppkey % 3 END AS dy FROM lineitem)
SELECT p_partkey AS idx, count(dx) AS enclosed FROM part LEFT JOIN p ON l_partkey = p_partkey AND dx > 0 AND dx < 10 AND dy < 10 AND NOT (dx < 1 + p_size % 4 AND dy > 10 - (1 + p_size % 4)) GROUP BY 1""")
def plots_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of order lines in the outlines of plots; those of returned ones stand on a corner."""
    key, corner = F.col("l_partkey"), F.col("l_returnflag") == "R"
    dx = F.when(corner, 0.0).otherwise(0.05 + F.col("l_quantity") * 0.18)
    dy = F.when(corner, 0.0).otherwise(F.col("l_linenumber") + 0.5 + F.col("l_suppkey") % 3)
    points = table(spark, sf_dir, "lineitem").select(((key % 50) * 10.0 + dx).alias("x"), (F.floor(key / 50) * 10.0 + dy).alias("y"))
    return spatial.enclosed(layers.plots(spark, sf_dir), points, 10.0)
