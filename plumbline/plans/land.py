"""Registered queries of reference systems, coordinate tables, rules, repairs and georeferencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import crs
from plumbline.functions import geometry as g
from plumbline.operators import components, fidelity, georeference, labels, raster, rules, shared, spatial, tiles, vector
from plumbline.operators.joins import shuffled
from plumbline.plans import layers
from plumbline.plans.layers import table
from plumbline.plans.registry import query
from plumbline.sources import tables

_PLACE = "(SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1600) / 10.0 - 80 AS lat, c_acctbal AS h FROM customer) c"
_PARCEL = "(SELECT p_partkey AS idx, p_size, (p_partkey % 50) * 10.0 AS minx, floor(p_partkey / 50) * 10.0 AS miny FROM part)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = (F.col("c_custkey") * 37 % 3600) / 10.0 - 180, (F.col("c_custkey") * 53 % 1600) / 10.0 - 80
    return table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"), F.col("c_acctbal").alias("h"))


@query(f"""
SELECT c_custkey, round(6378137 * radians(lon), 3) + 0.0 AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0.0 AS y, round(h, 3) AS z FROM {_PLACE}""")
def layer_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _places(spark, sf_dir).select("c_custkey", g.point(F.col("lon"), F.col("lat"), F.col("h")).alias("geom"))
    out = crs.transformed(df, crs.crs_from_epsg(4326), crs.crs_from_epsg(3857))
    p = g.positions(F.col("geom"))[0]
    return out.select("c_custkey", *[(F.round(p[i], 3) + 0.0).alias(k) for i, k in enumerate("xyz")])


_E2 = "(2 / 300.8017 - 1 / (300.8017 * 300.8017))"
_V2 = "(2 / 298.257223563 - 1 / (298.257223563 * 298.257223563))"


@query(f"""
WITH g AS (SELECT c_custkey, h, radians(lon) AS l, radians(lat) AS p, 6377276.345 / sqrt(1 - {_E2} * sin(radians(lat)) * sin(radians(lat))) AS v FROM {_PLACE}),
m AS (SELECT c_custkey, (v + h) * cos(p) * cos(l) AS x, (v + h) * cos(p) * sin(l) AS y, (v * (1 - {_E2}) + h) * sin(p) AS z FROM g),
s AS (SELECT c_custkey, 295 + x * (1 + 1e-6) - radians(2 / 3600.0) * y * (1 + 1e-6) AS x, 736 + y * (1 + 1e-6) + radians(2 / 3600.0) * x * (1 + 1e-6) AS y, 257 + z * (1 + 1e-6) AS z FROM m),
u AS (SELECT *, sqrt(x * x + y * y) AS r, 6378137 * (1 - 1 / 298.257223563) AS b FROM s),
w AS (SELECT *, atan2(z * 6378137, r * b) AS t FROM u)
SELECT c_custkey, round(degrees(atan2(y, x)), 9) AS lon,
  round(degrees(atan2(z + {_V2} / (1 - {_V2}) * b * pow(sin(t), 3), r - {_V2} * 6378137 * pow(cos(t), 3))), 9) AS lat FROM w""")
def datum_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = crs.plan_transform(crs.crs_from_epsg(4240), crs.crs_from_epsg(4326), ((295.0, 736.0, 257.0), (0.0, 0.0, 2.0), 1.0))
    lon, lat = plan(F.col("lon"), F.col("lat"), F.col("h"))
    return _places(spark, sf_dir).select("c_custkey", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 4326 WHEN 2 THEN 3857 END AS epsg,
  CASE n_nationkey % 4 WHEN 0 THEN 'degrees' WHEN 1 THEN 'utm' WHEN 2 THEN 'web mercator' ELSE 'local grid' END AS reading, n_nationkey % 4 <> 0 AS ambiguous
FROM (SELECT DISTINCT c_nationkey AS n_nationkey FROM customer)""")
def crs_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of numbers, by nation."""
    k, v = F.col("c_nationkey") % 4, F.col("c_custkey") % 50
    x = F.when(k == 0, v + 20.0).when(k == 1, v * 10.0 + 400_000).when(k == 2, v * 1000.0 + 5_000_000).otherwise(v * 10.0 + 30_000_000)
    y = F.when(k == 0, v + 11.0).when(k == 1, v * 10.0 + 1_500_000).when(k == 2, v * 1000.0 + 1_000_000).otherwise(v * 10.0 + 30_000_000)
    df = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), x.alias("x"), y.alias("y"))
    return crs.suggested_crs(df, by=["n_nationkey"])


_LCC = "0.9999 * 6378137.0"


@query(f"""
WITH c AS (SELECT sqrt(2 / 298.257223563 - 1 / (298.257223563 * 298.257223563)) AS e),
k AS (SELECT e, p1, p2, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2,
  tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1, tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2,
  tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0 FROM (SELECT e, radians(24) AS p0, radians(12.472955) AS p1, radians(35.172805) AS p2 FROM c)),
n AS (SELECT e, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n, m1, t1, t0 FROM k),
f AS (SELECT e, n, 6378137 * m1 / (n * pow(t1, n)) AS r, 6378137 * m1 / (n * pow(t1, n)) * pow(t0, n) AS r0 FROM n),
q AS (SELECT c_custkey, lon, lat, n, r0, r * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2), n) AS rho, n * radians(lon - 80) AS t FROM {_PLACE}, f)
SELECT c_custkey, round(rho * sin(t), 3) + 0.0 AS x, round(r0 - rho * cos(t), 3) AS y, round(lon, 7) + 0.0 AS lon, round(lat, 7) + 0.0 AS lat FROM q""")
def lambert_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conformal cone on two parallels, and the way back."""
    given = (80.0, 24.0, 12.472955, 35.172805)
    x, y = crs.lambert_conic(F.col("lon"), F.col("lat"), *given)
    df = _places(spark, sf_dir).withColumns({"x": x, "y": y})
    # The way back is planned, as for any pair of systems.
    cone = crs.Crs(None, "cone of two parallels", "projected", cone=(*given, 1.0, 0.0, 0.0))
    lon, lat = crs.plan_transform(cone, crs.crs_from_epsg(4326))(F.col("x"), F.col("y"), F.lit(0.0))
    return df.select("c_custkey", (F.round("x", 3) + 0.0).alias("x"), F.round("y", 3).alias("y"), (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


@query("""
SELECT p_partkey, round(p_retailprice * 0.3048, 6) AS metres, round(radians(p_size), 9) AS radians, round(p_retailprice / 4046.8564224, 9) AS acres, round(p_size / 0.001, 6) AS litres FROM part""")
def units_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(crs.convert(price, "foot", "metre"), 6).alias("metres"), F.round(crs.convert(size, "degree", "radian"), 9).alias("radians"),
        F.round(crs.convert(price, "square_metre", "acre"), 9).alias("acres"), F.round(crs.convert(size, "cubic_metre", "litre"), 6).alias("litres"),
    )


@query("""
SELECT c_custkey AS point, c_mktsegment AS code, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 2.0 END AS z, false AS skipped FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_custkey, c_mktsegment, NULL, NULL, NULL, true FROM customer WHERE c_custkey % 7 = 0""")
def table_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate table of text: some rows have no northing, some no height."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Point"), F.col("c_acctbal").cast("string").alias("Easting"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("string")).otherwise("n/a").alias("Northing"),
        F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") / 2).cast("string")).alias("RL"), F.col("c_mktsegment").alias("Code"),
    )
    points, skipped = tables.table_to_points(c, tables.match_headers(c.columns))
    p = g.positions(F.col("geom"))[0]
    made = points.select(F.col("Point").alias("point"), F.col("Code").alias("code"), p[0].alias("x"), p[1].alias("y"), F.get(p, F.lit(2)).alias("z"), F.lit(False).alias("skipped"))
    none = F.lit(None).cast("double")
    return made.unionByName(skipped.select(F.col("Point").alias("point"), F.col("Code").alias("code"), none.alias("x"), none.alias("y"), none.alias("z"), F.lit(True).alias("skipped")))


# Rules.


@query(f"""
SELECT a.idx AS a, b.idx AS b, round(CASE WHEN a.minx = b.minx OR a.miny = b.miny THEN 0.1 ELSE sqrt(0.02) END, 6) AS gap
FROM {_PARCEL} a JOIN {_PARCEL} b ON a.idx < b.idx AND abs(a.minx - b.minx) <= 10 AND abs(a.miny - b.miny) <= 10""")
def rule_must_not_have_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels a tenth short of their neighbours."""
    return rules.must_not_have_gaps(layers.parcels(spark, sf_dir, 9.9), 0.01).select("a", "b", F.round("gap", 6).alias("gap"))


@query(f"""
SELECT a.idx AS a, b.idx AS b, round(0.01 * (1 + a.p_size % 5), 6) AS gap FROM {_PARCEL} a JOIN {_PARCEL} b ON b.idx = a.idx + 1 AND b.minx > a.minx WHERE a.p_size % 3 = 0""")
def rule_shared_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with a vertex in the middle of each side; every third's eastern one is a little off."""
    off = F.when(F.col("p_size") % 3 == 0, 0.01 * (1 + F.col("p_size") % 5)).otherwise(0.0)
    x, y = F.col("maxx"), (F.col("miny") + F.col("maxy")) / 2
    shell = g.densified(F.get(F.get("geom.parts", F.lit(0)), F.lit(0)), 5.0)
    moved = F.transform(shell, lambda p: F.when((p[0] == x) & (p[1] == y), F.array(p[0] + off, p[1])).otherwise(p))
    df = layers.parcels(spark, sf_dir).withColumn("geom", g.polygon(moved))
    return rules.shared_boundaries_must_match(df, 0.001).select("a", "b", F.round("gap", 6).alias("gap"))


@query(f"""
SELECT idx FROM {_PARCEL} p WHERE NOT EXISTS (
  SELECT 1 FROM supplier WHERE s_suppkey % 50 * 10 IN (minx, minx + 10) AND floor(s_suppkey / 50) * 10 IN (miny, miny + 10))""")
def rule_must_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", g.point(F.col("s_suppkey") % 50 * 10.0, F.floor(F.col("s_suppkey") / 50) * 10.0).alias("geom"))
    return rules.must_touch(layers.parcels(spark, sf_dir), s, 0.001).select("idx")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each customer, end to end, but for gaps of a tenth or two by nation."""
    x = F.col("c_custkey") * 10.0
    end = x + 10 - F.col("c_nationkey") % 3 * 0.1
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.array(F.array(x, F.lit(0.0)), F.array(end, F.lit(0.0))).alias("path"))


@query("""
SELECT a.c_custkey AS idx, 1 AS side, a.c_custkey * 10.0 + 10 - a.c_nationkey % 3 * 0.1 AS x FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE b.c_custkey IS NULL OR a.c_nationkey % 3 > 0
UNION ALL SELECT a.c_custkey, 0, a.c_custkey * 10.0 FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey - 1 WHERE b.c_custkey IS NULL OR b.c_nationkey % 3 > 0""")
def rule_lines_must_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.lines_must_connect(_chain(spark, sf_dir), 0.01).select("idx", "side", "x")


@query("""
SELECT a.c_custkey AS idx, CASE WHEN b.c_nationkey % 3 = 1 THEN a.c_custkey * 10.0 - 0.1 WHEN b.c_nationkey % 3 = 2 THEN a.c_custkey * 10.0 - 0.2 ELSE a.c_custkey * 10.0 END AS x0,
  a.c_custkey * 10.0 + 10 - a.c_nationkey % 3 * 0.1 AS x1 FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey - 1""")
def lines_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the greater key moves its end to the other's."""
    out = rules.extended_lines(_chain(spark, sf_dir))
    return out.select("idx", F.get("path", F.lit(0))[0].alias("x0"), F.element_at("path", -1)[0].alias("x1"))


@query(f"""
SELECT idx, 0 AS part, 0 AS ring, 1.0 + p_size % 4 AS gap FROM {_PARCEL} WHERE p_size % 4 > 0""")
def rule_polygons_must_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shells whose last vertex is a little above the first; of every fourth it is within the tolerance."""
    up = F.when(F.col("p_size") % 4 > 0, 1.0 + F.col("p_size") % 4).otherwise(0.001)
    shell = F.get(F.get("geom.parts", F.lit(0)), F.lit(0))
    n = F.size(shell)
    open_ = F.transform(shell, lambda p, i: F.when(i == n - 1, F.array(p[0], p[1] + up)).otherwise(p))
    return rules.polygons_must_close(layers.parcels(spark, sf_dir).withColumn("geom", g.polygon(open_)), 0.01)


# Repairs with plan, application and undoing.


@query("""
SELECT p_partkey AS idx, 100 - n * n AS before, CASE WHEN n = 1 THEN 99.5 ELSE 100 - n * n END AS after, 0.0 AS moved, 100 - n * n AS undone
FROM (SELECT p_partkey, 1.0 + p_size % 4 AS n FROM part)""")
def repair_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices within one of an earlier one are snapped to it: small corners are cut, small holes fold up."""
    plots = layers.plots(spark, sf_dir)
    plan = rules.plan_repair(plots, "snap-vertices", 1.0)
    after = rules.apply_repair(plots, plan)
    back = rules.undo_repair(after, plan).select("idx", F.col("geom").alias("__back"))
    shell = lambda c: g.signed_area(F.get(F.get(F.col(c)["parts"], F.lit(0)), F.lit(0)))
    return after.select("idx", F.col("geom").alias("__after")).join(shuffled(plan.select("idx", "before", "moved")), "idx").join(shuffled(back), "idx").select(
        "idx", shell("before").alias("before"), shell("__after").alias("after"), "moved", shell("__back").alias("undone")
    )


# Georeferencing.


@query("""
WITH p AS (SELECT c_acctbal / 100 AS u, CAST(c_nationkey AS DOUBLE) AS v, 2 * c_acctbal / 100 - 0.5 * c_nationkey + 100 + c_custkey % 7 * 0.1 AS x, 0.5 * c_acctbal / 100 + 2 * c_nationkey + 50 AS y FROM customer),
m AS (SELECT avg(u) AS mu, avg(v) AS mv, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM p),
s AS (SELECT sum((u - mu) * (u - mu)) AS uu, sum((u - mu) * (v - mv)) AS uv, sum((v - mv) * (v - mv)) AS vv, sum((u - mu) * (x - mx)) AS ux, sum((v - mv) * (x - mx)) AS vx,
  sum((u - mu) * (y - my)) AS uy, sum((v - mv) * (y - my)) AS vy FROM p, m),
f AS (SELECT (vv * ux - uv * vx) / (uu * vv - uv * uv) AS a, (uu * vx - uv * ux) / (uu * vv - uv * uv) AS b, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS d, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS e,
  (ux + vy) / (uu + vv) AS sa, (uy - vx) / (uu + vv) AS sd FROM s)
SELECT 'affine' AS kind, n, round(a, 6) AS a, round(b, 6) AS b, round(mx - a * mu - b * mv, 6) AS c, round(d, 6) AS d, round(e, 6) AS e, round(my - d * mu - e * mv, 6) AS f FROM f, m
UNION ALL SELECT 'similarity', n, round(sa, 6), round(-sd, 6), round(mx - sa * mu + sd * mv, 6), round(sd, 6), round(sa, 6), round(my - sd * mu - sa * mv, 6) FROM f, m""")
def control_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double")
    points = table(spark, sf_dir, "customer").select(
        u.alias("u"), v.alias("v"), (2 * u - 0.5 * v + 100 + F.col("c_custkey") % 7 * 0.1).alias("x"), (0.5 * u + 2 * v + 50).alias("y")
    )
    fits = [georeference.fit_control(points, k) for k in ("affine", "similarity")]
    rows = [(f.kind, f.n, *(round(x, 6) + 0.0 for x in f.affine)) for f in fits]  # two rows of eight numbers
    return spark.createDataFrame(rows, "kind string, n long, a double, b double, c double, d double, e double, f double")


@query(f"""
SELECT idx, round(1000 + 2 * minx - 0.5 * miny, 6) AS x, round(2000 + 0.5 * minx + 2 * miny, 6) AS y, 425.0 AS area, minx AS back_x, miny AS back_y FROM {_PARCEL}""")
def layer_georeferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = (2.0, -0.5, 1000.0, 0.5, 2.0, 2000.0)
    out = georeference.georeferenced(layers.parcels(spark, sf_dir), turn)
    back = georeference.georeferenced(out.withColumnRenamed("geom", "moved").withColumn("geom", F.col("moved")), georeference.inverted(turn))

    def first(c: Column) -> Column:
        return g.positions(c)[0]

    return back.select(
        "idx", F.round(first(F.col("moved"))[0], 6).alias("x"), F.round(first(F.col("moved"))[1], 6).alias("y"), F.round(g.area(F.col("moved")), 6).alias("area"),
        *[(F.round(first(F.col("geom"))[i], 6) + 0.0).alias(f"back_{k}") for i, k in enumerate("xy")],
    )


_PIXELS = "(SELECT event_id // 64 AS row, event_id % 64 AS col, CAST(floor(value / 40) AS INTEGER) AS v FROM events)"


@query(f"""
WITH RECURSIVE d AS (SELECT * FROM {_PIXELS}),
r(row, col, v, root) AS (
  SELECT row, col, v, row * 1000 + col FROM d
  UNION SELECT d.row, d.col, d.v, r.root FROM r JOIN d ON d.v = r.v AND abs(d.row - r.row) + abs(d.col - r.col) = 1),
m AS (SELECT row, col, v, min(root) AS root FROM r GROUP BY 1, 2, 3)
SELECT CAST(v AS BIGINT) AS value, count(*) AS cells, CAST(count(*) AS DOUBLE) AS area, min(col) + 0.0 AS minx, max(row) + 1.0 AS maxy FROM m GROUP BY v, root""")
def raster_region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = layers.dem(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 40))
    b = g.bounds(F.col("geom"))
    return components.region_polygons(df).select(
        F.col("value").cast("bigint").alias("value"), F.col("cells").cast("bigint").alias("cells"), F.round(g.area(F.col("geom")), 6).alias("area"), b["minx"].alias("minx"), b["maxy"].alias("maxy")
    )


# Edits of vertices, measurements, tiles, masks.


@query("""
SELECT p_partkey AS idx, 10.0 * w + (2 * w + 10 * (1 + p_size % 3)) / 2.0 AS moved, 10.0 * w + 5 * (2 + p_size % 5) AS inserted, 5.0 * w AS deleted, round(0.4 * (1 + p_size % 3), 6) AS drift
FROM (SELECT *, 10.0 + p_size % 4 AS w FROM part)""")
def vertices_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corner of rectangles moves out, a side gets a new vertex, a corner goes; and how far vertices drift when all is moved."""
    x, y, k = F.col("minx"), F.col("miny"), F.col("p_size")
    w = 10.0 + k % 4
    df = layers.parcels(spark, sf_dir).withColumn("geom", g.polygon(g.box(x, y, x + w, y + 10)))
    ring = F.get(F.get("geom.parts", F.lit(0)), F.lit(0))
    made = {"moved": g.vertex_moved(ring, 2, 1.0 + k % 3, 2.0), "inserted": g.vertex_inserted(ring, 2, F.array(x + w + 2 + k % 5, y + 5)), "deleted": g.vertex_deleted(ring, 2)}
    shift = 0.1 * (1 + k % 3)
    after = df.withColumn("geom", g.map_positions(F.col("geom"), lambda p: F.array(p[0] + 3 * shift, p[1] + 4 * shift)))
    drift = fidelity.vertex_drift(df, after, ["idx"]).withColumn("drift", F.round("drift", 6))
    return df.select("idx", *[F.round(g.signed_area(c), 6).alias(name) for name, c in made.items()]).join(drift, "idx")


@query("""
WITH p AS (SELECT event_id, value AS x, user_id + 0.5 AS y FROM events), q AS (SELECT x + 0.5 + event_id % 3 AS x, y + 0.25 AS y FROM p WHERE event_id % 5 = 0)
SELECT round(max(d), 6) AS drift FROM (SELECT q.x, q.y, min(greatest(abs(q.x - p.x), abs(q.y - p.y))) AS d FROM q, p WHERE abs(q.x - p.x) <= 20 AND abs(q.y - p.y) <= 20 GROUP BY ALL)""")
def layer_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a layer of moved observations is from the layer of all of them, whatever belongs to what."""
    obs = layers.observations(spark, sf_dir).select("idx", g.point(F.col("x"), F.col("y")).alias("geom"))
    moved = obs.where("idx % 5 = 0").withColumn("geom", g.map_positions(F.col("geom"), lambda p: F.array(p[0] + 0.5 + F.col("idx") % 3, p[1] + 0.25)))
    return fidelity.layer_drift(obs, moved, 0.5).select(F.round("drift", 6).alias("drift"))


@query(f"""
SELECT c_custkey, round(degrees(abs(atan2(lon, lat))), 6) AS angle, round(100 * h / sqrt(lon * lon + lat * lat), 6) AS percent,
  round(lon + 100 * sin(radians(c_custkey % 360)), 6) + 0.0 AS x, round(lat + 100 * cos(radians(c_custkey % 360)), 6) + 0.0 AS y,
  CASE WHEN c_custkey % 360 < 90 OR c_custkey % 360 >= 270 THEN 'N ' ELSE 'S ' END ||
  CASE c_custkey % 360 // 90 WHEN 0 THEN c_custkey % 360 WHEN 1 THEN 180 - c_custkey % 360 WHEN 2 THEN c_custkey % 360 - 180 ELSE 360 - c_custkey % 360 END || '.0°' ||
  CASE WHEN c_custkey % 360 < 180 THEN ' E' ELSE ' W' END AS quadrant FROM {_PLACE} WHERE lon <> 0 OR lat <> 0""")
def places_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle from north at the origin, slope from it, where a bearing leads, and that bearing's quadrant."""
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    p, turn = F.array("lon", "lat", "h"), (F.col("c_custkey") % 360).cast("double")
    to = g.from_bearing_distance(p, turn, F.lit(100.0))
    return _places(spark, sf_dir).where("lon <> 0 or lat <> 0").select(
        "c_custkey", F.round(g.angle_between(F.array(F.lit(0.0), F.lit(1.0)), zero, p), 6).alias("angle"), F.round(g.slope(zero, p)["percent"], 6).alias("percent"),
        (F.round(to[0], 6) + 0.0).alias("x"), (F.round(to[1], 6) + 0.0).alias("y"), g.quadrant(turn).alias("quadrant"),
    )


_TILE_Y = "CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * {1}) AS INTEGER)"


@query(f"""
SELECT c_custkey, CAST(floor((lon + 180) / 360 * 1024) AS INTEGER) AS tile_x, {_TILE_Y.format("lat", 1024)} AS tile_y,
  round(degrees(atan(sinh(pi() * (1 - 2 * {_TILE_Y.format("lat", 1024)} / 1024.0)))), 9) + 0.0 AS north, CAST(least(greatest(floor(log2(360 / (256 * (abs(lat) + 1) / 1000)) + 0.5), 0), 19) AS INTEGER) AS zoom,
  c_custkey % 256 * 256.0 + c_custkey % 7 + (c_custkey % 11) / 256.0 - 32768 AS height FROM {_PLACE}""")
def tiles_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = tiles.tile_of(F.col("lon"), F.col("lat"), 10)
    k = F.col("c_custkey")
    return _places(spark, sf_dir).select(
        "c_custkey", x.alias("tile_x"), y.alias("tile_y"), (F.round(tiles.tile_corner(x, y, 10)[1], 9) + 0.0).alias("north"),
        tiles.tile_zoom((F.abs("lat") + 1) / 1000, 19).alias("zoom"), tiles.terrain_height(k % 256, k % 7, k % 11).alias("height"),
    )


@query(f"""
SELECT c_custkey, CAST(x % 128 AS INTEGER) AS tile_x, y AS tile_y FROM (
  SELECT c_custkey, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (
    SELECT c_custkey, CAST(floor((lon + 180) / 360 * 128) AS BIGINT) AS x0, CAST(floor((lon + 185) / 360 * 128) AS BIGINT) AS x1,
      {_TILE_Y.format("(lat + 3)", 128)} AS y0, {_TILE_Y.format("lat", 128)} AS y1 FROM {_PLACE})), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)""")
def tiles_covering_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _places(spark, sf_dir).select("c_custkey", F.col("lon").alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 5).alias("maxx"), (F.col("lat") + 3).alias("maxy"))
    return tiles.tiles_covering(boxes, 7).select("c_custkey", "tile_x", "tile_y")


@query("""
WITH p AS (SELECT p_partkey AS idx, 1.0 + p_size % 4 AS n FROM part),
c AS (SELECT idx, n, CASE WHEN a.s_suppkey IS NULL THEN 0.0 ELSE 18.0 END + CASE WHEN b.s_suppkey IS NULL THEN 0.0 ELSE 18 - least(n, 3) * greatest(n - 2, 0) END AS cut
  FROM p LEFT JOIN supplier a ON a.s_suppkey = idx LEFT JOIN supplier b ON b.s_suppkey = idx - 1 AND idx % 50 <> 0)
SELECT idx, CASE WHEN cut > 0 THEN cut END AS clipped, 99 - n * n - cut AS erased FROM c""")
def plots_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots cut to squares of six, one for each supplier, that lie over two plots; and what is left outside."""
    x, y = F.col("s_suppkey") % 50 * 10.0 + 7, F.floor(F.col("s_suppkey") / 50) * 10.0 + 2
    corners = dict(zip(spatial.BOX, (x, y, x + 6, y + 6), strict=True))
    masks = table(spark, sf_dir, "supplier").select(*[c.alias(k) for k, c in corners.items()], g.polygon(g.box(*corners.values())).alias("geom"))
    plots = layers.plots(spark, sf_dir)
    clipped, erased = (vector.masked(plots, masks, 40.0, e).select("idx", F.round(g.area(F.col("geom")), 6).alias(name)) for e, name in ((False, "clipped"), (True, "erased")))
    return erased.join(shuffled(clipped), "idx", "left").select("idx", "clipped", "erased")


# Shared borders.


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels whose right side is short of the neighbour's left side by one to three hundredths."""
    df = layers.parcels(spark, sf_dir)
    x, y = F.col("minx"), F.col("miny")
    return df.withColumn("right", F.round(x + 10 - 0.01 * (1 + F.col("p_size") % 3), 9)).withColumn("geom", g.polygon(g.box(x, y, F.col("right"), y + 10)))


@query("""
WITH p AS (SELECT p_partkey AS idx, p_partkey % 50 AS gx, p_partkey // 50 AS gy, 0.01 * (1 + p_size % 3) AS e FROM part),
c AS (SELECT idx, gx + i AS nx, gy + j AS ny, i, (gx + i) * 10.0 - CASE WHEN i = 1 THEN e ELSE 0 END AS x FROM p, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) v(i, j)),
m AS (SELECT nx, ny, avg(x) AS tx FROM c GROUP BY 1, 2),
s AS (SELECT idx, i, x, tx FROM c JOIN m USING (nx, ny))
SELECT idx, round(sum(CASE WHEN i = 1 THEN tx ELSE -tx END) * 5, 6) AS area, count(*) FILTER (WHERE abs(tx - x) > 1e-9) AS moved, round(max(abs(tx - x)), 6) + 0.0 AS moved_by FROM s GROUP BY idx""")
def parcels_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with gaps between them after their corners moved to common nodes."""
    out = shared.snap_shared_edges(_gapped(spark, sf_dir), 0.05)
    return out.select("idx", F.round(g.area(F.col("geom")), 6).alias("area"), "moved", (F.round("moved_by", 6) + 0.0).alias("moved_by"))


@query("""
WITH p AS (SELECT p_partkey AS idx, p_partkey % 50 AS gx FROM part)
SELECT p.idx, half, CASE WHEN p.idx % 3 = 0 THEN 0 ELSE CASE WHEN l.idx % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN r.idx % 3 = 0 THEN 1 ELSE 0 END END AS inserted
FROM p LEFT JOIN p l ON l.idx = p.idx - 1 AND p.gx > 0 LEFT JOIN p r ON r.idx = p.idx + 1 AND p.gx < 49, LATERAL (SELECT unnest(CASE WHEN p.idx % 3 = 0 THEN [0, 1] ELSE [0] END) AS half)""")
def parcels_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third parcel with a gap is two halves: the corners between them go into the neighbours' sides."""
    df = _gapped(spark, sf_dir).withColumn("half", F.explode(F.when(F.col("idx") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    y = F.col("miny") + 5.0 * F.col("half")
    high = F.when(F.col("idx") % 3 == 0, 5.0).otherwise(10.0)
    df = df.withColumn("geom", g.polygon(g.box(F.col("minx"), y, F.col("right"), y + high))).withColumn("key", F.col("idx") * 2 + F.col("half"))
    return shared.rebuild_topology(df, 0.05, 10.0, "key").select("idx", "half", "inserted")


@query("""
WITH ring AS (SELECT p_partkey AS idx, (p_partkey % 50) * 10.0 AS x, p_partkey // 50 * 10.0 AS y, 1.0 + p_size % 4 AS n FROM part),
edge AS (
  SELECT idx, x, y, x + e.x1 + e.n1 * n AS ax, y + e.y1 + e.m1 * n AS ay, x + e.x2 + e.n2 * n AS bx, y + e.y2 + e.m2 * n AS b_y
  FROM ring, (VALUES (0, 0, 0, 0, 10, 0, 0, 0), (10, 0, 0, 0, 10, 10, 0, 0), (10, 10, 0, 0, 0, 10, 1, 0), (0, 10, 1, 0, 0, 10, 1, -1), (0, 10, 1, -1, 0, 10, 0, -1), (0, 10, 0, -1, 0, 0, 0, 0),
    (6, 3, 0, 0, 6, 4, 0, 0), (6, 4, 0, 0, 7, 4, 0, 0), (7, 4, 0, 0, 7, 3, 0, 0), (7, 3, 0, 0, 6, 3, 0, 0)) e(x1, y1, n1, m1, x2, y2, n2, m2)),
pt AS (SELECT event_id, value AS px, user_id + 0.5 AS py FROM events),
near AS (
  SELECT event_id, px, py, e.*, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0), 1) AS t
  FROM pt JOIN edge e ON px >= x - 0.8 AND px <= x + 10.8 AND py >= y - 0.8 AND py <= y + 10.8),
far AS (
  SELECT event_id, unnest([0, 0, 1, 2]) AS rank, unnest([sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay)), sqrt((px - bx) * (px - bx) + (py - b_y) * (py - b_y)),
    sqrt((px - (ax + bx) / 2) * (px - (ax + bx) / 2) + (py - (ay + b_y) / 2) * (py - (ay + b_y) / 2)), sqrt((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) + (py - ay - t * (b_y - ay)) * (py - ay - t * (b_y - ay)))]) AS d FROM near)
SELECT event_id, ['vertex', 'midpoint', 'segment'][rank + 1] AS kind, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rank, d) AS r FROM far WHERE d <= 0.8) WHERE r = 1""")
def observations_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each observation would snap to on the borders of plots: a corner before the middle of a side before a side."""
    obs = layers.observations(spark, sf_dir).select(F.col("idx").alias("event_id"), "x", "y")
    out = shared.snap_targets(obs, layers.plots(spark, sf_dir), 0.8, 5.0, point_key="event_id")
    return out.select("event_id", "kind", F.round("distance", 6).alias("distance"))


# Labels, reprojected rasters, squared shapes.


_LABEL = """(SELECT p_partkey AS idx, 'plot ' || p_name AS t, p_partkey % 50 * 10.0 + p_size % 7 AS x, p_partkey // 50 * 3.0 + p_size % 5 * 0.5 AS y, p_size // 5 * 1.0 AS c FROM part)"""


@query(f"""
WITH RECURSIVE l AS (SELECT *, length(t) * 0.3 AS w, row_number() OVER (ORDER BY c DESC, idx) AS k FROM {_LABEL}),
n AS (SELECT a.k, list(b.k) FILTER (WHERE b.k IS NOT NULL) AS near FROM l a LEFT JOIN l b ON b.k < a.k AND abs(a.x - b.x) < a.w + b.w AND abs(a.y - b.y) < 1 GROUP BY a.k),
r(k, placed) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT n.k, CASE WHEN list_has_any(placed, coalesce(near, [])) THEN placed ELSE list_append(placed, n.k) END FROM r JOIN n ON n.k = r.k + 1),
p AS (SELECT unnest(placed) AS k FROM (SELECT placed FROM r ORDER BY k DESC LIMIT 1))
SELECT idx, k NOT IN (SELECT k FROM p) AS suppressed FROM l""")
def labels_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the parts' names: which of them would overlap one that has more room."""
    k, size = F.col("p_partkey"), F.col("p_size")
    made = table(spark, sf_dir, "part").select(
        k.alias("idx"), F.concat(F.lit("plot "), "p_name").alias("text"), (k % 50 * 10.0 + size % 7).alias("x"),
        (F.expr("p_partkey div 50") * 3.0 + size % 5 * 0.5).alias("y"), (F.expr("p_size div 5") * 1.0).alias("clearance"),
    )
    return labels.resolve_collisions(made, 1.0, 16.0).select("idx", "suppressed")


@query(f"""
WITH h AS (SELECT max(event_id) // 64 + 1 AS h FROM events),
b AS (SELECT h, 6378137.0 * radians(77.0) AS x0, 6378137.0 * radians(77.64) AS x1, 6378137.0 * ln(tan(pi() / 4 + radians(28.0 - 0.01 * h) / 2)) AS y0, 6378137.0 * ln(tan(pi() / 4 + radians(28.0) / 2)) AS y1 FROM h),
s AS (SELECT *, sqrt((x1 - x0) * (y1 - y0) / (64 * h)) AS s FROM b),
g AS (SELECT *, CAST(greatest(1, ceil((x1 - x0) / s)) AS BIGINT) AS gw, CAST(greatest(1, ceil((y1 - y0) / s)) AS BIGINT) AS gh FROM s),
px AS (SELECT gw, x0, y1, s, row, unnest(range(0, gw)) AS col FROM (SELECT *, unnest(range(0, gh)) AS row FROM g)),
aim AS (SELECT row, col, CAST(floor((degrees((x0 + (col + 0.5) * s) / 6378137.0) - 77.0) / 0.01) AS BIGINT) AS c, CAST(floor((28.0 - degrees(2 * atan(exp((y1 - (row + 0.5) * s) / 6378137.0)) - pi() / 2)) / 0.01) AS BIGINT) AS r FROM px)
SELECT CAST(aim.row AS INTEGER) AS row, CAST(aim.col AS INTEGER) AS col, coalesce(value, -9999) AS value FROM aim LEFT JOIN (SELECT event_id // 64 AS r, event_id % 64 AS c, value FROM events) d USING (r, c)""")
def dem_reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster, placed in degrees, on a grid of Web Mercator that is planned from its edges; blank outside."""
    rows = layers.dem_rows(spark, sf_dir)
    out, *_ = raster.reproject(layers.dem(spark, sf_dir), 64, rows, (77.0, 0.01, 0.0, 28.0, 0.0, -0.01), crs.crs_from_epsg(4326), crs.crs_from_epsg(3857), no_data=-9999.0)
    return out.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")


@query("""
SELECT p_partkey AS idx, round((p_partkey % 50) * 20.0 + s / 2, 6) AS minx, round((p_partkey % 50) * 20.0 + 12 + s / 2, 6) AS maxx, 60.0 + 12 * (p_size % 3) AS area, round(s / 2, 6) AS moved_by
FROM (SELECT *, (5 + p_size % 3) * 0.03 * (1 + p_size % 4) AS s FROM part)""")
def slanted_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted plots of twelve by five to seven come square in the frame of their long side."""
    k, size = F.col("p_partkey"), F.col("p_size")
    h, x, y = 5.0 + size % 3, k % 50 * 20.0, F.floor(k / 50) * 20.0
    s = h * 0.03 * (1 + size % 4)
    ring = F.array(*[g.position(*p) for p in ((x, y), (x + 12, y), (x + 12 + s, y + h), (x + s, y + h), (x, y))])
    df = table(spark, sf_dir, "part").select(k.alias("idx"), g.polygon(ring).alias("geom"))
    out, b = vector.regularise(df), g.bounds(F.col("geom"))
    return out.select("idx", F.round(b["minx"], 6).alias("minx"), F.round(b["maxx"], 6).alias("maxx"), F.round(g.area(F.col("geom")), 6).alias("area"), F.round("moved_by", 6).alias("moved_by"))


@query("""
SELECT idx, minx + CASE n WHEN 3 THEN 6.5 WHEN 4 THEN 7 ELSE 5 END AS x, miny + CASE n WHEN 1 THEN 6.5 WHEN 2 THEN 6 WHEN 3 THEN 8.5 ELSE 8 END AS y
FROM (SELECT p_partkey AS idx, 1 + p_size % 4 AS n, (p_partkey % 50) * 10.0 AS minx, p_partkey // 50 * 10.0 AS miny FROM part)""")
def plots_represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point inside of every plot, clear of its hole and its cut corner."""
    p = g.representative_point(F.col("geom"))
    # Few bytes, but much work for each.
    made = vector.spread(layers.plots(spark, sf_dir), "idx").withColumn("at", F.explode(F.array(p)))
    return made.select("idx", F.round(F.col("at")[0], 6).alias("x"), F.round(F.col("at")[1], 6).alias("y"))
