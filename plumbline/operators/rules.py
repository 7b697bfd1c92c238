"""Topology rules, defects and repairs over layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import spatial
from plumbline.operators.joins import shuffled
from plumbline.operators.table import Refused
from plumbline.operators.vector import spread

#: Slivers are thinner than the first and smaller than the second.
SLIVER_THINNESS, SLIVER_AREA = 0.02, 0.5


def is_sliver(geom: Column) -> Column:
    return F.coalesce((g.thinness(geom) < SLIVER_THINNESS) & (g.area(geom) < SLIVER_AREA), F.lit(False))


def hole_outside(geom: Column) -> Column:
    """Whether any hole has a vertex outside its shell."""
    return F.exists(
        geom["parts"],
        lambda rs: F.exists(F.slice(rs, 2, F.size(rs)), lambda h: F.exists(h, lambda p: ~g.in_ring(p[0], p[1], F.get(rs, F.lit(0))))),
    )


def topology_issues(df: DataFrame, key: str = "idx", geom: str = "geom") -> DataFrame:
    """One row for each issue of each feature; shapes of any size are searched for crossings.

    Edges of one ring that cross are found by an equi-join of edges on ring and grid cell.
    """
    # Few bytes, but much work for each.
    df = spread(df, key)
    s = F.col(geom)
    is_area, is_line = s["type"].endswith("Polygon"), s["type"].endswith("LineString")
    issues = {
        "missing geometry": s.isNull(),
        "open ring": is_area & F.exists(g.rings(s), lambda r: ~g.is_closed(r)),
        "too few vertices": (is_area & F.exists(g.rings(s), lambda r: F.size(r) < 4)) | (is_line & F.exists(g.rings(s), lambda r: F.size(r) < 2)),
        "repeated vertices": ~s["type"].endswith("Point") & F.exists(g.rings(s), lambda r: F.size(g.without_repeats(r, 0.0)) < F.size(r)),
        "wrong orientation": is_area & F.exists(s["parts"], lambda rs: g.signed_area(F.get(rs, F.lit(0))) < 0),
        "hole outside shell": is_area & hole_outside(s),
        "sliver": is_area & is_sliver(s),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in issues.items()]))
    crossing = self_crossings(df, key, geom).select(key).distinct().withColumn("issue", F.lit("self-intersection"))
    return df.select(key, F.explode(found).alias("issue")).unionByName(crossing)


def self_crossings(df: DataFrame, key: str = "idx", geom: str = "geom", short: int = 64) -> DataFrame:
    """Pairs of edges of one ring that cross properly: ``key, part, ring, i, j``.

    Edges of short rings meet by their ring; those of longer ones on a grid over their ring of
    about as many cells a side as the root of its edges, so that no ring's edges all meet.
    """
    s = F.col(geom)
    rings = df.where(~s["type"].endswith("Point")).select(F.col(key), F.posexplode(s["parts"]).alias("part", "rings")).select(key, "part", F.posexplode("rings").alias("ring", "path"))
    x, y = F.transform("path", lambda p: p[0]), F.transform("path", lambda p: p[1])
    n = F.size("path") - 1
    side = F.when(n > short, F.floor(F.sqrt(n))).otherwise(1)
    wide = F.greatest(F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y)) / side
    sized = rings.select(key, "part", "ring", F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.greatest(wide, F.lit(1e-12)).alias("cell"), "path")
    ends = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    edges = sized.where(F.size("path") > 3).select(key, "part", "ring", "x0", "y0", "cell", F.posexplode(ends).alias("i", "e"))

    def place(k: int, f: object, origin: str) -> Column:
        return F.floor((f(F.col("e.p")[k], F.col("e.q")[k]) - F.col(origin)) / F.col("cell"))

    dealt = edges.withColumn("cx", F.explode(F.sequence(place(0, F.least, "x0"), place(0, F.greatest, "x0")))).withColumn(
        "cy", F.explode(F.sequence(place(1, F.least, "y0"), place(1, F.greatest, "y0")))
    )
    at = [key, "part", "ring", "cx", "cy"]
    other = dealt.select(*at, F.col("i").alias("j"), F.col("e").alias("f"))
    met = dealt.join(shuffled(other), at).where(F.col("i") < F.col("j"))
    return met.where(g.segments_cross(F.col("e.p"), F.col("e.q"), F.col("f.p"), F.col("f.q"))).select(key, "part", "ring", "i", "j").distinct()


def must_contain(polygons: DataFrame, points: DataFrame, size: float, key: str = "idx") -> DataFrame:
    """Polygons that hold no point of the other layer."""
    return polygons.join(shuffled(spatial.contained(points.select("x", "y"), polygons, size).select(key)), key, "left_anti")


def must_be_within(points: DataFrame, polygons: DataFrame, size: float, key: str) -> DataFrame:
    """Points in no polygon of the other layer."""
    return spatial.orphans(points, polygons, size, key)


def must_not_overlap(polygons: DataFrame, size: float) -> DataFrame:
    """Pairs that cross properly, or one of which holds the other."""
    return spatial.overlapping(spatial.candidate_pairs(polygons, size)).select("a", "b", "relation")


def shell_vertices(polygons: DataFrame, key: str = "idx") -> DataFrame:
    """``key, vertex, x, y`` of each polygon's first shell."""
    at = F.posexplode(F.get(F.get("geom.parts", F.lit(0)), F.lit(0))).alias("vertex", "p")
    return polygons.select(F.col(key), at).select(key, "vertex", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def _closest(polygons: DataFrame, reach: float, key: str) -> DataFrame:
    """``a, b, vertex, gap``: for each vertex of a, the nearest vertex of each other polygon b > a within reach."""
    v = shell_vertices(polygons, key)
    left = v.select(F.col(key).alias("a"), "vertex", F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = v.select(F.col(key).alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.within_distance(left, right, reach).where(F.col("a") < F.col("b"))
    return near.groupBy("a", "b", "vertex").agg(F.min("distance").alias("gap"))


def must_not_have_gaps(polygons: DataFrame, tolerance: float, key: str = "idx") -> DataFrame:
    """Pairs whose nearest vertices are over the tolerance apart, but under fifty times it."""
    nearest = _closest(polygons, 50 * tolerance, key).groupBy("a", "b").agg(F.min("gap").alias("gap"))
    return nearest.where((F.col("gap") > tolerance) & (F.col("gap") < 50 * tolerance))


def shared_boundaries_must_match(polygons: DataFrame, tolerance: float, key: str = "idx") -> DataFrame:
    """Pairs with two or more shared vertices and one that misses by less than a hundred times the tolerance."""
    miss = (F.col("gap") > tolerance) & (F.col("gap") < 100 * tolerance)
    pairs = _closest(polygons, 100 * tolerance, key).groupBy("a", "b").agg(
        F.count_if(F.col("gap") <= tolerance).alias("shared"), F.min(F.when(miss, F.col("gap"))).alias("gap")
    )
    return pairs.where((F.col("shared") >= 2) & F.col("gap").isNotNull())


def _all_vertices(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key), F.explode(g.positions(F.col("geom"))).alias("p")).select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def must_touch(subjects: DataFrame, others: DataFrame, tolerance: float, key: str = "idx") -> DataFrame:
    """Subjects of which no vertex is within the tolerance of any vertex of the other layer."""
    left = _all_vertices(subjects, key).withColumnsRenamed({"x": "lx", "y": "ly"})
    # One vertex of a place is enough.
    right = others.select(F.explode(g.positions(F.col("geom"))).alias("p")).select(F.col("p")[0].alias("rx"), F.col("p")[1].alias("ry")).distinct()
    touching = spatial.within_distance(left, right, tolerance).select(key).distinct()
    return subjects.where(F.size(g.positions(F.col("geom"))) > 0).join(touching, key, "left_anti")


def lines_must_connect(lines: DataFrame, tolerance: float, key: str = "idx") -> DataFrame:
    """Line ends ``key, side, x, y`` with no vertex of another line within the tolerance."""
    ends = lines.where(F.size("path") > 1).select(F.col(key), F.posexplode(F.array(F.get("path", F.lit(0)), F.element_at("path", -1))).alias("side", "p"))
    ends = ends.select(key, "side", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    vertices = lines.select(F.col(key).alias("other"), F.explode("path").alias("p")).select("other", F.col("p")[0].alias("rx"), F.col("p")[1].alias("ry"))
    near = spatial.within_distance(ends.withColumnsRenamed({"x": "lx", "y": "ly"}), vertices, tolerance).where(F.col(key) != F.col("other"))
    return ends.join(shuffled(near.select(key, "side").distinct()), [key, "side"], "left_anti")


def polygons_must_close(polygons: DataFrame, tolerance: float, key: str = "idx") -> DataFrame:
    """Rings ``key, part, ring, gap`` whose ends are over the tolerance apart."""
    rings = polygons.select(F.col(key), F.posexplode("geom.parts").alias("part", "rings")).select(key, "part", F.posexplode("rings").alias("ring", "path"))
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    return rings.withColumn("gap", F.hypot(first[0] - last[0], first[1] - last[1])).where(F.col("gap") > tolerance).drop("path")


def in_scope(df: DataFrame, layer: str | None = None, ids: list | None = None, key: str = "idx") -> DataFrame:
    """The features that a rule or a repair is for: of one layer, or some of it, or all."""
    out = df if layer is None else df.where(F.col("layer") == layer)
    return out if ids is None else out.where(F.col(key).isin(ids))


def evaluated(name: str, subjects: DataFrame, violations: DataFrame) -> DataFrame:
    """A rule's verdict: never passed for a layer without rows."""
    n = subjects.agg(F.count(F.lit(1)).alias("subjects"))
    v = violations.agg(F.count(F.lit(1)).alias("violations"))
    verdict = F.when(F.col("subjects") == 0, "not evaluated").when(F.col("violations") == 0, "passed").otherwise("failed")
    # Two tables of one row each.
    return n.withColumn("k", F.lit(0)).join(v.withColumn("k", F.lit(0)), "k").select(F.lit(name).alias("rule"), "subjects", "violations", verdict.alias("verdict"))


def repaired(geom: Column, tolerance: float = 0.0) -> Column:
    """The safe repairs in order: close rings, drop repeated vertices, orient rings."""
    is_area = geom["type"].endswith("Polygon")
    closed = g.map_rings(geom, lambda r, _: F.when(is_area, g.close_ring(r)).otherwise(r))
    single = g.map_rings(closed, lambda r, _: g.without_repeats(r, tolerance))
    return F.when(is_area, g.orient_polygon(single)).when(geom["type"].endswith("LineString"), single).otherwise(geom)


def without_slivers(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.where(~is_sliver(F.col(geom)))


def without_spikes(path: Column, degrees: float = 5.0) -> Column:
    """Drops the vertices at which a path turns back."""
    sharp = g.spikes(path, degrees)
    return F.filter(path, lambda p, i: ~F.array_contains(sharp, i))


def snapped_to_grid(geom: Column, cell: float) -> Column:
    return g.map_positions(geom, lambda p: F.transform(p, lambda v: F.floor(v / cell + 0.5) * cell))


def profile(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Counts by geometry type, and vertices; one pass with partial sums."""
    s = F.col(geom)
    return df.groupBy(F.coalesce(s["type"], F.lit("null")).alias("type")).agg(
        F.count(F.lit(1)).alias("features"), F.coalesce(F.sum(g.vertex_count(s)), F.lit(0)).alias("vertices"),
        F.min(g.bounds(s)["minx"]).alias("minx"), F.max(g.bounds(s)["maxy"]).alias("maxy"),
    )


def snapped_vertices(path: Column, tolerance: float) -> Column:
    """Moves each vertex to the first earlier one of its path that is within the tolerance."""

    def step(kept: Column, p: Column) -> Column:
        near = F.filter(kept, lambda q: F.hypot(q[0] - p[0], q[1] - p[1]) <= tolerance)
        return F.concat(kept, F.array(F.coalesce(F.get(near, F.lit(0)), p)))

    return F.aggregate(path, F.slice(path, 1, 0), step)


def repair(geom: Column, kind: str, tolerance: float = 0.0) -> Column:
    """A geometry after a repair of one kind; those of paths work on every ring."""
    is_area = geom["type"].endswith("Polygon")
    return {
        "close-rings": lambda: F.when(is_area, g.map_rings(geom, lambda r, _: g.close_ring(r))).otherwise(geom),
        "remove-duplicate-vertices": lambda: g.map_rings(geom, lambda r, _: g.without_repeats(r, tolerance)),
        "remove-zero-length-segments": lambda: g.map_rings(geom, lambda r, _: g.without_repeats(r, 0.0)),
        "fix-ring-orientation": lambda: F.when(is_area, g.orient_polygon(geom)).otherwise(geom),
        "snap-vertices": lambda: g.map_rings(geom, lambda r, _: snapped_vertices(r, tolerance)),
        "snap-to-grid": lambda: snapped_to_grid(geom, tolerance),
        "densify": lambda: g.map_rings(geom, lambda r, _: g.densified(r, tolerance)),
        "fix-safe-issues": lambda: repaired(geom, tolerance),
    }[kind]()


def plan_repair(df: DataFrame, kind: str, tolerance: float = 0.0, protected: tuple[str, ...] = (), layer: str | None = None, ids: list | None = None, key: str = "idx") -> DataFrame:
    """What a repair would change: ``key, before, after, moved`` for the features in scope that it changes.

    ``moved`` is the largest distance of a vertex after it from the nearest vertex before. A
    protected layer is refused.
    """
    if layer in protected:
        raise Refused(f"layer {layer} is protected")
    scope = in_scope(df, layer, ids, key)
    if protected and "layer" in df.columns:
        scope = scope.where(~F.col("layer").isin(list(protected)))
    plan = scope.select(F.col(key), F.col("geom").alias("before"), repair(F.col("geom"), kind, tolerance).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    gap = lambda p, q: F.hypot(p[0] - q[0], p[1] - q[1])
    olds = g.positions(F.col("before"))
    far = F.array_max(F.transform(g.positions(F.col("after")), lambda p: F.array_min(F.transform(olds, lambda q: gap(p, q)))))
    return plan.withColumn("moved", F.coalesce(far, F.lit(0.0)))


def apply_repair(df: DataFrame, plan: DataFrame, key: str = "idx") -> DataFrame:
    """The layer with the plan's geometries; features outside of it stay."""
    return _with_geometry(df, plan, "after", key)


def undo_repair(df: DataFrame, plan: DataFrame, key: str = "idx") -> DataFrame:
    """The layer as it was before the plan was applied, exactly."""
    return _with_geometry(df, plan, "before", key)


def _with_geometry(df: DataFrame, plan: DataFrame, which: str, key: str) -> DataFrame:
    new = plan.select(F.col(key), F.lit(True).alias("__new"), F.col(which).alias("__geom"))
    return df.join(shuffled(new), key, "left").withColumn("geom", F.when(F.col("__new"), F.col("__geom")).otherwise(F.col("geom"))).drop("__new", "__geom")


def extended_lines(lines: DataFrame, tolerance: float = 0.25, key: str = "idx") -> DataFrame:
    """Moves the ends of lines to the nearest end of another line within the tolerance.

    Ends that already meet another stay; of two that are near, the one of the greater key moves.
    """
    ends = lines.where(F.size("path") > 1).select(F.col(key).alias("id"), F.posexplode(F.array(F.get("path", F.lit(0)), F.element_at("path", -1))).alias("side", "p"))
    a = ends.select("id", "side", F.col("p")[0].alias("lx"), F.col("p")[1].alias("ly"))
    b = ends.select(F.col("id").alias("other"), F.col("p").alias("to"), F.col("p")[0].alias("rx"), F.col("p")[1].alias("ry"))
    near = spatial.within_distance(a, b, tolerance).where(F.col("id") != F.col("other"))
    best = near.groupBy("id", "side").agg(F.min(F.struct("distance", "other", "to")).alias("m")).where((F.col("m.distance") > 0) & (F.col("m.other") < F.col("id")))
    to = best.groupBy("id").agg(F.min(F.when(F.col("side") == 0, F.col("m.to"))).alias("__first"), F.min(F.when(F.col("side") == 1, F.col("m.to"))).alias("__last"))
    n = F.size("path")
    path = F.transform("path", lambda p, i: F.when((i == 0) & F.col("__first").isNotNull(), F.col("__first")).when((i == n - 1) & F.col("__last").isNotNull(), F.col("__last")).otherwise(p))
    return lines.join(shuffled(to.withColumnRenamed("id", key)), key, "left").withColumn("path", path).drop("__first", "__last")
