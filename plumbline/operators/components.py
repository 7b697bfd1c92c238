"""Connected components, and what rests on them: raster regions, adjacent polygons, merged lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import spatial
from plumbline.operators.joins import shuffled
from plumbline.storage import stored


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes (id)`` with ``component``, the smallest id reachable over ``links (a, b)`` between them.

    In a round every node goes to its least neighbour, if that is less than itself. Where such steps end is found by pointer
    jumping, so the logarithm of the longest way counts, and each tree then becomes one node with the
    links that leave it. So what is left shrinks from round to round; each is kept in the shared folder.
    """
    # Sides are kept before they are joined, so that they are plain shuffles, which the adaptive planner
    # splits where very many nodes go to one.
    left = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(nodes.select("id", F.col("id").alias("component")).distinct())
    while left.take(1):
        roots = _ends(left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).where("to < id"))
        for end in ("a", "b"):
            of = shuffled(roots.select(F.col("id").alias(end), F.col("to").alias("__to")))
            left = left.join(of, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        left = stored(left.where("a <> b").distinct(), "links-left")
        known = shuffled(roots.withColumnRenamed("id", "component"))
        labels = stored(labels.join(known, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
    return labels


def _ends(steps: DataFrame) -> DataFrame:
    """``steps (id, to)`` with ``to`` where one after another ends; every ``to`` is less than its id."""
    state = stored(steps.select("id", "to", F.lit(True).alias("moved")), "steps")
    while state.where("moved").take(1):
        ahead = shuffled(state.select(F.col("id").alias("to"), F.col("to").alias("next")))
        further = state.join(ahead, "to", "left")
        state = stored(further.select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "steps")
    return state.select("id", "to")


def _labelled_runs(pixels: DataFrame) -> DataFrame:
    """Row-wise runs of equal values with ``component``: as many nodes as runs, not pixels."""
    from plumbline.operators.raster import runs_of_value

    place = (F.col("band").cast("bigint") * (1 << 20) + F.col("row")) * (1 << 20) + F.col("c0")
    runs = stored(runs_of_value(pixels).withColumn("id", place))
    a = runs.select(F.col("id").alias("a"), "band", "value", "row", F.col("c0").alias("a0"), F.col("c1").alias("a1"))
    b = runs.select(F.col("id").alias("b"), "band", "value", (F.col("row") - 1).alias("row"), F.col("c0").alias("b0"), F.col("c1").alias("b1"))
    links = a.join(shuffled(b), ["band", "value", "row"]).where("a0 <= b1 and b0 <= a1").select("a", "b")
    return runs.join(shuffled(components(runs, links)), "id")


def raster_regions(pixels: DataFrame) -> DataFrame:
    """Edge-connected regions of equal values: ``band, value, region, cells`` and pixel bounds."""
    return (
        _labelled_runs(pixels)
        .groupBy("band", "value", F.col("component").alias("region"))
        .agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    )


def region_polygons(pixels: DataFrame) -> DataFrame:
    """Each region as a multi polygon with its cell count: the union of its runs' rectangles."""
    from plumbline.operators.planar import dissolve

    runs = stored(_labelled_runs(pixels))
    x0, x1, y0, y1 = F.col("c0").cast("double"), F.col("c1") + 1.0, F.col("row").cast("double"), F.col("row") + 1.0
    shapes = runs.select("component", x0.alias("minx"), y0.alias("miny"), g.polygon(g.box(x0, y0, x1, y1)).alias("geom"))
    facts = runs.groupBy("component").agg(F.first("value").alias("value"), F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"))
    return dissolve(shapes, "component", 8.0).join(shuffled(facts), "component")


def adjacent_groups(polygons: DataFrame, size: float, key: str = "idx") -> DataFrame:
    """``key`` with ``component`` for polygons that share an edge in whole: by equi-joins on edges."""
    ring = F.explode(g.rings(F.col("geom"))).alias("ring")
    edges = polygons.select(F.col(key).alias("id"), ring).select(
        "id", F.explode(F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda p, q: F.array_sort(F.array(p, q)))).alias("edge")
    )
    # Each edge names its least polygon; the others link to it.
    least = edges.groupBy("edge").agg(F.min("id").alias("b"))
    links = edges.join(shuffled(least), "edge").select(F.col("id").alias("a"), "b").where("a <> b")
    return components(polygons.select(F.col(key).alias("id")), links).withColumnRenamed("id", key)


def merge_adjacent(polygons: DataFrame, size: float, key: str = "idx") -> DataFrame:
    """Polygons that share edges in whole, directly or by others, as one: the least ``key``, ``merged`` (how many) and ``geom``."""
    from plumbline.operators.planar import dissolve

    groups = stored(adjacent_groups(polygons, size, key), "adjacent")
    counts = groups.groupBy(F.col("component").alias(key)).agg(F.count(F.lit(1)).alias("merged"))
    whole = dissolve(polygons.join(groups, key), "component", size).withColumnRenamed("component", key)
    return counts.join(whole, key)


def merge_lines(lines: DataFrame, key: str = "idx", path: str = "path", within: tuple[str, ...] = ()) -> DataFrame:
    """Lines joined end to end where exactly two ends meet; junctions of three or more stay.

    Lines meet only where they are equal in the columns ``within``. Returns ``component`` (the
    least key of a chain), ``merged`` (how many lines), ``path`` and those columns.

    Each line can be run through in two directions, and a direction has at most one that
    follows it. By pointer jumping every direction learns its chain's last one and how many
    steps away it is, in rounds that grow with the logarithm of the longest chain. Of a chain's
    two directions the one is kept in which its least line runs as it was given; a closed chain
    begins there. A chain's pieces are gathered, in order, into the one value that it is.
    """
    node = lambda p: F.array(*[F.round(p[i], 9) + 0.0 for i in (0, 1)])
    first, last = F.get(path, F.lit(0)), F.element_at(path, -1)
    rows = stored(lines.select(F.col(key).alias("id"), *within, F.col(path).alias("path"), node(first).alias("a"), node(last).alias("b")), "lines")
    ends = rows.select("id", *within, F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side")))).alias("e")).select("id", *within, "e.*")
    # Of two ends that meet, each is where the other line goes on. A line that ends where it begins stays as it is.
    meet = ends.groupBy("node", *within).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "side")).alias("x"), F.max(F.struct("id", "side")).alias("y"))
    meet = meet.where((F.col("n") == 2) & (F.col("x.id") != F.col("y.id"))).select("x", "y")
    of = stored(components(rows.select("id"), meet.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))), "chains")
    # Way 0 enters a line by its side 0 and leaves by side 1; way 1 the other way round.
    both = meet.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("y").alias("u"), F.col("x").alias("v")))).alias("m"))
    follow = both.select(F.col("m.u.id").alias("id"), (1 - F.col("m.u.side")).alias("way"), F.col("m.v.id").alias("to"), F.col("m.v.side").alias("to_way"))
    linked = rows.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("way")).join(of, "id").join(follow, ["id", "way"], "left")
    rings = stored(linked.groupBy("component").agg(F.bool_and(F.col("to").isNotNull()).alias("ring")).where("ring"), "rings")
    goes_on = F.col("to").isNotNull() & ~(F.col("ring").isNotNull() & (F.col("to") == F.col("component")))
    state = stored(
        linked.join(rings, "component", "left").select(
            "component", "id", "way",
            F.when(goes_on, F.col("to")).otherwise(F.col("id")).alias("to"),
            F.when(goes_on, F.col("to_way")).otherwise(F.col("way")).alias("to_way"),
            F.when(goes_on, 1).otherwise(0).cast("long").alias("steps"), goes_on.alias("moved"),
        ),
        "ways",
    )
    while state.where("moved").take(1):
        ahead = state.select(F.col("id").alias("to"), F.col("way").alias("to_way"), F.col("to").alias("next"), F.col("to_way").alias("next_way"), F.col("steps").alias("more"))
        state = stored(
            state.join(ahead, ["to", "to_way"]).select(
                "component", "id", "way", F.col("next").alias("to"), F.col("next_way").alias("to_way"),
                (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved"),
            ),
            "ways",
        )
    chosen = state.where("id = component and way = 0").select("component", "to", "to_way")
    runs = state.join(chosen, ["component", "to", "to_way"]).join(rows, "id")
    part = F.when(F.col("way") == 0, F.col("path")).otherwise(F.reverse("path"))
    pieces = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), part.alias("p"))))
    joined = runs.groupBy("component", *within).agg(F.count(F.lit(1)).alias("merged"), pieces.alias("pieces"))
    path = F.flatten(F.transform("pieces", lambda x, i: F.when(i == 0, x["p"]).otherwise(F.slice(x["p"], 2, F.size(x["p"])))))
    return joined.select("component", *within, "merged", path.alias("path"))


def near_duplicates(polygons: DataFrame, size: float, tolerance: float) -> DataFrame:
    """Pairs of one type and vertex count whose vertices agree, in order, within the tolerance on each axis."""
    pairs = spatial.candidate_pairs(polygons, size)
    a, b = g.positions(F.col("a_geom")), g.positions(F.col("b_geom"))
    close = F.forall(F.zip_with(a, b, lambda p, q: (F.abs(p[0] - q[0]) <= tolerance) & (F.abs(p[1] - q[1]) <= tolerance)), lambda ok: ok)
    return pairs.where((F.col("a_geom.type") == F.col("b_geom.type")) & (F.size(a) == F.size(b)) & close).select("a", "b")


def contour_lines(pixels: DataFrame, interval: float, base: float = 0.0, no_data: float | None = None, index_every: int = 5) -> DataFrame:
    """Contours as lines in pixel coordinates: ``band, elevation, is_index, length, closed, path``.

    Segments of marching squares meet at equal points; those of one band and level are joined.
    """
    from plumbline.operators.raster import contour_segments

    segments = contour_segments(pixels, interval, base, no_data).where("x1 <> x2 or y1 <> y2")
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    named = stored(
        segments.select(F.xxhash64("band", "level", "r", "c", *ends).alias("idx"), "band", "level", F.array(F.array(*ends[:2]), F.array(*ends[2:])).alias("path"))
    )
    lines = merge_lines(named, within=("band", "level"))
    path = F.col("path")
    return lines.select(
        "band",
        F.col("level").alias("elevation"),
        (F.floor(F.round((F.col("level") - base) / interval)) % index_every == 0).alias("is_index"),
        g.path_length(path).alias("length"), g.is_closed(path).alias("closed"), "path",
    )


def polygonize(lines: DataFrame, tolerance: float, size: float, key: str = "idx", least_area: float = 0.0) -> DataFrame:
    """Closed loops of lines, end to end within the tolerance, as polygons; loops inside loops are holes.

    Ends are snapped to a grid of the tolerance first. A loop at odd depth is a hole of the
    smallest loop around it. Loops meet the loops around them by a join on grid cells.
    """
    snap = lambda p: F.transform(p, lambda v: F.floor(v / tolerance + 0.5) * tolerance)
    path = F.col("path")
    ends = lines.select(key, F.concat(F.array(snap(F.get(path, F.lit(0)))), F.slice(path, 2, F.greatest(F.size(path) - 2, F.lit(0))), F.array(snap(F.element_at(path, -1)))).alias("path"))
    ring = F.col("ring")
    loops = merge_lines(ends, key).select("component", g.oriented(F.col("path")).alias("ring"))
    loops = loops.where((F.size("ring") > 3) & g.is_closed(ring)).withColumn("area", F.abs(g.signed_area(ring))).where(F.col("area") > least_area)
    b = g.bounds(F.col("geom"))
    loops = stored(loops.withColumn("geom", g.polygon(ring)).select("*", *[b[k].alias(k) for k in spatial.BOX]))
    # The middle of the first edge stands for a loop: loops don't cross.
    mid = [(ring[0][i] + ring[1][i]) / 2 for i in (0, 1)]
    marks = loops.select(F.col("component").alias("inner"), F.col("area").alias("inner_area"), mid[0].alias("x"), mid[1].alias("y"))
    around = spatial.contained(marks, loops, size).where((F.col("inner") != F.col("component")) & (F.col("area") > F.col("inner_area")))
    depth = around.groupBy("inner").agg(F.count(F.lit(1)).alias("depth"), F.min_by("component", "area").alias("parent"))
    placed = loops.join(depth.withColumnRenamed("inner", "component"), "component", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    holes = placed.where("depth % 2 = 1").groupBy(F.col("parent").alias("component")).agg(F.collect_list(F.reverse("ring")).alias("holes"))
    shells = placed.where("depth % 2 = 0").join(holes, "component", "left")
    whole = F.concat(F.array(ring), F.coalesce("holes", F.array().cast("array<array<array<double>>>")))
    return shells.select(F.col("component").alias(key), g.geometry("Polygon", F.array(whole)).alias("geom"))
