"""Borders that neighbours share: vertices snapped to common nodes, nodes put into the edges they lie on, snap targets.

Shapes are taken apart into rows of vertices and edges, which meet in grid cells: an edge is dealt to the cells that
it runs through, with a margin, so a long slanted edge isn't met by all points of its box. Changed vertices
are joined back and rings are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import spatial
from plumbline.operators.components import components
from plumbline.operators.joins import shuffled
from plumbline.storage import stored

PLACE = ["part", "ring", "pos"]


def vertices(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """``key, part, ring, pos, p``: every position of every ring, ends of closed rings included."""
    rows = df.select(key, F.posexplode(f"{geom}.parts").alias("part", "rs")).select(key, "part", F.posexplode("rs").alias("ring", "r"))
    return rows.select(key, "part", "ring", F.posexplode("r").alias("pos", "p"))


def reassembled(rows: DataFrame, key: str) -> DataFrame:
    """``key, parts`` from vertices in any order; ``pos`` may be of any type that is ordered."""
    one = lambda of, what: F.transform(F.array_sort(F.collect_list(F.struct(of, what))), lambda s: s[what])
    rings = rows.groupBy(key, "part", "ring").agg(one("pos", "p").alias("r"))
    parts = rings.groupBy(key, "part").agg(one("ring", "r").alias("rs"))
    return parts.groupBy(key).agg(one("part", "rs").alias("parts"))


def edge_cells(edges: DataFrame, cell: float, margin: float, ends: tuple[str, str, str, str] = ("ax", "ay", "bx", "by")) -> DataFrame:
    """A row for each cell (``cx``, ``cy``) that is within ``margin`` of an edge, column by column of cells."""
    back = F.col(ends[0]) > F.col(ends[2])
    ax, ay, bx, by = (F.when(back, F.col(b)).otherwise(F.col(a)) for a, b in zip(ends, (ends[2], ends[3], ends[0], ends[1]), strict=True))
    at = lambda v: F.floor(v / cell)
    wide = edges.withColumn("cx", F.explode(F.sequence(at(ax - margin), at(bx + margin))))
    slope = F.when(bx > ax, (by - ay) / (bx - ax))
    left = F.least(F.greatest(ax, F.col("cx") * cell - margin), bx)
    right = F.greatest(F.least(bx, (F.col("cx") + 1) * cell + margin), ax)
    y0, y1 = F.coalesce(ay + slope * (left - ax), ay), F.coalesce(ay + slope * (right - ax), by)
    more = margin + cell * 1e-9
    return wide.withColumn("cy", F.explode(F.sequence(at(F.least(y0, y1) - more), at(F.greatest(y0, y1) + more))))


def points_near_edges(points: DataFrame, edges: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """Pairs of points ``x, y`` and edges ``ax, ay, bx, by`` at most so far apart: ``t`` (0 to 1) and ``qx, qy`` on the edge, ``distance``."""
    dealt = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    met = dealt.join(shuffled(edge_cells(edges, cell, tolerance)), ["cx", "cy"]).drop("cx", "cy")
    ax, ay, bx, by, x, y = (F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y"))
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    met = met.withColumn("t", t).withColumns({"qx": ax + F.col("t") * dx, "qy": ay + F.col("t") * dy})
    return met.withColumn("distance", F.hypot(x - F.col("qx"), y - F.col("qy"))).where(F.col("distance") <= tolerance)


def shared_nodes(df: DataFrame, tolerance: float, key: str = "idx", geom: str = "geom") -> DataFrame:
    """``x, y, tx, ty, features, moved_by``: vertices that come near ones of other features, and their common node.

    Vertices within the tolerance of each other, directly or by others, are one node: their mean, each feature's
    vertex once. What only one feature has is no shared node and isn't touched.
    """
    own = vertices(df, key, geom).select(F.col(key).alias("owner"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y")).distinct()
    # Places are joined once, however many features have a vertex there.
    places = stored(own.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("first"), F.max("owner").alias("last")).withColumn("id", F.struct("x", "y")), "places")
    a = places.select(F.col("id").alias("a"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = places.select(F.col("id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    links = spatial.within_distance(a, b, tolerance).where("a < b").select("a", "b")
    of = components(places.select("id"), links)
    named = stored(places.join(shuffled(of), "id"), "nodes")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    nodes = named.groupBy("component").agg(mean("x").alias("tx"), mean("y").alias("ty"), F.min("first").alias("f"), F.max("last").alias("l"), F.sum("n").alias("features"))
    nodes = nodes.where("f <> l").select("component", F.round("tx", 9).alias("tx"), F.round("ty", 9).alias("ty"), "features")
    out = named.join(shuffled(nodes), "component").select("x", "y", "tx", "ty", "features")
    return out.withColumn("moved_by", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")))


def snap_shared_edges(df: DataFrame, tolerance: float, key: str = "idx", geom: str = "geom") -> DataFrame:
    """A layer whose vertices near those of neighbours lie on common nodes, with ``moved`` (vertices) and ``moved_by`` (the farthest)."""
    nodes = shared_nodes(df, tolerance, key, geom).where("moved_by > 0")
    rows = vertices(df, key, geom).withColumns({"x": F.col("p")[0], "y": F.col("p")[1]}).join(shuffled(nodes), ["x", "y"], "left")
    new = F.when(F.col("tx").isNotNull(), F.concat(F.array("tx", "ty"), F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))))).otherwise(F.col("p"))
    rows = stored(rows.withColumn("p", new), "snapped")
    # The end of a closed ring isn't a vertex of its own.
    facts = rows.where("tx is not null").groupBy(key).agg(F.count_distinct("x", "y").alias("moved"), F.max("moved_by").alias("moved_by"))
    whole = reassembled(rows.select(key, *PLACE, "p"), key)
    out = df.join(shuffled(whole), key).join(shuffled(facts), key, "left").withColumn(geom, g.geometry(F.col(f"{geom}.type"), F.col("parts"))).drop("parts")
    return out.withColumns({"moved": F.coalesce("moved", F.lit(0)), "moved_by": F.coalesce("moved_by", F.lit(0.0))})


def rebuild_topology(df: DataFrame, tolerance: float, cell: float, key: str = "idx", geom: str = "geom") -> DataFrame:
    """Shared edges snapped, and then every vertex put into the edges that it lies on, of whatever feature: ``inserted`` counts them.

    No position moves in the second step. A vertex within the tolerance of an edge's ends isn't inserted; several go in
    their order along the edge.
    """
    snapped = stored(snap_shared_edges(df, tolerance, key, geom), "snapped-layer")
    rows = stored(vertices(snapped, key, geom), "vertices")
    nodes = rows.select(F.col("p")[0].alias("x"), F.col("p")[1].alias("y")).distinct()
    before = rows.select(key, "part", "ring", F.col("pos").alias("pos"), F.col("p")[0].alias("ax"), F.col("p")[1].alias("ay"))
    after = rows.select(key, "part", "ring", (F.col("pos") - 1).alias("pos"), F.col("p")[0].alias("bx"), F.col("p")[1].alias("by"))
    edges = before.join(shuffled(after), [key, *PLACE])
    away = lambda a, b: F.hypot(F.col("x") - F.col(a), F.col("y") - F.col(b)) > tolerance
    hits = points_near_edges(nodes, edges, tolerance, cell).where(away("ax", "ay") & away("bx", "by") & (F.col("t") > 0) & (F.col("t") < 1))
    # Of two at one place along an edge the first by position goes in.
    hits = hits.groupBy(key, *PLACE, "t").agg(F.min(F.struct("x", "y")).alias("p")).select(key, "part", "ring", (F.col("pos") + F.col("t")).alias("pos"), F.array("p.x", "p.y").alias("p"))
    hits = stored(hits, "inserted")
    whole = reassembled(rows.select(key, "part", "ring", F.col("pos").cast("double").alias("pos"), "p").unionByName(hits), key)
    counts = hits.groupBy(key).agg(F.count(F.lit(1)).alias("inserted"))
    out = snapped.join(shuffled(whole), key).join(shuffled(counts), key, "left").withColumn(geom, g.geometry(F.col(f"{geom}.type"), F.col("parts"))).drop("parts")
    return out.withColumn("inserted", F.coalesce("inserted", F.lit(0)))


def snap_targets(points: DataFrame, layer: DataFrame, tolerance: float, cell: float, key: str = "idx", point_key: str = "point", kinds: tuple[str, ...] = ("vertex", "midpoint", "segment")) -> DataFrame:
    """For each point the best target of a layer within the tolerance: ``kind``, ``of`` (the feature), ``tx, ty``, ``distance``.

    Kinds go in the order in which they are given: a vertex is taken before a nearer place on an edge. Within a kind the
    nearest is, then the least feature, then the least position. Points without a target are left out.
    """
    rows = vertices(layer, key)
    before = rows.select(key, *PLACE, F.col("p")[0].alias("ax"), F.col("p")[1].alias("ay"))
    after = rows.select(key, "part", "ring", (F.col("pos") - 1).alias("pos"), F.col("p")[0].alias("bx"), F.col("p")[1].alias("by"))
    edges = before.join(shuffled(after), [key, *PLACE]).select(F.col(key).alias("of"), "ax", "ay", "bx", "by")
    # A vertex or a midpoint within the tolerance lies on an edge that is.
    met = points_near_edges(points.select(point_key, "x", "y"), edges, tolerance, cell)
    place = {
        "vertex": [(F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))],
        "midpoint": [((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)],
        "segment": [(F.col("qx"), F.col("qy"))],
    }

    def target(rank: int, kind: str, tx: Column, ty: Column) -> Column:
        far = F.hypot(F.col("x") - tx, F.col("y") - ty)
        return F.when(far <= tolerance, F.struct(F.lit(rank).alias("rank"), far.alias("distance"), F.col("of").alias("of"), tx.alias("tx"), ty.alias("ty"), F.lit(kind).alias("kind")))

    found = F.array_compact(F.array(*[target(k, kind, *at) for k, kind in enumerate(kinds) for at in place[kind]]))
    best = met.select(point_key, F.array_min(found).alias("m")).where("m is not null").groupBy(point_key).agg(F.min("m").alias("m"))
    return best.select(point_key, "m.kind", "m.of", "m.tx", "m.ty", "m.distance")
