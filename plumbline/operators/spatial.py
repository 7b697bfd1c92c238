"""Spatial joins as equi-joins on grid cells.

Each side is dealt to the cells its box touches, the join is a hash or merge join on the
cell, and exact predicates follow. A pair that shares several cells is kept in one only:
the cell of the greater of both least corners. So nothing is compared twice, no
distinct is needed, and the adaptive planner can split a crowded cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.joins import shuffled
from plumbline.storage import stored

BOX = ("minx", "miny", "maxx", "maxy")


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def with_cells(df: DataFrame, size: float, box: tuple[str, ...] = BOX) -> DataFrame:
    """A row for each cell (``cx``, ``cy``) that a box touches."""
    a, b, c, d = (F.col(x) for x in box)
    return df.withColumn("cx", F.explode(F.sequence(_cell(a, size), _cell(c, size)))).withColumn(
        "cy", F.explode(F.sequence(_cell(b, size), _cell(d, size)))
    )


def boxes_meet(left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    """Closed boxes: touching counts."""
    return (
        (F.col(left[0]) <= F.col(right[2])) & (F.col(left[2]) >= F.col(right[0]))
        & (F.col(left[1]) <= F.col(right[3])) & (F.col(left[3]) >= F.col(right[1]))
    )


#: Cells of a level are so many times as wide as those of the level below.
STEP = 4


def level_of(box: tuple[str, ...], size: float) -> Column:
    """The lowest level whose cells are at least as wide as a box, which touches four of them at most."""
    across = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1])) / size
    level = F.greatest(F.ceil(F.log(across) / math.log(STEP)), F.lit(0))
    return F.when(across <= 1, 0).otherwise(F.when(across <= F.pow(F.lit(float(STEP)), level), level).otherwise(level + 1)).cast("int")


def _used(df: DataFrame, box: tuple[str, ...], size: float) -> Column:
    """The levels that a side's boxes are on, as a scalar subquery: it is part of the plan, not a job of its own."""
    return df.select(level_of(box, size).alias("level")).agg(F.array_sort(F.collect_set("level"))).scalar()


def _dealt(df: DataFrame, box: tuple[str, ...], size: float, others: Column, own_role: int, up_role: int) -> DataFrame:
    """Rows for the cells of a box: on its own level and, to meet larger boxes, on those of the other side above."""
    made = df.withColumns({"__level": level_of(box, size), "__others": others})
    level = F.col("__level")
    place = lambda at, role: F.struct(at.cast("int").alias("level"), F.lit(role).alias("role"))
    same = F.transform(F.filter("__others", lambda o: o == level), lambda o: place(o, 0))
    above = F.transform(F.filter("__others", lambda o: o > level), lambda o: place(o, up_role))
    below = F.when(F.exists("__others", lambda o: o < level), F.array(place(level, own_role))).otherwise(F.array().cast("array<struct<level:int,role:int>>"))
    made = made.withColumn("__at", F.explode(F.concat(same, above, below))).drop("__others", "__level")
    cell = F.lit(float(size)) * F.pow(F.lit(float(STEP)), F.col("__at.level"))
    made = made.withColumns({"__cell": cell, "__lv": F.col("__at.level"), "__role": F.col("__at.role")}).drop("__at")
    across = [F.sequence(F.floor(F.col(box[k]) / F.col("__cell")), F.floor(F.col(box[k + 2]) / F.col("__cell"))) for k in (0, 1)]
    return made.withColumn("cx", F.explode(across[0])).withColumn("cy", F.explode(across[1]))


def box_join(left: DataFrame, right: DataFrame, size: float, lbox: tuple[str, ...], rbox: tuple[str, ...], points: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose boxes meet; columns of both sides must differ in name.

    Grids of several levels, each of cells ``STEP`` times as wide as the one below. A box is entered on the
    level of its own size, where it touches four cells at most, and once more for each higher level
    that the other side uses. Two boxes meet on the level of the larger one only: of
    two that are both small, neither is compared on a level that only large ones need. Which
    levels are used is found by the plan itself. ``points``: left boxes are points, so that the left side isn't
    asked, and may be a stream. ``on``: columns of both sides that are equal as well.
    """
    left_levels = F.array(F.lit(0)) if points else _used(left, lbox, size)
    a = _dealt(left, lbox, size, _used(right, rbox, size), 1, 2)
    b = _dealt(right, rbox, size, left_levels, 2, 1).drop("__cell")
    first = [F.floor(F.greatest(lbox[k], rbox[k]) / F.col("__cell")) == F.col(c) for k, c in enumerate(("cx", "cy"))]
    pairs = a.join(shuffled(b), [*on, "__lv", "__role", "cx", "cy"]).where(boxes_meet(lbox, rbox) & first[0] & first[1])
    return pairs.drop("__lv", "__role", "__cell", "cx", "cy")


def candidate_pairs(df: DataFrame, size: float, key: str = "idx") -> DataFrame:
    """Each unordered pair of one layer whose boxes meet, as ``a`` and ``b`` with a < b."""
    left = df.select(F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in (*BOX, "geom")])
    right = df.select(F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in (*BOX, "geom")])
    pairs = box_join(left, right, size, tuple(f"a_{c}" for c in BOX), tuple(f"b_{c}" for c in BOX))
    return pairs.where(F.col("a") < F.col("b"))


def contained(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", on: tuple[str, ...] = ()) -> DataFrame:
    """Points with each polygon that holds them: half-open edges, holes excluded; ``on``: columns that are equal as well."""
    spots = points.withColumns({"__x0": F.col(x), "__y0": F.col(y), "__x1": F.col(x), "__y1": F.col(y)})
    pairs = box_join(spots, polygons, size, ("__x0", "__y0", "__x1", "__y1"), BOX, points=True, on=on).drop("__x0", "__y0", "__x1", "__y1")
    return pairs.where(g.in_polygon(F.col(x), F.col(y), F.col("geom")))


def point_layers(features: DataFrame, layer: str = "layer", geom: str = "geom") -> DataFrame:
    """The features of layers that have a point at all: those that a border is drawn from."""
    having = features.where(F.col(f"{geom}.type").isin("Point", "MultiPoint")).select(layer).distinct()
    return features.join(having, layer, "left_semi")


def enclosed(borders: DataFrame, points: DataFrame, size: float, key: str = "idx") -> DataFrame:
    """For each border, ``key`` and ``enclosed``: how many points its outer ring holds that aren't vertices of it.

    A point that was passed over is usually a corner that was missed. Borders have ``minx, miny, maxx, maxy, geom``, points
    ``x, y``; those at one place count each.
    """
    outer = F.transform(F.col("geom.parts"), lambda rs: F.slice(rs, 1, 1))
    shells = borders.select(key, *BOX, g.geometry(F.col("geom.type"), outer).alias("geom"))
    used = borders.select(F.col(key), F.explode(g.positions(F.col("geom"))).alias("__p")).select(key, F.col("__p")[0].alias("x"), F.col("__p")[1].alias("y")).distinct()
    held = contained(points.select("x", "y"), shells, size).join(shuffled(used), [key, "x", "y"], "left_anti")
    counts = held.groupBy(key).agg(F.count(F.lit(1)).alias("enclosed"))
    return borders.select(key).join(shuffled(counts), key, "left").select(key, F.coalesce("enclosed", F.lit(0)).alias("enclosed"))


def burn_in(polygons: DataFrame, texts: DataFrame, size: float, text: str, priority: str = "nearest", key: str = "idx", separator: str = " / ", field: str | None = None) -> DataFrame:
    """Gives each polygon the text of a point inside it; polygons without one keep null.

    ``nearest`` to the middle of its box, ``largest`` text height (column ``height``),
    ``first`` by row, ``field``: the greatest value of a column of ``texts``, or all, ``concatenate``d in
    order. Ties go by text. A point inside several
    polygons is burnt into the first of them by ``key`` only.
    """
    named = texts.select(F.col(text).alias("burnt"), "x", "y", *[c for c in dict.fromkeys(("height", "row", field)) if c in texts.columns])
    found = contained(named.withColumn("__point", F.xxhash64(*named.columns)), polygons, size)
    # Equal points are burnt alike, so they may share their mark.
    firsts = found.groupBy("__point").agg(F.min(key).alias(key))
    found = found.join(shuffled(firsts), ["__point", key], "left_semi")
    if priority == "concatenate":
        best = found.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("burnt")), separator).alias("burnt"))
    else:
        far = F.hypot(F.col("x") - (F.col("minx") + F.col("maxx")) / 2, F.col("y") - (F.col("miny") + F.col("maxy")) / 2)
        if priority == "field":
            best = found.groupBy(key, field).agg(F.min("burnt").alias("burnt")).groupBy(key).agg(F.max_by("burnt", field).alias("burnt"))
            return polygons.join(shuffled(best), key, "left")
        rank = {"nearest": far, "largest": -F.col("height") if priority == "largest" else None, "first": F.col("row") if priority == "first" else None}[priority]
        best = found.groupBy(key).agg(F.min(F.struct(rank.alias("r"), "burnt")).alias("m")).select(key, F.col("m.burnt").alias("burnt"))
    return polygons.join(shuffled(best), key, "left")


def orphans(texts: DataFrame, polygons: DataFrame, size: float, key: str) -> DataFrame:
    """Points in no polygon."""
    return texts.join(shuffled(contained(texts, polygons, size).select(key)), key, "left_anti")


def within_distance(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """Pairs of points (``lx, ly`` and ``rx, ry``) at most so far apart; cells are as wide as the distance."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumn("n", F.explode(near)).withColumn("cx", _cell(F.col("lx"), distance) + F.col("n.i")).withColumn("cy", _cell(F.col("ly"), distance) + F.col("n.j")).drop("n")
    b = right.withColumn("cx", _cell(F.col("rx"), distance)).withColumn("cy", _cell(F.col("ry"), distance))
    gap = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
    return a.join(shuffled(b), ["cx", "cy"]).withColumn("distance", gap).where(F.col("distance") <= distance).drop("cx", "cy")


def nearest(left: DataFrame, right: DataFrame, key: str, start: float, by_axis: bool = False) -> DataFrame:
    """For each left point the nearest right point, by distance then right key; exact.

    ``by_axis``: the distance is the larger one of both axes.

    Searches with a distance that grows fourfold for the points that found none; none is given
    up, since the last distance covers both layers. In a round a point looks first at the
    boxes of the right points in cells of an eighth of the distance, some hundreds at most,
    and then only at the points of boxes that can hold the nearest; right points at one place
    count once. So crowded places and far points don't meet all of a layer. Each round's finds,
    and the points that are left, are kept in the shared folder.
    """
    away = F.greatest if by_axis else F.hypot
    right = stored(right.groupBy("rx", "ry").agg(F.min_by(F.struct(*right.columns), "rkey").alias("r")).select("r.*"), "right")
    spans = [df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first() for df, a, b in ((left, "lx", "ly"), (right, "rx", "ry"))]
    if any(s[0] is None for s in spans):
        return within_distance(left.limit(0), right.limit(0), start)
    reach = 2 * max(max(s[1], t[1]) - min(s[0], t[0]) + max(s[3], t[3]) - min(s[2], t[2]) for s in spans for t in spans)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out, rest, d = None, left.where(F.col("lx").isNotNull() & F.col("ly").isNotNull()), start
    while True:
        placed = right.withColumn("sx", _cell(F.col("rx"), d / 8)).withColumn("sy", _cell(F.col("ry"), d / 8))
        boxes = placed.groupBy("sx", "sy").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("rx", "ry") for f in (F.min, F.max)])
        boxes = boxes.withColumn("cx", F.floor(F.col("sx") / 8)).withColumn("cy", F.floor(F.col("sy") / 8))
        spots = rest.select(F.col(key), "lx", "ly", F.explode(near).alias("n")).select(
            key, "lx", "ly",
            (F.floor(_cell(F.col("lx"), d / 8) / 8) + F.col("n.i")).alias("cx"), (F.floor(_cell(F.col("ly"), d / 8) / 8) + F.col("n.j")).alias("cy"),
        )
        off = {c: (F.greatest(F.col(f"min_r{c}") - F.col(f"l{c}"), F.col(f"l{c}") - F.col(f"max_r{c}"), F.lit(0.0))) for c in "xy"}
        far = {c: F.greatest(F.abs(F.col(f"min_r{c}") - F.col(f"l{c}")), F.abs(F.col(f"max_r{c}") - F.col(f"l{c}"))) for c in "xy"}
        seen = spots.join(boxes, ["cx", "cy"]).select(
            key, "lx", "ly", "sx", "sy", away(off["x"], off["y"]).alias("least"), away(far["x"], far["y"]).alias("most")
        )
        # Some hundreds of boxes for a point: the nearest right point is no farther than the nearest far corner.
        bound = F.min("most").over(Window.partitionBy(key))
        open_ = seen.withColumn("bound", bound).where((F.col("least") <= F.col("bound") * (1 + 1e-12)) & (F.col("least") <= d)).select(key, "lx", "ly", "sx", "sy")
        pairs = open_.join(placed.drop("lx", "ly"), ["sx", "sy"]).withColumn("distance", away(F.abs(F.col("lx") - F.col("rx")), F.abs(F.col("ly") - F.col("ry"))))
        # A little less than d, so that no rounding puts a point of that distance into a cell farther off.
        found = pairs.where(F.col("distance") <= d * (1 - 1e-9))
        best = found.groupBy(key).agg(F.min(F.struct("distance", "rkey", *[c for c in right.columns if c != "rkey"])).alias("m")).select(key, "m.*")
        best = stored(best, "nearest")
        out = best if out is None else out.unionByName(best)
        rest = stored(rest.join(best.select(key), key, "left_anti"), "left")
        if d > reach or not rest.take(1):
            break
        d *= 4
    return left.join(out, key)


def overlapping(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs of polygons those whose shells cross properly, or one of which holds all of the other."""
    shell_a, shell_b = F.col("a_geom.parts")[0][0], F.col("b_geom.parts")[0][0]

    def edges(r: Column) -> Column:
        return F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    crossing = F.exists(edges(shell_a), lambda e: F.exists(edges(shell_b), lambda f: g.segments_cross(e["p"], e["q"], f["p"], f["q"])))

    def holds(outer: Column, inner: Column) -> Column:
        return F.forall(inner, lambda p: g.in_ring(p[0], p[1], outer))

    return pairs.withColumn(
        "relation",
        F.when(crossing, "overlap").when(holds(shell_a, shell_b), "a holds b").when(holds(shell_b, shell_a), "b holds a"),
    ).where(F.col("relation").isNotNull())


def dangling_ends(lines: DataFrame, tolerance: float, key: str = "idx") -> DataFrame:
    """Line ends that no other line's end is within the tolerance of, though one is within a hundred times it."""
    ends = lines.select(F.col(key), F.explode(F.array(F.get("path", F.lit(0)), F.element_at("path", -1))).alias("p"))
    a = ends.select(F.col(key).alias("line"), F.col("p")[0].alias("lx"), F.col("p")[1].alias("ly"))
    b = ends.select(F.col(key).alias("other"), F.col("p")[0].alias("rx"), F.col("p")[1].alias("ry"))
    gaps = within_distance(a, b, 100 * tolerance).where(F.col("line") != F.col("other"))
    return gaps.groupBy("line", "lx", "ly").agg(F.min("distance").alias("gap")).where(F.col("gap") > tolerance)
