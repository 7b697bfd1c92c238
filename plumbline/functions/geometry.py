"""Geometry as nested arrays, and its functions as Spark columns.

A geometry is ``struct<type, parts>`` with ``parts[component][ring][position][ordinate]``:
a point is ``[[[p]]]``, a line ``[[[p, ...]]]``, a polygon ``[[ring, ...]]`` with the shell
first, and the multi types have several components. Positions are ``[x, y]`` or
``[x, y, z]``, always in x/y order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<type:string,parts:array<array<array<array<double>>>>>"


def geometry(kind: str | Column, parts: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(k.alias("type"), parts.alias("parts")).cast(GEOMETRY)


def position(*ordinates: Column) -> Column:
    return F.array(*[o.cast("double") for o in ordinates])


def point(x: Column, y: Column, *more: Column) -> Column:
    return geometry("Point", F.array(F.array(F.array(position(x, y, *more)))))


def line(positions: Column) -> Column:
    return geometry("LineString", F.array(F.array(positions)))


def polygon(shell: Column, *holes: Column) -> Column:
    return geometry("Polygon", F.array(F.array(shell, *holes)))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A closed ring from the least corner on, counter-clockwise."""
    at = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return F.array(*[position(x, y) for x, y in at])


def rings(g: Column) -> Column:
    return F.flatten(g["parts"])


def positions(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def ordinates(g: Column, k: int) -> Column:
    return F.transform(positions(g), lambda p: p[k])


def bounds(g: Column) -> Column:
    """``struct<minx, miny, maxx, maxy>``; nulls where there is no position."""
    return F.struct(
        F.array_min(ordinates(g, 0)).alias("minx"),
        F.array_min(ordinates(g, 1)).alias("miny"),
        F.array_max(ordinates(g, 0)).alias("maxx"),
        F.array_max(ordinates(g, 1)).alias("maxy"),
    )


def vertex_count(g: Column) -> Column:
    return F.size(positions(g))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it and inside of whatever lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _edges(path: Column, f: Callable[[Column, Column], Column]) -> Column:
    n = F.size(path)
    return F.zip_with(F.slice(path, 1, F.greatest(n - 1, F.lit(0))), F.slice(path, 2, F.greatest(n - 1, F.lit(0))), f)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    """Shoelace; counter-clockwise rings are positive. Relative to the first vertex, for large coordinates."""
    x0, y0 = F.get(ring, 0)[0], F.get(ring, 0)[1]
    return _sum(_edges(ring, lambda p, q: (p[0] - x0) * (q[1] - y0) - (q[0] - x0) * (p[1] - y0))) / 2


def path_length(path: Column) -> Column:
    return _sum(_edges(path, lambda p, q: F.hypot(q[0] - p[0], q[1] - p[1])))


def area(g: Column) -> Column:
    """Of polygons: shells less holes, at least 0; else 0."""

    def component(rs: Column) -> Column:
        whole = F.transform(rs, lambda r: F.abs(signed_area(r)))
        return F.greatest(F.coalesce(F.get(whole, 0), F.lit(0.0)) * 2 - _sum(whole), F.lit(0.0))

    return F.when(g["type"].endswith("Polygon"), _sum(F.transform(g["parts"], component))).otherwise(0.0)


def length(g: Column) -> Column:
    """Of lines their length, of polygons the perimeter of all rings, else 0."""
    return F.when(~g["type"].endswith("Point"), _sum(F.transform(rings(g), path_length))).otherwise(0.0)


def is_closed(ring: Column) -> Column:
    return F.get(ring, 0) == F.element_at(ring, -1)


def close_ring(ring: Column) -> Column:
    """Appends the first vertex where three or more don't end there."""
    return F.when((F.size(ring) >= 3) & ~is_closed(ring), F.concat(ring, F.array(F.get(ring, 0)))).otherwise(ring)


def oriented(ring: Column, clockwise: bool = False) -> Column:
    wrong = signed_area(ring) > 0 if clockwise else signed_area(ring) < 0
    return F.when(wrong, F.reverse(ring)).otherwise(ring)


def map_rings(g: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(ring, its place in its component)`` over all rings."""
    return geometry(g["type"], F.transform(g["parts"], lambda rs: F.transform(rs, f)))


def map_positions(g: Column, f: Callable[[Column], Column]) -> Column:
    return map_rings(g, lambda r, _: F.transform(r, f))


def orient_polygon(g: Column) -> Column:
    """Shells counter-clockwise, holes clockwise."""
    return map_rings(g, lambda r, i: F.when(i == 0, oriented(r)).otherwise(oriented(r, clockwise=True)))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule with half-open edges: the low and left sides are inside, the others outside."""

    def crosses(p: Column, q: Column) -> Column:
        over = (p[1] > y) != (q[1] > y)
        return over & (x < (q[0] - p[0]) * (y - p[1]) / F.when(over, q[1] - p[1]) + p[0])

    hits = _edges(ring, lambda p, q: F.coalesce(crosses(p, q), F.lit(False)))
    return F.aggregate(hits, F.lit(False), lambda a, h: a != h)


def in_polygon(x: Column, y: Column, g: Column) -> Column:
    """In any component's shell and in none of its holes."""

    def inside(rs: Column) -> Column:
        marks = F.transform(rs, lambda r: in_ring(x, y, r))
        return F.coalesce(F.get(marks, 0), F.lit(False)) & (F.size(F.filter(marks, lambda m: m)) == 1)

    return F.exists(g["parts"], inside)


def centroid(g: Column) -> Column:
    """``[x, y]``: by area for polygons, by length for lines, else the mean of positions."""

    def moments(path: Column, by_area: bool) -> Column:
        x0, y0 = F.get(path, 0)[0], F.get(path, 0)[1]

        def of(p: Column, q: Column) -> Column:
            if by_area:
                px, py, qx, qy = p[0] - x0, p[1] - y0, q[0] - x0, q[1] - y0
                w = (px * qy - qx * py) / 2
                return F.array(w, w * (x0 + (px + qx) / 3), w * (y0 + (py + qy) / 3))
            w = F.hypot(q[0] - p[0], q[1] - p[1])
            return F.array(w, w * (p[0] + q[0]) / 2, w * (p[1] + q[1]) / 2)

        zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        return F.aggregate(_edges(path, of), zero, lambda a, m: F.zip_with(a, m, lambda u, v: u + v))

    def total(by_area: bool) -> Column:
        signed = F.transform(rings(g), lambda r: moments(r, by_area))
        zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        return F.aggregate(signed, zero, lambda a, m: F.zip_with(a, m, lambda u, v: u + v))

    n = F.size(positions(g))
    mean = F.array(_sum(ordinates(g, 0)) / n, _sum(ordinates(g, 1)) / n)
    by = F.when(g["type"].endswith("Polygon"), total(True)).when(g["type"].endswith("LineString"), total(False))
    return F.when(by[0] != 0, F.array(by[1] / by[0], by[2] / by[0])).otherwise(mean)


def envelope(g: Column) -> Column:
    b = bounds(g)
    return polygon(box(b["minx"], b["miny"], b["maxx"], b["maxy"]))


def exploded(g: Column) -> Column:
    """An array of single geometries, one for each component; explode it to rows."""
    single = F.regexp_replace(g["type"], "^Multi", "")
    return F.transform(g["parts"], lambda rs: geometry(single, F.array(rs)))


def translated(g: Column, dx: float, dy: float) -> Column:
    return map_positions(g, lambda p: F.concat(F.array(p[0] + dx, p[1] + dy), F.slice(p, 3, 2)))


def scaled(g: Column, factor: float, x: Column, y: Column) -> Column:
    return map_positions(g, lambda p: F.concat(F.array(x + (p[0] - x) * factor, y + (p[1] - y) * factor), F.slice(p, 3, 2)))


def rotated(g: Column, degrees: float, x: Column, y: Column) -> Column:
    """Clockwise for positive angles."""
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    return map_positions(
        g,
        lambda p: F.concat(
            F.array(x + (p[0] - x) * c + (p[1] - y) * s, y - (p[0] - x) * s + (p[1] - y) * c), F.slice(p, 3, 2)
        ),
    )


def segments_cross(p1: Column, p2: Column, q1: Column, q2: Column) -> Column:
    """A proper crossing only: touching and collinear segments don't cross."""

    def side(a: Column, b: Column, c: Column) -> Column:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    return (side(p1, p2, q1) * side(p1, p2, q2) < 0) & (side(q1, q2, p1) * side(q1, q2, p2) < 0)


def self_crossing(path: Column) -> Column:
    """Whether two edges of a path cross properly; compares all pairs, so for short paths."""
    edges = _edges(path, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.exists(
        F.transform(edges, lambda e, i: F.exists(F.slice(edges, i + 2, F.size(edges)), lambda f: segments_cross(e["p"], e["q"], f["p"], f["q"]))),
        lambda hit: hit,
    )


def thinness(g: Column) -> Column:
    """4 pi area / perimeter squared: 1 for a disc, near 0 for slivers."""
    return F.try_divide(4 * F.pi() * area(g), length(g) * length(g))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, from 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def dms(degrees: Column) -> Column:
    """Whole seconds: 12°34'56\"."""
    s = F.round(F.abs(degrees) * 3600).cast("bigint")
    sign = F.when(degrees < 0, "-").otherwise("")
    return F.concat(sign, F.format_string("%d°%02d'%02d\"", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def without_repeats(path: Column, tolerance: float) -> Column:
    """Drops vertices within the tolerance on both axes of the last one that was kept."""

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.abs(p[0] - last[0]) <= tolerance) & (F.abs(p[1] - last[1]) <= tolerance)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(F.slice(path, 2, F.size(path)), F.slice(path, 1, 1), step)


def spikes(path: Column, degrees: float = 5.0) -> Column:
    """Places (from 0) of vertices at which a path turns back by less than the angle."""
    n = F.size(path)

    def turn(i: Column) -> Column:
        a, b, c = F.get(path, i - 1), F.get(path, i), F.get(path, i + 1)
        ux, uy, vx, vy = a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1]
        return F.degrees(F.abs(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)))

    inner = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: turn(i) < degrees)


def densified(path: Column, longest: float) -> Column:
    """Cuts each edge into equal parts no longer than ``longest``."""

    def parts(p: Column, q: Column) -> Column:
        k = F.greatest(F.ceil(F.hypot(q[0] - p[0], q[1] - p[1]) / longest).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.zip_with(p, q, lambda u, v: u + (v - u) * i / k))

    return F.concat(F.flatten(_edges(path, parts)), F.slice(path, -1, 1))


def smoothed(path: Column, passes: int = 1) -> Column:
    """Chaikin's corner cutting; ends of open paths stay."""
    for _ in range(passes):
        cut = F.flatten(
            _edges(path, lambda p, q: F.array(F.zip_with(p, q, lambda u, v: u * 0.75 + v * 0.25), F.zip_with(p, q, lambda u, v: u * 0.25 + v * 0.75)))
        )
        path = F.when(is_closed(path), F.concat(cut, F.slice(cut, 1, 1))).otherwise(
            F.concat(F.slice(path, 1, 1), F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))), F.slice(path, -1, 1))
        )
    return path


def without_small_holes(g: Column, most: float | None = None) -> Column:
    """Drops holes of at most an area, or all."""

    def keep(r: Column, i: Column) -> Column:
        return (i == 0) | (F.lit(False) if most is None else F.abs(signed_area(r)) > most)

    return geometry(g["type"], F.transform(g["parts"], lambda rs: F.filter(rs, keep)))


def along(path: Column, start: float, end: float) -> Column:
    """The part of a line between two distances from its beginning (linear referencing)."""
    steps = _edges(path, lambda p, q: F.struct(p.alias("p"), q.alias("q"), F.hypot(q[0] - p[0], q[1] - p[1]).alias("d")))
    placed = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("at"), F.array().cast("array<array<double>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["d"]).alias("at"),
            F.when((acc["at"] + s["d"] <= start) | (acc["at"] >= end) | (s["d"] == 0), acc["out"])
            .otherwise(
                F.concat(
                    acc["out"],
                    F.when(
                        F.size(acc["out"]) == 0,
                        F.array(_between(s["p"], s["q"], F.greatest(F.lit(0.0), (start - acc["at"]) / s["d"]))),
                    ).otherwise(F.array().cast("array<array<double>>")),
                    F.array(_between(s["p"], s["q"], F.least(F.lit(1.0), (end - acc["at"]) / s["d"]))),
                )
            )
            .alias("out"),
        ),
    )
    return placed["out"]


def _between(p: Column, q: Column, t: Column) -> Column:
    return F.zip_with(p, q, lambda u, v: u + (v - u) * t)


def to_wkt(g: Column) -> Column:
    def number(v: Column) -> Column:
        return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))

    def path(r: Column) -> Column:
        return F.array_join(F.transform(r, lambda p: F.array_join(F.transform(p, number), " ")), ", ")

    def bracketed(items: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))

    polygons = F.transform(g["parts"], lambda rs: bracketed(F.transform(rs, lambda r: F.concat(F.lit("("), path(r), F.lit(")")))))
    paths = F.transform(g["parts"], lambda rs: F.concat(F.lit("("), path(F.get(rs, 0)), F.lit(")")))
    body = (
        F.when(g["type"] == "Polygon", F.get(polygons, 0))
        .when(g["type"] == "MultiPolygon", bracketed(polygons))
        .when(g["type"].isin("Point", "LineString"), F.get(paths, 0))
        .otherwise(bracketed(paths))
    )
    z = F.when(F.size(F.get(positions(g), 0)) > 2, " Z ").otherwise(" ")
    return F.concat(F.upper(g["type"]), z, body)


def to_geojson(g: Column) -> Column:
    """A GeoJSON geometry object as text."""
    coordinates = (
        F.when(g["type"] == "Point", F.to_json(F.get(F.get(F.get(g["parts"], 0), 0), 0)))
        .when(g["type"] == "LineString", F.to_json(F.get(F.get(g["parts"], 0), 0)))
        .when(g["type"] == "Polygon", F.to_json(F.get(g["parts"], 0)))
        .when(g["type"] == "MultiPoint", F.to_json(F.transform(g["parts"], lambda rs: F.get(F.get(rs, 0), 0))))
        .when(g["type"] == "MultiLineString", F.to_json(F.transform(g["parts"], lambda rs: F.get(rs, 0))))
        .otherwise(F.to_json(g["parts"]))
    )
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), coordinates, F.lit("}"))


def from_geojson(text: Column) -> Column:
    """A geometry from a GeoJSON geometry object; null where it is none of the six types."""
    kind = F.get_json_object(text, "$.type")
    raw = F.get_json_object(text, "$.coordinates")

    def read(depth: int) -> Column:
        return F.from_json(raw, "array<" * depth + "double" + ">" * depth)

    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(read(1)))))
        .when(kind == "LineString", F.array(F.array(read(2))))
        .when(kind == "Polygon", F.array(read(3)))
        .when(kind == "MultiPoint", F.transform(read(2), lambda p: F.array(F.array(p))))
        .when(kind == "MultiLineString", F.transform(read(3), lambda r: F.array(r)))
        .when(kind == "MultiPolygon", read(4))
    )
    return F.when(parts.isNotNull(), geometry(kind, parts))


def bounds3(g: Column) -> Column:
    """``struct<minz, maxz>`` of a geometry; null where no position has a height."""
    heights = F.array_compact(ordinates(g, 2))
    return F.struct(F.array_min(heights).alias("minz"), F.array_max(heights).alias("maxz"))


def quadrant(degrees: Column) -> Column:
    """A bearing from north or south towards east or west: N 30.5° E."""
    b = F.pmod(degrees, F.lit(360.0))
    part = F.floor(b / 90)
    angle = F.when(part == 0, b).when(part == 1, 180 - b).when(part == 2, b - 180).otherwise(360 - b)
    return F.concat(F.when(part.isin(0, 3), "N ").otherwise("S "), F.format_string("%.1f°", angle), F.when(part.isin(0, 1), " E").otherwise(" W"))


def angle_between(a: Column, vertex: Column, b: Column) -> Column:
    """The angle at a vertex between the ways to two positions, 0 to 180 degrees; null where one is the vertex."""
    u, v = [a[i] - vertex[i] for i in (0, 1)], [b[i] - vertex[i] for i in (0, 1)]
    angle = F.degrees(F.abs(F.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1])))
    return F.when((F.hypot(*u) > 0) & (F.hypot(*v) > 0), angle)


def slope(a: Column, b: Column) -> Column:
    """``struct<rise, run, percent, degrees>`` between two positions with heights; no percent where they are above each other."""
    rise, run = b[2] - a[2], F.hypot(b[0] - a[0], b[1] - a[1])
    return F.struct(rise.alias("rise"), run.alias("run"), F.try_divide(100 * rise, run).alias("percent"), F.degrees(F.atan2(rise, run)).alias("degrees"))


def from_bearing_distance(p: Column, degrees: Column, distance: Column) -> Column:
    """The position at a distance in a direction, clockwise from north, in a plane."""
    return F.array(p[0] + distance * F.sin(F.radians(degrees)), p[1] + distance * F.cos(F.radians(degrees)))


def vertex_moved(path: Column, at: int, dx: float, dy: float) -> Column:
    """A path with one vertex (from 0) moved; the ends of a closed path move together."""
    n = F.size(path)
    twin = is_closed(path) & (F.lit(at).isin(0) | (n - 1 == at))
    return F.transform(path, lambda p, i: F.when((i == at) | (twin & ((i == 0) | (i == n - 1))), F.concat(F.array(p[0] + dx, p[1] + dy), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))))).otherwise(p))


def vertex_inserted(path: Column, at: int, p: Column) -> Column:
    """A path with a position before the vertex ``at``."""
    return F.concat(F.slice(path, 1, at), F.array(p), F.slice(path, at + 1, F.size(path)))


def vertex_deleted(path: Column, at: int) -> Column:
    """A path without a vertex; a closed path stays closed, and none falls under two vertices, or four where it is closed."""
    n, closed = F.size(path), is_closed(path)
    rest = F.filter(path, lambda p, i: i != at)
    ends = closed & ((F.lit(at) == 0) | (n - 1 == at))
    inner = F.slice(path, 2, F.greatest(n - 2, F.lit(0)))
    new = F.when(ends, F.concat(inner, F.slice(inner, 1, 1))).otherwise(rest)
    return F.when(n > F.when(closed, 4).otherwise(2), new).otherwise(path)


def representative_point(geom: Column) -> Column:
    """``[x, y]`` inside of a polygon, whatever its shape: the middle of the widest stretch on a level line.

    The line is half way between two neighbouring heights of vertices, those farthest apart, so it meets no vertex. Null
    where there is no area.
    """

    def level_of(ys: Column) -> Column:
        n = F.greatest(F.size(ys) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(ys, 1, n), F.slice(ys, 2, n), lambda a, b: F.struct((b - a).alias("gap"), ((a + b) / 2).alias("y")))
        return F.array_max(gaps)["y"]

    def crossings(ring: Column, level: Column) -> Column:
        return F.array_compact(_edges(ring, lambda p, q: F.when((p[1] > level) != (q[1] > level), p[0] + (level - p[1]) / (q[1] - p[1]) * (q[0] - p[0]))))

    def middle(xs: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct((F.get(xs, 2 * k + 1) - F.get(xs, 2 * k)).alias("wide"), ((F.get(xs, 2 * k) + F.get(xs, 2 * k + 1)) / 2).alias("x")))
        return F.array_max(F.filter(pairs, lambda s: s["wide"] > 0))["x"]

    def at(level: Column) -> Column:
        xs = F.array_sort(F.flatten(F.transform(rings(geom), lambda r: crossings(r, level))))
        return _once(_once(xs, middle), lambda x: F.when(x.isNotNull(), F.array(x, level)))

    found = _once(_once(F.array_sort(F.array_distinct(ordinates(geom, 1))), level_of), at)
    return F.when(geom["type"].endswith("Polygon"), found)


def offset_path(path: Column, distance: Column | float, miter_limit: float = 4.0) -> Column:
    """A path that runs parallel, to the left for positive distances, open as the source is taken.

    Corners are where the parallels meet; one that would be farther than ``miter_limit`` distances is cut off. Where the
    source turns more tightly than the distance, the parallel crosses itself, and that is left.
    """
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    real = without_repeats(path, 0.0)
    n = F.size(real)

    def normal(p: Column, q: Column) -> Column:
        size = F.hypot(q[0] - p[0], q[1] - p[1])
        return F.struct((-(q[1] - p[1]) / size).alias("x"), ((q[0] - p[0]) / size).alias("y"))

    normals = _edges(real, normal)
    moved = lambda p, v, k: F.array(p[0] + d * v["x"] / k, p[1] + d * v["y"] / k)

    def corner(p: Column, i: Column) -> Column:
        a, b = F.get(normals, F.greatest(i - 1, F.lit(0))), F.get(normals, F.least(i, n - 2))
        both = F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))
        cosine = 1 + a["x"] * b["x"] + a["y"] * b["y"]
        sharp = cosine < 2 / miter_limit**2
        return F.when(sharp, F.array(moved(p, a, F.lit(1.0)), moved(p, b, F.lit(1.0)))).otherwise(F.array(moved(p, both, cosine)))

    return F.when(n > 1, F.flatten(F.transform(real, corner))).otherwise(path)
