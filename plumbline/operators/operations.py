"""One door to the operations on a layer's geometry: checks first, then a plan that can be looked at, applied and undone.

A distance in degrees, or in units that nobody stated, gives a plausible and wrong shape, so buffers and offsets
are refused there. So are layers that are protected, empty scopes and operations without what they need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.crs import Crs
from plumbline.operators import planar, spatial, vector
from plumbline.operators.table import Refused

#: Operations that take a distance in the layer's units.
WITH_DISTANCE = ("buffer", "offset")
SIDES = ("signed", "inside", "outside", "both")


@dataclass(frozen=True)
class Plan:
    """What an operation would make of a layer; nothing is changed until it is applied."""

    operation: str
    features: DataFrame
    #: What isn't in the operation's scope, and stays as it is.
    untouched: DataFrame
    source: DataFrame
    notes: list[str] = field(default_factory=list)

    def applied(self) -> DataFrame:
        """The layer with the operation's result in place of what it took."""
        return self.untouched.unionByName(self.features, allowMissingColumns=True)

    def undone(self) -> DataFrame:
        return self.source


def _boxed(df: DataFrame) -> DataFrame:
    b = g.bounds(F.col("geom"))
    return df.withColumns({k: b[k] for k in spatial.BOX})


def _buffer(df: DataFrame, o: dict) -> DataFrame:
    return df.withColumn("geom", vector.buffer_column(F.col("geom"), o["distance"], o.get("tolerance", 0.05))).where("geom is not null")


def _offset(df: DataFrame, o: dict) -> DataFrame:
    """Lines run parallel; of polygons the border of what is so far inside or outside, as lines."""
    d, side = o["distance"], o.get("side", "signed")
    if side not in SIDES:
        raise Refused(f"there is no side {side}")
    lines = df.where(F.col("geom.type").endswith("LineString"))
    made = lines.withColumn("geom", g.map_rings(F.col("geom"), lambda r, _: g.offset_path(r, d)))
    distances = {"signed": [d], "inside": [-abs(d)], "outside": [abs(d)], "both": [-abs(d), abs(d)]}[side]
    shapes = df.where(F.col("geom.type").endswith("Polygon"))
    for k, v in enumerate(distances):
        shapes = shapes.withColumn(f"__ring{k}", g.rings(vector.buffer_column(F.col("geom"), v, o.get("tolerance", 0.05))))
    none = F.array().cast("array<array<array<double>>>")
    every = F.flatten(F.array(*[F.coalesce(f"__ring{k}", none) for k in range(len(distances))]))
    whole = shapes.withColumn("__all", every).where(F.size("__all") > 0)
    borders = whole.withColumn("geom", g.geometry("MultiLineString", F.transform("__all", lambda r: F.array(r))))
    return made.unionByName(borders.select(*df.columns))


def _fixed_point(df: DataFrame, o: dict) -> tuple[Column, Column]:
    if "anchor" in o:
        return F.lit(float(o["anchor"][0])), F.lit(float(o["anchor"][1]))
    b = df.select(g.bounds(F.col("geom")).alias("b")).agg(*[f(f"b.{c}").alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]).first()
    o["anchor"] = ((b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2)
    return _fixed_point(df, o)


def _turned(df: DataFrame, o: dict) -> DataFrame:
    x, y = _fixed_point(df, o)
    change = g.scaled(F.col("geom"), o["factor"], x, y) if "factor" in o else g.rotated(F.col("geom"), o["degrees"], x, y)
    return df.withColumn("geom", change)


def _folded(operation: str) -> Callable:
    return lambda df, o: planar.self_boolean(_boxed(df), operation, o["cell"], [], o["key"])


def _masked(erase: bool) -> Callable:
    return lambda df, o: vector.masked(_boxed(df), _boxed(o["mask"]), o["cell"], erase, o["key"]).drop(*spatial.BOX)


def _hull(df: DataFrame, o: dict) -> DataFrame:
    pts = df.select(F.lit(1).alias("one"), F.explode(g.positions(F.col("geom"))).alias("p")).select("one", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return vector.convex_hulls(pts, ["one"]).select(g.polygon(F.col("ring")).alias("geom"))


OPERATIONS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame, dict], DataFrame]]] = {
    "buffer": (("distance",), _buffer),
    "offset": (("distance",), _offset),
    "centroid": ((), lambda df, o: df.withColumn("geom", g.point(g.centroid(F.col("geom"))[0], g.centroid(F.col("geom"))[1]))),
    "envelope": ((), lambda df, o: df.withColumn("geom", g.envelope(F.col("geom")))),
    "explode": ((), lambda df, o: df.withColumn("geom", F.explode(g.exploded(F.col("geom"))))),
    "convex-hull": ((), _hull),
    "dissolve": (("field", "cell"), lambda df, o: planar.dissolve(df, o["field"], o["cell"])),
    "union": (("cell",), _folded("union")),
    "intersection": (("cell",), _folded("intersection")),
    "difference": (("cell",), _folded("difference")),
    "symmetric-difference": (("cell",), _folded("symmetric-difference")),
    "clip": (("mask", "cell"), _masked(False)),
    "erase": (("mask", "cell"), _masked(True)),
    "split-by-line": (("cut", "cell"), lambda df, o: planar.split_by_lines(_boxed(df), o["cut"], o["cell"], o["key"]).drop("part", *spatial.BOX)),
    "translate": (("dx", "dy"), lambda df, o: df.withColumn("geom", g.translated(F.col("geom"), o["dx"], o["dy"]))),
    "scale": (("factor",), _turned),
    "rotate": (("degrees",), _turned),
}


def plan_operation(layer: DataFrame, operation: str, crs: Crs | None = None, scope: Column | None = None, protected: bool = False, key: str = "idx", **options: object) -> Plan:
    """The plan of an operation over a layer, or ``Refused`` with the reason.

    ``scope`` is a condition on the layer's columns; what it leaves out is untouched. Which other options an operation
    needs is in ``OPERATIONS``; ``cell`` is the grid that edges meet on, about as wide as a few edges.
    """
    if operation not in OPERATIONS:
        raise Refused(f"there is no operation {operation}")
    if protected:
        raise Refused("the layer is protected, so its geometry was not changed")
    needed, run = OPERATIONS[operation]
    missing = [k for k in needed if k not in options]
    if missing:
        raise Refused(f"{operation} needs {', '.join(missing)}")
    if operation in WITH_DISTANCE:
        if crs is None:
            raise Refused(f"{operation} needs to know what coordinates mean: no system is given, so a distance has no unit")
        if crs.kind == "geographic":
            raise Refused(f"{operation} can't run on degrees: 10 would be 10 degrees; go to a projected system first")
        if not options["distance"]:
            raise Refused(f"{operation} needs a distance that isn't zero")
    if operation in ("intersection", "difference", "symmetric-difference") and not layer.where(F.lit(True) if scope is None else scope).limit(2).count() == 2:
        raise Refused(f"{operation} needs at least two polygons")
    taken = layer if scope is None else layer.where(scope)
    if not taken.take(1):
        raise Refused("there is nothing to operate on: the layer, or the selection, is empty")
    rest = layer.where(F.lit(False)) if scope is None else layer.where(~F.coalesce(scope, F.lit(False)))
    given: dict = {"key": key, **options}
    made = run(taken, given)
    notes = []
    if operation in ("scale", "rotate"):
        notes.append(f"about ({given['anchor'][0]:g}, {given['anchor'][1]:g})")
    if operation == "split-by-line":
        notes.append("every part has a copy of its polygon's columns")
    return Plan(operation, made, rest, layer, notes)
