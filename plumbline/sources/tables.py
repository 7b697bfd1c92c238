"""Coordinate tables, point clouds and grids in text, and binary clouds."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.table import Refused

#: Header names of each role, normalised.
ROLES = {
    "x": ("x", "easting", "east", "e", "eastings", "xcoord"),
    "y": ("y", "northing", "north", "n", "northings", "ycoord"),
    "z": ("z", "elevation", "elev", "level", "rl", "height", "h", "alt"),
    "lon": ("longitude", "lon", "long", "lng"),
    "lat": ("latitude", "lat"),
    "id": ("id", "point", "pointid", "pt", "no", "slno", "name", "number"),
    "code": ("code", "description", "desc", "feature", "remark"),
}
SEPARATORS = (",", "\t", ";", "|")


def normalised(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def match_headers(headers: list[str]) -> dict[str, str]:
    """Role -> header; exact names before names that only begin with an alias of three letters or more."""
    out: dict[str, str] = {}
    for exact in (True, False):
        for h in headers:
            n = normalised(h)
            for role, names in ROLES.items():
                ok = n in names if exact else any(len(a) > 2 and n.startswith(a) for a in names)
                if ok and role not in out and h not in out.values():
                    out[role] = h
    return out


def sniff_separator(lines: list[str]) -> str:
    """The separator that gives most columns on most lines; a space where none does."""
    score = {s: (sum(s in x for x in lines), sum(x.count(s) for x in lines)) for s in SEPARATORS}
    best = max(SEPARATORS, key=lambda s: score[s])
    return best if score[best][0] else " "


def _texts(cells: list[str]) -> tuple[int, int]:
    filled = [c for c in cells if c.strip()]
    numbers = sum(bool(re.fullmatch(r"\s*[-+]?\d*\.?\d+([eE][-+]?\d+)?\s*", c)) for c in filled)
    return len(filled) - numbers, numbers


def find_header(rows: list[list[str]]) -> int | None:
    """Among the first eight rows, the first that fills half the widest; a header if text leads there."""
    widest = max((sum(bool(c.strip()) for c in r) for r in rows[:40]), default=0)
    for i, r in enumerate(rows[:8]):
        if sum(bool(c.strip()) for c in r) * 2 >= widest:
            text, numbers = _texts(r)
            return i if text and text >= numbers else None
    return None


def guarded_number(c: Column) -> Column:
    """A number, unless the text starts with a zero before another digit: codes keep their zeros."""
    s = F.trim(c)
    return F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$") & ~s.rlike(r"^0\d"), s.try_cast("double"))


def read_csv_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows of delimited text and the roles of its columns.

    Only the first forty lines are looked at on the driver. Lines that start with # or ; are
    comments. Columns of which every filled cell is a number become numbers, which one
    aggregate decides; all others stay text.
    """
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#;].*)?$"))
    head = [r["value"] for r in text.limit(40).collect()]
    if not head:
        raise Refused("the file has no rows")
    sep = sniff_separator(head)
    grid = [[c.strip() for c in (line.split() if sep == " " else next(csv.reader([line], delimiter=sep)))] for line in head]
    at = find_header(grid)
    width = max(map(len, grid))
    names = grid[at] if at is not None else []
    seen: dict[str, int] = {}
    columns = []
    for i in range(width):
        n = names[i].strip('"') if i < len(names) and names[i] else f"column_{i + 1}"
        seen[n] = seen.get(n, 0) + 1
        columns.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    cells = F.split(F.trim("value"), r"\s+" if sep == " " else re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')
    banner = head[: (at + 1) if at is not None else 0]
    rows = text.where(~F.col("value").isin(banner)) if banner else text
    unquoted = lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"'))
    rows = rows.select(*[F.nullif(unquoted(F.get(cells, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)])
    bad = rows.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & guarded_number(F.col(f"`{c}`")).isNull()).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    typed = rows.select(*[(guarded_number(F.col(f"`{c}`")) if bad[i] == 0 else F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)])
    return typed, match_headers(columns)


#: Layouts of tables without headers, the likelier ones first, as roles of their columns.
SCHEMAS = {
    "pnezd": ("id", "y", "x", "z", "code"), "penzd": ("id", "x", "y", "z", "code"), "nez": ("y", "x", "z"), "enz": ("x", "y", "z"), "xyz": ("x", "y", "z"),
    "id-xyz": ("id", "x", "y", "z"), "id-yxz": ("id", "y", "x", "z"), "lonlatz": ("lon", "lat", "z"), "latlonz": ("lat", "lon", "z"),
}


@dataclass(frozen=True)
class Schema:
    """What the columns of a coordinate table are: ``roles`` (role -> column), and whether a person has to confirm it."""

    name: str | None
    roles: dict[str, str]
    confirm: bool

    @property
    def at(self) -> dict[str, str]:
        """The roles with longitude and latitude for x and y, as ``table_to_points`` takes them."""
        geographic = "lon" in self.roles and "lat" in self.roles
        own = {r: c for r, c in self.roles.items() if r not in (("x", "y") if geographic else ()) + ("lon", "lat")}
        return own | ({"x": self.roles["lon"], "y": self.roles["lat"]} if geographic else {})


def detect_schema(df: DataFrame, chosen: str | None = None) -> Schema:
    """The layout of a table that ``read_csv_table`` read: by its headers, or else by the number of its columns.

    Columns named x and y of which every row that has both lies within 180 and 90 are longitude and latitude, which
    one aggregate over all rows decides. That, and every layout without headers, has to be confirmed: the first one
    of as many columns is offered, else the first one of fewer. ``chosen`` names a layout, and isn't asked about.
    """
    columns = df.columns

    def positional(name: str, confirm: bool) -> Schema:
        return Schema(name, dict(zip(SCHEMAS[name], columns, strict=False)), confirm)

    if chosen is not None:
        if chosen not in SCHEMAS:
            raise Refused(f"no layout is called {chosen!r}")
        if len(SCHEMAS[chosen]) > len(columns):
            raise Refused(f"{chosen} needs {len(SCHEMAS[chosen])} columns, and there are {len(columns)}")
        return positional(chosen, False)
    named = not all(re.fullmatch(r"column_\d+", c) for c in columns)
    roles = match_headers(columns) if named else {}
    plane, geographic = "x" in roles and "y" in roles, "lon" in roles and "lat" in roles
    if plane and not geographic:
        x, y = (F.col(f"`{roles[r]}`").cast("string").try_cast("double") for r in ("x", "y"))
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        beyond = (F.abs(x) > 180) | (F.abs(y) > 90)
        seen = df.agg(F.count_if(both).alias("n"), F.count_if(both & beyond).alias("far")).first()
        if seen["n"] and not seen["far"]:
            kept = {r: c for r, c in roles.items() if r not in ("x", "y", "lon", "lat")}
            return Schema("header-geographic", kept | {"lon": roles["x"], "lat": roles["y"]}, True)
    if plane or geographic:
        return Schema("header-named", roles, False)
    fits = [n for n, order in SCHEMAS.items() if len(order) == len(columns)] or [n for n, order in SCHEMAS.items() if len(order) <= len(columns)]
    return positional(fits[0], True) if fits else Schema(None, {}, True)


def read_coordinates(spark: SparkSession, path: str, layout: str | None = None, confirmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points of a coordinate table, and rows without any; refused while its layout is only a guess that nobody confirmed."""
    df, _ = read_csv_table(spark, path)
    schema = detect_schema(df, layout)
    if schema.name is None:
        raise Refused(f"no layout has {len(df.columns)} columns without coordinates in their names")
    if schema.confirm and not confirmed:
        raise Refused(f"the table looks like {schema.name}; confirm it or name its layout, as a wrong one swaps the axes")
    return table_to_points(df, schema.at)


def table_to_points(df: DataFrame, roles: dict[str, str], lat_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points of a coordinate table by its columns' roles (``x``, ``y``, ``z``, ``id``), and the rows that have none.

    A row needs both coordinates; its height is kept where it has one. Coordinate columns
    aren't repeated among the attributes; all others stay under their names. Latitude may
    come first, where the roles say x for it.
    """
    if "x" not in roles or "y" not in roles:
        raise Refused("the columns of easting and northing are not known")
    number = lambda role: (F.col(f"`{roles[role]}`") if dict(df.dtypes)[roles[role]] == "double" else guarded_number(F.col(f"`{roles[role]}`").cast("string")))
    x, y = (number("y"), number("x")) if lat_first else (number("x"), number("y"))
    z = number("z") if "z" in roles else F.lit(None).cast("double")
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    used = {roles[r] for r in ("x", "y", "z") if r in roles}
    at = F.when(z.isNotNull(), g.point(x, y, z)).otherwise(g.point(x, y))
    return df.where(ok).select(*[F.col(f"`{c}`") for c in df.columns if c not in used], at.alias("geom")), df.where(~F.coalesce(ok, F.lit(False)))


def read_xyz(spark: SparkSession, path: str, skip_counts: bool = False) -> DataFrame:
    """Points of x y z and up to four more columns, by white space or commas; comments are skipped.

    ``skip_counts`` also skips lines of a single number, as PTS files have before each scan.
    """
    parts = F.split(F.trim("value"), r"[\s,;]+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*|//.*)?$"))
    v = [F.get(parts, F.lit(i)).try_cast("double") for i in range(7)]
    out = rows.select(F.size(parts).alias("n"), *[c.alias(k) for c, k in zip(v, ("x", "y", "z", "a", "b", "c", "d"), strict=True)])
    out = out.where((F.col("n") >= (3 if skip_counts else 2)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    intensity = F.when(F.col("n").isin(4, 7), F.col("a"))
    rgb = [F.when(F.col("n") == 7, F.col(c)).when(F.col("n") == 6, F.col(e)).cast("int") for c, e in (("b", "a"), ("c", "b"), ("d", "c"))]
    return out.select("x", "y", "z", intensity.alias("intensity"), *[c.alias(k) for c, k in zip(rgb, ("red", "green", "blue"), strict=True)])


def write_xyz(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(" ", "x", "y", "z").alias("value")).write.text(path)


@dataclass(frozen=True)
class Grid:
    """An ASCII grid's header."""

    columns: int
    rows: int
    cell: float
    west: float
    south: float
    no_data: float | None

    @property
    def geotransform(self) -> tuple[float, ...]:
        return (self.west, self.cell, 0.0, self.south + self.rows * self.cell, 0.0, -self.cell)


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Pixels ``(band, row, col, value)``; rows are numbered from the file's first data line."""
    lines = spark.read.text(path)
    head = {}
    for r in lines.limit(6).collect():
        m = re.match(r"\s*([A-Za-z_]+)\s+(\S+)\s*$", r["value"])
        if m:
            head[m[1].lower()] = float(m[2])
    cell = head["cellsize"]
    west = head.get("xllcorner", head.get("xllcenter", 0.0) - cell / 2)
    south = head.get("yllcorner", head.get("yllcenter", 0.0) - cell / 2)
    grid = Grid(int(head["ncols"]), int(head["nrows"]), cell, west, south, head.get("nodata_value"))
    if grid.columns * grid.rows == 0:
        raise Refused("the grid has no cells")
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_replace("value", r"(?is)^(\s*[a-z_]+\s+\S+[ \t]*\r?\n)+", "")
    cells = whole.select(F.posexplode(F.split(F.btrim(body, F.lit(" \t\r\n")), r"\s+")).alias("k", "v"))
    return cells.select(
        F.lit(1).alias("band"), F.floor(F.col("k") / grid.columns).cast("int").alias("row"), (F.col("k") % grid.columns).alias("col"), F.col("v").try_cast("double").alias("value")
    ), grid


def write_ascii_grid(pixels: DataFrame, path: str, grid: Grid) -> None:
    """Lines of a grid in order, in one file: the format is one sequence. Missing pixels are no data."""
    blank = grid.no_data if grid.no_data is not None else -9999.0
    rows = pixels.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(grid.columns - 1)), lambda c: F.coalesce(F.col("m")[c], F.lit(blank)).cast("string")), " ")
    spark = pixels.sparkSession
    every = spark.range(grid.rows).select(F.col("id").cast("int").alias("row")).join(rows, "row", "left")
    empty = " ".join([str(blank)] * grid.columns)
    head = f"ncols {grid.columns}\nnrows {grid.rows}\nxllcorner {grid.west}\nyllcorner {grid.south}\ncellsize {grid.cell}\nNODATA_value {blank}"
    body = every.select("row", F.coalesce(line, F.lit(empty)).alias("value"))
    top = spark.createDataFrame([(-1, head)], "row int, value string")
    top.unionByName(body).repartitionByRange(1, "row").sortWithinPartitions("row").select("value").write.text(path)


def read_gcps(spark: SparkSession, path: str) -> DataFrame:
    """Ground control points: map and source positions, enabled ones."""
    rows = spark.read.option("comment", "#").csv(path, header=True, inferSchema=False)
    number = [F.col(c).cast("double").alias(k) for c, k in (("mapX", "map_x"), ("mapY", "map_y"), ("sourceX", "source_x"), ("sourceY", "source_y"))]
    on = F.coalesce(F.col("enable"), F.lit("1")) != "0" if "enable" in rows.columns else F.lit(True)
    return rows.where(on).select(*number)


def fit_affine(gcps: DataFrame) -> tuple[np.ndarray, float]:
    """Least squares: sums over all points in Spark, a 3x3 system on the driver. Six terms, and the residual RMS."""
    x, y, u, v = (F.col(c) for c in ("source_x", "source_y", "map_x", "map_y"))
    terms = {"n": F.count(F.lit(1)), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(x * x), "xy": F.sum(x * y), "yy": F.sum(y * y)}
    terms |= {f"{k}{m}": F.sum(a * b) for k, a in (("u", u), ("v", v)) for m, b in (("1", F.lit(1.0)), ("x", x), ("y", y))}
    terms |= {"uu": F.sum(u * u), "vv": F.sum(v * v)}
    s = gcps.agg(*[c.alias(k) for k, c in terms.items()]).first().asDict()
    if (s["n"] or 0) < 3:
        raise Refused("an affine fit needs three points")
    m = np.array([[s["n"], s["x"], s["y"]], [s["x"], s["xx"], s["xy"]], [s["y"], s["xy"], s["yy"]]], float)
    rhs = np.array([[s["u1"], s["v1"]], [s["ux"], s["vx"]], [s["uy"], s["vy"]]], float)
    if abs(np.linalg.det(m)) < 1e-9:
        raise Refused("the points are on one line")
    beta = np.linalg.solve(m, rhs)
    square = s["uu"] + s["vv"] - float((beta * rhs).sum())
    return beta.T.ravel(), float(np.sqrt(max(square, 0.0) / s["n"]))
