"""Slippy map tiles and terrain tiles as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: tiles end at this latitude.
EDGE = 85.05112878


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the tile that holds a position; what is outside of the map goes to its edge."""
    n = 1 << zoom
    phi = F.radians(F.least(F.greatest(lat, F.lit(-EDGE)), F.lit(EDGE)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    within = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    return within(x), within(y)


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = 1 << zoom
    return x / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))


def tiles_covering(boxes: DataFrame, zoom: int, most: int | None = None) -> DataFrame:
    """A row for each tile (``tile_x``, ``tile_y``) that a box in degrees touches.

    Longitude wraps around, latitude ends at the map's edge. Where ``most`` is given, for maps that draw what they
    get, a box of more tiles has none: a part of a cover would look like missing data, and a lower zoom is the answer.
    """
    n = 1 << zoom
    column = lambda lon: F.floor((F.col(lon) + 180) / 360 * n)
    x0, x1 = column("minx"), column("maxx")
    y0, y1 = tile_of(F.col("minx"), F.col("maxy"), zoom)[1], tile_of(F.col("maxx"), F.col("miny"), zoom)[1]
    fits = (x1 >= x0) & (y1 >= y0)
    if most is not None:
        fits &= (x1 - x0 + 1) * (y1 - y0 + 1) <= most
    within = boxes.where(fits)
    return within.withColumn("tile_x", F.explode(F.transform(F.sequence(x0, x1), lambda x: F.pmod(x, F.lit(n)).cast("int")))).withColumn("tile_y", F.explode(F.sequence(y0, y1)))


def tile_zoom(degrees_per_pixel: Column, most: int) -> Column:
    """The zoom whose tiles of 256 pixels are nearest to a scale, 0 to ``most``."""
    z = F.floor(F.log2(360 / (256 * degrees_per_pixel)) + 0.5)
    return F.when(degrees_per_pixel > 0, F.least(F.greatest(z, F.lit(0)), F.lit(most))).otherwise(0).cast("int")


def terrain_height(r: Column, g: Column, b: Column) -> Column:
    """Metres from the three bytes of a terrain pixel."""
    return r * 256.0 + g + b / 256.0 - 32768
