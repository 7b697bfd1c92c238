"""Coordinate reference systems as column arithmetic; all angles in degrees."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import map_positions

#: Ellipsoids as (semi-major axis in metres, inverse flattening).
WGS84 = (6378137.0, 298.257223563)
EVEREST_1830 = (6377276.345, 300.8017)
GRS80 = (6378137.0, 298.257222101)
#: UTM's scale on the central meridian, false easting, false northing in the south.
UTM_SCALE, UTM_EAST, UTM_NORTH = 0.9996, 500000.0, 10000000.0
#: Fixed value: mean radius of the sphere for areas, in metres.
MEAN_RADIUS = 6371008.8


class NoTransform(ValueError):
    """A transform that would need what the user has not given, and why."""


@dataclass(frozen=True)
class Crs:
    epsg: int | None
    name: str
    kind: str
    datum: str = "WGS 84"
    unit: str | None = None
    utm: tuple[int, bool] | None = None
    ellipsoid: tuple[float, float] = WGS84
    #: Of a conformal cone: central meridian, latitude of origin, both parallels, scale, false easting and northing.
    cone: tuple[float, float, float, float, float, float, float] | None = None


#: Geographic systems by code, with their datum and ellipsoid.
GEOGRAPHIC = {
    4326: ("WGS 84", "WGS 84", WGS84), 4979: ("WGS 84 3D", "WGS 84", WGS84), 4269: ("NAD83", "North American 1983", GRS80),
    4240: ("Indian 1975", "Indian 1975", EVEREST_1830), 4145: ("Kalianpur 1962", "Kalianpur 1962", EVEREST_1830),
}


def crs_from_epsg(code: int) -> Crs | None:
    """The built-in systems: geographic ones, Web Mercator, and UTM on WGS 84 and Kalianpur 1975."""
    if code in GEOGRAPHIC:
        name, datum, ellipsoid = GEOGRAPHIC[code]
        return Crs(code, name, "geographic", datum, "degree", None, ellipsoid)
    if code == 3857:
        return Crs(code, "WGS 84 / Pseudo-Mercator", "projected", unit="metre")
    for base, south in ((32600, False), (32700, True)):
        if base < code <= base + 60:
            return Crs(code, f"WGS 84 / UTM zone {code - base}{'NS'[south]}", "projected", unit="metre", utm=(code - base, south))
    if code in (24378, 24379):
        return Crs(code, f"Kalianpur 1975 / UTM zone {code - 24335}N", "projected", "Kalianpur 1975", "metre", (code - 24335, False), EVEREST_1830)
    return None


def is_wgs84(crs: Crs | None) -> bool:
    return crs is not None and re.search(r"wgs\s*(19)?84", re.sub(r"^D_", "", crs.datum).replace("_", " "), re.I) is not None


def same_crs(a: Crs | None, b: Crs | None) -> bool:
    """Equal codes where both have one; else equal zones on one datum; else equal names and datums."""
    if a is None or b is None:
        return False
    if a.epsg and b.epsg:
        return a.epsg == b.epsg
    if a.utm and b.utm:
        return a.utm == b.utm and a.datum == b.datum
    return (a.name, a.datum, a.kind) == (b.name, b.datum, b.kind)


def grid_unit(crs: Crs | None) -> str:
    """What a system's axes are counted in: degree, metre, foot or unknown."""
    if crs is None:
        return "unknown"
    unit = (crs.unit or "").lower()
    if crs.kind == "geographic" or "degree" in unit:
        return "degree"
    if "foot" in unit or "feet" in unit or unit == "ft":
        return "foot"
    return "metre" if "met" in unit or crs.kind == "projected" else "unknown"


#: A shift between datums as the user's authority publishes it: metres, seconds, parts per million.
Shift = tuple[tuple[float, float, float], tuple[float, float, float], float]


def plan_transform(source: Crs | None, target: Crs | None, shift: Shift | None = None) -> Callable[[Column, Column, Column], tuple[Column, Column]] | None:
    """A function of x, y and height columns to x and y columns; None where nothing changes.

    Unknown or equal systems change nothing. Between datums a shift must be given: none is
    ever guessed. A projection that isn't known is refused. Heights take part in the shift only and are themselves left as they are.
    """
    if source is None or target is None or same_crs(source, target):
        return None
    crossing = not (is_wgs84(source) and is_wgs84(target))
    for crs in (source, target):
        if not (crs.kind == "geographic" or crs.epsg == 3857 or crs.utm or crs.cone):
            raise NoTransform(f"{crs.name} is of a projection that can't be computed here")
    if crossing and shift is None:
        foreign = source if not is_wgs84(source) else target
        raise NoTransform(f"{foreign.datum} is another datum than WGS 84; give the seven parameters of a shift")

    def run(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        lon, lat = to_geographic(x, y, source)
        if crossing:
            at = to_geocentric(lon, lat, F.coalesce(z, F.lit(0.0)), source.ellipsoid)
            lon, lat, _ = from_geocentric(*helmert(*at, *shift), target.ellipsoid)
        return from_geographic(lon, lat, target)

    return run


def to_geographic(x: Column, y: Column, crs: Crs) -> tuple[Column, Column]:
    if crs.kind == "geographic":
        return x, y
    if crs.utm:
        return inverse_transverse_mercator(x - UTM_EAST, y - (UTM_NORTH if crs.utm[1] else 0.0), F.lit(crs.utm[0] * 6 - 183), UTM_SCALE, crs.ellipsoid)
    if crs.cone:
        *at, scale, east, north = crs.cone
        return inverse_lambert_conic(x - east, y - north, *at, crs.ellipsoid, scale)
    return from_web_mercator(x, y)


def from_geographic(lon: Column, lat: Column, crs: Crs) -> tuple[Column, Column]:
    if crs.kind == "geographic":
        return lon, lat
    if crs.utm:
        east, north = transverse_mercator(lon, lat, F.lit(crs.utm[0] * 6 - 183), UTM_SCALE, crs.ellipsoid)
        return east + UTM_EAST, north + (UTM_NORTH if crs.utm[1] else 0.0)
    if crs.cone:
        *at, scale, east, north = crs.cone
        x, y = lambert_conic(lon, lat, *at, crs.ellipsoid, scale)
        return x + east, y + north
    return to_web_mercator(lon, lat)


def transformed(df: DataFrame, source: Crs | None, target: Crs | None, shift: Shift | None = None, geom: str = "geom") -> DataFrame:
    """A layer with all positions in another system; height and measure pass as they are."""
    plan = plan_transform(source, target, shift)
    if plan is None:
        return df

    def moved(p: Column) -> Column:
        x, y = plan(p[0], p[1], F.get(p, F.lit(2)))
        return F.concat(F.array(x, y), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))))

    return df.withColumn(geom, map_positions(F.col(geom), moved))


def suggested_crs(df: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """What system a layer's numbers look like: ``epsg, reading, ambiguous``; a suggestion, never a decision."""
    b = df.groupBy(*(by or [])).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    within = lambda lim_x, lim_y: (F.abs(x0) <= lim_x) & (F.abs(x1) <= lim_x) & (F.abs(y0) <= lim_y) & (F.abs(y1) <= lim_y)
    degrees = within(180, 90)
    utm = (x0 >= 100000) & (x1 <= 900000) & (y0 >= 0) & (y1 <= 10000000)
    web = (F.abs(x0) <= 20037509) & (F.abs(x1) <= 20037509) & (F.abs(y1) <= 20048967) & (F.abs(x1) > 900000)
    none = x0.isNull() | y0.isNull()
    reading = F.when(none, "none").when(degrees, "degrees").when(utm, "utm").when(web, "web mercator").otherwise("local grid")
    return b.select(
        *(by or []),
        F.when(degrees, 4326).when(~utm & web, 3857).alias("epsg"),
        reading.alias("reading"),
        F.coalesce(~degrees | ((F.abs(x1) < 10) & (F.abs(y1) < 10)), F.lit(True)).alias("ambiguous"),
    )


def resolved_crs(user: Crs | None = None, declared: Crs | None = None, sidecar: Crs | None = None, assumed: Crs | None = None, inferred: Crs | None = None) -> tuple[Crs | None, str, Crs | None]:
    """The system to read a layer in, where it is from, and what the file stated if the user's choice replaces it.

    The user comes first, then what the file declares, its sidecar, what its format implies, and
    an unambiguous inference; without any of these the layer is blocked.
    """
    for crs, origin in ((user, "user"), (declared, "declared"), (sidecar, "sidecar"), (assumed, "assumed"), (inferred, "inferred")):
        if crs is not None:
            stated = declared or sidecar
            return crs, origin, stated if origin == "user" and stated is not None and not same_crs(stated, crs) else None
    return None, "blocked", None


def utm_zone(lon: Column) -> Column:
    """1 to 60, without the exceptions for Norway and Svalbard."""
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def _series(n: float) -> tuple[float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Krueger's coefficients to the third order in the third flattening."""
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return radius, alpha, beta, delta


def transverse_mercator(
    lon: Column, lat: Column, central: Column, scale: float = UTM_SCALE, ellipsoid: tuple[float, float] = WGS84
) -> tuple[Column, Column]:
    """Easting and northing without false origin."""
    a, inverse = ellipsoid
    n = 1 / (2 * inverse - 1)
    radius, alpha, _, _ = _series(n)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(F.pmod(lon - central + 180, F.lit(360.0)) - 180)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return scale * a * radius * east, scale * a * radius * north


def inverse_transverse_mercator(
    east: Column, north: Column, central: Column, scale: float = UTM_SCALE, ellipsoid: tuple[float, float] = WGS84
) -> tuple[Column, Column]:
    """Longitude and latitude; a closed series, no iteration."""
    a, inverse = ellipsoid
    radius, _, beta, delta = _series(1 / (2 * inverse - 1))
    xi, eta = north / (scale * a * radius), east / (scale * a * radius)
    x, e = xi, eta
    for j, c in enumerate(beta, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(e), F.cos(x))) + central, F.degrees(lat)


def to_utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in the zone (each position's own without one)."""
    east, north = transverse_mercator(lon, lat, (zone if zone is not None else utm_zone(lon)) * 6 - 183)
    return east + UTM_EAST, north + F.when(lat < 0, UTM_NORTH).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    return inverse_transverse_mercator(east - UTM_EAST, north - F.when(south, UTM_NORTH).otherwise(0.0), zone * 6 - 183)


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return WGS84[0] * F.radians(lon), WGS84[0] * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WGS84[0]), F.degrees(2 * F.atan(F.exp(y / WGS84[0])) - math.pi / 2)


def _conic(lon0: float, lat0: float, lat1: float, lat2: float, ellipsoid: tuple[float, float]) -> tuple[float, float, float, float]:
    """The eccentricity, the cone's constant, the radius at t = 1, and the radius at the origin."""
    a, inverse = ellipsoid
    e = math.sqrt(2 / inverse - 1 / inverse**2)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p0, p1, p2 = (math.radians(x) for x in (lat0, lat1, lat2))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = a * m(p1) / (n * t(p1) ** n)
    return e, n, scale, scale * t(p0) ** n


def lambert_conic(
    lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float, ellipsoid: tuple[float, float] = WGS84, scale: float = 1.0
) -> tuple[Column, Column]:
    """Conformal conic on two standard parallels, which may be equal (then with a scale there)."""
    e, n, radius, r0 = _conic(lon0, lat0, lat1, lat2, ellipsoid)
    phi = F.radians(lat)
    at = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    r = scale * radius * F.pow(at, F.lit(n))
    theta = n * F.radians(lon - lon0)
    return r * F.sin(theta), scale * r0 - r * F.cos(theta)


def inverse_lambert_conic(
    x: Column, y: Column, lon0: float, lat0: float, lat1: float, lat2: float, ellipsoid: tuple[float, float] = WGS84, scale: float = 1.0
) -> tuple[Column, Column]:
    """Longitude and latitude; eight steps towards the latitude."""
    e, n, radius, r0 = _conic(lon0, lat0, lat1, lat2, ellipsoid)
    sign = math.copysign(1.0, n)
    r = sign * F.hypot(x, scale * r0 - y)
    t = F.pow(r / (scale * radius), F.lit(1 / n))
    theta = F.atan2(sign * x, sign * (scale * r0 - y))
    step = lambda p, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2)))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), math.pi / 2 - 2 * F.atan(t), step)
    return F.degrees(theta / n) + lon0, F.degrees(phi)


def to_geocentric(lon: Column, lat: Column, height: Column, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column, Column]:
    a, inverse = ellipsoid
    e2 = 2 / inverse - 1 / inverse**2
    phi, lam = F.radians(lat), F.radians(lon)
    v = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (v + height) * F.cos(phi) * F.cos(lam), (v + height) * F.cos(phi) * F.sin(lam), (v * (1 - e2) + height) * F.sin(phi)


def from_geocentric(x: Column, y: Column, z: Column, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height, by Bowring's formula (to a fraction of a millimetre near the ground)."""
    a, inverse = ellipsoid
    b = a * (1 - 1 / inverse)
    e2, ep2 = 1 - (b / a) ** 2, (a / b) ** 2 - 1
    p = F.hypot(x, y)
    u = F.atan2(z * a, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(u), F.lit(3.0)), p - e2 * a * F.pow(F.cos(u), F.lit(3.0)))
    v = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), p / F.cos(lat) - v


def helmert(x: Column, y: Column, z: Column, shift: tuple[float, float, float], seconds: tuple[float, float, float] = (0, 0, 0), ppm: float = 0.0) -> tuple[Column, Column, Column]:
    """Position-vector rotation with small angles, as given by the user; never guessed."""
    rx, ry, rz = (math.radians(s / 3600) for s in seconds)
    k = 1 + ppm * 1e-6
    return (
        shift[0] + k * (x - rz * y + ry * z),
        shift[1] + k * (rz * x + y - rx * z),
        shift[2] + k * (-ry * x + rx * y + z),
    )


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres on the mean sphere."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * MEAN_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


#: Metres in a unit of length.
METRES = {
    "metre": 1.0, "kilometre": 1000.0, "centimetre": 0.01, "millimetre": 0.001, "foot": 0.3048,
    "us_survey_foot": 1200 / 3937, "yard": 0.9144, "mile": 1609.344, "chain": 20.1168, "link": 0.201168,
}


def convert_length(v: Column, of: str, to: str) -> Column:
    return v * (METRES[of] / METRES[to])


#: Radians in a unit of angle, square metres in one of area, cubic metres in one of volume.
RADIANS = {"radian": 1.0, "degree": math.pi / 180, "minute": math.pi / 10800, "second": math.pi / 648000, "gon": math.pi / 200}
SQUARE_METRES = {"square_metre": 1.0, "hectare": 10_000.0, "square_kilometre": 1e6, "acre": 4046.8564224, "square_foot": 0.09290304}
CUBIC_METRES = {"cubic_metre": 1.0, "litre": 0.001, "cubic_foot": 0.028316846592, "cubic_yard": 0.764554857984}


def convert(v: Column, of: str, to: str) -> Column:
    """Between units of one kind: length, angle, area or volume."""
    for units in (METRES, RADIANS, SQUARE_METRES, CUBIC_METRES):
        if of in units and to in units:
            return v * (units[of] / units[to])
    raise ValueError(f"{of} and {to} are not units of one kind")
