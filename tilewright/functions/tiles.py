"""Tile, mercator and degree-grid arithmetic as column expressions.

Tiles are XYZ (row 0 in the north) unless a name says TMS. All functions take and return columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clamped

#: Mercator circumference and radius, mean Earth radius, metres a degree.
CIRCUMFERENCE, RADIUS, EARTH, DEGREE_M = 40075016.686, 6378137.0, 6371008.8, 111320.0
#: The equator in web mercator, from its radius.
CIRCUMFERENCE_M = 2 * 3.141592653589793 * RADIUS
#: Degrees a graph tile, by level.
GRAPH_DEGREES = {0: 4.0, 1: 1.0, 2: 0.25}
#: Fixed values of the national conic projection: exponent, constant, false origin, first eccentricity, central meridian.
LAMBERT93 = {"n": 0.7256077650532670, "c": 11754255.426096, "xs": 700000.0, "ys": 12655612.049876, "e": 0.08181919112, "lon0": 3.0}


def pow2(zoom: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), zoom.cast("int"))


def floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def fraction(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Fractional world tile of a point."""
    n, phi = pow2(zoom), F.radians(lat)
    return (lon + 180.0) / 360.0 * n, (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0 * n


def tile_of(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Tile of a point, clamped to the zoom's tiles."""
    top = pow2(zoom) - 1
    return tuple(clamped(floor(v), F.lit(0).cast("long"), top) for v in fraction(lon, lat, zoom))


def tile_range(west: Column, south: Column, east: Column, north: Column, zoom: Column, epsilon: float = 0.0, most_lat: float = 90.0) -> tuple[Column, ...]:
    """(x0, y0, x1, y1) of the tiles a box touches; ``epsilon`` degrees are taken off each side."""
    clamp = (lambda v: v) if most_lat >= 90 else (lambda v: clamped(v, -most_lat, most_lat))
    x0, y0 = tile_of(west + epsilon, clamp(north - epsilon), zoom)
    x1, y1 = tile_of(east - epsilon, clamp(south + epsilon), zoom)
    return x0, y0, x1, y1


def _lat(y: Column, n: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / n))))


def tile_box(x: Column, y: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north)."""
    n = pow2(zoom)
    return x / n * 360.0 - 180.0, _lat(y + 1, n), (x + 1) / n * 360.0 - 180.0, _lat(y, n)


def pixel_centre(x: Column, y: Column, px: Column, py: Column, zoom: Column, size: int) -> tuple[Column, Column]:
    """(lon, lat) of a pixel's centre."""
    n = pow2(zoom) * size
    return (x * size + px + 0.5) / n * 360.0 - 180.0, _lat(y * size + py + 0.5, n)


def ground_resolution(y: Column, zoom: Column, size: int) -> Column:
    """Metres a pixel at the latitude of the tile's centre."""
    return CIRCUMFERENCE * F.cos(F.radians(_lat(y + 0.5, pow2(zoom)))) / (pow2(zoom) * size)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(clamped(a, None, 1.0)))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return RADIUS * F.radians(lon), RADIUS * F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.pi() / 2)


def _isometric(phi: Column) -> Column:
    e = LAMBERT93["e"]
    s = F.sin(phi)
    return F.ln(F.tan(F.pi() / 4 + phi / 2) * F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2)))


def to_lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    p = LAMBERT93
    r = p["c"] * F.exp(-p["n"] * _isometric(F.radians(lat)))
    turn = p["n"] * F.radians(lon - p["lon0"])
    return p["xs"] + r * F.sin(turn), p["ys"] - r * F.cos(turn)


def from_lambert93(x: Column, y: Column, rounds: int = 8) -> tuple[Column, Column]:
    """Inverse by a fixed number of fixed-point rounds (each gains more than two digits)."""
    p = LAMBERT93
    dx, dy, e = x - p["xs"], p["ys"] - y, p["e"]
    iso = -F.ln(F.sqrt(dx * dx + dy * dy) / p["c"]) / p["n"]
    bare = lambda shift: 2 * F.atan(F.exp(iso + shift)) - F.pi() / 2
    phi = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        bare(F.lit(0.0)),
        lambda acc, _: 2 * F.atan(F.exp(iso) * F.pow((1 + e * F.sin(acc)) / (1 - e * F.sin(acc)), F.lit(e / 2))) - F.pi() / 2,
    )
    return F.degrees(F.atan2(dx, dy)) / p["n"] + p["lon0"], F.degrees(phi)


def flip_row(zoom: Column, y: Column) -> Column:
    """TMS row of an XYZ row or the other way; null where the zoom has no such row."""
    return F.when((y >= 0) & (y < pow2(zoom)), pow2(zoom) - 1 - y)


def tile_id(zoom: Column, x: Column, y: Column) -> Column:
    """Number of the tile over all zooms: those of lower zooms first, then row by row."""
    return F.floor((pow2(zoom) * pow2(zoom) - 1) / 3).cast("long") + pow2(zoom) * y + x


def parent(zoom: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    return zoom - 1, F.shiftright(x, 1), F.shiftright(y, 1)


def children(zoom: Column, x: Column, y: Column) -> Column:
    """The four tiles below, as an array of structs (zoom, x, y)."""
    return F.array(*[F.struct((zoom + 1).alias("zoom"), (x * 2 + dx).alias("x"), (y * 2 + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])


def ancestors(zoom: Column, x: Column, y: Column) -> Column:
    """All tiles above, as an array of structs (zoom, x, y), the nearest first; none at zoom 0."""
    up = F.when(zoom > 0, F.sequence(F.lit(1), zoom.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(up, lambda k: F.struct((zoom - k).alias("zoom"), F.call_function("shiftright", x, k).alias("x"), F.call_function("shiftright", y, k).alias("y")))


def degree_name(lon: Column, lat: Column) -> Column:
    """Name of the one-degree square, as ``N44E006``."""
    y, x = floor(lat), floor(lon)
    return F.concat(
        F.when(y < 0, "S").otherwise("N"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x < 0, "W").otherwise("E"), F.lpad(F.abs(x).cast("string"), 3, "0")
    )


def parse_degree_name(name: Column) -> tuple[Column, Column]:
    """(lon, lat) of the south-west corner; null where the text is no such name."""
    pattern = r"^([NSns])(\d{2})([EWew])(\d{3})"
    ok = name.rlike(pattern)
    part = lambda i: F.regexp_extract(name, pattern, i)
    lat = F.when(ok, part(2).try_cast("int") * F.when(F.upper(part(1)) == "S", -1).otherwise(1))
    lon = F.when(ok, part(4).try_cast("int") * F.when(F.upper(part(3)) == "W", -1).otherwise(1))
    return lon, lat


def degree_cover(west: Column, south: Column, east: Column, north: Column) -> Column:
    """South-west corners of the one-degree squares a box lies in, at least one; array of structs (lon, lat)."""
    last = lambda lo, hi: F.greatest(F.ceil(hi).cast("long") - 1, floor(lo))
    return F.flatten(
        F.transform(
            F.sequence(floor(south), last(south, north)),
            lambda y: F.transform(F.sequence(floor(west), last(west, east)), lambda x: F.struct(x.alias("lon"), y.alias("lat"))),
        )
    )


def graph_degrees(level: Column) -> Column:
    return F.when(level == 0, GRAPH_DEGREES[0]).when(level == 1, GRAPH_DEGREES[1]).when(level == 2, GRAPH_DEGREES[2])


def graph_box(x: Column, y: Column, level: Column) -> tuple[Column, Column, Column, Column]:
    d = graph_degrees(level)
    return x * d - 180.0, y * d - 90.0, (x + 1) * d - 180.0, (y + 1) * d - 90.0


def graph_path(x: Column, y: Column, level: Column) -> Column:
    """``<level>/<groups of three digits>.gph``; level 2 has nine digits, the others six."""
    columns = (F.lit(360.0) / graph_degrees(level)).cast("long")
    digits = F.lpad((y * columns + x).cast("string"), F.when(level == 2, 9).otherwise(6), F.lit("0"))
    groups = F.when(level == 2, F.concat_ws("/", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 3))).otherwise(
        F.concat_ws("/", F.substring(digits, 1, 3), F.substring(digits, 4, 3))
    )
    return F.concat(level.cast("string"), F.lit("/"), groups, F.lit(".gph"))


def graph_cover(west: Column, south: Column, east: Column, north: Column, level: Column) -> Column:
    """Graph tiles a box touches at a level; array of structs (x, y)."""
    d = graph_degrees(level)
    return F.flatten(
        F.transform(
            F.sequence(floor((south + 90.0) / d), floor((north + 90.0) / d)),
            lambda y: F.transform(F.sequence(floor((west + 180.0) / d), floor((east + 180.0) / d)), lambda x: F.struct(x.alias("x"), y.alias("y"))),
        )
    )


def parse_bounds(text: Column) -> Column:
    """Array of exactly four numbers, or null."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), parts)


def clamp_bounds(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, ...]:
    """A box inside +-180 and +-85 degrees."""
    return clamped(west, -180.0, 180.0), clamped(south, -85.0, 85.0), clamped(east, -180.0, 180.0), clamped(north, -85.0, 85.0)


def box_centre(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    return (west + east) / 2, (south + north) / 2


def native_resolution(degrees_per_pixel: Column) -> Column:
    return degrees_per_pixel * DEGREE_M


def project_pixel(px: Column, py: Column, origin: tuple[Column, Column], scale: tuple[Column, Column]) -> tuple[Column, Column]:
    """(easting, northing) of a raster pixel's centre; the origin is the north-west corner."""
    return origin[0] + (px + 0.5) * scale[0], origin[1] - (py + 0.5) * scale[1]


def pixel_of(easting: Column, northing: Column, origin: tuple[Column, Column], scale: tuple[Column, Column]) -> tuple[Column, Column]:
    """Fractional pixel (x, y) of a projected point; a pixel's centre is a whole number."""
    return (easting - origin[0]) / scale[0] - 0.5, (origin[1] - northing) / scale[1] - 0.5


def raster_bounds(width: Column, height: Column, origin: tuple[Column, Column], scale: tuple[Column, Column]) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a raster in map units."""
    return origin[0], origin[1] - height * scale[1], origin[0] + width * scale[0], origin[1]
