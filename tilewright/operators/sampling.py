"""Elevation of points from tile archives, projected rasters and degree squares, and blending of sources.

Samples are equi-joins on pixel addresses: each point asks for its four neighbours, wherever they lie. A missing
first neighbour means no elevation; the others borrow from the ones before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamped
from ..functions import tiles as G
from ..functions.elevation import bilinear

_CORNERS = (("v00", 0, 0), ("v10", 1, 0), ("v01", 0, 1), ("v11", 1, 1))


def _corners(x: Column, y: Column) -> Column:
    """Array of (corner, x, y) of the four pixels around a fractional one."""
    at = lambda c: F.floor(c).cast("long")
    return F.array(*[F.struct(F.lit(n).alias("corner"), (at(x) + dx).alias("x"), (at(y) + dy).alias("y")) for n, dx, dy in _CORNERS])


def _blend(asked: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row a point with its bilinear ``value`` from rows (by, fx, fy, corner, value)."""
    corner = lambda n: F.max(F.when(F.col("corner") == n, F.col(value).cast("double"))).alias(n)
    out = asked.groupBy(*by, "fx", "fy").agg(*[corner(n) for n, _, _ in _CORNERS])
    return out.select(*by, bilinear(*[F.col(n) for n, _, _ in _CORNERS], F.col("fx"), F.col("fy")).alias(value))


def clamped_zoom(zoom: Column, archive: DataFrame) -> DataFrame:
    """One row, ``zoom``: the zoom asked for, inside the zooms that the archive has."""
    return archive.agg(F.min("zoom_level").alias("_low"), F.max("zoom_level").alias("_high")).select(F.greatest(F.least(zoom, F.col("_high")), F.col("_low")).cast("int").alias("zoom"))


def tile_sizes(pixels: DataFrame) -> DataFrame:
    """``(zoom_level, tile_column, tile_row, size)``: the side in pixels that each decoded tile turns out to have."""
    return pixels.groupBy("zoom_level", "tile_column", "tile_row").agg((F.max("gx") + 1).cast("long").alias("size"))


def sample_archive(points: DataFrame, pixels: DataFrame, zoom: int, by: list[str], value: str = "elev") -> DataFrame:
    """``(by, value)``: elevation of points (lon, lat) from the decoded tiles ``pixels`` (XYZ rows) of one zoom.

    The tile that covers a point says how many pixels a side has; neighbours may lie in the tiles next to it.
    Points without a covering tile, or whose first neighbour is missing, have none. ``by`` names a point.
    """
    own = pixels.where(F.col("zoom_level") == zoom)
    tx, ty = G.fraction(F.col("lon"), F.col("lat"), F.lit(zoom))
    placed = points.select(*by, tx.alias("tx"), ty.alias("ty")).withColumns({"tile_column": G.floor(F.col("tx")), "tile_row": G.floor(F.col("ty"))})
    sized = placed.join(tile_sizes(own).drop("zoom_level"), ["tile_column", "tile_row"], "left")
    wx, wy = F.col("tx") * F.col("size") - 0.5, F.col("ty") * F.col("size") - 0.5
    asked = sized.select(*by, "size", (wx - F.floor(wx)).alias("fx"), (wy - F.floor(wy)).alias("fy"), F.explode(_corners(wx, wy)).alias("c"))
    part = lambda c: F.floor(F.col(f"c.{c}") / F.col("size")).cast("long")
    asked = asked.select(
        *by, "fx", "fy", "c.corner", part("x").alias("tile_column"), part("y").alias("tile_row"), F.pmod("c.x", "size").alias("gx"), F.pmod("c.y", "size").alias("gy")
    )
    have = own.select("tile_column", "tile_row", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), value)
    return _blend(asked.join(have, ["tile_column", "tile_row", "gx", "gy"], "left"), by, value)


def sample_raster(points: DataFrame, pixels: DataFrame, level: dict[str, float], by: list[str], value: str = "elev") -> DataFrame:
    """``(by, value)``: elevation of projected points (easting, northing) from one level of a raster ``pixels (gx, gy, value)``.

    ``level`` has width, height, origin_x, origin_y, scale_x and scale_y. A pixel's value is at its centre;
    points outside the pixel centres' range have none; neighbours beyond the last row or column are that one.
    """
    origin, scale = (F.lit(level["origin_x"]), F.lit(level["origin_y"])), (F.lit(level["scale_x"]), F.lit(level["scale_y"]))
    x, y = G.pixel_of(F.col("easting"), F.col("northing"), origin, scale)
    placed = points.select(*by, x.alias("x"), y.alias("y"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < level["width"]) & (F.col("y") < level["height"])
    at = F.when(inside, _corners(F.col("x"), F.col("y"))).otherwise(F.array(F.struct(F.lit("none").alias("corner"), F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y"))))
    asked = placed.select(*by, (F.col("x") - F.floor("x")).alias("fx"), (F.col("y") - F.floor("y")).alias("fy"), F.explode(at).alias("c"))
    asked = asked.select(*by, "fx", "fy", "c.corner", F.least("c.x", F.lit(int(level["width"]) - 1)).alias("gx"), F.least("c.y", F.lit(int(level["height"]) - 1)).alias("gy"))
    have = pixels.where(~F.isnan(F.col(value).cast("double"))).select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), value)
    return _blend(asked.join(have, ["gx", "gy"], "left"), by, value)


def located_squares(points: DataFrame, squares: DataFrame, by: list[str]) -> DataFrame:
    """``(by, lon_deg, lat_deg)``: the one-degree square among ``squares (lon_deg, lat_deg)`` that answers for each point.

    A point on a square's edge may be answered by its neighbour: its own square comes first, then the one to the south,
    to the west and to the south-west. Points without any are left out.
    """
    lon, lat = G.floor(F.col("lon")), G.floor(F.col("lat"))
    on_lon, on_lat = F.col("lon") == F.floor("lon"), F.col("lat") == F.floor("lat")
    turn = lambda k, x, y, ok: F.struct(F.lit(k).alias("rank"), x.alias("lon_deg"), y.alias("lat_deg"), ok.alias("ok"))
    turns = F.array(turn(0, lon, lat, F.lit(True)), turn(1, lon, lat - 1, on_lat), turn(2, lon - 1, lat, on_lon), turn(3, lon - 1, lat - 1, on_lon & on_lat))
    asked = points.select(*by, F.explode(F.filter(turns, lambda t: t["ok"])).alias("t")).select(*by, "t.rank", "t.lon_deg", "t.lat_deg")
    found = asked.join(squares.select("lon_deg", "lat_deg").distinct(), ["lon_deg", "lat_deg"])
    return found.groupBy(*by).agg(F.min_by(F.struct("lon_deg", "lat_deg"), "rank").alias("s")).select(*by, "s.lon_deg", "s.lat_deg")


def sample_squares(points: DataFrame, pixels: DataFrame, by: list[str], value: str = "elev") -> DataFrame:
    """``(by, value)``: elevation of points (lon, lat) from degree squares ``pixels (lon_deg, lat_deg, gx, gy, value)``, gy 0 in the north.

    Squares repeat their edge rows and columns, so a sample stays inside its square. Points without a square are left out.
    """
    sizes = pixels.groupBy("lon_deg", "lat_deg").agg(F.max("gx").cast("long").alias("last"))
    placed = located_squares(points, sizes, by).join(points.select(*by, "lon", "lat"), by).join(sizes, ["lon_deg", "lat_deg"])
    x = clamped((F.col("lon") - F.col("lon_deg")) * F.col("last"), F.lit(0.0), F.col("last").cast("double"))
    y = clamped((1.0 - (F.col("lat") - F.col("lat_deg"))) * F.col("last"), F.lit(0.0), F.col("last").cast("double"))
    asked = placed.select(*by, "lon_deg", "lat_deg", "last", (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"), F.explode(_corners(x, y)).alias("c"))
    asked = asked.select(*by, "lon_deg", "lat_deg", "fx", "fy", "c.corner", F.least("c.x", "last").alias("gx"), F.least("c.y", "last").alias("gy"))
    have = pixels.select("lon_deg", "lat_deg", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), value)
    return _blend(asked.join(have, ["lon_deg", "lat_deg", "gx", "gy"], "left"), by, value)


def ring_probes(points: DataFrame, by: list[str], metres: float) -> DataFrame:
    """``(by, probe, lon, lat)``: each point (probe 0) and the ring of eight around it, ``metres`` away."""
    from .raster import RING

    dlat = metres / G.DEGREE_M
    dlon = dlat / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))
    ring = [F.struct(F.lit(i + 1).alias("probe"), (F.col("lon") + dlon * x).alias("lon"), (F.col("lat") + dlat * y).alias("lat")) for i, (x, y) in enumerate(RING)]
    return points.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("probe"), F.col("lon"), F.col("lat")), *ring)).alias("p")).select(*by, "p.probe", "p.lon", "p.lat")


def blend_sources(samples: DataFrame, by: list[str], value: str = "elev", feathered: bool = True) -> DataFrame:
    """``(by, value)``: sources blended at each point, from ``samples (by, priority, probe, value)``.

    The lowest priority that covers a point sets its value; each better one is mixed in by the share of its
    nine probes that it covers, or, where not ``feathered``, replaces it.
    """
    from .raster import composite

    own = F.max(F.when(F.col("probe") == 0, F.col(value).cast("double")))
    each = samples.groupBy(*by, "priority").agg(own.alias("value"), (F.count(value) / 9.0 if feathered else F.lit(1.0)).alias("weight"))
    listed = each.where("value IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("priority", "value", "weight"))).alias("s"))
    parts = F.transform("s", lambda s: F.struct(s["value"].alias("value"), s["weight"].alias("weight"), F.lit(None).cast("double").alias("least")))
    return listed.select(*by, composite(parts).alias(value))


def warp(tiles: DataFrame, size: int, sample) -> DataFrame:
    """``(zoom_level, tile_column, tile_row, px, py, elev)``: every pixel of the tiles, with what ``sample`` gives at its centre.

    ``sample`` takes points (zoom_level, tile_column, tile_row, px, py, lon, lat) and returns them with ``elev`` instead of
    the place: any of the samplers above, after a projection if the source has one. Pixels without a value are null.
    """
    by = ["zoom_level", "tile_column", "tile_row", "px", "py"]
    many = F.sequence(F.lit(0), F.lit(size - 1))
    grid = tiles.select("zoom_level", "tile_column", "tile_row").distinct().withColumn("px", F.explode(many)).withColumn("py", F.explode(many))
    lon, lat = G.pixel_centre(F.col("tile_column"), F.col("tile_row"), F.col("px"), F.col("py"), F.col("zoom_level"), size)
    return grid.join(sample(grid.select(*by, lon.alias("lon"), lat.alias("lat")), by), by, "left")
