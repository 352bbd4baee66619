"""From shapes to tiles and from pixels to tiles: covers by levels, rendering, exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elevation as E
from ..functions import tiles as G
from ..session import written
from . import geometry


def _boxed(tiles: DataFrame) -> DataFrame:
    sides = G.tile_box(F.col("tile_column"), F.col("tile_row"), F.col("zoom_level"))
    return tiles.withColumns(dict(zip(("west", "south", "east", "north"), sides)))


def tiles_of_shape(ring_vertices: DataFrame, max_zoom: int, buffer: float = 0.0, step: int = 5) -> DataFrame:
    """Tiles of every zoom up to ``max_zoom`` that touch the shape grown by ``buffer`` tiles.

    ``step`` zooms are asked at a time: those that touch at the lowest of them are split into all tiles below,
    so a thin shape costs what it touches and the plan has a join for each step, not for each tile.
    """
    start = ring_vertices.sparkSession.createDataFrame([(0, 0, 0)], "zoom_level int, tile_column long, tile_row long")
    out, first = None, 0
    while first <= max_zoom:
        last = min(max_zoom, first + step)
        below = F.explode(F.sequence(F.lit(0), F.lit(last) - F.col("zoom_level"))).alias("d")
        many = F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, d) - 1"))
        level = (
            start.select("*", below)
            .select("zoom_level", "d", "tile_row", F.col("tile_column"), F.explode(many).alias("dx"))
            .select("zoom_level", "d", "tile_row", "tile_column", "dx", F.explode(many).alias("dy"))
            .select(
                (F.col("zoom_level") + F.col("d")).alias("zoom_level"),
                (F.expr("shiftleft(tile_column, d)") + F.col("dx")).alias("tile_column"),
                (F.expr("shiftleft(tile_row, d)") + F.col("dy")).alias("tile_row"),
            )
        )
        found = written(geometry.boxes_touching_shape(_boxed(level), ring_vertices, buffer).select("zoom_level", "tile_column", "tile_row"))
        part = found if first == 0 else found.where(F.col("zoom_level") > first)
        out = part if out is None else out.unionByName(part)
        start = found.where(F.col("zoom_level") == last)
        first = last if last < max_zoom else max_zoom + 1
    return out


def cover_boxes(boxes: DataFrame, zoom: int, ring: int = 0) -> DataFrame:
    """``boxes`` with a row for each tile (x, y) of a zoom they touch, and ``ring`` tiles around."""
    x0, y0, x1, y1 = G.tile_range(*[F.col(c) for c in ("west", "south", "east", "north")], F.lit(zoom))
    top = (1 << zoom) - 1
    span = lambda lo, hi: F.sequence(F.greatest(lo - ring, F.lit(0)), F.least(hi + ring, F.lit(top)))
    return boxes.withColumn("x", F.explode(span(x0, x1))).withColumn("y", F.explode(span(y0, y1)))


def macrotiles(tiles: DataFrame, side: int) -> DataFrame:
    """``(zoom_level, mx, my, tiles)``: the blocks of ``side`` by ``side`` tiles that are rendered together."""
    at = lambda c, n: F.floor(F.col(c) / side).cast("long").alias(n)
    return tiles.groupBy("zoom_level", at("tile_column", "mx"), at("tile_row", "my")).agg(F.count(F.lit(1)).alias("tiles"))


def graph_tiles_at(points: DataFrame, levels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The graph tiles (x, y, level) that hold the points (lon, lat), each once, in their order."""
    rows = points.select("lon", "lat", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    deg = G.graph_degrees(F.col("level"))
    at = rows.select(G.floor((F.col("lon") + 180.0) / deg).alias("x"), G.floor((F.col("lat") + 90.0) / deg).alias("y"), "level")
    return at.distinct().orderBy("x", "y", "level")


def degree_files(boxes: DataFrame, files: DataFrame) -> DataFrame:
    """The one-degree squares (lon, lat) among ``files`` that the boxes lie in."""
    wanted = boxes.select(F.explode(G.degree_cover(*[F.col(c) for c in ("west", "south", "east", "north")])).alias("c")).select("c.lon", "c.lat").distinct()
    return files.join(wanted, ["lon", "lat"], "left_semi")


def resolved_files(wanted: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """``wanted (x, y, level)`` graph tiles with their path under ``root`` and ``found``: whether ``listing (path)`` has it."""
    paths = wanted.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), G.graph_path(F.col("x"), F.col("y"), F.col("level"))))
    return paths.join(listing.select("path", F.lit(True).alias("found")).distinct(), "path", "left").fillna(False, ["found"])


def tile_counts(store: DataFrame) -> DataFrame:
    """``(zoom_level, stored, wanted, extra)`` for tiles that are to be stored: those to be made also have the
    children of the tiles stored a zoom above among them, of zooms that are stored."""
    address = ["zoom_level", "tile_column", "tile_row"]
    own = store.select(*address).distinct()
    zooms = own.select("zoom_level").distinct()
    child = own.select(F.explode(G.children(F.col("zoom_level"), F.col("tile_column"), F.col("tile_row"))).alias("c"))
    below = child.select(F.col("c.zoom").alias("zoom_level"), F.col("c.x").alias("tile_column"), F.col("c.y").alias("tile_row")).join(zooms, "zoom_level", "left_semi")
    both = own.withColumn("stored", F.lit(1)).unionByName(below.withColumn("stored", F.lit(0)))
    each = both.groupBy(*address).agg(F.max("stored").alias("stored"))
    return each.groupBy("zoom_level").agg(F.sum("stored").alias("stored"), F.count(F.lit(1)).alias("wanted"), (F.count(F.lit(1)) - F.sum("stored")).alias("extra"))


def dry_run(bounds: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """``bounds`` with ``tiles``: how many tiles its box has from one zoom to another, whatever the shape."""

    def at(zoom: Column) -> Column:
        x0, y0, x1, y1 = G.tile_range(*[F.col(c) for c in ("west", "south", "east", "north")], zoom)
        return (x1 - x0 + 1) * (y1 - y0 + 1)

    zooms = F.sequence(F.lit(min_zoom), F.lit(max_zoom))
    return bounds.withColumn("tiles", F.aggregate(F.transform(zooms, at), F.lit(0).cast("long"), lambda a, b: a + b))


def halo(max_zoom: Column, size: int, blur: Column) -> tuple[Column, Column]:
    """(pixels, metres) around a block that a blur of ``blur`` metres reads, and the margin of the sources around all."""
    metres = G.CIRCUMFERENCE_M / (G.pow2(max_zoom) * size)
    pixels = F.when(blur != 0, 2 * F.floor(blur / metres) + 4).otherwise(0).cast("long")
    return pixels, (pixels + size) * metres


def outline(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """``(x1, y1, x2, y2)``: the border of the tiles' union, in sides of tiles of ``max_zoom``; rows count from the north.

    A side that two tiles share is inside. Tiles above ``max_zoom`` stand for all tiles below them.
    """
    deep = tiles.where(F.col("zoom_level") <= max_zoom).withColumn("d", F.lit(max_zoom) - F.col("zoom_level"))
    many = F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, d) - 1"))
    full = deep.withColumn("dx", F.explode(many)).withColumn("dy", F.explode(many))
    cells = full.select((F.expr("shiftleft(tile_column, d)") + F.col("dx")).alias("x"), (F.expr("shiftleft(tile_row, d)") + F.col("dy")).alias("y")).distinct()
    x, y = F.col("x"), F.col("y")
    side = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    sides = F.array(side(x, y, x + 1, y), side(x, y + 1, x + 1, y + 1), side(x, y, x, y + 1), side(x + 1, y, x + 1, y + 1))
    return cells.select(F.explode(sides).alias("s")).groupBy("s.x1", "s.y1", "s.x2", "s.y2").count().where("count = 1").drop("count")


def world_file(max_zoom: Column) -> Column:
    """The six lines that place a picture of ``2**max_zoom`` pixels a side in web mercator."""
    half = G.CIRCUMFERENCE_M / 2
    pixel = 2 * half / G.pow2(max_zoom)
    return F.concat_ws("\n", *[v.cast("string") for v in (pixel, F.lit(0), F.lit(0), -pixel, pixel / 2 - half, half - pixel / 2)])


def mask_picture(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """``(px, py)``: the black pixels of a mask's picture, a pixel a tile of ``max_zoom``; rows of ``tiles`` count from the south."""
    own = tiles.where(F.col("zoom_level") == max_zoom)
    return own.select(F.col("tile_column").alias("px"), (F.lit((1 << max_zoom) - 1) - F.col("tile_row")).alias("py")).distinct()


def mask_to_graph_tiles(tiles: DataFrame, levels: tuple[int, ...] = (0, 1, 2), least_zoom: int = 10) -> DataFrame:
    """Graph tiles (x, y, level) that mask tiles of zoom ``least_zoom`` and more touch."""
    w, s, e, n = G.tile_box(F.col("tile_column"), F.col("tile_row"), F.col("zoom_level"))
    rows = tiles.where(F.col("zoom_level") >= least_zoom).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    inner = lambda v, by: v + by  # noqa: E731  a tile's far edge belongs to the next one
    cover = G.graph_cover(w, inner(s, 1e-9), inner(e, -1e-9), n, F.col("level"))
    return rows.select("level", F.explode(cover).alias("c")).select("c.x", "c.y", "level").distinct()


def to_tile_pixels(points: DataFrame, zoom: int, size: int) -> DataFrame:
    """Points (lon, lat, ...) with tile_column, tile_row, px, py of the pixel they fall in."""
    x, y = G.fraction(F.col("lon"), F.col("lat"), F.lit(zoom))
    gx, gy = G.floor(x * size), G.floor(y * size)
    return points.withColumns(
        {"zoom_level": F.lit(zoom), "tile_column": F.floor(gx / size).cast("long"), "tile_row": F.floor(gy / size).cast("long"), "px": gx % size, "py": gy % size}
    )


def render(pixels: DataFrame, size: int, step: float, encoding: str = "terrarium") -> DataFrame:
    """PNG tiles of ``pixels (zoom_level, tile_column, tile_row, px, py, elev)``; tiles without any covered pixel are left out.

    A pixel without a value is encoded as elevation 0. A tile's pixels are size * size rows at most.
    """
    import numpy as np

    from ..sources.grids import encode_png

    coded = E.encode_terrarium if encoding == "terrarium" else E.encode_mapbox
    r, g, b = coded(F.col("elev").cast("double"), F.lit(step))
    rgb = pixels.where("elev IS NOT NULL").select("zoom_level", "tile_column", "tile_row", "px", "py", r.alias("r"), g.alias("g"), b.alias("b"))
    empty = (128, 0, 0) if encoding == "terrarium" else (1, 134, 160)

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        grid = np.empty((size, size, 3), np.uint8)
        grid[:] = empty
        grid[f["py"].to_numpy(), f["px"].to_numpy()] = f[["r", "g", "b"]].to_numpy()
        first = f.iloc[0]
        return pd.DataFrame({"zoom_level": [int(first.zoom_level)], "tile_column": [int(first.tile_column)], "tile_row": [int(first.tile_row)], "tile_data": [encode_png(grid)]})

    return rgb.groupBy("zoom_level", "tile_column", "tile_row").applyInPandas(draw, "zoom_level int, tile_column long, tile_row long, tile_data binary")


def compact(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of a compact archive: addresses with a content id, and each content once."""
    keyed = tiles.withColumn("tile_data_id", F.sha2("tile_data", 256))
    return keyed.drop("tile_data"), keyed.select("tile_data_id", "tile_data").dropDuplicates(["tile_data_id"])


def set_metadata(metadata: DataFrame, name: str, value: str) -> DataFrame:
    """The map with the value of one name replaced, or added where it was missing."""
    new = metadata.sparkSession.createDataFrame([(name, value)], "name string, value string")
    return metadata.where(F.col("name") != name).unionByName(new)


def _ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.array(*[F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))])


def geojson_grid(tiles: DataFrame, most: int) -> DataFrame:
    """A GeoJSON feature (one text a row) for each tile's outline, at most ``most`` (a display limit), by address."""
    w, s, e, n = G.tile_box(F.col("tile_column"), F.col("tile_row"), F.col("zoom_level"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(_ring(w, s, e, n)).alias("coordinates")).alias("geometry"),
        F.struct(F.concat_ws("/", "zoom_level", "tile_column", "tile_row").alias("label")).alias("properties"),
    )
    return tiles.orderBy("zoom_level", "tile_column", "tile_row").limit(most).select(F.to_json(feature).alias("feature"))


def add_metadata(metadata: DataFrame, name: str, value: str) -> DataFrame:
    """The rows and one more, whatever names are there already."""
    return metadata.unionByName(metadata.sparkSession.createDataFrame([(name, value)], "name string, value string"))


def geojson_points(points: DataFrame, properties: list[str]) -> DataFrame:
    """A GeoJSON point feature for each row (lon, lat) with its ``properties``: a trip's manoeuvres."""
    place = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(*properties, F.to_json(F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def geojson_line(points: DataFrame, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """A GeoJSON line feature for each line of points (lon, lat)."""
    listed = points.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), "lon", "lat"))).alias("p"))
    coordinates = F.transform("p", lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return listed.select(line, F.to_json(feature).alias("feature"))
