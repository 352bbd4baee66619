"""Grids as rows of blocks: halos out of neighbours' edges, samples and warps a block at a time.

A block ``(bx, by, data)`` holds ``side`` by ``side`` doubles, row by row from the north, NaN for none: pixel (gx, gy) is in
the block (gx div side, gy div side). A grid moves once, as blocks; of its neighbours a block gets the rows and columns
at their edges and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as G

#: Points of a block that are sampled together; a block that many points ask for is read by several tasks.
AT_ONCE = 4096
_AT = ["bx", "by"]
_TILE = ["zoom_level", "tile_column", "tile_row"]


def from_pixels(pixels: DataFrame, side: int, value: str = "elev") -> DataFrame:
    """Blocks of ``pixels (gx, gy, value)``, those that have any; a null value is none."""
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    rows = pixels.select(at("gx").alias("bx"), at("gy").alias("by"), F.pmod("gx", F.lit(side)).cast("int").alias("x"), F.pmod("gy", F.lit(side)).cast("int").alias("y"), F.col(value).cast("double").alias("v"))

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((side, side), np.nan)
        grid[f["y"].to_numpy(), f["x"].to_numpy()] = f["v"].to_numpy(float)
        return pd.DataFrame({"bx": f["bx"].iloc[:1], "by": f["by"].iloc[:1], "data": [grid.tobytes()]})

    return rows.groupBy(*_AT).applyInPandas(fill, "bx long, by long, data binary")


def from_raster(read: DataFrame) -> DataFrame:
    """Blocks of the rows of :func:`tilewright.sources.rasters.read_blocks`, of one level with square blocks."""
    place = [F.floor(F.col("gx0") / F.col("width")).cast("long").alias("bx"), F.floor(F.col("gy0") / F.col("height")).cast("long").alias("by")]

    @F.pandas_udf("binary")
    def doubles(data: pd.Series) -> pd.Series:
        return data.map(lambda d: np.frombuffer(d, np.float32).astype(float).tobytes())

    return read.where("data IS NOT NULL").select(*place, doubles("data").alias("data"))


def to_pixels(blocks: DataFrame, side: int, value: str = "elev") -> DataFrame:
    """``(gx, gy, value)`` of the pixels that have one."""
    return _unpacked(blocks, side, value, _AT).select(
        (F.col("bx") * side + F.col("px")).alias("gx"), (F.col("by") * side + F.col("py")).alias("gy"), value
    )


def _unpacked(rows: DataFrame, side: int, value: str, by: list[str]) -> DataFrame:
    @F.pandas_udf("array<double>")
    def listed(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else np.frombuffer(d))

    each = rows.select(*by, F.posexplode(listed("data")).alias("i", value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    return each.select(*by, (F.col("i") % side).alias("px"), F.floor(F.col("i") / side).cast("int").alias("py"), value)


def with_halo(blocks: DataFrame, side: int, before: int, after: int) -> DataFrame:
    """The blocks with ``before`` rows and columns more to the north and west and ``after`` more to the south and east.

    ``data`` has ``side + before + after`` doubles a side then; what no block has is NaN. Each block sends its edges to the
    eight around it, so that of a grid in blocks of 256 with a halo of one pixel some 3 % move besides the blocks.
    """
    if max(before, after) > side:
        raise ValueError("a halo reaches no further than the blocks next to it")
    whole = side + before + after
    # Where a part lies in the block it comes from and in the one that gets it, by the way from the first to the second.
    own = {-1: slice(0, after), 0: slice(0, side), 1: slice(side - before, side)}
    into = {-1: slice(before + side, whole), 0: slice(before, before + side), 1: slice(0, before)}
    ways = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if own[dx].stop > own[dx].start and own[dy].stop > own[dy].start]

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x, y, data in zip(f["bx"], f["by"], f["data"]):
                grid = np.frombuffer(data).reshape(side, side)
                yield pd.DataFrame({"bx": [x + dx for dx, _ in ways], "by": [y + dy for _, dy in ways], "dx": [dx for dx, _ in ways], "dy": [dy for _, dy in ways], "data": [np.ascontiguousarray(grid[own[dy], own[dx]]).tobytes() for dx, dy in ways]})

    def put(f: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((whole, whole), np.nan)
        here = False
        for dx, dy, data in zip(f["dx"], f["dy"], f["data"]):
            part = grid[into[dy], into[dx]]
            part[:] = np.frombuffer(data).reshape(part.shape)
            here |= dx == dy == 0
        return pd.DataFrame({"bx": f["bx"].iloc[:1], "by": f["by"].iloc[:1], "data": [grid.tobytes()]})[: int(here)]

    sent = blocks.select(*_AT, "data").mapInPandas(send, "bx long, by long, dx int, dy int, data binary")
    return sent.groupBy(*_AT).applyInPandas(put, "bx long, by long, data binary")


def interpolated(grid: np.ndarray, x: np.ndarray, y: np.ndarray, last: tuple[float, float] = (np.inf, np.inf)) -> np.ndarray:
    """Bilinear values at ``x, y`` in units of ``grid[y, x]``; NaN without the first neighbour, voids among the others borrow from it.

    Neighbours beyond the column and the row of ``last`` are those.
    """
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0
    x1, y1 = np.minimum(x0 + 1, last[0]).astype(np.int64), np.minimum(y0 + 1, last[1]).astype(np.int64)
    v00, v10, v01, v11 = grid[y0, x0], grid[y0, x1], grid[y1, x0], grid[y1, x1]
    v10, v01 = np.where(np.isnan(v10), v00, v10), np.where(np.isnan(v01), v00, v01)
    v11 = np.where(np.isnan(v11), v10, v11)
    return (v00 * (1 - fx) + v10 * fx) * (1 - fy) + (v01 * (1 - fx) + v11 * fx) * fy


def sampled(points: DataFrame, haloed: DataFrame, side: int, before: int, by: list[str], last: tuple[int, int] | None = None, value: str = "elev") -> DataFrame:
    """``(by, value)`` of points ``(by, bx, by_, x, y)``: the block each asks, as ``bx, by_``, and its place in pixels of the whole grid.

    ``haloed`` are blocks with ``before`` pixels more to the west and north, and as many to the other sides as the points'
    neighbours need; ``last`` is the grid's last pixel, whose neighbours are itself. Points without a block or a first neighbour
    have a null value. Points travel as arrays of some ``AT_ONCE`` of a block, so that a block that a third of all ask is
    met in many rows, of bounded size, which a skewed join can be split by.
    """
    asked = points.select("bx", "by_", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]).alias("k"), "x", "y")
    counts = asked.groupBy("bx", "by_").agg(F.ceil(F.count(F.lit(1)) / AT_ONCE).cast("int").alias("parts"))
    dealt = asked.join(counts, ["bx", "by_"]).withColumn("part", F.pmod(F.xxhash64("k"), "parts"))
    lists = dealt.groupBy("bx", "by_", "part").agg(F.collect_list(F.struct("k", "x", "y")).alias("p"))

    @F.pandas_udf("array<double>")
    def values(data: pd.Series, bx: pd.Series, by_: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for d, cx, cy, px, py in zip(data, bx, by_, x, y):
            if d is None:
                out.append([None] * len(px))
                continue
            ox, oy = cx * side - before, cy * side - before
            end = (np.inf, np.inf) if last is None else (last[0] - ox, last[1] - oy)
            grid = np.frombuffer(d)
            found = interpolated(grid.reshape(int(len(grid) ** 0.5), -1), px - ox, py - oy, end)
            out.append([None if np.isnan(v) else v for v in found.tolist()])
        return pd.Series(out, dtype=object)

    both = lists.join(haloed.withColumnRenamed("by", "by_"), ["bx", "by_"], "left")
    found = both.select("p", values("data", "bx", "by_", F.col("p.x"), F.col("p.y")).alias("v"))
    each = found.select(F.explode(F.arrays_zip(F.col("p.k").alias("k"), "v")).alias("r"))
    return each.select(*[F.col(f"r.k.k{i}").alias(c) for i, c in enumerate(by)], F.col("r.v").alias(value))


def sample_raster(points: DataFrame, blocks: DataFrame, side: int, level: dict[str, float], by: list[str], value: str = "elev") -> DataFrame:
    """What :func:`tilewright.operators.sampling.sample_raster` gives, from blocks of ``side`` pixels; a point outside has none."""
    x, y = G.pixel_of(F.col("easting"), F.col("northing"), (F.lit(level["origin_x"]), F.lit(level["origin_y"])), (F.lit(level["scale_x"]), F.lit(level["scale_y"])))
    placed = points.select(*by, x.alias("x"), y.alias("y"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < level["width"]) & (F.col("y") < level["height"])
    block = lambda c: F.when(inside, F.floor(F.col(c) / side)).otherwise(-1).cast("long")
    return sampled(placed.select(*by, "x", "y", block("x").alias("bx"), block("y").alias("by_")), with_halo(blocks, side, 0, 1), side, 0, by, (int(level["width"]) - 1, int(level["height"]) - 1), value)


def sample_tiles(points: DataFrame, tiles: DataFrame, zoom: int, side: int, by: list[str], value: str = "elev") -> DataFrame:
    """What :func:`tilewright.operators.sampling.sample_archive` gives, from decoded tiles ``(tile_column, tile_row, data)`` of one zoom and size."""
    tx, ty = G.fraction(F.col("lon"), F.col("lat"), F.lit(zoom))
    placed = points.select(*by, (tx * side - 0.5).alias("x"), (ty * side - 0.5).alias("y"), G.floor(tx).alias("bx"), G.floor(ty).alias("by_"))
    return sampled(placed, with_halo(tiles.select(F.col("tile_column").alias("bx"), F.col("tile_row").alias("by"), "data"), side, 1, 1), side, 1, by, None, value)


#: From the longitudes and latitudes of pixel centres to the source's fractional pixels.
Place = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def tile_centres(zoom: int, column: int, row: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes of a tile's columns of pixels and latitudes of its rows, at their centres."""
    n = float(1 << zoom) * size
    lon = (column * size + np.arange(size) + 0.5) / n * 360.0 - 180.0
    return lon, np.degrees(np.arctan(np.sinh(np.pi * (1.0 - 2.0 * (row * size + np.arange(size) + 0.5) / n))))


def warp(tiles: DataFrame, size: int, blocks: DataFrame, side: int, extent: tuple[int, int], place: Place) -> DataFrame:
    """``(zoom_level, tile_column, tile_row, data)``: tiles of ``size`` pixels out of a grid in blocks, by bilinear samples at pixel centres.

    ``place`` gives the fractional pixel of the source (of ``extent`` pixels) for arrays of longitudes and latitudes. A tile is
    asked of every block that one of its pixels has its first neighbour in, with a few numbers a block; what a block has
    of the tile comes back as values and places. So the grid moves once, and the tiles' pixels once. A tile that no block
    covers is all NaN.
    """

    def places(zoom: int, column: int, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lon, lat = tile_centres(zoom, column, row, size)
        x, y = (np.broadcast_to(v, (size, size)).ravel() for v in place(lon[None, :], lat[:, None]))
        at = np.flatnonzero((x >= 0) & (y >= 0) & (x < extent[0]) & (y < extent[1]))
        x, y = x[at], y[at]
        return at, x, y, (np.floor(y / side) * (1 << 31) + np.floor(x / side)).astype(np.int64)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tile in zip(*(f[c].tolist() for c in _TILE)):
                block = np.unique(places(*tile)[3])
                yield pd.DataFrame(dict(zip(_TILE, tile)) | {"bx": block % (1 << 31), "by": block // (1 << 31)}, index=range(len(block)))

    @F.pandas_udf("at binary, v binary")
    def part(zoom: pd.Series, column: pd.Series, row: pd.Series, bx: pd.Series, by: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for *tile, cx, cy, d in zip(zoom, column, row, bx, by, data):
            at, x, y, block = places(*tile)
            own = block == cy * (1 << 31) + cx
            last = (extent[0] - 1 - cx * side, extent[1] - 1 - cy * side)
            v = interpolated(np.frombuffer(d).reshape(side + 1, side + 1), x[own] - cx * side, y[own] - cy * side, last)
            out.append((at[own].astype(np.int32).tobytes(), v.tobytes()))
        return pd.DataFrame(out, columns=["at", "v"])

    @F.pandas_udf("binary")
    def merged(parts: pd.Series) -> pd.Series:
        out = []
        for ps in parts:
            tile = np.full(size * size, np.nan)
            for p in ps if ps is not None else []:
                tile[np.frombuffer(p["at"], np.int32)] = np.frombuffer(p["v"])
            out.append(tile.tobytes())
        return pd.Series(out)

    own = tiles.select(F.col("zoom_level").cast("int").alias("zoom_level"), F.col("tile_column").cast("long").alias("tile_column"), F.col("tile_row").cast("long").alias("tile_row")).distinct()
    asked = own.mapInPandas(ask, "zoom_level int, tile_column long, tile_row long, bx long, by long")
    found = asked.join(with_halo(blocks, side, 0, 1), _AT).select(*_TILE, part(*_TILE, *_AT, "data").alias("p"))
    lists = found.groupBy(*_TILE).agg(F.collect_list("p").alias("parts"))
    return own.join(lists, _TILE, "left").select(*_TILE, merged("parts").alias("data"))


def tile_pixels(tiles: DataFrame, size: int, value: str = "elev") -> DataFrame:
    """``(zoom_level, tile_column, tile_row, px, py, value)`` of the tiles' pixels that have a value."""
    return _unpacked(tiles, size, value, _TILE)


def affine(level: dict[str, float]) -> Place:
    """Of a source in degrees whose pixels' centres are half a pixel inside its origin."""

    def place(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (lon - level["origin_x"]) / level["scale_x"] - 0.5, (level["origin_y"] - lat) / level["scale_y"] - 0.5

    return place

