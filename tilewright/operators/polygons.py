"""Polygons of tile masks: the union of tiles as closed rings, holes with the ring around them.

Sides of tiles that have no neighbour there are the border. Each goes around its tile with the tile on its left, seen
with y upwards; what follows a side is decided by the two tiles ahead of it, so blocks of tiles need a ring of tiles
around them and no more. Sides of a block are chained in one task and only the chains that end at a block's
border are linked. Tiles that touch at a corner alone are apart; a ring may touch itself there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as G
from ..session import written
from .chains import ranked
from .contours import walks

#: A side: where it starts and which way it goes: 0 down, 1 right, 2 up, 3 left, y downwards.
_NODE = "struct<y: long, x: long, way: int>"
_ARC = f"first {_NODE}, last {_NODE}, closed boolean, low {_NODE}, low_at long, n long, area long, west {_NODE}, xs array<long>, ys array<long>, downs array<{_NODE}>"
_WAYS = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
#: For each way, the tile to the left of a side that starts at (0, 0), the one to the right, and both ahead of its end.
_LEFT = np.array([(0, 0), (0, -1), (-1, -1), (-1, 0)])
_RIGHT = np.array([(-1, 0), (0, 0), (0, -1), (-1, -1)])


def sides(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end ``(y, x, way)`` of the border sides of the inner tiles of ``full[y, x]``, which has a ring of tiles around.

    The end's way is that of the side that follows. Coordinates are those of the array.
    """
    inner = np.zeros_like(full)
    inner[1:-1, 1:-1] = full[1:-1, 1:-1]
    starts, ends = [], []
    for way in range(4):
        ty, tx = np.nonzero(inner)
        x, y = tx - _LEFT[way][0], ty - _LEFT[way][1]
        border = ~full[y + _RIGHT[way][1], x + _RIGHT[way][0]]
        x, y = x[border], y[border]
        ex, ey = x + _WAYS[way][0], y + _WAYS[way][1]
        left = full[ey + _LEFT[way][1], ex + _LEFT[way][0]]
        right = full[ey + _RIGHT[way][1], ex + _RIGHT[way][0]]
        after = np.where(~left, (way + 1) % 4, np.where(right, (way + 3) % 4, way))
        starts.append(np.stack([y, x, np.full_like(x, way)], axis=1))
        ends.append(np.stack([ey, ex, after], axis=1))
    return np.concatenate(starts), np.concatenate(ends)


def _arcs(f: pd.DataFrame, side: int) -> pd.DataFrame:
    bx, by = int(f["bx"].iloc[0]) * side - 1, int(f["by"].iloc[0]) * side - 1
    full = np.zeros((side + 2, side + 2), bool)
    full[f["y"].to_numpy() - by, f["x"].to_numpy() - bx] = True
    start, end = (s + (by, bx, 0) for s in sides(full))
    a, b = ([tuple(n) for n in s.tolist()] for s in (start, end))
    name = lambda n: None if n is None else dict(zip(("y", "x", "way"), n))
    rows = []
    for chain, closed in walks(a, b):
        turns = [b[i] for i in chain if a[i][2] != b[i][2]]
        if closed:
            at = turns.index(min(turns))
            turns = turns[at:] + turns[:at]
        way, x = start[chain, 2], start[chain, 1]
        ups, downs = ([a[i] for i in chain if a[i][2] == w] for w in (2, 0))
        rows.append(
            {
                "first": name(min(turns) if closed else a[chain[0]]),
                "last": name(b[chain[-1]]),
                "closed": closed,
                "low": name(min(turns, default=None)),
                "low_at": turns.index(min(turns)) if turns else 0,
                "n": len(turns),
                "area": int(x[way == 2].sum() - x[way == 0].sum()),
                "west": name(min(ups, key=lambda n: (n[1], n[0]), default=None)),
                "xs": [t[1] for t in turns],
                "ys": [t[0] for t in turns],
                "downs": [name(d) for d in downs],
            }
        )
    return pd.DataFrame(rows, columns=["first", "last", "closed", "low", "low_at", "n", "area", "west", "xs", "ys", "downs"], dtype=None if rows else object)


def in_blocks(cells: DataFrame, side: int) -> DataFrame:
    """Cells (x, y) with the block ``(bx, by)`` they are in, and with those whose border they lie next to."""

    def blocks(c: str):
        at, inside = F.floor(F.col(c) / side).cast("long"), F.pmod(F.col(c), F.lit(side))
        return F.array_compact(F.array(F.when(inside == 0, at - 1), at, F.when(inside == side - 1, at + 1)))

    return cells.withColumn("bx", F.explode(blocks("x"))).withColumn("by", F.explode(blocks("y")))


def cells_of(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """``(x, y)``: tiles of ``max_zoom`` that are among ``tiles`` or below one of them."""
    deep = tiles.where(F.col("zoom_level") <= max_zoom).withColumn("d", (F.lit(max_zoom) - F.col("zoom_level")).cast("int"))
    many = F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, d) - 1"))
    full = deep.withColumn("dx", F.explode(many)).withColumn("dy", F.explode(many))
    return full.select((F.expr("shiftleft(tile_column, d)") + F.col("dx")).alias("x"), (F.expr("shiftleft(tile_row, d)") + F.col("dy")).alias("y")).distinct()


def border(cells: DataFrame, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Rings of the union of ``cells (x, y)``: ``(ring, area, length, west)`` and their pieces ``(ring, length, start, n, xs, ys, downs)``.

    ``ring`` is the ring's smallest corner (y, x, way on), ``area`` counts cells and is negative for a hole, ``length`` is
    the number of corners. A piece has ``n`` corners, the first of them being corner ``start`` of the ring, then on
    around. ``west`` is the westernmost side that goes up, ``downs`` are sides that go down. A task holds ``block`` cells a side.
    """
    arcs = written(in_blocks(cells.select("x", "y").distinct(), block).groupBy("bx", "by").applyInPandas(lambda f: _arcs(f, block), _ARC))
    open_ = arcs.where("NOT closed")
    behind = open_.select(F.col("first").alias("prev"), F.col("last").alias("id"), F.col("n").alias("step"))
    order = ranked(open_.select(F.col("first").alias("id")).join(behind, "id"))
    placed = open_.drop("closed").join(order.select(F.col("id").alias("first"), "chain", "before"), "first")
    west = F.min_by("west", F.when(F.col("west").isNotNull(), F.struct("west.x", "west.y"))).alias("west")
    lowest = F.min(F.when(F.col("low").isNotNull(), F.struct("low", (F.col("before") + F.col("low_at")).alias("at")))).alias("lowest")
    whole = written(placed.groupBy("chain").agg(F.sum("n").alias("length"), lowest, F.sum("area").alias("area"), west))
    across = placed.drop("west", "area").join(whole, "chain")
    start = F.pmod(F.col("before") - F.col("lowest.at"), F.col("length"))
    inside = arcs.where("closed")
    rings = whole.select(F.col("lowest.low").alias("ring"), "area", "length", "west").unionByName(inside.select(F.col("first").alias("ring"), "area", F.col("n").alias("length"), "west"))
    pieces = across.select(F.col("lowest.low").alias("ring"), "length", start.alias("start"), "n", "xs", "ys", "downs").unionByName(
        inside.select(F.col("first").alias("ring"), F.col("n").alias("length"), F.lit(0).cast("long").alias("start"), "n", "xs", "ys", "downs")
    )
    return rings, pieces


def polygons(cells: DataFrame, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """``(ring, polygon, is_hole, area, length)`` of the union's rings, and their corners ``(ring, length, seq, x, y)``.

    ``polygon`` is the outer ring that a ring belongs to. To the west of a hole its row is full up to a border side: that
    side's ring goes around the same polygon, or is another of its holes, further west, which is followed on.
    """
    rings, pieces = border(cells, block)
    holes = rings.where("area < 0").select(F.col("west.y").alias("y"), F.col("west.x").alias("x"), F.col("ring").alias("hole"))
    # A side that goes down starts a row higher up than one that goes up past the same tile.
    downs = pieces.select("ring", F.explode("downs").alias("d")).select((F.col("d.y") + 1).alias("y"), F.col("d.x").alias("x"), "ring")
    asked = downs.join(holes.select("y").distinct(), "y", "left_semi").withColumn("hole", F.lit(None).cast(_NODE)).unionByName(holes.withColumn("ring", F.lit(None).cast(_NODE)))
    row = Window.partitionBy("y").orderBy("x", F.col("hole").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = asked.withColumn("prev", F.last("ring", ignorenulls=True).over(row)).where("hole IS NOT NULL").select(F.col("hole").alias("id"), "prev", F.lit(1).alias("step"))
    links = rings.where("area > 0").select(F.col("ring").alias("id"), F.lit(None).cast(_NODE).alias("prev"), F.lit(0).alias("step")).unionByName(around)
    owner = ranked(links).select(F.col("id").alias("ring"), F.col("chain").alias("polygon"))
    out = rings.join(owner, "ring").select("ring", "polygon", (F.col("area") < 0).alias("is_hole"), "area", "length")
    corners = pieces.select("ring", "length", "start", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"))
    return out, corners.select("ring", "length", ((F.col("start") + F.col("i")) % F.col("length")).alias("seq"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


def mask_polygons(tiles: DataFrame, max_zoom: int, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """:func:`polygons` of a mask's tiles (rows from the north), with the corners' place in web mercator metres as ``easting, northing``."""
    rings, corners = polygons(cells_of(tiles, max_zoom), block)
    tile = G.CIRCUMFERENCE_M / (1 << max_zoom)
    metres = {"easting": F.col("x") * tile - G.CIRCUMFERENCE_M / 2, "northing": G.CIRCUMFERENCE_M / 2 - F.col("y") * tile}
    return rings, corners.withColumns(metres)
