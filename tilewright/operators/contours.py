"""Contour lines by marching squares over blocks of a grid, put together across blocks.

A cell lies between four pixels. A line of a level crosses the sides of the cell whose ends are at or above the
level and below it, has the higher ground on one side all along, and so leaves each side that it enters by: every
crossing is the end of one segment and the start of one other. Blocks share a row and a column of pixels,
segments of a block are chained in one task, and only the chains that end at a block's border are linked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .chains import ranked

#: A crossing: the grid side from pixel (gx, gy) to the next in x (side 0) or in y (side 1).
_NODE = "struct<k: long, side: int, gx: long, gy: long>"
_ARC = f"first {_NODE}, last {_NODE}, closed boolean, low {_NODE}, low_at long, n long, xs array<double>, ys array<double>"
#: The sides of a cell around it, each with the corner that it starts from: (side, dx, dy).
_SIDES = np.array([(0, 0, 0), (1, 1, 0), (0, 0, 1), (1, 0, 0)])


def segments(grid: np.ndarray, step: float, origin: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end crossings ``(k, side, x, y)`` of all segments in ``grid[y, x]``, whose first pixel is ``origin``, and their points.

    Cells with a corner that is no finite number have none. At a saddle the mean of the corners decides which are joined.
    """
    corners = np.stack([grid[:-1, :-1], grid[:-1, 1:], grid[1:, 1:], grid[1:, :-1]], axis=-1)
    y, x = np.nonzero(np.isfinite(corners).all(-1))
    corners = corners[y, x]
    low, high = np.floor(corners.min(1) / step).astype(np.int64), np.floor(corners.max(1) / step).astype(np.int64)
    cell = np.repeat(np.arange(len(x)), high - low)
    k = np.arange(len(cell)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[cell] + 1
    above = corners[cell] >= (k * step)[:, None]
    after = np.roll(above, -1, axis=1)
    row, start = np.nonzero(above & ~after)
    rising = ~above & after
    saddle = rising.sum(1) == 2
    turn = np.where(corners[cell].mean(1) >= k * step, 1, 3)
    end = np.where(saddle[row], (start + turn[row]) % 4, rising.argmax(1)[row])

    def crossing(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, dx, dy = _SIDES[side].T
        cx, cy = x[cell[row]] + dx, y[cell[row]] + dy
        a, b = grid[cy, cx], grid[cy + kind, cx + 1 - kind]
        t = (k[row] * step - a) / (b - a)
        cx, cy = cx + origin[0], cy + origin[1]
        return np.stack([k[row], kind, cx, cy], axis=1), np.stack([np.where(kind == 0, cx + t, cx), np.where(kind == 1, cy + t, cy)], axis=1)

    (from_node, from_point), (to_node, to_point) = crossing(start), crossing(end)
    return from_node, to_node, from_point, to_point


def walks(start: list, end: list) -> list[tuple[list[int], bool]]:
    """The numbers of links in order, a list for each chain, and whether it is closed."""
    at = {s: i for i, s in enumerate(start)}
    after = [at.get(e, -1) for e in end]
    entered = set(after)
    seen, out = [False] * len(start), []
    for i in [*(i for i in range(len(start)) if i not in entered), *range(len(start))]:
        chain = []
        while i >= 0 and not seen[i]:
            seen[i] = True
            chain.append(i)
            i = after[i]
        if chain:
            out.append((chain, i == chain[0]))
    return out


def _arcs(f: pd.DataFrame, side: int, step: float) -> pd.DataFrame:
    bx, by = int(f["bx"].iloc[0]) * side, int(f["by"].iloc[0]) * side
    grid = np.full((side + 1, side + 1), np.nan)
    grid[f["gy"].to_numpy() - by, f["gx"].to_numpy() - bx] = f["elev"].to_numpy(float)
    a, b, p, q = segments(grid, step, (bx, by))
    names = [[tuple(n) for n in nodes.tolist()] for nodes in (a, b)]
    rows = []
    for chain, closed in walks(*names):
        nodes = [names[0][i] for i in chain]
        low_at = min(range(len(chain)), key=nodes.__getitem__)
        if closed:  # starts at its smallest crossing, whatever the block
            chain, low_at = chain[low_at:] + chain[:low_at], 0
        points = np.concatenate([p[chain], q[chain[-1:]]])
        first, last, low = names[0][chain[0]], names[1][chain[-1]], min(nodes)
        rows.append((first, last, closed, low, low_at, len(chain), points[:, 0], points[:, 1]))
    keys = ["k", "side", "gx", "gy"]
    out = pd.DataFrame(rows, columns=["first", "last", "closed", "low", "low_at", "n", "xs", "ys"])
    return out.assign(**{c: pd.Series([dict(zip(keys, v)) for v in out[c]], dtype=object) for c in ("first", "last", "low")})


def in_blocks(pixels: DataFrame, side: int) -> DataFrame:
    """The pixels with the block ``(bx, by)`` they are in; a block's first row and column also end the blocks before it."""
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    own = lambda c: F.when(F.col(c) % side == 0, F.array(at(c) - 1, at(c))).otherwise(F.array(at(c)))
    return pixels.withColumn("bx", F.explode(own("gx"))).withColumn("by", F.explode(own("gy")))


def contour_pieces(pixels: DataFrame, step: float, block: int = 64) -> DataFrame:
    """``(level, line, closed, length, start, n, xs, ys)``: contour lines of ``pixels (gx, gy, elev)`` in pieces, one a block it crosses.

    ``line`` is the crossing that the line starts from (of a closed line the smallest) and ``length`` its segments. A
    piece has ``n + 1`` points in grid units, of which the first is vertex ``start`` of the line; the higher ground is to the
    right of the way they go, with y downwards. Levels are the multiples of ``step``; a pixel at a level counts as above.
    Pixels without a finite value and missing ones interrupt lines, repeated ones must agree. A task holds
    a block of ``block`` pixels a side; lines, of any length, are linked by the pieces' ends alone.
    """
    rows = in_blocks(pixels.select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.col("elev").cast("double").alias("elev")), block)
    arcs = written(rows.groupBy("bx", "by").applyInPandas(lambda f: _arcs(f, block, step), _ARC))
    open_ = arcs.where("NOT closed")
    behind = open_.select(F.col("first").alias("prev"), F.col("last").alias("id"), F.col("n").alias("step"))
    links = open_.select(F.col("first").alias("id")).join(behind, "id", "left")
    placed = open_.join(ranked(links).withColumnRenamed("id", "first").withColumnRenamed("closed", "circle"), "first")
    # A circle starts at its smallest crossing, which may be inside a piece.
    whole = placed.groupBy("chain").agg(F.sum("n").alias("length"), F.min(F.struct("low", (F.col("before") + F.col("low_at")).alias("at"))).alias("smallest"))
    joined = placed.join(whole, "chain")
    start = F.when(F.col("circle"), F.pmod(F.col("before") - F.col("smallest.at"), F.col("length"))).otherwise(F.col("before"))
    line = F.when(F.col("circle"), F.col("smallest.low")).otherwise(F.col("chain"))
    across = joined.select(line.alias("line"), F.col("circle").alias("closed"), "length", start.alias("start"), "n", "xs", "ys")
    inside = arcs.where("closed").select(F.col("first").alias("line"), "closed", F.col("n").alias("length"), F.lit(0).cast("long").alias("start"), "n", "xs", "ys")
    return inside.unionByName(across).select((F.col("line.k") * F.lit(float(step))).alias("level"), "line", "closed", "length", "start", "n", "xs", "ys")


def contour_segments(pieces: DataFrame) -> DataFrame:
    """``(level, x1, y1, x2, y2)`` of every segment."""
    each = pieces.select("level", "xs", "ys", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    at = lambda c, i: F.element_at(c, i)
    return each.select("level", at("xs", F.col("i")).alias("x1"), at("ys", F.col("i")).alias("y1"), at("xs", F.col("i") + 1).alias("x2"), at("ys", F.col("i") + 1).alias("y2"))


def contour_vertices(pieces: DataFrame) -> DataFrame:
    """``(level, line, closed, length, seq, x, y)``: every vertex of every line once; a closed line's end is its vertex 0 again."""
    each = pieces.select("level", "line", "closed", "length", "start", "n", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"))
    own = (F.col("i") < F.col("n")) | (~F.col("closed") & (F.col("start") + F.col("n") == F.col("length")))
    seq = F.when(F.col("closed"), (F.col("start") + F.col("i")) % F.col("length")).otherwise(F.col("start") + F.col("i"))
    return each.where(own).select("level", "line", "closed", "length", seq.alias("seq"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


def lines_in_parts(vertices: DataFrame, most: int = 10_000) -> DataFrame:
    """``(level, line, closed, part, points)``: lines as arrays of points (at, x, y), those of over ``most`` segments in several parts.

    A part ends with the point that the next one starts from; a closed line ends with its first.
    """
    ends = F.when(F.col("closed") & (F.col("seq") == 0), F.array(F.col("seq"), F.col("length"))).otherwise(F.array("seq"))
    each = vertices.withColumn("at", F.explode(ends))
    part = lambda c: F.floor(c / most).cast("long")
    parts = F.array(F.greatest(part(F.col("at") - 1), F.lit(0)), F.least(part(F.col("at")), part(F.col("length") - 1)))
    dealt = each.withColumn("part", F.explode(F.array_distinct(parts)))
    return dealt.groupBy("level", "line", "closed", "part").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("points"))
