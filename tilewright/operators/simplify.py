"""Shapes with fewer vertices: common borders stay common, small ones go, neighbours are united.

Rings are rows ``(shape, ring, seq, x, y)``: ``seq`` counts from 0 without gaps and the last vertex connects to the first.
A border is cut into arcs where more than two sides meet, so that whatever is decided about an arc holds for
the rings on both sides of it; an arc is judged by its points alone, the same from either end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .chains import ranked

#: Positions of a ring that are ranked together.
_RUN = 4096
_KEY = ["shape", "ring"]


def with_next(rings: DataFrame) -> DataFrame:
    """The vertices with ``n``, their ring's number of vertices, and the one that follows, ``nx, ny``: joins, no ring in one task."""
    sized = rings.join(rings.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")), _KEY)
    after = sized.select(*_KEY, F.pmod(F.col("seq") - 1, F.col("n")).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return sized.join(after, [*_KEY, "seq"])


def ring_areas(rings: DataFrame) -> DataFrame:
    """``(shape, ring, area)``: positive for rings that go around their inside to the left, y upwards."""
    return with_next(rings).groupBy(*_KEY).agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def without_small(rings: DataFrame, size: float) -> DataFrame:
    """The rings that cover at least the square of ``size``; smaller holes are filled, smaller shapes go."""
    large = ring_areas(rings).where(F.abs("area") >= size * size).select(*_KEY)
    return rings.join(large, _KEY, "left_semi")


def fixed_vertices(rings: DataFrame, every: int = 4096) -> DataFrame:
    """The vertices with ``fixed``: whether arcs end there.

    They do where a point has more or fewer than two neighbours among all rings, at the first point, by its place, of
    a ring without any such, and at one point in ``every``, chosen by its place, so that no arc is of
    unbounded length. Rings that share a point agree about it.
    """
    sides = with_next(rings)
    ways = sides.select("x", "y", "nx", "ny").unionByName(sides.select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("x").alias("nx"), F.col("y").alias("ny")))
    meeting = ways.distinct().groupBy("x", "y").count().where("count <> 2").select("x", "y", F.lit(True).alias("meets"))
    known = rings.join(meeting, ["x", "y"], "left").withColumn("fixed", F.coalesce("meets", F.lit(False)) | (F.pmod(F.xxhash64("x", "y"), F.lit(every)) == 0)).drop("meets")
    first = known.groupBy(*_KEY).agg(F.max("fixed").alias("any"), F.min(F.struct("x", "y")).alias("low"), F.count(F.lit(1)).alias("n"))
    low = (F.col("x") == F.col("low.x")) & (F.col("y") == F.col("low.y"))
    return known.join(first, _KEY).select(*_KEY, "seq", "x", "y", "n", (F.col("fixed") | (~F.col("any") & low)).alias("fixed"))


def in_arcs(fixed: DataFrame) -> DataFrame:
    """``(shape, ring, arc, at, seq, x, y)``: each arc's vertices in order of ``at``, its two ends among them.

    ``arc`` is the position of its first vertex; the arc over a ring's end goes on counting. The last fixed
    vertex before each is found in runs of positions, and over the runs by their last ones.
    """
    run = F.floor(F.col("seq") / _RUN)
    rows = written(fixed.withColumn("run", run))
    lasts = rows.where("fixed").groupBy(*_KEY, "run").agg(F.max("seq").alias("last"))
    runs = rows.select(*_KEY, "run").distinct().join(lasts, [*_KEY, "run"], "left")
    before = Window.partitionBy(*_KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ring = Window.partitionBy(*_KEY)
    # Vertices before the first fixed one are on the arc that starts at the last one.
    start = F.coalesce(F.last("last", ignorenulls=True).over(before), F.max("last").over(ring))
    starts = runs.select(*_KEY, "run", start.alias("start"))
    own = F.when(F.col("fixed"), F.col("seq"))
    upto = Window.partitionBy(*_KEY, "run").orderBy("seq")
    placed = rows.join(starts, [*_KEY, "run"]).withColumns(
        {
            "own": F.coalesce(F.last(own, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("start")),
            "past": F.coalesce(F.last(own, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.col("start")),
        }
    )
    member = lambda arc, ends: F.struct(F.col(arc).alias("arc"), F.when((F.col("seq") < F.col(arc)) | (F.col("seq") == F.col(arc)) & F.lit(ends), F.col("seq") + F.col("n")).otherwise(F.col("seq")).alias("at"))
    arcs = F.when(F.col("fixed"), F.array(member("own", False), member("past", True))).otherwise(F.array(member("own", False)))
    return placed.select(*_KEY, "seq", "x", "y", F.explode(arcs).alias("a")).select(*_KEY, "a.arc", "a.at", "seq", "x", "y")


def doubled_area(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> float:
    """Of a triangle, in one way of summing, so that it does not depend on the points' order."""
    (ax, ay), (bx, by), (cx, cy) = sorted((a, b, c))
    return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))


def _changes(f: pd.DataFrame) -> np.ndarray:
    """Whether a row is the first of its arc, in rows sorted by arc."""
    out = np.ones(len(f), bool)
    out[1:] = np.any([f[c].to_numpy()[1:] != f[c].to_numpy()[:-1] for c in (*_KEY, "arc")], axis=0)
    return out


def eliminate(points: list[tuple[float, float]], area: float, least: int = 0) -> list[bool]:
    """Which points of an arc stay: the smallest triangle of a point and its two neighbours goes first, as long as it is below ``area``.

    A point counts as no smaller than one that went before it. The ends stay, and ``least`` points between them; of
    equal triangles the one whose point comes first by its place goes first.
    """
    n = len(points)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    size = [0.0] * n
    stays = [True] * n
    heap = []

    def judge(i: int, floor: float) -> None:
        size[i] = max(doubled_area(points[before[i]], points[i], points[after[i]]), floor)
        heapq.heappush(heap, (size[i], points[i], i))

    for i in range(1, n - 1):
        judge(i, 0.0)
    left = n - 2
    while heap and left > least:
        s, _, i = heapq.heappop(heap)
        if not stays[i] or s != size[i]:
            continue
        if s >= 2 * area:
            break
        stays[i] = False
        left -= 1
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for j in (p, q):
            if 0 < j < n - 1:
                judge(j, s)
    return stays


def simplified(rings: DataFrame, area: float, every: int = 4096) -> DataFrame:
    """The rings without the vertices that span less than ``area`` with their neighbours, smallest first, arc by arc.

    ``seq`` stays as it was. Rings that are left with less than three vertices have no inside any more and go; what
    they lay between meets along the line they shrank to. An arc from a point to itself keeps two points between.
    Repeated points in a row, which span nothing, are best removed before; an empty table gives an empty one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rings.schema.fields}
    schema = f"shape {kinds['shape']}, ring {kinds['ring']}, seq long, x double, y double"

    def thin(f: pd.DataFrame) -> pd.DataFrame:
        points = list(zip(f["x"].tolist(), f["y"].tolist()))
        first = np.flatnonzero(_changes(f)).tolist()
        stays: list[bool] = []
        for lo, hi in zip(first, [*first[1:], len(f)]):
            arc = points[lo:hi]
            stays += eliminate(arc, area, 2 if arc[0] == arc[-1] else 0)
            stays[-1] = False  # the next arc's first
        return f.loc[np.array(stays, bool), ["shape", "ring", "seq", "x", "y"]]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            last = int(np.flatnonzero(_changes(f))[-1]) if len(f) else 0
            held = f.iloc[last:]
            yield thin(f.iloc[:last])
        if held is not None:
            yield thin(held)

    rows = rings.select(*_KEY, F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    arcs = in_arcs(fixed_vertices(rows, every)).repartition(*_KEY, "arc").sortWithinPartitions(*_KEY, "arc", "at")
    kept = written(arcs.mapInPandas(each, schema))
    whole = kept.groupBy(*_KEY).count().where("count > 2").select(*_KEY)
    return kept.join(whole, _KEY, "left_semi")


def renumbered(rings: DataFrame) -> DataFrame:
    """The vertices with ``seq`` counted from 0 without gaps again, in runs of positions and over the runs."""
    runs = rings.withColumn("run", F.floor(F.col("seq") / _RUN))
    before = Window.partitionBy(*_KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = runs.groupBy(*_KEY, "run").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy(*_KEY, "run").orderBy("seq")) - 1
    return runs.withColumn("own", own).join(counts, [*_KEY, "run"]).withColumn("seq", F.col("first") + F.col("own")).drop("run", "own", "first")


def united(rings: DataFrame) -> DataFrame:
    """Rings ``(shape, ring, seq, x, y)`` of the union of shapes that meet along common sides; ``shape`` is empty.

    Outer rings go around to the left and holes to the right, as GeoJSON has them. A side that another ring has the other
    way round is inside and goes. Where several borders meet in a point, a ring takes the first side clockwise
    from the one it came by, so rings that only touch there stay apart. ``ring`` is its smallest side. Shapes that
    overlap, or whose common borders have different vertices, have to be cut to each other before.
    """
    sides = with_next(rings.select(*_KEY, "seq", "x", "y")).where("x <> nx OR y <> ny").select("x", "y", "nx", "ny").distinct()
    other = sides.select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    border = written(sides.join(other, ["x", "y", "nx", "ny"], "left_anti"))

    angle = lambda dx, dy: F.atan2(dy, dx)
    leaving = border.groupBy("x", "y").agg(F.collect_list(F.struct(angle(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).alias("angle"), "nx", "ny")).alias("out"))
    came = border.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("nx").alias("x"), F.col("ny").alias("y"))
    back = angle(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    turned = came.join(leaving, ["x", "y"]).withColumn("back", back)
    # The sides out of a point are few, and pairs of neighbours in the round: the next below the angle, else the highest.
    way = F.coalesce(F.array_max(F.filter("out", lambda o: o["angle"] < F.col("back"))), F.array_max("out"))
    node = lambda *c: F.struct(*[F.col(n).alias(m) for n, m in zip(c, ("x", "y", "nx", "ny"))])
    links = turned.withColumn("way", way).select(F.struct("x", "y", F.col("way.nx").alias("nx"), F.col("way.ny").alias("ny")).alias("id"), node("px", "py", "x", "y").alias("prev"), F.lit(1).alias("step"))
    order = ranked(links)
    return order.select(F.lit("").alias("shape"), F.col("chain").alias("ring"), F.col("before").alias("seq"), "id.x", "id.y")
