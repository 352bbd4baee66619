"""Shapes as quadtree cells: inside ones answer without an edge, boundary ones hold only their own edges.

A cell that edges run through is split as long as they are more than a few. Which rings its reference point is in
follows from the cell it was split from: the way between the two points, along x and then along y, stays in
that cell, so only its edges can be crossed. Cells without edges are all inside or all outside and are never split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as G
from ..session import written
from . import geometry

#: The reference point's place in a cell: no share of it that coordinates are likely to have.
_REF = (0.41421356237309515, 0.5772156649015329)
_CELL = ["zoom_level", "tile_column", "tile_row"]
_EDGE = ["ring_id", "is_hole", "x1", "y1", "x2", "y2"]
Box = tuple[Column, Column, Column, Column]


def tile_box(column: Column, row: Column, zoom: Column) -> Box:
    return G.tile_box(column, row, zoom)


def degree_box(column: Column, row: Column, zoom: Column) -> Box:
    """Cells of the whole globe in degrees, rows from the south."""
    n = F.pow(F.lit(2.0), zoom)
    return column / n * 360.0 - 180.0, row / n * 180.0 - 90.0, (column + 1) / n * 360.0 - 180.0, (row + 1) / n * 180.0 - 90.0


def _reference(box: Box) -> tuple[Column, Column]:
    w, s, e, n = box
    return w + (e - w) * _REF[0], s + (n - s) * _REF[1]


def _on_the_way(edge: Callable[[str], Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """How often an edge is crossed from ``a`` to ``b`` along x, then along y: 0, 1 or 2."""

    def between(at: Column, lo: Column, hi: Column) -> Column:
        return (at > F.least(lo, hi)) & (at <= F.greatest(lo, hi))

    x1, y1, x2, y2 = (edge(c) for c in ("x1", "y1", "x2", "y2"))
    at_x = (x2 - x1) * (a[1] - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    at_y = (y2 - y1) * (b[0] - x1) / F.nullif(x2 - x1, F.lit(0.0)) + y1
    along_x = ((y1 > a[1]) != (y2 > a[1])) & between(at_x, a[0], b[0])
    along_y = ((x1 > b[0]) != (x2 > b[0])) & between(at_y, a[1], b[1])
    return F.coalesce(along_x, F.lit(False)).cast("int") + F.coalesce(along_y, F.lit(False)).cast("int")


def _meets(box: Box) -> Column:
    """Whether an edge and a box have a point in common."""
    w, s, e, n = box
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    near = (F.least(x1, x2) <= e) & (F.greatest(x1, x2) >= w) & (F.least(y1, y2) <= n) & (F.greatest(y1, y2) >= s)
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (w, e) for y in (s, n)]
    return near & (F.least(*sides) <= geometry.EPSILON) & (F.greatest(*sides) >= -geometry.EPSILON)


def _swapped(within: Column, odd: Column) -> Column:
    return F.concat(F.array_except(within, odd), F.array_except(odd, within))


def _is_inside(within: Column) -> Column:
    """In an outer ring and in no hole."""
    return F.exists(within, lambda r: r["is_hole"] == 0) & ~F.exists(within, lambda r: r["is_hole"] == 1)


def shape_cells(ring_vertices: DataFrame, max_zoom: int, most: int = 32, step: int = 2, box: Callable[..., Box] = degree_box) -> tuple[DataFrame, DataFrame]:
    """Inside cells ``(zoom_level, tile_column, tile_row)`` and boundary cells, with ``within`` and ``edges``, of a shape.

    ``ring_vertices (ring_id, is_hole, seq, lon, lat)`` are closed; a place is inside if it is in an outer ring and in no
    hole. ``within`` are the rings around the cell's reference point, ``edges`` those that meet the cell: ``most`` of them at
    most, but for cells of ``max_zoom``. ``step`` zooms are gone down at a time. No two cells overlap.
    """
    ring = F.struct("ring_id", "is_hole")
    none = F.array().cast("array<struct<ring_id: int, is_hole: int>>")
    edges = written(geometry.edges(ring_vertices, True).select(F.col("ring_id").cast("int").alias("ring_id"), F.col("is_hole").cast("int").alias("is_hole"), *[F.col(c).cast("double").alias(c) for c in _EDGE[2:]]))
    root = [F.lit(0).alias("zoom_level"), F.lit(0).cast("long").alias("tile_column"), F.lit(0).cast("long").alias("tile_row")]
    whole = box(F.lit(0), F.lit(0), F.lit(0))
    crossed = edges.where(geometry.crosses_ray({c: F.col(c) for c in _EDGE}, *_reference(whole))).groupBy("ring_id", "is_hole").count().where("count % 2 = 1")
    cells = crossed.agg(F.collect_list(ring).alias("within")).select(*root, F.coalesce("within", none).alias("within"))
    pairs = edges.where(_meets(whole)).select(*root, *_EDGE)
    inside = boundary = None
    zoom = 0
    while True:
        held = pairs.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"))
        known = written(cells.join(held, _CELL, "left"))
        free = known.where(F.col("n").isNull() & _is_inside(F.col("within"))).select(*_CELL)
        busy = known.where(F.col("n") > (most if zoom < max_zoom else 1 << 62))
        done = known.where(F.col("n") <= (most if zoom < max_zoom else 1 << 62))
        lists = pairs.groupBy(*_CELL).agg(F.collect_list(F.struct(*_EDGE)).alias("edges"))
        found = written(done.select(*_CELL, "within").join(lists, _CELL))
        inside = free if inside is None else inside.unionByName(free)
        boundary = found if boundary is None else boundary.unionByName(found)
        if busy.isEmpty():
            return inside, boundary
        down = min(step, max_zoom - zoom)
        many = F.sequence(F.lit(0).cast("long"), F.lit((1 << down) - 1).cast("long"))

        def children(rows: DataFrame) -> DataFrame:
            split = rows.withColumn("dx", F.explode(many)).withColumn("dy", F.explode(many))
            return split.withColumns({"z": F.col("zoom_level") + down, "x": F.col("tile_column") * (1 << down) + F.col("dx"), "y": F.col("tile_row") * (1 << down) + F.col("dy")})

        child, parent = box(F.col("x"), F.col("y"), F.col("z")), box(F.col("tile_column"), F.col("tile_row"), F.col("zoom_level"))
        split = children(pairs.join(busy.select(*_CELL), _CELL, "left_semi"))
        met = written(
            split.select("z", "x", "y", *_EDGE, _meets(child).alias("meets"), _on_the_way(F.col, _reference(parent), _reference(child)).alias("crossed")).where("meets OR crossed = 1")
        )
        odd = met.where("crossed = 1").groupBy("z", "x", "y", "ring_id", "is_hole").count().where("count % 2 = 1").groupBy("z", "x", "y").agg(F.collect_list(ring).alias("odd"))
        rename = [F.col("z").alias("zoom_level"), F.col("x").alias("tile_column"), F.col("y").alias("tile_row")]
        cells = children(busy).join(odd, ["z", "x", "y"], "left").select(*rename, _swapped(F.col("within"), F.coalesce("odd", none)).alias("within"))
        pairs = met.where("meets").select(*rename, *_EDGE)
        zoom += down


def points_in_cells(points: DataFrame, cells: tuple[DataFrame, DataFrame], deepest: int, step: int = 2, strict: bool = False) -> DataFrame:
    """The rows of ``points (lon, lat, ...)`` inside the shape that ``cells`` of :func:`shape_cells` cover, in degrees.

    A point asks for the cells above it at the zooms there are, an equi-join; an inside cell answers, a boundary cell by its
    own edges, of which there are few. ``deepest`` and ``step`` are those the cells were made with. With ``strict`` a point
    is in no ring that it lies on, be it an outer ring or a hole.
    """
    inside, boundary = cells
    zooms = sorted({*range(0, deepest, step), deepest})
    place = lambda c, size, n: F.least(F.floor(c / size * n), n - 1).cast("long")
    n = F.pow(F.lit(2.0), F.col("_z"))
    asked = points.withColumn("_z", F.explode(F.array(*map(F.lit, zooms)))).withColumns({"_x": place(F.col("lon") + 180.0, 360.0, n), "_y": place(F.col("lat") + 90.0, 180.0, n)})
    named = [F.col(c).alias(a) for c, a in zip(_CELL, ("_z", "_x", "_y"))]
    sure = asked.join(inside.select(*named), ["_z", "_x", "_y"], "left_semi")
    a, p = _reference(degree_box(F.col("_x"), F.col("_y"), F.col("_z"))), (F.col("lon"), F.col("lat"))
    hits = F.transform(F.filter("_edges", lambda e: _on_the_way(lambda c: e[c], a, p) == 1), lambda e: F.struct(e["ring_id"].alias("ring_id"), e["is_hole"].alias("is_hole")))
    odd = F.filter(F.array_distinct("_hits"), lambda r: F.size(F.filter("_hits", lambda h: h == r)) % 2 == 1)
    near = asked.join(boundary.select(*named, F.col("within").alias("_within"), F.col("edges").alias("_edges")), ["_z", "_x", "_y"]).withColumn("_hits", hits)
    within = _swapped(F.col("_within"), odd)
    if strict:
        within = F.filter(within, lambda r: ~F.exists("_edges", lambda e: (e["ring_id"] == r["ring_id"]) & geometry.on_edge(e, *p)))
    tested = near.where(_is_inside(within))
    return sure.unionByName(tested.select(*sure.columns)).drop("_z", "_x", "_y")


def shape_tiles(ring_vertices: DataFrame, max_zoom: int, step: int = 2) -> DataFrame:
    """``(zoom_level, tile_column, tile_row)``: the tiles of every zoom up to ``max_zoom`` that have a point in common with the shape.

    Only tiles that edges run through are split and asked again; below a tile that is inside all are taken.
    """
    inside, boundary = shape_cells(ring_vertices, max_zoom, 0, step, tile_box)
    up = F.explode(F.sequence(F.lit(0), F.col("zoom_level"))).alias("zoom_level")
    above = inside.unionByName(boundary.select(*_CELL)).withColumn("d", F.col("zoom_level")).select(up, "d", "tile_column", "tile_row").select("zoom_level", *[F.call_function("shiftright", F.col(c), F.col("d") - F.col("zoom_level")).alias(c) for c in _CELL[1:]])
    down = inside.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_zoom) - F.col("zoom_level"))).alias("d")).where("d > 0")
    many = F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, d) - 1"))
    below = down.withColumn("dx", F.explode(many)).withColumn("dy", F.explode(many))
    below = below.select((F.col("zoom_level") + F.col("d")).alias("zoom_level"), (F.expr("shiftleft(tile_column, d)") + F.col("dx")).alias("tile_column"), (F.expr("shiftleft(tile_row, d)") + F.col("dy")).alias("tile_row"))
    return above.distinct().unionByName(below)
