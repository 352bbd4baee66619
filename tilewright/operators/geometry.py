"""Points, boxes and polygons: ray casting, touching, and cell-keyed joins instead of theta joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Doubled areas, in square degrees, that count as none.
EPSILON = 1e-12


def edges(ring_vertices: DataFrame, closed: bool) -> DataFrame:
    """(ring_id, is_hole, x1, y1, x2, y2) of ``ring_vertices (ring_id, is_hole, seq, lon, lat)``; ``closed`` adds last to first."""
    order = Window.partitionBy("ring_id").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.lead(c).over(order) for c in ("lon", "lat")]
    if closed:
        after = [F.coalesce(a, F.first(c).over(whole)) for a, c in zip(after, ("lon", "lat"))]
    out = ring_vertices.select("ring_id", "is_hole", F.col("lon").alias("x1"), F.col("lat").alias("y1"), after[0].alias("x2"), after[1].alias("y2"))
    return out.where("x2 IS NOT NULL")


def crosses_ray(edge: Column, lon: Column, lat: Column) -> Column:
    """Whether a ray to the east of the point crosses the edge."""
    spans = (edge["y1"] > lat) != (edge["y2"] > lat)
    at = (edge["x2"] - edge["x1"]) * (lat - edge["y1"]) / F.nullif(edge["y2"] - edge["y1"], F.lit(0.0)) + edge["x1"]
    return F.coalesce(spans & (lon < at), F.lit(False))


def on_edge(edge: Column, lon: Column, lat: Column) -> Column:
    """Whether the point lies on the edge, its ends included."""
    between = lambda at, a, b: (at >= F.least(edge[a], edge[b])) & (at <= F.greatest(edge[a], edge[b]))
    in_line = (edge["x2"] - edge["x1"]) * (lat - edge["y1"]) == (edge["y2"] - edge["y1"]) * (lon - edge["x1"])
    return in_line & between(lon, "x1", "x2") & between(lat, "y1", "y2")


def inside(edge_array: Column, lon: Column, lat: Column, strict: bool = False) -> Column:
    """Even-odd over all rings: inside any outer ring and no hole, for rings that do not overlap otherwise.

    A ray leaves a point on a ring's western and southern edges inside and one on the others outside; with ``strict`` it
    is in no ring that it lies on, be it an outer ring or a hole.
    """
    hits = lambda hole: F.filter(edge_array, lambda e: (e["is_hole"] == hole) & crosses_ray(e, lon, lat))
    off = lambda r: ~F.exists(edge_array, lambda e: (e["ring_id"] == r) & on_edge(e, lon, lat)) if strict else F.lit(True)
    odd = lambda found: F.exists(F.transform(F.array_distinct(F.transform(found, lambda e: e["ring_id"])), lambda r: (F.size(F.filter(found, lambda e: e["ring_id"] == r)) % 2 == 1) & off(r)), lambda b: b)
    return odd(hits(0)) & ~odd(hits(1))


def edges_by_band(ring_vertices: DataFrame, degrees: float, closed: bool = True) -> DataFrame:
    """``(band, edges)``: the edges that reach into each band of latitude, as an array; what a shape has in one band."""
    band = lambda c: F.floor(c / degrees).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges(ring_vertices, closed).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    return rows.groupBy("band").agg(F.collect_list(F.struct("ring_id", "is_hole", "x1", "y1", "x2", "y2")).alias("edges"))


def points_in_shape(points: DataFrame, ring_vertices: DataFrame, degrees: float = 1.0, closed: bool = True, strict: bool = False) -> DataFrame:
    """The points inside the shape: an equi-join on bands of latitude, since a ray to the east stays in its band.

    ``strict`` leaves out points on an outer edge and takes those on a hole's, see :func:`inside`.
    """
    keyed = points.withColumn("band", F.floor(F.col("lat") / degrees).cast("long"))
    return keyed.join(edges_by_band(ring_vertices, degrees, closed), "band").where(inside(F.col("edges"), F.col("lon"), F.col("lat"), strict)).drop("band", "edges")


def boxes_overlap_open(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (west, south, east, north) that share area; touching is not enough."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def boxes_overlap_closed(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return ~((a[2] < b[0]) | (a[0] > b[2]) | (a[3] < b[1]) | (a[1] > b[3]))


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    v = (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return F.when(F.abs(v) < EPSILON, 0).otherwise(F.signum(v))


def segments_cross(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column], s: tuple[Column, Column]) -> Column:
    """Whether the segments pq and rs meet, by orientation signs.

    Three points count as in line from a doubled area under ``EPSILON``, and touching counts, of segments
    in line too: a box that only shares a stretch of its border with an edge touches the shape.
    """
    d1, d2, d3, d4 = _side(*p, *q, *r), _side(*p, *q, *s), _side(*r, *s, *p), _side(*r, *s, *q)
    between = lambda a, b, c: (c[0] >= F.least(a[0], b[0])) & (c[0] <= F.greatest(a[0], b[0])) & (c[1] >= F.least(a[1], b[1])) & (c[1] <= F.greatest(a[1], b[1]))
    proper = (d1 != d2) & (d3 != d4)
    return proper | ((d1 == 0) & between(p, q, r)) | ((d2 == 0) & between(p, q, s)) | ((d3 == 0) & between(r, s, p)) | ((d4 == 0) & between(r, s, q))


def _box_cut(edge: dict[str, Column], box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether an edge has a vertex in the box or crosses its border."""
    w, s, e, n = box
    corners = [(w, s), (e, s), (e, n), (w, n)]
    out = (edge["x1"] >= w) & (edge["x1"] <= e) & (edge["y1"] >= s) & (edge["y1"] <= n)
    for a, b in zip(corners, corners[1:] + corners[:1]):
        out = out | segments_cross((edge["x1"], edge["y1"]), (edge["x2"], edge["y2"]), a, b)
    return out


def grown(box: tuple[Column, ...], by: Column) -> tuple[Column, ...]:
    """A box grown by a number of its own widths and heights (a buffer counted in tiles)."""
    w, s, e, n = box
    return w - (e - w) * by, s - (n - s) * by, e + (e - w) * by, n + (n - s) * by


def boxes_touching_shape(boxes: DataFrame, ring_vertices: DataFrame, buffer: float = 0.0, degrees: float = 4.0) -> DataFrame:
    """The rows of ``boxes (west, south, east, north)`` that touch the shape grown by ``buffer`` boxes.

    A box touches if a corner or its centre is inside, or an outer edge has a vertex in it or crosses it.
    Probes meet the shape by bands of latitude, boxes and edges by the grid cells both touch. Edges are those
    between vertices that follow each other; a ring is not closed for this. Two known limits: hole edges do
    not count, and a box whose probes all lie in holes is missed where it reaches between them.
    """
    sides = ("west", "south", "east", "north")
    w, s, e, n = grown(tuple(F.col(c) for c in sides), F.lit(buffer))
    probes = [(w, s), (e, s), (e, n), (w, n), ((w + e) / 2, (s + n) / 2)]
    only = boxes.select(*sides).distinct()
    asked = only.withColumn("p", F.explode(F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in probes]))).select(*sides, F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    hit = points_in_shape(asked, ring_vertices).select(*sides)
    spread = boxes_on_grid(only.select(*[F.col(c).alias(f"own_{c}") for c in sides], w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north")), degrees)
    outer = edges(ring_vertices, False).where("is_hole = 0")
    cells = boxes_on_grid(outer.select("*", F.least("x1", "x2").alias("west"), F.least("y1", "y2").alias("south"), F.greatest("x1", "x2").alias("east"), F.greatest("y1", "y2").alias("north")), degrees)
    both = spread.join(cells.select("cell_x", "cell_y", "x1", "y1", "x2", "y2"), ["cell_x", "cell_y"])
    cut = both.where(_box_cut({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, tuple(F.col(c) for c in sides)))
    found = hit.unionByName(cut.select(*[F.col(f"own_{c}").alias(c) for c in sides])).distinct()
    return boxes.join(found, list(sides), "left_semi")


def boxes_on_grid(boxes: DataFrame, degrees: float) -> DataFrame:
    """One row for each grid cell a box touches (cell_x, cell_y): the key for an equi-join with other boxes or points."""
    cell = lambda c: F.floor(F.col(c) / degrees).cast("long")
    return boxes.withColumn("cell_x", F.explode(F.sequence(cell("west"), cell("east")))).withColumn("cell_y", F.explode(F.sequence(cell("south"), cell("north"))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, degrees: float = 4.0) -> DataFrame:
    """Every (point, box) pair with the point in the box, joined on grid cells."""
    cell = lambda c: F.floor(F.col(c) / degrees).cast("long")
    keyed = points.withColumn("cell_x", cell("lon")).withColumn("cell_y", cell("lat"))
    both = keyed.join(boxes_on_grid(boxes, degrees), ["cell_x", "cell_y"]).drop("cell_x", "cell_y")
    return both.where("lon BETWEEN west AND east AND lat BETWEEN south AND north")


def bounding_box(vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    return vertices.groupBy(*(by or [])).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
