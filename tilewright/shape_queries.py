"""Queries of lines and polygons made out of grids, masks and shapes, with the SQL that says what each must return."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import elevation as E
from .functions import tiles as G
from .operators import contours, cover, polygons, raster, simplify
from .queries import query
from .views import view

# --- contour lines -----------------------------------------------------------

_STEP = 250

#: Segments of every cell and level, from side to side: out where the ground falls around the cell, in where it rises.
_SEGMENTS = f"""g AS (SELECT gx, gy, CAST(arg_max(elev, priority) AS DOUBLE) AS v FROM fx_pixels GROUP BY 1, 2),
  c AS (SELECT a.gx, a.gy, a.v AS va, b.v AS vb, c.v AS vc, d.v AS vd FROM g a JOIN g b ON b.gx = a.gx + 1 AND b.gy = a.gy
    JOIN g c ON c.gx = a.gx + 1 AND c.gy = a.gy + 1 JOIN g d ON d.gx = a.gx AND d.gy = a.gy + 1),
  l AS (SELECT *, unnest(generate_series(CAST(floor(least(va, vb, vc, vd) / {_STEP}) AS BIGINT) + 1, CAST(floor(greatest(va, vb, vc, vd) / {_STEP}) AS BIGINT))) AS k FROM c),
  s AS (SELECT gx, gy, k, (va + vb + vc + vd) / 4 >= k * {_STEP} AS joined, unnest([
    {{'i': 0, 'u': va, 'v': vb, 'side': 0, 'x': gx, 'y': gy}}, {{'i': 1, 'u': vb, 'v': vc, 'side': 1, 'x': gx + 1, 'y': gy}},
    {{'i': 2, 'u': vc, 'v': vd, 'side': 0, 'x': gx, 'y': gy + 1}}, {{'i': 3, 'u': vd, 'v': va, 'side': 1, 'x': gx, 'y': gy}}]) AS e FROM l),
  p AS (SELECT gx, gy, k, joined, e.i AS i, e.u >= k * {_STEP} AS leaves, concat_ws(':', k, e.side, e.x, e.y) AS node,
    CASE WHEN e.i < 2 THEN (k * {_STEP} - e.u) / (e.v - e.u) ELSE (k * {_STEP} - e.v) / (e.u - e.v) END AS t, e.side AS side, e.x AS x, e.y AS y
    FROM s WHERE (e.u >= k * {_STEP}) <> (e.v >= k * {_STEP})),
  n AS (SELECT *, count(*) OVER (PARTITION BY gx, gy, k) AS crossings, CASE WHEN side = 0 THEN x + t ELSE x END AS px, CASE WHEN side = 1 THEN y + t ELSE y END AS py FROM p),
  segment AS (SELECT a.k, a.node AS start_node, b.node AS end_node, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM n a JOIN n b USING (gx, gy, k)
    WHERE a.leaves AND NOT b.leaves AND (a.crossings = 2 OR b.i = (a.i + CASE WHEN a.joined THEN 1 ELSE 3 END) % 4))"""


def _pieces(spark, d, block: int = 16):
    return contours.contour_pieces(raster.highest_priority(view(spark, d, "fx_pixels")), _STEP, block)


@query(
    "T22_contour_segments",
    f"WITH {_SEGMENTS} SELECT CAST(k * {_STEP} AS DOUBLE) AS level, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM segment",
)
def _(spark, d):
    return contours.contour_segments(_pieces(spark, d))


def _closed_lines(rounds: int = 14) -> str:
    """Crossings that are left after jumping along 2 to the power of ``rounds`` segments are in circles; each has one lowest."""
    steps = ["j0 AS MATERIALIZED (SELECT start_node AS node, end_node AS jump, start_node AS low, k FROM segment)"]
    for r in range(rounds):
        steps.append(f"j{r + 1} AS MATERIALIZED (SELECT a.node, b.jump, least(a.low, b.low) AS low, a.k FROM j{r} a JOIN j{r} b ON a.jump = b.node)")
    return ", ".join(steps) + f", circles AS (SELECT k, count(DISTINCT low) AS n FROM j{rounds} GROUP BY k)"


@query(
    "T22_contour_lines",
    f"""WITH {_SEGMENTS}, {_closed_lines()}, per AS (SELECT k, count(*) AS segments, count(*) FILTER (start_node NOT IN (SELECT end_node FROM segment)) AS open_lines FROM segment GROUP BY k)
SELECT CAST(k * {_STEP} AS DOUBLE) AS level, CAST(CASE WHEN k * {_STEP} % 1000 = 0 THEN 1000 WHEN k * {_STEP} % 500 = 0 THEN 500 ELSE 250 END AS INTEGER) AS band, open_lines, coalesce(n, 0) AS closed_lines, segments
FROM per LEFT JOIN circles USING (k)""",
)
def _(spark, d):
    """Lines by level, put together across blocks, with the band a map draws them in."""
    lines = _pieces(spark, d).groupBy("level", "line", "closed").agg(F.sum("n").alias("n"))
    counted = lines.groupBy("level").agg(F.count_if(~F.col("closed")).alias("open_lines"), F.count_if("closed").alias("closed_lines"), F.sum("n").alias("segments"))
    return counted.select("level", E.contour_band(F.col("level")).cast("int").alias("band"), "open_lines", "closed_lines", "segments")


# --- polygons of masks -------------------------------------------------------

_CELLS = "c AS (SELECT DISTINCT tile_column AS x, tile_row AS y FROM fx_archive WHERE zoom_level = 6)"


@query(
    "Q10_mask_polygons",
    f"""WITH RECURSIVE {_CELLS},
  e AS (SELECT a.y * 64 + a.x AS id, b.y * 64 + b.x AS other FROM c a, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy), c b WHERE b.x = a.x + dx AND b.y = a.y + dy),
  f(low, id) AS (SELECT y * 64 + x, y * 64 + x FROM c UNION SELECT f.low, e.other FROM f JOIN e USING (id) WHERE e.other > f.low),
  o AS (SELECT id % 64 AS x, id // 64 AS y, min(low) AS own FROM f GROUP BY id),
  v AS (SELECT DISTINCT x + dx AS vx, y + dy AS vy FROM c, range(2) a(dx), range(2) b(dy)),
  q AS (SELECT vx, vy, array_agg(own) AS owners, count(*) AS n, bool_or(x = vx AND y = vy) AND bool_or(x = vx - 1 AND y = vy - 1) OR bool_or(x = vx - 1 AND y = vy) AND bool_or(x = vx AND y = vy - 1) AS across
    FROM v JOIN o ON x IN (vx, vx - 1) AND y IN (vy, vy - 1) GROUP BY vx, vy),
  corner AS (SELECT unnest(owners) AS own FROM q WHERE n = 1 OR (n = 2 AND across) UNION ALL SELECT owners[1] FROM q WHERE n = 3),
  k AS (SELECT own, count(*) AS corners FROM corner GROUP BY own)
SELECT own % 64 AS x, own // 64 AS y, count(*) AS tiles, CAST(max(corners) AS BIGINT) AS corners FROM o JOIN k USING (own) GROUP BY own""",
)
def _(spark, d):
    """The union's polygons, each by its first tile from the north: what its rings go around, less its holes, and their corners."""
    rings, _ = polygons.mask_polygons(view(spark, d, "fx_archive").where("zoom_level = 6"), 6, 16)
    return rings.groupBy("polygon").agg(F.sum("area").alias("tiles"), F.sum("length").alias("corners")).select("polygon.x", "polygon.y", "tiles", "corners")


# --- union and simplification ------------------------------------------------

#: Of cells c (x, y): the border's sides, and its corners, of which a point where cells only touch has two.
_BORDER = """e AS (SELECT x, y, 0 AS up, x AS x2, y AS y2 FROM c UNION ALL SELECT x, y, 1, x, y FROM c UNION ALL SELECT x, y, 0, x, y + 1 FROM c UNION ALL SELECT x, y, 1, x + 1, y FROM c),
  side AS (SELECT up, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1),
  v AS (SELECT x + dx AS vx, y + dy AS vy, count(*) AS n, bool_or(dx = dy) AND bool_or(dx <> dy) AS beside FROM c, range(2) a(dx), range(2) b(dy) GROUP BY ALL),
  corner AS (SELECT vx, vy FROM v WHERE n IN (1, 3) OR (n = 2 AND NOT beside) UNION ALL SELECT vx, vy FROM v WHERE n = 2 AND NOT beside)"""


def _squares(cells):
    """A ring for each cell (x, y), around to the left."""
    corners = F.array(*[F.struct(F.lit(k).alias("seq"), (F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    return cells.select(F.concat_ws("/", "x", "y").alias("shape"), F.lit(0).alias("ring"), F.explode(corners).alias("c")).select("shape", "ring", "c.seq", "c.x", "c.y")


def _tile_cells(spark, d):
    return view(spark, d, "fx_archive").where("zoom_level = 6").select(F.col("tile_column").alias("x"), F.col("tile_row").alias("y"))


@query(
    "U07_united_tiles",
    f"""WITH {_CELLS}, {_BORDER}, p AS (SELECT (SELECT count(*) FROM c a JOIN c b ON b.y = a.y AND b.x = a.x + 1) + (SELECT count(*) FROM c a JOIN c b ON b.x = a.x AND b.y = a.y + 1) AS pairs, (SELECT count(*) FROM v WHERE n = 4) AS fours)
SELECT CAST((SELECT count(*) FROM c) AS DOUBLE) AS area, (SELECT count(*) FROM side) AS sides, (SELECT count(*) FROM c) - pairs + fours AS outer_less_holes FROM p""",
)
def _(spark, d):
    """Tiles as rings of their own, united; outer rings less holes is what Euler's formula gives for the tiles."""
    rings = simplify.united(_squares(_tile_cells(spark, d)))
    areas = simplify.ring_areas(rings).select(F.sum("area").alias("area"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes"))
    return areas.crossJoin(rings.agg(F.count(F.lit(1)).alias("sides")))


@query("F18_simplified_border", f"WITH {_CELLS}, {_BORDER} SELECT CAST(vx AS DOUBLE) AS x, CAST(vy AS DOUBLE) AS y FROM corner")
def _(spark, d):
    """A threshold just above nothing leaves the corners of a border."""
    return simplify.simplified(simplify.united(_squares(_tile_cells(spark, d))), 1e-9, 1 << 62).select("x", "y")


@query("F18_small_shapes", "SELECT CAST(point_id AS VARCHAR) AS shape FROM fx_points WHERE (point_id % 10) / 2.0 * ((point_id % 7) / 2.0) >= 2.25")
def _(spark, d):
    width, height = F.col("point_id") % 10 / 2.0, F.col("point_id") % 7 / 2.0
    corners = F.array(*[F.struct(F.lit(k).alias("seq"), (F.col("lon") + width * dx).alias("x"), (F.col("lat") + height * dy).alias("y")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    boxes = view(spark, d, "fx_points").select(F.col("point_id").cast("string").alias("shape"), F.lit(0).alias("ring"), F.explode(corners).alias("c"))
    return simplify.without_small(boxes.select("shape", "ring", "c.seq", "c.x", "c.y"), 1.5 - 1e-9).select("shape").distinct()


@query(
    "S31_projected_shape",
    f"""WITH c AS (SELECT DISTINCT CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y FROM fx_points), {_BORDER}
SELECT round(6378137.0 * radians(vx), 3) AS easting, round(6378137.0 * ln(tan(pi() / 4 + radians(vy) / 2)), 3) AS northing FROM corner""",
)
def _(spark, d):
    """Degree squares that hold points, united, projected and simplified by 20 m squared."""
    cells = view(spark, d, "fx_points").select(F.floor("lon").alias("x"), F.floor("lat").alias("y")).distinct()
    easting, northing = G.to_mercator(F.col("x"), F.col("y"))
    shape = simplify.united(_squares(cells)).select("shape", "ring", "seq", easting.alias("x"), northing.alias("y"))
    return simplify.simplified(shape, 400.0, 1 << 62).select(F.round("x", 3).alias("easting"), F.round("y", 3).alias("northing"))


# --- inside and boundary cells ---------------------------------------------------

_HOLED = "b AS (SELECT west, south, east, north, west + 0.8 AS hw, south + 0.8 AS hs, east - 0.8 AS he, north - 0.8 AS hn FROM fx_boxes)"


def _holed_boxes(spark, d):
    """Each box as a ring, with one in it that is a hole."""
    hole = F.explode(F.array(F.lit(0), F.lit(1))).alias("is_hole")
    grown = F.col("is_hole") * 0.8
    corners = F.array(*[F.struct(F.lit(k).alias("seq"), x.alias("lon"), y.alias("lat")) for k, (x, y) in enumerate((x, y) for x, y in ((F.col("west") + grown, F.col("south") + grown), (F.col("east") - grown, F.col("south") + grown), (F.col("east") - grown, F.col("north") - grown), (F.col("west") + grown, F.col("north") - grown)))])
    rows = view(spark, d, "fx_boxes").select("*", hole).select((F.col("box_id") * 2 + F.col("is_hole")).cast("int").alias("ring_id"), "is_hole", F.explode(corners).alias("c"))
    return rows.select("ring_id", "is_hole", "c.seq", "c.lon", "c.lat")


@query(
    "F06_points_by_cells",
    f"""WITH {_HOLED} SELECT point_id FROM fx_points WHERE EXISTS (SELECT 1 FROM b WHERE lon > west AND lon < east AND lat > south AND lat < north) AND NOT EXISTS (SELECT 1 FROM b WHERE lon > hw AND lon < he AND lat > hs AND lat < hn)""",
)
def _(spark, d):
    """Points in any box and in no box's hole."""
    cells = cover.shape_cells(_holed_boxes(spark, d), 9, 8)
    return cover.points_in_cells(view(spark, d, "fx_points"), cells, 9, strict=True).select("point_id")


@query(
    "Q06_tiles_by_cells",
    """WITH t AS (SELECT z AS zoom_level, x, y, x / power(2, z) * 360.0 - 180.0 AS w, (x + 1) / power(2, z) * 360.0 - 180.0 AS e,
  degrees(atan(sinh(pi() * (1.0 - 2.0 * (y + 1) / power(2, z))))) AS s, degrees(atan(sinh(pi() * (1.0 - 2.0 * y / power(2, z))))) AS n
  FROM (SELECT cast(z AS int) AS z, x, y FROM range(9) a(z), range(256) b(x), range(256) c(y) WHERE x < power(2, z) AND y < power(2, z)))
SELECT DISTINCT zoom_level, x AS tile_column, y AS tile_row FROM t, fx_boxes b WHERE t.w <= b.east AND t.e >= b.west AND t.s <= b.north AND t.n >= b.south""",
)
def _(spark, d):
    """Tiles that have a point of any box; below a tile that is inside none is asked."""
    return cover.shape_tiles(_holed_boxes(spark, d).where("is_hole = 0"), 8)
