"""Queries of sources, sinks, samplers and documents. Files are written to a scratch folder from the driver's tables and read back."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import elevation as E
from .functions import sql as SQL
from .functions import text as X
from .functions import tiles as G
from .operators import archive, blocks, catalog, geometry, masks, options, profile, raster, sampling, tiling
from .plans import steps
from .queries import _EVENT, _KINDED, _builds, _c, _events, query
from .session import load, scratch
from .sources import bounds, formats, grids, mbtiles, rasters, vectors
from .sources import catalog as files
from .streaming import logs, tail
from .views import view

ADDRESS = archive.ADDRESS

# --- tile archives -----------------------------------------------------------------


def _archive(spark: SparkSession, d: str, layout: str = "classic", content: str = "concat('t', tile_column)") -> str:
    mbtiles.register(spark)
    path = f"{scratch(spark)}/own.mbtiles"
    tiles = view(spark, d, "fx_archive").withColumn("tile_data", F.expr(content).cast("binary"))
    tiles.write.format("mbtiles").option("metadata.format", "pbf").option("layout", layout).mode("overwrite").save(path)
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    return mbtiles.pushed(spark, "mbtiles", path)


@query("S01_archive_scan", "SELECT zoom_level, tile_column, tile_row, concat('t', cast(tile_column AS varchar)) AS content FROM fx_archive WHERE zoom_level <= 5")
def _(spark, d):
    return archive.at_zooms(_read(spark, _archive(spark, d)), 5).select(*ADDRESS, F.col("tile_data").cast("string").alias("content"))


@query("S02_archive_metadata", "SELECT 'format' AS name, 'pbf' AS value")
def _(spark, d):
    return spark.read.format("mbtiles").option("table", "metadata").load(_archive(spark, d))


@query("S03_archive_layouts", "SELECT layout, count(*) AS tiles, count(DISTINCT CASE WHEN layout = 'compact' THEN cast(tile_column AS varchar) ELSE concat(zoom_level, '/', tile_column, '/', tile_row) END) AS blobs FROM fx_archive, (VALUES ('classic'), ('compact')) t(layout) GROUP BY 1")
def _(spark, d):
    """Each layout as it is found in an archive, with what the archive keeps."""
    out = None
    for kind in ("classic", "compact"):
        path = _archive(spark, d, kind)
        own = _read(spark, path).agg(F.count(F.lit(1)).alias("tiles"), F.count_distinct("tile_data").alias("contents"))
        found = mbtiles.layout(path)
        one = own.select(F.lit(found).alias("layout"), "tiles", F.col("contents" if found == "compact" else "tiles").alias("blobs"))
        out = one if out is None else out.unionByName(one)
    return out


@query("S04_tile_lookup", "SELECT tile_column AS x, 7 - tile_row AS y, concat('t', cast(tile_column AS varchar)) AS content FROM fx_archive WHERE zoom_level = 3 AND tile_column = 5 AND tile_row = 4")
def _(spark, d):
    found = _read(spark, _archive(spark, d)).where("zoom_level = 3 AND tile_column = 5 AND tile_row = 4")
    return found.select(F.col("tile_column").alias("x"), G.flip_row(F.col("zoom_level"), F.col("tile_row")).alias("y"), F.col("tile_data").cast("string").alias("content"))


@query("S05_graph_tiles_in_order", "SELECT zoom_level AS level, tile_column AS x, tile_row AS y FROM fx_archive WHERE zoom_level <= 2")
def _(spark, d):
    return _read(spark, _archive(spark, d)).where("zoom_level <= 2").select(F.col("zoom_level").alias("level"), F.col("tile_column").alias("x"), F.col("tile_row").alias("y")).orderBy("level", "x", "y")


@query("K01_sharded_archive", "SELECT zoom_level, tile_column // 32 AS mx, tile_row // 32 AS my, count(*) AS tiles, cast(sum(1 + length(cast(tile_column AS varchar))) AS bigint) AS bytes FROM fx_archive GROUP BY 1, 2, 3")
def _(spark, d):
    tiles = view(spark, d, "fx_archive").withColumn("tile_data", F.concat(F.lit("t"), "tile_column").cast("binary"))
    return mbtiles.write_shards(tiles, scratch(spark), 32).drop("path")


@query("K02_compact_archive", "SELECT zoom_level, tile_column, tile_row, concat('t', cast(tile_column % 3 AS varchar)) AS content FROM fx_archive")
def _(spark, d):
    return _read(spark, _archive(spark, d, "compact", "concat('t', tile_column % 3)")).select(*ADDRESS, F.col("tile_data").cast("string").alias("content"))


@query(
    "K04_package_tree",
    """SELECT DISTINCT concat('1/', lpad(cast((y * 360 + x) // 1000 AS varchar), 3, '0'), '/', lpad(cast((y * 360 + x) % 1000 AS varchar), 3, '0'), '.gph') AS path, cast(5 * (x + y) AS bigint) AS bytes
FROM (SELECT a.x, b.y FROM fx_boxes, unnest(generate_series(cast(floor(west + 180.0) AS bigint), cast(floor(east + 180.0) AS bigint))) a(x), unnest(generate_series(cast(floor(south + 90.0) AS bigint), cast(floor(north + 90.0) AS bigint))) b(y))""",
)
def _(spark, d):
    """Graph tiles packed, written as a package, read in order and unpacked to a tree of files."""
    mbtiles.register(spark)
    folder = scratch(spark)
    wanted = view(spark, d, "fx_boxes").select(F.explode(G.graph_cover(*_c("west", "south", "east", "north"), F.lit(1))).alias("c")).select("c.x", "c.y").distinct()
    tiles = wanted.select(F.lit(1).alias("zoom_level"), F.col("x").alias("tile_column"), F.col("y").alias("tile_row"), F.repeat(F.lit("graph"), (F.col("x") + F.col("y")).cast("int")).cast("binary").alias("tile_data"))
    grids.pack_blobs(tiles).select(*ADDRESS, "tile_data").write.format("mbtiles").mode("overwrite").save(f"{folder}/own.vtiles")
    packed = _read(spark, f"{folder}/own.vtiles")
    return grids.write_tree(packed.select(G.graph_path(F.col("tile_column"), F.col("tile_row"), F.col("zoom_level")).alias("path"), "tile_data"), f"{folder}/tree")


@query("K12_recompressed", "SELECT count(*) AS tiles, cast(count(*) * 1000 AS bigint) AS before_bytes, true AS smaller FROM supplier")
def _(spark, d):
    blobs = load(spark, d, "supplier").select(F.repeat(F.substring("s_name", 1, 10), 100).cast("binary").alias("tile_data"))
    _, report = grids.recompress(blobs)
    return report.select("tiles", "before_bytes", (F.col("after_bytes") < F.col("before_bytes")).alias("smaller"))


@query("K05_image_tiles", "SELECT gx // 16 AS tile_column, gy // 16 AS tile_row, gx % 16 AS gx, gy % 16 AS gy, coalesce(elev, 0) AS elev FROM (SELECT a.gx, b.gy FROM range(64) a(gx), range(64) b(gy)) LEFT JOIN (SELECT gx, gy, elev FROM fx_pixels WHERE priority = 1) USING (gx, gy) WHERE (gx // 16, gy // 16) IN (SELECT (gx // 16, gy // 16) FROM fx_pixels WHERE priority = 1)")
def _(spark, d):
    """Tiles rendered as pictures (T18) and decoded again (S36); pixels without a value come back as 0."""
    at = lambda c, n: (F.floor(F.col(c) / 16)).cast("long").alias(n)
    px = view(spark, d, "fx_pixels").where("priority = 1")
    own = px.select(F.lit(5).alias("zoom_level"), at("gx", "tile_column"), at("gy", "tile_row"), (F.col("gx") % 16).alias("px"), (F.col("gy") % 16).alias("py"), "elev")
    return grids.tile_pixels(tiling.render(own, 16, 1.0)).select("tile_column", "tile_row", "gx", "gy", "elev")


@query("K06_tile_grid", "SELECT concat(cast(zoom_level AS varchar), '/', cast(tile_column AS varchar), '/', cast(tile_row AS varchar)) AS label, round(tile_column / power(2, zoom_level) * 360.0 - 180.0, 6) AS west FROM fx_archive ORDER BY zoom_level, tile_column, tile_row LIMIT 200")
def _(spark, d):
    f = F.from_json("feature", "properties struct<label:string>, geometry struct<coordinates:array<array<array<double>>>>")
    return tiling.geojson_grid(view(spark, d, "fx_archive"), 200).select(f.alias("f")).select("f.properties.label", F.round(F.col("f.geometry.coordinates")[0][0][0], 6).alias("west"))


@query("K08_mask_picture", "SELECT DISTINCT tile_column AS px, 31 - tile_row AS py FROM fx_archive WHERE zoom_level = 5")
def _(spark, d):
    return tiling.mask_picture(view(spark, d, "fx_archive"), 5)


@query("K08_world_file", "SELECT DISTINCT zoom_level, round(2 * pi() * 6378137.0 / power(2, zoom_level), 6) AS pixel, round(pi() * 6378137.0 / power(2, zoom_level) - pi() * 6378137.0, 6) AS west FROM fx_archive")
def _(spark, d):
    lines = F.split(tiling.world_file(F.col("zoom_level")), "\n")
    at = lambda i: F.round(F.get(lines, F.lit(i)).cast("double"), 6)
    return view(spark, d, "fx_archive").select("zoom_level").distinct().select("zoom_level", at(0).alias("pixel"), at(4).alias("west"))


@query("K10_tile_json", "SELECT file_name AS name, concat('http://own/', file_name, '/{z}/{x}/{y}') AS url, 14 AS maxzoom FROM fx_files")
def _(spark, d):
    rows = view(spark, d, "fx_files").select(F.col("file_name").alias("name"), F.lit(0).alias("minzoom"), F.lit(14).alias("maxzoom"), F.array(*map(F.lit, (-180.0, -85.0, 180.0, 85.0))).alias("bounds"))
    f = F.from_json("document", "tiles array<string>, maxzoom int")
    return catalog.tile_json(rows, "http://own/").select("name", f.alias("f")).select("name", F.col("f.tiles")[0].alias("url"), "f.maxzoom")


@query("K11_metadata_row", "SELECT name, value FROM fx_meta WHERE build = 'a' UNION ALL SELECT 'k1', 'AAA'")
def _(spark, d):
    return tiling.add_metadata(_builds(spark, d, "fx_meta")[0], "k1", "AAA")


@query("K14_metadata_update", "SELECT name, CASE WHEN name = 'k1' THEN 'x' ELSE value END AS value FROM fx_meta WHERE build = 'a' UNION ALL SELECT 'k1', 'x' WHERE NOT EXISTS (SELECT 1 FROM fx_meta WHERE build = 'a' AND name = 'k1')")
def _(spark, d):
    return tiling.set_metadata(_builds(spark, d, "fx_meta")[0], "k1", "x")


@query("K07_manoeuvre_features", """WITH p AS (SELECT line_id, seq, max(seq) OVER (PARTITION BY line_id) AS last FROM fx_profile)
SELECT line_id, m.k AS manoeuvre, cast(seq AS double) AS lon FROM p JOIN (VALUES (0, 1), (1, 40)) m(k, spot) ON p.seq = least(m.spot, p.last)""")
def _(spark, d):
    points = view(spark, d, "fx_profile").select("line_id", "seq", F.col("seq").cast("double").alias("lon"), F.lit(45.0).alias("lat"))
    asked = points.select("line_id").distinct().withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, at in ((0, 1), (1, 40))]))).select("line_id", F.col("m.k").alias("manoeuvre"), F.col("m.at").alias("spot"))
    made = tiling.geojson_points(profile.manoeuvre_points(asked, points), ["line_id", "manoeuvre"])
    f = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<line_id:bigint,manoeuvre:int>")
    return made.select(f.alias("f")).select("f.properties.line_id", "f.properties.manoeuvre", F.col("f.geometry.coordinates")[0].alias("lon"))


# --- elevation files and rasters ------------------------------------------------------

_GRID = "CASE WHEN (gx + gy) % 7 = 0 THEN NULL ELSE (gx * 7 + gy * 13) % 300 END"


def _grid_values(width: int, height: int, void: float) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    return np.where((x + y) % 7 == 0, void, (x * 7 + y * 13) % 300)


@query("S06_hgt_samples", "WITH p AS (SELECT DISTINCT priority FROM fx_pixels) SELECT concat('N4', p.priority, 'E006') AS name, x AS gx, y AS gy, elev FROM p CROSS JOIN range(64) a(x) CROSS JOIN range(64) b(y) LEFT JOIN fx_pixels f ON f.priority = p.priority AND f.gx = x AND f.gy = y")
def _(spark, d):
    """A degree square of each priority, some in folders of their own, written and read back."""
    name = F.concat(F.lit("N4"), "bx", F.lit("E006"))
    path = F.concat(F.when(F.col("bx") % 2 == 0, F.concat(F.lit("N4"), "bx", F.lit("/"))).otherwise(""), name, F.lit(".hgt"))
    folder = scratch(spark)
    files.write_files(_priorities(spark, d).select(path.alias("path"), grids.hgt_bytes(F.col("data")).alias("data")), folder).count()
    return grids.read_hgt(spark, folder).drop("path")


@query("S06_hgt_format", "WITH p AS (SELECT DISTINCT priority FROM fx_pixels) SELECT 40 + p.priority AS lat_deg, x AS gx, y AS gy, elev FROM p CROSS JOIN range(64) a(x) CROSS JOIN range(20) b(y) LEFT JOIN fx_pixels f ON f.priority = p.priority AND f.gx = x AND f.gy = y WHERE p.priority IN (2, 3, 5) AND x <> 7")
def _(spark, d):
    """Some squares' northern lines: other files are not opened, other lines not read."""
    formats.register(spark)
    folder = scratch(spark)
    path = F.concat(F.lit("N4"), "bx", F.lit("E006.hgt"))
    files.write_files(_priorities(spark, d).select(path.alias("path"), grids.hgt_bytes(F.col("data")).alias("data")), folder).count()
    found = mbtiles.pushed(spark, "hgt", folder).where("lon_deg = 6 AND lat_deg IN (42, 43, 45) AND gy < 20").where("gx <> 7")
    return found.select("lat_deg", "gx", "gy", "elev")


_NAME = """concat(CASE WHEN floor(lat) < 0 THEN 'S' ELSE 'N' END, lpad(cast(cast(abs(floor(lat)) AS bigint) AS varchar), 2, '0'), CASE WHEN floor(lon) < 0 THEN 'W' ELSE 'E' END, lpad(cast(cast(abs(floor(lon)) AS bigint) AS varchar), 3, '0'))"""
_LISTING = f"SELECT DISTINCT concat('/dem/', CASE WHEN point_id % 2 = 0 THEN concat(substr(name, 1, 3), '/') ELSE '' END, name, '.hgt') AS path FROM (SELECT point_id, {_NAME} AS name FROM fx_points) WHERE point_id % 3 <> 0"


def _listing(spark, d):
    p = view(spark, d, "fx_points").where("point_id % 3 <> 0").select("point_id", G.degree_name(F.col("lon"), F.col("lat")).alias("name"))
    return p.select(F.concat(F.lit("/dem/"), F.when(F.col("point_id") % 2 == 0, F.concat(F.substring("name", 1, 3), F.lit("/"))).otherwise(""), "name", F.lit(".hgt")).alias("path")).distinct()


@query(
    "S07_hgt_files",
    f"""WITH l AS ({_LISTING}), w AS (SELECT DISTINCT cast(floor(lon) AS bigint) AS lon, cast(floor(lat) AS bigint) AS lat, {_NAME} AS name FROM fx_points)
SELECT lon, lat, coalesce(a.path, b.path) AS path FROM w LEFT JOIN l a ON a.path = concat('/dem/', substr(name, 1, 3), '/', name, '.hgt') LEFT JOIN l b ON b.path = concat('/dem/', name, '.hgt')""",
)
def _(spark, d):
    wanted = view(spark, d, "fx_points").select(G.floor(F.col("lon")).alias("lon"), G.floor(F.col("lat")).alias("lat"))
    return grids.located_hgt(wanted, _listing(spark, d), "/dem")


@query("S08_hgt_coverage", "SELECT DISTINCT cast(floor(lon) AS int) AS lon, cast(floor(lat) AS int) AS lat FROM fx_points WHERE point_id % 3 <> 0")
def _(spark, d):
    other = spark.createDataFrame([("/dem/readme.txt",), ("/dem/N44E006.tif",), ("/dem/x.hgt",)], "path string")
    return grids.hgt_coverage(_listing(spark, d).unionByName(other))


_LEVEL = {"width": 72, "height": 34, "origin_x": -180.0, "origin_y": 85.0, "scale_x": 5.0, "scale_y": 5.0}


def _priorities(spark: SparkSession, d: str) -> DataFrame:
    """The grid of each priority as a block; ``bx`` is the priority."""
    pixels = view(spark, d, "fx_pixels")
    return blocks.from_pixels(pixels.select((F.col("gx") + 64 * F.col("priority")).alias("gx"), "gy", "elev"), 64)


def _rasters(spark: SparkSession, d: str) -> str:
    """A folder with a raster file of each priority, and a file that is none."""
    folder = scratch(spark)

    @F.pandas_udf("binary")
    def tiff(priority: pd.Series, data: pd.Series) -> pd.Series:
        made = lambda p, v: rasters.write_tiff(np.nan_to_num(np.frombuffer(v).reshape(64, 64), nan=-9999.0), 32, (10.0 * p, 85.0), 5.0, -9999.0)
        return pd.Series([made(p, v) for p, v in zip(priority, data)])

    files.write_files(_priorities(spark, d).select(F.concat("bx", F.lit(".tif")).alias("path"), tiff("bx", "data").alias("data")), folder).count()
    with open(f"{folder}/other.txt", "w") as out:
        out.write("no raster")
    return folder


@query("S09_raster_blocks", "SELECT priority, 0 AS level, cast(x * 32 AS int) AS gx0, cast(y * 32 AS int) AS gy0, 32 AS width, 10.0 * priority AS origin_x, 5.0 AS scale_y, 'deflate' AS codec FROM (SELECT DISTINCT priority FROM fx_pixels), range(2) a(x), range(2) b(y)")
def _(spark, d):
    found = rasters.list_blocks(spark, _rasters(spark, d))
    return found.select(F.regexp_extract("path", "([0-9]+).tif$", 1).cast("int").alias("priority"), "level", "gx0", "gy0", "width", "origin_x", "scale_y", "codec")


@query("S11_raster_pixels", "SELECT priority, gx, gy, cast(elev AS double) AS elev FROM fx_pixels")
def _(spark, d):
    found = rasters.block_pixels(rasters.read_blocks(spark, [f"{_rasters(spark, d)}/*.tif"]))
    return found.select(F.regexp_extract("path", "([0-9]+).tif$", 1).cast("int").alias("priority"), F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), "elev")


@query(
    "S11_raster_format",
    "SELECT priority, cast(gx AS bigint) AS gx, cast(gy AS bigint) AS gy, cast(elev AS double) AS elev FROM fx_pixels WHERE gx BETWEEN 20 AND 40 AND gy >= 30",
)
def _(spark, d):
    """The blocks that a window touches, and of them its pixels."""
    formats.register(spark)
    found = mbtiles.pushed(spark, "raster", _rasters(spark, d)).where("level = 0 AND gx BETWEEN 20 AND 40 AND gy >= 30")
    return found.select(F.regexp_extract("path", "([0-9]+).tif$", 1).cast("int").alias("priority"), "gx", "gy", "elev")


@query(
    "S29_bounds_index",
    "SELECT priority, 10.0 * priority AS west, 85.0 - 320 AS south, 10.0 * priority + 320 AS east, 85.0 AS north, 0 AS opened_again FROM (SELECT DISTINCT priority FROM fx_pixels) WHERE 10.0 * priority < 25 AND 10.0 * priority + 320 > 20",
)
def _(spark, d):
    """Files whose bounds meet a box, from an index that is made and then found to be as the files are."""
    folder, index = _rasters(spark, d), f"{scratch(spark)}/index"
    files_ = bounds.listed(spark, folder)
    bounds.refresh(spark, files_, index, bounds.raster_bounds)
    again = bounds.refresh(spark, files_, index, bounds.raster_bounds).agg(F.count(F.lit(1)).cast("int").alias("opened_again"))
    priority = F.regexp_extract("path", "([0-9]+).tif$", 1).cast("int").alias("priority")
    return bounds.touching(spark, index, (20.0, -10.0, 25.0, 10.0)).select(priority, "west", "south", "east", "north").crossJoin(F.broadcast(again))


def _bilinear(points: str, keys: str, x: str, y: str, value: str) -> str:
    """SQL of a bilinear sample of the grid of formulas at fractional pixels, with borrowed neighbours."""
    at = lambda n, dx, dy: f"(SELECT {value} FROM (SELECT least(cast(floor(px) AS bigint) + {dx}, 71) AS gx, least(cast(floor(py) AS bigint) + {dy}, 33) AS gy)) AS {n}"
    return f"""SELECT {keys}, CASE WHEN px >= 0 AND py >= 0 AND px < 72 AND py < 34 THEN round((v00 * (1 - fx) + coalesce(v10, v00) * fx) * (1 - fy) + (coalesce(v01, v00) * (1 - fx) + coalesce(v11, v10, v00) * fx) * fy, 5) END AS elev
FROM (SELECT *, px - floor(px) AS fx, py - floor(py) AS fy, {at('v00', 0, 0)}, {at('v10', 1, 0)}, {at('v01', 0, 1)}, {at('v11', 1, 1)} FROM (SELECT *, {x} AS px, {y} AS py FROM {points}))"""


def _grid_pixels(spark) -> DataFrame:
    grid = spark.range(72).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(33).cast("long"))).alias("gy"))
    return grid.select("gx", "gy", F.expr(_GRID).cast("double").alias("elev")).where("elev IS NOT NULL")


@query("T07_raster_sample", _bilinear("fx_points", "point_id", "(lon + 180.0) / 5.0 - 0.5", "(85.0 - lat) / 5.0 - 0.5", _GRID))
def _(spark, d):
    points = view(spark, d, "fx_points").select("point_id", F.col("lon").alias("easting"), F.col("lat").alias("northing"))
    return blocks.sample_raster(points, blocks.from_pixels(_grid_pixels(spark), 16), 16, _LEVEL, ["point_id"]).withColumn("elev", F.round("elev", 5))


_CENTRES = """(SELECT zoom_level, tile_column, tile_row, px0 AS px_, py0 AS py_, (tile_column * 4 + px0 + 0.5) / (power(2, zoom_level) * 4) * 360.0 - 180.0 AS lon, degrees(atan(sinh(pi() * (1.0 - 2.0 * (tile_row * 4 + py0 + 0.5) / (power(2, zoom_level) * 4))))) AS lat
FROM (SELECT * FROM fx_archive WHERE zoom_level = 3), range(4) a(px0), range(4) b(py0))"""


@query("T14_warp", "SELECT zoom_level, tile_column, tile_row, px_ AS px, py_ AS py, elev FROM (" + _bilinear(_CENTRES, "zoom_level, tile_column, tile_row, px_, py_", "(lon + 180.0) / 5.0 - 0.5", "(85.0 - lat) / 5.0 - 0.5", _GRID) + ")")
def _(spark, d):
    tiles, size = view(spark, d, "fx_archive").where("zoom_level = 3"), 4
    made = blocks.warp(tiles, size, blocks.from_pixels(_grid_pixels(spark), 16), 16, (72, 34), blocks.affine(_LEVEL))
    found = blocks.tile_pixels(made, size).withColumn("elev", F.round("elev", 5))
    many = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    return made.select(*ADDRESS, many.alias("px")).select("*", many.alias("py")).join(found, [*ADDRESS, "px", "py"], "left")


@query("G20_pixel_round_trip", "SELECT point_id, (lon + 180.0) / 5.0 - 0.5 AS px, (85.0 - lat) / 5.0 - 0.5 AS py, round(lon, 6) AS easting, round(lat, 6) AS northing FROM fx_points")
def _(spark, d):
    origin, scale = (F.lit(-180.0), F.lit(85.0)), (F.lit(5.0), F.lit(5.0))
    px, py = G.pixel_of(F.col("lon"), F.col("lat"), origin, scale)
    x, y = G.project_pixel(F.col("px"), F.col("py"), origin, scale)
    return view(spark, d, "fx_points").withColumns({"px": px, "py": py}).select("point_id", "px", "py", F.round(x, 6).alias("easting"), F.round(y, 6).alias("northing"))


@query("G21_raster_bounds", "SELECT box_id, west, north - 34 * 0.5 AS south, west + 72 * 0.25 AS east, north FROM fx_boxes")
def _(spark, d):
    box = G.raster_bounds(F.lit(72), F.lit(34), (F.col("west"), F.col("north")), (F.lit(0.25), F.lit(0.5)))
    return view(spark, d, "fx_boxes").select("box_id", *[b.alias(n) for b, n in zip(box, ("west", "south", "east", "north"))])


@query("G25_native_resolution", "SELECT box_id, round((east - west) / 3600 * 111320, 6) AS metres FROM fx_boxes")
def _(spark, d):
    return view(spark, d, "fx_boxes").select("box_id", F.round(G.native_resolution((F.col("east") - F.col("west")) / 3600), 6).alias("metres"))


_TILE_VALUE = "CASE WHEN gx >= 0 AND gy >= 0 AND gx < 128 AND gy < 128 AND (gx // 16 + gy // 16) % 5 <> 0 THEN (gx * 7 + gy * 13) % 300 END"


@query(
    "T08_archive_sample",
    f"""WITH p AS (SELECT point_id, (lon + 180.0) / 360.0 * 8 AS tx, (1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 8 AS ty FROM fx_points),
  w AS (SELECT point_id, tx * 16 - 0.5 AS wx, ty * 16 - 0.5 AS wy, (cast(floor(tx) AS bigint) + cast(floor(ty) AS bigint)) % 5 <> 0 AND tx < 8 AS has FROM p),
  n AS (SELECT *, wx - floor(wx) AS fx, wy - floor(wy) AS fy, {", ".join(f"(SELECT {_TILE_VALUE} FROM (SELECT cast(floor(wx) AS bigint) + {dx} AS gx, cast(floor(wy) AS bigint) + {dy} AS gy)) AS v{dx}{dy}" for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)))} FROM w)
SELECT point_id, CASE WHEN has THEN round((v00 * (1 - fx) + coalesce(v10, v00) * fx) * (1 - fy) + (coalesce(v01, v00) * (1 - fx) + coalesce(v11, v10, v00) * fx) * fy, 5) END AS elev FROM n""",
)
def _(spark, d):
    """Across tile seams, from tiles as blocks with the edges of those around them."""
    return blocks.sample_tiles(view(spark, d, "fx_points"), _formula_tiles(spark), 3, 16, ["point_id"]).withColumn("elev", F.round("elev", 5))


def _formula_tiles(spark: SparkSession) -> DataFrame:
    """Decoded tiles of zoom 3, a fifth of them missing."""
    grid = spark.range(128).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(127).cast("long"))).alias("gy"))
    pixels = grid.select("gx", "gy", ((F.col("gx") * 7 + F.col("gy") * 13) % 300).alias("elev"))
    return blocks.from_pixels(pixels.where("(gx div 16 + gy div 16) % 5 <> 0"), 16).withColumnsRenamed({"bx": "tile_column", "by": "tile_row"})


_METRES = "2 * 6371008.8 * asin(least(1.0, sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2))))"


@query(
    "A12_line_profiles",
    f"""WITH RECURSIVE s AS (SELECT point_id // 20 AS line_id, point_id % 20 AS seq, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM fx_points WINDOW w AS (PARTITION BY point_id // 20 ORDER BY point_id)),
  n AS (SELECT *, CASE WHEN lon2 IS NULL THEN 1 ELSE greatest(cast(floor({_METRES} / 400000) AS int), 1) END AS pieces FROM s),
  d AS (SELECT line_id, seq, part, CASE WHEN part = 0 THEN lon ELSE lon + (lon2 - lon) * part / pieces END AS lon, CASE WHEN part = 0 THEN lat ELSE lat + (lat2 - lat) * part / pieces END AS lat FROM n, unnest(generate_series(0, pieces - 1)) u(part)),
  o AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY seq, part) AS k, lon, lat FROM d),
  p AS (SELECT line_id, k, (lon + 180.0) / 360.0 * 8 AS tx, (1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 8 AS ty FROM o),
  w AS (SELECT line_id, k, tx * 16 - 0.5 AS wx, ty * 16 - 0.5 AS wy, (cast(floor(tx) AS bigint) + cast(floor(ty) AS bigint)) % 5 <> 0 AND tx < 8 AS has FROM p),
  v AS (SELECT *, wx - floor(wx) AS fx, wy - floor(wy) AS fy, {", ".join(f"(SELECT {_TILE_VALUE} FROM (SELECT cast(floor(wx) AS bigint) + {dx} AS gx, cast(floor(wy) AS bigint) + {dy} AS gy)) AS v{dx}{dy}" for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)))} FROM w),
  e AS (SELECT line_id, k, CASE WHEN has THEN (v00 * (1 - fx) + coalesce(v10, v00) * fx) * (1 - fy) + (coalesce(v01, v00) * (1 - fx) + coalesce(v11, v10, v00) * fx) * fy END AS e FROM v),
  known AS MATERIALIZED (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY k) AS k, e FROM e WHERE e IS NOT NULL),
  f AS (SELECT line_id, k, e AS anchor, cast(0 AS double) AS up, cast(0 AS double) AS down FROM known WHERE k = 1 UNION ALL
    SELECT x.line_id, x.k, CASE WHEN abs(x.e - f.anchor) >= 3 THEN x.e ELSE f.anchor END, f.up + CASE WHEN x.e - f.anchor >= 3 THEN x.e - f.anchor ELSE 0 END, f.down + CASE WHEN f.anchor - x.e >= 3 THEN f.anchor - x.e ELSE 0 END
    FROM f JOIN known x ON x.line_id = f.line_id AND x.k = f.k + 1),
  climbs AS (SELECT line_id, arg_max(up, k) AS up, arg_max(down, k) AS down FROM f GROUP BY 1),
  way AS (SELECT line_id, sum(CASE WHEN lon2 IS NULL THEN 0 ELSE {_METRES} END) AS far FROM (SELECT line_id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM o WINDOW w AS (PARTITION BY line_id ORDER BY k)) GROUP BY 1),
  seen AS (SELECT line_id, min(e) AS low, max(e) AS high, count(*) - count(e) AS gaps, count(*) AS points FROM e GROUP BY 1)
SELECT line_id, round(far, 2) AS distance_m, round(coalesce(up, 0), 4) AS ascent_m, round(coalesce(down, 0), 4) AS descent_m, round(low, 4) AS min_m, round(high, 4) AS max_m, gaps, points
FROM seen JOIN way USING (line_id) LEFT JOIN climbs USING (line_id)""",
)
def _(spark, d):
    """Whole profiles: lines of twenty points, made denser, sampled over tile seams, measured and climbed."""
    points = view(spark, d, "fx_points").select(F.floor(F.col("point_id") / 20).alias("line_id"), (F.col("point_id") % 20).alias("seq"), "lon", "lat")
    made = profile.of_lines(points, _formula_tiles(spark), 3, 16, 400_000.0)
    return made.select("line_id", F.round("distance_m", 2).alias("distance_m"), *[F.round(c, 4).alias(c) for c in ("ascent_m", "descent_m", "min_m", "max_m")], "gaps", "points")


@query("T09_clamped_zoom", "SELECT cast(greatest(least(20, max(zoom_level)), min(zoom_level)) AS int) AS zoom FROM fx_archive")
def _(spark, d):
    return sampling.clamped_zoom(F.lit(20), view(spark, d, "fx_archive"))


@query(
    "J12_square_of_point",
    """WITH p AS (SELECT point_id, floor(lon) AS lon, floor(lat) + (point_id % 2) * 0.5 AS lat FROM fx_points), s AS (SELECT DISTINCT cast(floor(lon) AS bigint) AS x, cast(floor(lat) AS bigint) AS y FROM fx_points WHERE point_id % 4 = 1),
  c AS (SELECT point_id, k, cast(floor(lon) AS bigint) - dx AS x, cast(floor(lat) AS bigint) - dy AS y FROM p, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) t(k, dx, dy) WHERE (dy = 0 OR lat = floor(lat)))
SELECT point_id, arg_min(c.x, k) AS lon_deg, arg_min(c.y, k) AS lat_deg FROM c JOIN s ON c.x = s.x AND c.y = s.y GROUP BY 1""",
)
def _(spark, d):
    own = view(spark, d, "fx_points")
    points = own.select("point_id", F.floor("lon").cast("double").alias("lon"), (F.floor("lat") + (F.col("point_id") % 2) * 0.5).cast("double").alias("lat"))
    squares = own.where("point_id % 4 = 1").select(G.floor(F.col("lon")).alias("lon_deg"), G.floor(F.col("lat")).alias("lat_deg"))
    return sampling.located_squares(points, squares, ["point_id"])


@query(
    "T16_blended_sources",
    """WITH RECURSIVE s AS (SELECT gx, gy, priority, cast(elev AS double) AS v, (SELECT count(*) FROM range(9) r(probe) WHERE probe = 0 OR (gx + probe + priority) % 4 <> 0) / 9.0 AS w FROM fx_pixels),
  o AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY priority) AS k FROM s),
  f AS (SELECT gx, gy, k, v AS acc FROM o WHERE k = 1 UNION ALL SELECT o.gx, o.gy, o.k, f.acc * (1 - o.w) + o.v * o.w FROM f JOIN o ON o.gx = f.gx AND o.gy = f.gy AND o.k = f.k + 1)
SELECT gx, gy, round(arg_max(acc, k), 6) AS elev FROM f GROUP BY 1, 2""",
)
def _(spark, d):
    probes = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("probe")
    samples = view(spark, d, "fx_pixels").select("gx", "gy", "priority", "elev", probes)
    covered = samples.withColumn("elev", F.when((F.col("probe") == 0) | ((F.col("gx") + F.col("probe") + F.col("priority")) % 4 != 0), F.col("elev")))
    return sampling.blend_sources(covered, ["gx", "gy"]).withColumn("elev", F.round("elev", 6))


@query("T13_halo", """SELECT point_id, CASE WHEN blur = 0 THEN 0 ELSE 2 * cast(floor(blur / m) AS bigint) + 4 END AS pixels, round((CASE WHEN blur = 0 THEN 0 ELSE 2 * cast(floor(blur / m) AS bigint) + 4 END + 512) * m, 4) AS metres
FROM (SELECT point_id, cast(point_id % 300 AS double) AS blur, 2 * pi() * 6378137.0 / (power(2, 5 + point_id % 10) * 512) AS m FROM fx_points)""")
def _(spark, d):
    pixels, metres = tiling.halo(5 + F.col("point_id") % 10, 512, (F.col("point_id") % 300).cast("double"))
    return view(spark, d, "fx_points").select("point_id", pixels.alias("pixels"), F.round(metres, 4).alias("metres"))


@query("T23_step_schedule", "SELECT point_id, power(2.0, round_even(log2((abs(lat) + 1) / 3.0), 0)) AS step FROM fx_points")
def _(spark, d):
    return view(spark, d, "fx_points").select("point_id", E.step_for_resolution(F.abs("lat") + 1, F.lit(3.0)).alias("step"))


@query(
    "T25_mosaic_overviews",
    """WITH m AS (SELECT gx, gy, cast(arg_max(elev, priority) AS double) AS elev FROM fx_pixels GROUP BY 1, 2), a AS (SELECT gx // 2 AS gx, gy // 2 AS gy, avg(elev) AS elev FROM m GROUP BY 1, 2)
SELECT cast(gx AS bigint) AS gx, cast(gy AS bigint) AS gy, round(elev, 6) AS elev, 0 AS level FROM m UNION ALL SELECT gx, gy, round(elev, 6), 1 FROM a""",
)
def _(spark, d):
    mosaic = raster.highest_priority(view(spark, d, "fx_pixels")).select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "elev")
    return raster.pyramid(mosaic, 1).withColumn("elev", F.round("elev", 6))


# --- shapes and masks ------------------------------------------------------------------

_BOX_RINGS = "SELECT box_id, is_hole, seq, CASE WHEN seq IN (1, 2) THEN east - is_hole * 0.5 ELSE west + is_hole * 0.5 END AS lon, CASE WHEN seq IN (2, 3) THEN north - is_hole * 0.5 ELSE south + is_hole * 0.5 END AS lat FROM fx_boxes, range(2) h(is_hole), range(5) s(seq)"


def _polys(spark: SparkSession, d: str) -> DataFrame:
    return vectors.read_poly(spark, _poly_folder(spark, d))


def _poly_folder(spark: SparkSession, d: str) -> str:
    """A polygon file of each box, with a hole in the middle."""

    def ring(head: str, inner: float):
        corners = [("west", "south", 1, 1), ("east", "south", -1, 1), ("east", "north", -1, -1), ("west", "north", 1, -1), ("west", "south", 1, 1)]
        return F.concat_ws("\n", F.lit(head), *[F.concat(F.lit("  "), (F.col(x) + i * inner).cast("string"), F.lit(" "), (F.col(y) + j * inner).cast("string")) for x, y, i, j in corners], F.lit("END"))

    text = F.concat_ws("\n", "name", ring("1", 0.0), ring("!2", 0.5), F.lit("END\n"))
    folder = scratch(spark)
    files.write_files(view(spark, d, "fx_boxes").select(F.concat("box_id", F.lit(".poly")).alias("path"), text.alias("data")), folder).count()
    return folder


@query("S13_poly", f"SELECT cast(box_id AS int) AS box_id, cast(is_hole AS int) AS ring_id, cast(is_hole AS int) AS is_hole, cast(seq AS int) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_BOX_RINGS})")
def _(spark, d):
    box = F.regexp_extract("path", "([0-9]+).poly$", 1).cast("int").alias("box_id")
    return _polys(spark, d).select(box, "ring_id", "is_hole", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("S13_poly_format", f"SELECT cast(box_id AS varchar) AS file, cast(is_hole AS int) AS is_hole, cast(seq AS int) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_BOX_RINGS}) WHERE box_id IN (3, 7, 11)")
def _(spark, d):
    """Three of the boxes' polygon files; the others are not opened."""
    formats.register(spark)
    found = mbtiles.pushed(spark, "poly", _poly_folder(spark, d)).where("file IN ('3', '7', '11')")
    return found.select("file", "is_hole", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("S14_poly_geojson", f"SELECT cast(is_hole AS int) AS is_hole, cast(seq AS int) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_BOX_RINGS})")
def _(spark, d):
    """Polygon files written as GeoJSON and read back (S31)."""
    return vectors.geojson_rings(vectors.poly_geojson(_polys(spark, d), "name"), "feature").select("is_hole", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    "S33_vector_tiles",
    """WITH f AS (SELECT feature_id % 40 AS tile, layer, row_number() OVER (PARTITION BY feature_id % 40, layer ORDER BY feature_id) - 1 AS feature, CASE feature_id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END AS geometry, field, value_id, feature_id FROM fx_fields)
SELECT tile, layer, feature, geometry, 'field' AS key, field AS value FROM f UNION ALL SELECT tile, layer, feature, geometry, 'size', cast(value_id - 20 AS varchar) FROM f
UNION ALL SELECT tile, layer, feature, geometry, 'part', cast(cast(value_id / 4.0 AS double) AS varchar) FROM f UNION ALL SELECT tile, layer, feature, geometry, 'odd', CASE WHEN value_id % 2 = 1 THEN 'true' ELSE 'false' END FROM f WHERE value_id % 5 <> 0""",
)
def _(spark, d):
    """Tiles of many layers, features and kinds of values, encoded and decoded."""
    vectors.register(spark)
    none = {"text": "string", "whole": "long", "real": "double", "flag": "boolean"}
    tag = lambda key, **own: F.struct(F.lit(key).alias("key"), *[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()])
    size = F.col("value_id")
    tags = F.array(tag("field", text=F.col("field")), tag("size", whole=size - 20), tag("part", real=size / 4.0), tag("odd", flag=size % 2 == 1))
    tags = F.when(size % 5 == 0, F.slice(tags, 1, 3)).otherwise(tags)
    features = view(spark, d, "fx_fields").select((F.col("feature_id") % 40).alias("tile"), "feature_id", "layer", (F.col("feature_id") % 3 + 1).cast("int").alias("kind"), tags.alias("tags"))
    made = vectors.vector_tiles(features, ["tile"], "feature_id")
    return spark.sql("SELECT t.tile, d.layer, d.feature, d.geometry, d.key, d.value FROM {t} t, LATERAL decode_tile(t.tile_data) d", t=made)


@query("S31_geojson_shape", "SELECT point_id FROM fx_points WHERE (lon > 0 AND lon < 10 AND lat > 0 AND lat < 10) OR (lon > 20 AND lon < 30 AND lat > 20 AND lat < 30)")
def _(spark, d):
    ring = lambda a: f"[[[{a},{a}],[{a},{a + 10}],[{a + 10},{a + 10}],[{a + 10},{a}],[{a},{a}]]]"
    feature = '{{"type":"Feature","properties":{{}},"geometry":{{"type":"{}","coordinates":{}}}}}'.format
    text = f'{{"type":"FeatureCollection","features":[{feature("Polygon", ring(0))},{feature("MultiPolygon", "[" + ring(20) + "]")},{feature("Point", "[1,1]")}]}}'
    shape = vectors.geojson_rings(spark.createDataFrame([(text,)], "value string"))
    return geometry.points_in_shape(view(spark, d, "fx_points"), shape, strict=True).select("point_id")


@query("S15_tile_list", "SELECT zoom_level, tile_column, tile_row FROM fx_archive")
def _(spark, d):
    folder = f"{scratch(spark)}/tiles"
    view(spark, d, "fx_archive").select("tile_column", "tile_row", "zoom_level").write.csv(folder, sep="\t", header=True)
    return files.tile_list(spark, folder)


@query(
    "F09_buffered_boxes",
    """SELECT box_id FROM (SELECT box_id, west - (east - west) AS w, south - (north - south) AS s, east + (east - west) AS e, north + (north - south) AS n FROM fx_boxes)
WHERE w <= 40 AND e >= -40 AND s <= 30 AND n >= -30 AND NOT (w > -10 AND e < 10 AND s > -10 AND n < 10)""",
)
def _(spark, d):
    return geometry.boxes_touching_shape(view(spark, d, "fx_boxes"), view(spark, d, "fx_ring"), 1.0).select("box_id")


@query(
    "Q06_shape_tiles",
    """WITH t AS (SELECT z AS zoom_level, x, y, x / power(2, z) * 360.0 - 180.0 AS w, (x + 1) / power(2, z) * 360.0 - 180.0 AS e,
  degrees(atan(sinh(pi() * (1.0 - 2.0 * (y + 1) / power(2, z))))) AS s, degrees(atan(sinh(pi() * (1.0 - 2.0 * y / power(2, z))))) AS n
  FROM (SELECT cast(z AS int) AS z, x, y FROM range(8) a(z), range(128) b(x), range(128) c(y) WHERE x < power(2, z) AND y < power(2, z)))
SELECT DISTINCT zoom_level, x AS tile_column, y AS tile_row FROM t, fx_boxes b WHERE t.w <= b.east AND t.e >= b.west AND t.s <= b.north AND t.n >= b.south""",
)
def _(spark, d):
    """Tiles that touch a shape of many rings, one a box."""
    sides = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    corners = F.array(*[F.struct(F.lit(k).alias("seq"), F.col(x).alias("lon"), F.col(y).alias("lat")) for k, (x, y) in enumerate(sides)])
    rings = view(spark, d, "fx_boxes").select(F.col("box_id").alias("ring_id"), F.lit(0).alias("is_hole"), F.explode(corners).alias("c"))
    return tiling.tiles_of_shape(rings.select("ring_id", "is_hole", "c.seq", "c.lon", "c.lat"), 7)


@query("Q07_mask_of_archive", "SELECT DISTINCT cast(zoom_level - k AS int) AS zoom_level, tile_column >> k AS tile_column, tile_row >> k AS tile_row FROM fx_archive, unnest(generate_series(0, zoom_level)) u(k) WHERE zoom_level <= 5")
def _(spark, d):
    spark.udtf.register("expand_mask", masks.ExpandMask)
    text = masks.mask_of(view(spark, d, "fx_archive"), 5)
    return spark.sql("SELECT DISTINCT t.* FROM {m} m, LATERAL expand_mask(m.mask, 5) t", m=text)


@query("Q09_mask_graph_tiles", """WITH b AS (SELECT DISTINCT tile_column / power(2, zoom_level) * 360.0 - 180.0 AS w, (tile_column + 1) / power(2, zoom_level) * 360.0 - 180.0 - 1e-9 AS e,
  degrees(atan(sinh(pi() * (1.0 - 2.0 * (tile_row + 1) / power(2, zoom_level))))) + 1e-9 AS s, degrees(atan(sinh(pi() * (1.0 - 2.0 * tile_row / power(2, zoom_level))))) AS n FROM fx_tiles WHERE zoom_level >= 10)
SELECT DISTINCT a.x, c.y, 1 AS level FROM b, unnest(generate_series(cast(floor(w + 180.0) AS bigint), cast(floor(e + 180.0) AS bigint))) a(x), unnest(generate_series(cast(floor(s + 90.0) AS bigint), cast(floor(n + 90.0) AS bigint))) c(y)""")
def _(spark, d):
    return tiling.mask_to_graph_tiles(view(spark, d, "fx_tiles").select(*ADDRESS).distinct(), (1,))


@query("Q10_mask_outline", """WITH c AS (SELECT DISTINCT tile_column * 2 + dx AS x, tile_row * 2 + dy AS y FROM fx_archive, range(2) a(dx), range(2) b(dy) WHERE zoom_level = 4),
  s AS (SELECT x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM c UNION ALL SELECT x, y + 1, x + 1, y + 1 FROM c UNION ALL SELECT x, y, x, y + 1 FROM c UNION ALL SELECT x + 1, y, x + 1, y + 1 FROM c)
SELECT x1, y1, x2, y2 FROM s GROUP BY ALL HAVING count(*) = 1""")
def _(spark, d):
    return tiling.outline(view(spark, d, "fx_archive").where("zoom_level = 4"), 5)


@query(
    "J04_keep_by_mask",
    """WITH l AS (SELECT DISTINCT zoom_level, tile_column, tile_row FROM fx_tiles WHERE zoom_level IN (5, 7) AND tile_data_id % 3 = 0)
SELECT t.zoom_level, t.tile_column, t.tile_row, t.nbytes FROM fx_tiles t WHERE EXISTS (SELECT 1 FROM l WHERE l.zoom_level = 5 AND t.zoom_level >= 5 AND t.tile_column >> (t.zoom_level - 5) = l.tile_column AND t.tile_row >> (t.zoom_level - 5) = l.tile_row)
  OR EXISTS (SELECT 1 FROM l WHERE l.zoom_level = 7 AND t.zoom_level >= 7 AND t.tile_column >> greatest(t.zoom_level - 7, 0) = l.tile_column AND t.tile_row >> greatest(t.zoom_level - 7, 0) = l.tile_row)""",
)
def _(spark, d):
    t = view(spark, d, "fx_tiles")
    return archive.keep_by_mask(t, t.where("zoom_level IN (5, 7) AND tile_data_id % 3 = 0")).select(*ADDRESS, "nbytes")


@query(
    "J08_graph_files",
    f"""WITH w AS (SELECT DISTINCT cast(floor(lon + 180) AS bigint) AS x, cast(floor(lat + 90) AS bigint) AS y FROM fx_points)
SELECT x, y, EXISTS (SELECT 1 FROM fx_points p WHERE p.point_id % 3 = 1 AND cast(floor(p.lon + 180) AS bigint) = x AND cast(floor(p.lat + 90) AS bigint) = y) AS found FROM w""",
)
def _(spark, d):
    points = view(spark, d, "fx_points")
    path = F.concat(F.lit("/graph/"), G.graph_path(*_c("x", "y", "level")))
    listing = tiling.graph_tiles_at(points.where("point_id % 3 = 1"), (1,)).select(path.alias("path"))
    return tiling.resolved_files(tiling.graph_tiles_at(points, (1,)), listing, "/graph").select("x", "y", "found")


@query(
    "A27_tile_counts",
    """WITH s AS (SELECT DISTINCT zoom_level AS z, tile_column AS x, tile_row AS y FROM fx_archive WHERE zoom_level BETWEEN 3 AND 6), w AS (SELECT * FROM s UNION SELECT z + 1, x * 2 + dx, y * 2 + dy FROM s, range(2) a(dx), range(2) b(dy) WHERE z < 6)
SELECT w.z AS zoom_level, count(s.z) AS stored, count(*) AS wanted, count(*) - count(s.z) AS extra FROM w LEFT JOIN s ON s.z = w.z AND s.x = w.x AND s.y = w.y GROUP BY 1""",
)
def _(spark, d):
    return tiling.tile_counts(view(spark, d, "fx_archive").where("zoom_level BETWEEN 3 AND 6"))


@query("A28_empty_archive", "SELECT 0 AS tiles, 0 AS bytes, 0.0 AS dedup_ratio")
def _(spark, d):
    return archive.archive_totals(view(spark, d, "fx_tiles").where("false"), None).select("tiles", "bytes", "dedup_ratio")


# --- catalogues ----------------------------------------------------------------------------


@query("S16_source_list", "SELECT cast(row_number() OVER (ORDER BY s_suppkey) - 1 AS int) AS priority, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'hgt' ELSE 'raster' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN -cast(s_suppkey AS double) END AS clamp_min FROM supplier")
def _(spark, d):
    """One document that lists a source for each supplier."""
    own = F.struct(F.col("s_suppkey").alias("k"), F.struct(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "hgt").otherwise("raster").alias("type"), F.lit("dem").alias("path"), F.when(F.col("s_suppkey") % 3 == 0, -F.col("s_suppkey").cast("double")).alias("clamp_min")).alias("s"))
    listed = load(spark, d, "supplier").agg(F.array_sort(F.collect_list(own)).alias("l"))
    document = F.to_json(F.struct(F.transform("l", lambda x: x["s"]).alias("sources")))
    folder = scratch(spark)
    files.write_files(listed.select(F.lit("sources.json").alias("path"), document.alias("data")), folder).count()
    return files.source_list(spark, f"{folder}/sources.json").select("priority", "name", "type", "clamp_min")


@query("S17_catalogue", "SELECT * FROM (VALUES ('alps', 'alps.mbtiles', 'classic', true), ('alps', 'alps_routes.mbtiles', 'compact', true), ('alps', 'broken.mbtiles', NULL, false)) t(area, file_name, layout, readable)")
def _(spark, d):
    """A directory of areas with their archives (S17) and what each says of itself (S18)."""
    root = scratch(spark)
    os.makedirs(f"{root}/alps"), os.makedirs(f"{root}/.hidden")
    os.rename(_archive(spark, d), f"{root}/alps/alps.mbtiles")
    os.rename(_archive(spark, d, "compact"), f"{root}/alps/alps_routes.mbtiles")
    for name in ("alps/broken.mbtiles", "alps/.DS_Store", ".hidden/x.mbtiles"):
        with open(f"{root}/{name}", "w") as out:
            out.write("no archive")
    found = catalog.listed(files.probe(files.list_files(spark, root)))
    return found.select("area", "file_name", "layout", F.col("error").isNull().alias("readable")).unionByName(files.list_files(spark, f"{root}/none").selectExpr("area", "file_name", "cast(null as string) as layout", "true as readable"))


def _extracts(spark, d):
    n = load(spark, d, "nation")
    return n.select(F.lower("n_name").alias("id"), F.concat(F.lit("Land "), "n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("http://own/"), "n_nationkey")).alias("url"))


@query("S20_extract_url", "SELECT * FROM (SELECT lower(n_name) AS id, concat('http://own/', cast(n_nationkey AS varchar)) AS url FROM nation WHERE n_nationkey = 6 AND n_nationkey % 5 <> 0) UNION ALL SELECT lower(n_name), concat('http://own/', cast(n_nationkey AS varchar)) FROM nation WHERE n_nationkey = 7 AND n_nationkey % 5 <> 0")
def _(spark, d):
    """By id; by name, from the second index since the first is empty."""
    own = _extracts(spark, d)
    six, seven = (load(spark, d, "nation").where(f"n_nationkey = {k}").first()["n_name"] for k in (6, 7))
    return catalog.resolved(own, six.capitalize()).select("id", "url").unionByName(catalog.resolved(own.where("false"), f"land {seven}".lower(), own).select("id", "url"))


@query("S22_mirror_listing", "SELECT concat('area', cast(n_regionkey AS varchar)) AS name, cast(CASE WHEN n_nationkey % 7 <> 0 THEN date '2024-01-01' + cast(n_nationkey AS int) END AS varchar) AS date, n_nationkey % 2 = 0 AS has_md5 FROM nation")
def _(spark, d):
    """Links of a mirror's page with their dates and their checksums' links."""
    n = load(spark, d, "nation")
    stamp = F.when(F.col("n_nationkey") % 7 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")), "yyMMdd")).otherwise("latest")
    file = F.concat(F.lit('http://own/'), "n_nationkey", F.lit("/area"), "n_regionkey", F.lit("-"), stamp, F.lit(".osm.pbf"))
    pages = n.select(F.concat(F.lit('<a href="'), file, F.lit('">x</a>'), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('<a href="'), file, F.lit('.md5">y</a>'))).otherwise(""), F.lit('<a href="other.html">z</a>')).alias("html"))
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    data = files.hrefs(pages).join(catalog.with_md5(links).select("href", "md5").distinct(), "href")
    return data.select("name", F.col("date").cast("string").alias("date"), F.col("md5").isNotNull().alias("has_md5"))


@query("S24_first_source", "SELECT n_nationkey AS area, CASE WHEN n_nationkey % 2 = 0 THEN 'url' ELSE 'index' END AS source, n_nationkey + CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 100 END AS file_len FROM nation WHERE n_nationkey % 6 <> 1")
def _(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("area"))
    one = n.select("area", F.lit("url").alias("source"), F.when(F.col("area") % 2 == 0, F.col("area")).alias("file_len"))
    two = n.select("area", F.lit("index").alias("source"), F.when(F.col("area") % 6 != 1, F.col("area") + 100).alias("file_len"))
    return options.first_with_length(options.in_order_of(one, two), "area")


@query("U09_candidates", "SELECT n_name AS name, 0 AS place FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT r_name, 2 FROM region")
def _(spark, d):
    n, r = load(spark, d, "nation").select(F.col("n_name").alias("name")), load(spark, d, "region").select(F.col("r_name").alias("name"))
    return options.in_order_of(n, r, r)


@query("S26_pruned_archives", """SELECT name AS stem, count(*) AS parts FROM (SELECT concat('dem_N', lpad(cast(n_nationkey AS varchar), 2, '0'), 'E006') AS name, unnest(generate_series(1, n_nationkey % 3 + 1)) FROM nation WHERE n_nationkey < 10 AND n_nationkey + 1 > 4.5) GROUP BY 1""")
def _(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_nationkey").cast("long") % 3 + 1)).alias("part"))
    listing = n.select(F.format_string("dem_N%02dE006.7z.%03d", F.col("n_nationkey").cast("int"), F.col("part").cast("int")).alias("name"))
    return catalog.wanted_archives(listing, (6.0, 4.5, 7.0, 10.0)).select("stem", F.size("parts").cast("long").alias("parts"))


@query("S29_files_in_box", "SELECT box_id FROM fx_boxes WHERE box_id % 5 = 0 OR (west < 20 AND east > -20 AND south < 20 AND north > -20)")
def _(spark, d):
    sides = {c: F.when(F.col("box_id") % 5 != 0, F.col(c)) for c in ("west", "south", "east", "north")}
    return catalog.touching_files(view(spark, d, "fx_boxes").withColumns(sides), (-20.0, -20.0, 20.0, 20.0)).select("box_id")


@query("S37_documents", "SELECT s_name AS output_root, cast(s_suppkey % 15 AS int) AS maxzoom, NULL AS missing FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT NULL, NULL, NULL FROM supplier WHERE s_suppkey % 4 = 0")
def _(spark, d):
    """A settings document of each supplier, every fourth of them broken; one that is not there reads as nulls."""
    text = F.when(F.col("s_suppkey") % 4 == 0, "{").otherwise(F.to_json(F.struct(F.col("s_name").alias("output_root"), (F.col("s_suppkey") % 15).alias("maxzoom"), F.array(F.lit(1)).alias("unknown"))))
    folder = scratch(spark)
    files.write_files(load(spark, d, "supplier").select(F.concat("s_suppkey", F.lit("/settings.json")).alias("path"), text.alias("data")), folder).count()
    own = files.read_document(spark, f"{folder}/*/settings.json", "output_root string, maxzoom int")
    none = files.read_document(spark, f"{folder}/none.json", "output_root string")
    return own.join(none.select(F.col("output_root").alias("missing")), F.lit(True))


@query("S38_layer_bytes", "SELECT p_type AS layer, cast(sum(p_size) AS bigint) AS bytes FROM part GROUP BY 1")
def _(spark, d):
    folder = f"{scratch(spark)}/stats"
    p = load(spark, d, "part").select(*[F.lit(0).alias(f"c{i}") for i in range(5)], F.col("p_type").alias("layer"), F.col("p_size").cast("long").alias("bytes"))
    p.write.csv(folder, sep="\t", header=True, compression="gzip")
    return files.layer_stats(spark, folder)


@query("S39_header_bounds", "SELECT box_id, west, north FROM fx_boxes")
def _(spark, d):
    text = F.concat(F.lit("minlon: "), "west", F.lit("\nminlat: "), "south", F.lit("\nmaxlon: "), "east", F.lit("\nmaxlat: "), "north", F.lit("\nnodes: 12"))
    return view(spark, d, "fx_boxes").select("box_id", files.bounds_of_header(text).alias("b")).select("box_id", "b.west", "b.north")


@query("F10_servable", f"SELECT file_id FROM ({_KINDED}) WHERE file_id % 3 <> 0 AND file_id % 4 <> 0")
def _(spark, d):
    c = catalog.described(view(spark, d, "fx_files"))
    probed = c.withColumns({"error": F.when(F.col("file_id") % 3 == 0, "unreadable"), "format": F.when(F.col("file_id") % 4 == 0, "gph3").when(F.col("file_id") % 4 == 1, "pbf")})
    return catalog.servable(probed).select("file_id")


@query("F11_one_area", f"SELECT file_id, file_name FROM ({_KINDED})")
def _(spark, d):
    c = catalog.described(view(spark, d, "fx_files").unionByName(view(spark, d, "fx_files").withColumn("area", F.lit("corsica"))))
    return catalog.listed(c, "rhone-alpes").select("file_id", "file_name")


@query("F15_visible_kinds", "SELECT feature_id, kind, (kind = 'rasters' OR kind = 'lines') AND feature_id % 2 = 0 AND value_id % 3 <> 0 AS \"on\" FROM fx_fields, (VALUES ('rasters'), ('polygons'), ('lines'), ('points')) k(kind)")
def _(spark, d):
    kinds = F.explode(F.array(*map(F.lit, ("rasters", "polygons", "lines", "points")))).alias("kind")
    rows = view(spark, d, "fx_fields").select("feature_id", kinds, (F.col("feature_id") % 2 == 0).alias("source_visible"), (F.col("value_id") % 3 != 0).alias("layer_visible"))
    return catalog.visible_kinds(rows, "lines").select("feature_id", "kind", "on")


@query("O09_first_features", "SELECT layer, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY feature_id) AS k FROM fx_fields) WHERE k <= 8")
def _(spark, d):
    return archive.cap_per_group(view(spark, d, "fx_fields").select("layer", "feature_id"), ["layer"], ["feature_id"], 8).select("layer", "feature_id")


@query("O10_newest_jar", "SELECT c_nationkey AS folder, max(concat('own-', lpad(cast(c_custkey % 50 AS varchar), 3, '0'), '-with-deps.jar')) AS jar FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1")
def _(spark, d):
    name = F.format_string("own-%03d%s.jar", (F.col("c_custkey") % 50).cast("int"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("-with-deps"))
    return catalog.newest_jar(load(spark, d, "customer").select(F.col("c_nationkey").alias("folder"), name.alias("file_name")), "folder")


# --- names, documents and plans ----------------------------------------------------------------


def _metadata(spark, d):
    """A metadata map for each file, of five kinds by its number."""
    k = F.col("file_id") % 5
    pair = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    m = F.when(k == 0, pair("encoding", "terrarium")).when(k == 1, pair("round-digits", "3")).when(k == 2, pair("json", '{"vector_layers":[{"id":"route"}]}')).when(k == 3, pair("json", "{broken")).otherwise(pair("planetiler:version", "1"))
    return view(spark, d, "fx_files").select("file_id", m.alias("m"))


@query("X05_dem_encoding", "SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'terrarium' WHEN 1 THEN 'mapbox' END AS encoding FROM fx_files")
def _(spark, d):
    return _metadata(spark, d).select("file_id", X.dem_encoding(F.col("m")).alias("encoding"))


@query("X06_kind_of_metadata", "SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'terrain' WHEN 1 THEN 'terrain' WHEN 2 THEN 'routes' ELSE 'basemap' END AS kind, cast(CASE WHEN file_id % 5 = 2 THEN 1 ELSE 0 END AS int) AS layers FROM fx_files")
def _(spark, d):
    """Layers of the embedded document (X07) and what they and the map say of the kind."""
    layers = X.layers_of_json(F.try_element_at("m", F.lit("json")))
    return _metadata(spark, d).select("file_id", X.kind_of_metadata(F.col("m"), layers, F.lit("basemap")).alias("kind"), F.size(layers).alias("layers"))


@query("X08_provenance", "SELECT file_id, CASE WHEN file_id % 5 = 4 THEN '1' END AS planetiler_version FROM fx_files")
def _(spark, d):
    return _metadata(spark, d).select("file_id", X.provenance(F.col("m"), ("planetiler:version", "json")).alias("p")).select("file_id", "p.planetiler_version")


@query("X09_strip_ansi", "SELECT line_no, regexp_replace(line, concat(chr(27), '\\[[0-9;]*[A-Za-z]'), '', 'g') AS line FROM fx_log")
def _(spark, d):
    return view(spark, d, "fx_log").select("line_no", X.strip_ansi(F.col("line")).alias("line"))


@query("X13_shell_words", "SELECT s_suppkey AS id, 4 AS words, concat('--polygon=/tmp/my area ', cast(s_suppkey AS varchar), '.poly') AS second, '' AS third, CASE WHEN s_suppkey % 2 = 0 THEN 'a/b' ELSE '''it''\\''''s''' END AS quoted FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    line = F.concat(F.lit("run  --polygon='/tmp/my area "), k, F.lit(".poly' '' \"x\"y"))
    words = X.shell_words(line)
    return load(spark, d, "supplier").select(k.alias("id"), F.size(words).alias("words"), words[1].alias("second"), words[2].alias("third"), X.shell_quote(F.when(k % 2 == 0, "a/b").otherwise("it's")).alias("quoted"))


@query("X14_human_size", "SELECT n, CASE WHEN n >= 1073741824 THEN concat(cast(round(n / 1073741824, 1) AS varchar), ' GiB') WHEN n >= 1048576 THEN concat(cast(round(n / 1048576, 1) AS varchar), ' MiB') WHEN n >= 1024 THEN concat(cast(round(n / 1024, 1) AS varchar), ' KiB') ELSE concat(cast(n AS varchar), ' B') END AS text FROM (SELECT event_id * event_id * 37 AS n FROM events)")
def _(spark, d):
    return load(spark, d, "events").select((F.col("event_id") * F.col("event_id") * 37).alias("n")).withColumn("text", X.human_size(F.col("n")))


@query("X15_option_flags", "SELECT array_to_string(list(concat('--', name, '=', value) ORDER BY seq), ' ') AS flags FROM (SELECT name, value, cast(substr(name, 2) AS bigint) AS seq FROM fx_meta WHERE build = 'a') WHERE seq % 2 = 0")
def _(spark, d):
    a, _ = _builds(spark, d, "fx_meta")
    seq = F.substring("name", 2, 20).cast("long")
    schema = a.select(seq.alias("seq"), F.col("name").alias("key"), F.col("name").alias("flag")).where("seq % 2 = 0")
    return options.rendered(a.select(F.col("name").alias("key"), "value"), schema).select(F.array_join("flags", " ").alias("flags"))


@query(
    "X17_fingerprint",
    """SELECT n_nationkey AS id, lpad(lower(to_hex(cast(list_reduce(list_prepend(cast(14695981039346656037 AS hugeint), list_transform(string_split(concat('{"a":"', n_name, '","b":"', cast(n_regionkey AS varchar), '"}'), ''), lambda c: cast(ord(c) AS hugeint))), lambda h, c: (xor(h, c) * cast(1099511628211 AS hugeint)) % cast(18446744073709551616 AS hugeint)) AS ubigint))), 16, '0') AS fingerprint FROM nation""",
)
def _(spark, d):
    options_ = F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name"))
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), X.fingerprint(X.canonical_options(options_)).alias("fingerprint"))


@query("X19_polyline", """SELECT point_id // 20 AS line, row_number() OVER (PARTITION BY point_id // 20 ORDER BY point_id) - 1 AS "index", lon, lat FROM fx_points""")
def _(spark, d):
    """Lines of twenty points, encoded and decoded."""
    vectors.register(spark)
    lines = view(spark, d, "fx_points").groupBy(F.floor(F.col("point_id") / 20).alias("line")).agg(F.array_sort(F.collect_list(F.struct("point_id", "lon", "lat"))).alias("points"))
    return spark.sql('SELECT l.line, p.index, p.lon, p.lat FROM {l} l, LATERAL decode_polyline(l.polyline) p', l=vectors.polylines(lines, "line"))


@query("X21_route_request", "SELECT point_id, 'pedestrian' AS costing, 'kilometers' AS units, lat FROM fx_points")
def _(spark, d):
    places = F.array(F.struct(F.lit(5.0).alias("lon"), F.lit(45.0).alias("lat")), F.struct("lon", "lat"))
    f = F.from_json("j", "costing string, directions_options struct<units:string>, locations array<struct<lon:double,lat:double>>")
    made = view(spark, d, "fx_points").select("point_id", X.route_request(places, F.lit("pedestrian")).alias("j")).select("point_id", f.alias("f"))
    return made.select("point_id", "f.costing", F.col("f.directions_options.units").alias("units"), F.col("f.locations")[1]["lat"].alias("lat"))


@query("X22_command_lines", "SELECT n_nationkey AS tool, concat('cmd', cast(n_nationkey AS varchar)) AS name, 'Does a thing' AS description FROM nation UNION ALL SELECT n_nationkey, 'bare', '' FROM nation")
def _(spark, d):
    lines = ["Usage: tool", "", "Commands:", "  cmd#   Does a thing", "  bare", "  help   Print this", "", "Options:", "  -h   Help"]
    listed = F.posexplode(F.array(*map(F.lit, lines))).alias("n", "line")
    rows = load(spark, d, "nation").select(F.col("n_nationkey").alias("tool"), listed).withColumn("line", F.replace("line", F.lit("#"), F.col("tool").cast("string")))
    return options.command_lines(rows, "tool", "n")


@query("X23_layer_hue", """SELECT feature_id, CASE feature_id % 6 WHEN 0 THEN 'blue' WHEN 1 THEN 'orange' WHEN 2 THEN 'monochrome' WHEN 3 THEN 'green' WHEN 4 THEN 'pink' END AS hue FROM fx_fields""")
def _(spark, d):
    names = F.array(*map(F.lit, ("water_name", "transportation", "building_road", "landcover", "place", "poi")))
    return view(spark, d, "fx_fields").select("feature_id", X.layer_hue(names[(F.col("feature_id") % 6).cast("int")]).alias("hue"))


@query("X24_replication", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'minute' WHEN 1 THEN 'hour' WHEN 2 THEN 'day' END AS interval FROM nation")
def _(spark, d):
    urls = F.array(*map(F.lit, ("http://own/minute/", "http://own/hour", "http://own/day/", "http://own/week")))
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), X.replication_interval(urls[(F.col("n_nationkey") % 4).cast("int")]).alias("interval"))


@query("X29_extent", "SELECT event_id, concat(cast(round(event_id / 8, 2) AS varchar), ',', cast(round(-event_id / 8, 2) AS varchar)) AS extent FROM events")
def _(spark, d):
    text = F.concat((F.col("event_id") / 8).cast("string"), F.lit(", "), (-F.col("event_id") / 8).cast("string"))
    return load(spark, d, "events").select("event_id", X.trimmed_extent(text, 2).alias("extent"))


@query("P02_step_outputs", """SELECT area, step, replace(replace(path, '{area}', area), '{area_}', replace(area, '-', '_')) AS path FROM (SELECT DISTINCT area FROM fx_files UNION SELECT lower(r_name) FROM region) a,
  (VALUES ('basemap', '/out/{area}/{area}.mbtiles'), ('routes', '/out/{area}/{area}_routes.mbtiles'), ('terrain', '/out/{area}/{area}_terrain.mbtiles'), ('hillshade', '/out/{area}/{area}_hillshade.mbtiles'),
   ('valhalla_package', '/out/{area}/{area}.vtiles'), ('download', '/data/{area_}.osm.pbf'), ('elevation', '/dem'), ('valhalla_tiles', '/graph')) s(step, path)""")
def _(spark, d):
    areas = view(spark, d, "fx_files").select("area").union(load(spark, d, "region").select(F.lower("r_name")))
    return steps.outputs(areas, {"area": "/out", "data": "/data", "elevation": "/dem", "graph": "/graph"})


@query("P04_all_statuses", "SELECT c_custkey AS step, CASE WHEN c_custkey % 3 = 0 THEN 'missing' ELSE 'untracked' END AS status FROM customer")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("step"))
    path = F.col("step").cast("string")
    none = spark.createDataFrame([], "step long, name string, value string")
    some = c.where("step % 3 <> 0")
    return options.all_statuses(c, options.step_status(some.select("step", path.alias("path")), some.select(path.alias("path"), F.lit(1).alias("size")), none, none))


@query("P09_chosen_bounds", "SELECT box_id, CASE WHEN box_id % 3 = 0 THEN 'explicit' WHEN box_id % 3 = 1 THEN 'shape' ELSE 'basemap' END AS bounds FROM fx_boxes")
def _(spark, d):
    b = view(spark, d, "fx_boxes").select("box_id")
    given = lambda t, word: t.select("box_id", F.lit(word).alias("bounds"))
    return options.chosen_bounds(given(b.where("box_id % 3 = 0"), "explicit"), given(b.where("box_id % 3 <> 2"), "shape"), given(b, "basemap"), "box_id")


@query(
    "P10_dry_run",
    """SELECT box_id, cast(sum((floor((east + 180.0) / 360.0 * power(2, z)) - floor((west + 180.0) / 360.0 * power(2, z)) + 1) * (floor((1.0 - ln(tan(radians(south)) + 1.0 / cos(radians(south))) / pi()) / 2.0 * power(2, z))
  - floor((1.0 - ln(tan(radians(north)) + 1.0 / cos(radians(north))) / pi()) / 2.0 * power(2, z)) + 1)) AS bigint) AS tiles FROM fx_boxes, unnest(generate_series(5, 9)) u(z) GROUP BY 1""",
)
def _(spark, d):
    return tiling.dry_run(view(spark, d, "fx_boxes"), 5, 9).select("box_id", "tiles")


_CALLS = """SELECT point_id, tile_x(lon, 9) AS x, tile_y(lat, 9) AS y, round(tile_west(tile_x(lon, 9), 9), 6) AS west, round(tile_north(tile_y(lat, 9), 9), 6) AS north, flip_row(9, tile_y(lat, 9)) AS flipped,
  tile_number(9, tile_x(lon, 9), tile_y(lat, 9)) AS number, round(haversine_m(lon, lat, 5, 45), 3) AS metres, round(mercator_x(lon), 4) AS mx, round(mercator_y(lat), 4) AS my, degree_name(lon, lat) AS name,
  decode_terrarium(128, cast(point_id % 256 AS int), 0) AS elevation, contour_band(point_id) AS band, human_seconds(point_id) AS took, is_md5('x') AS md5 FROM {p}"""


@query(
    "G00_sql_functions",
    """WITH t AS (SELECT point_id, lon, lat, least(greatest(cast(floor((lon + 180.0) / 360.0 * 512) AS bigint), 0), 511) AS x, least(greatest(cast(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 512) AS bigint), 0), 511) AS y FROM fx_points)
SELECT point_id, x, y, round(x / 512 * 360.0 - 180.0, 6) AS west, round(degrees(atan(sinh(pi() * (1.0 - 2.0 * y / 512)))), 6) AS north, 511 - y AS flipped, cast((power(4, 9) - 1) / 3 AS bigint) + 512 * y + x AS number,
  round(2 * 6371008.8 * asin(sqrt(power(sin(radians(45.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45.0)) * power(sin(radians(5.0 - lon) / 2), 2))), 3) AS metres, round(6378137.0 * radians(lon), 4) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS my,
  """ + _NAME + """ AS name, cast(point_id % 256 AS double) AS elevation, CASE WHEN point_id % 1000 = 0 THEN 1000 WHEN point_id % 500 = 0 THEN 500 WHEN point_id % 250 = 0 THEN 250 WHEN point_id % 200 = 0 THEN 200 WHEN point_id % 100 = 0 THEN 100 WHEN point_id % 50 = 0 THEN 50 WHEN point_id % 20 = 0 THEN 20 ELSE 10 END AS band,
  CASE WHEN point_id >= 3600 THEN concat(cast(point_id // 3600 AS varchar), 'h', lpad(cast((point_id // 60) % 60 AS varchar), 2, '0'), 'm', lpad(cast(point_id % 60 AS varchar), 2, '0'), 's') WHEN point_id >= 60 THEN concat(cast(point_id // 60 AS varchar), 'm', lpad(cast(point_id % 60 AS varchar), 2, '0'), 's') ELSE concat(cast(point_id AS varchar), 's') END AS took, false AS md5 FROM t""",
)
def _(spark, d):
    SQL.register(spark)
    return spark.sql(_CALLS, p=view(spark, d, "fx_points"))


# --- streams -----------------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str, make, mode: str = "append") -> DataFrame:
    """The rows that a query over the log as a stream of two folders' files writes until nothing new is there."""
    folder = scratch(spark)
    lines = view(spark, d, "fx_log").select("line")
    lines.where("line LIKE '%Finished%'").write.text(f"{folder}/one")
    lines.where("line NOT LIKE '%Finished%'").write.text(f"{folder}/two")
    events = logs.parsed(logs.read_log_stream(spark, f"{folder}/one", f"{folder}/two"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    made = make(events)
    made.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out").select(*made.columns)


@query("R02_streamed_events", f"WITH e AS ({_EVENT}) SELECT event, stage, count(*) AS n FROM e GROUP BY ALL")
def _(spark, d):
    """Two folders of lines merged (R01), every line an event."""
    return _streamed(spark, d, lambda e: e.select("event", "stage")).groupBy("event", "stage").agg(F.count(F.lit(1)).alias("n"))


#: Lines of a run; each run is a log file of its own.
_LINES = 500


def _followed(spark: SparkSession, d: str, make) -> DataFrame:
    """The rows that a query over the runs' log files, followed as they are, has written."""
    tail.register(spark)
    folder = scratch(spark)
    lines = view(spark, d, "fx_log").select(F.floor(F.col("line_no") / _LINES).alias("run"), "line_no", "line")
    own = lines.repartition("run").sortWithinPartitions("run", "line_no").drop("line_no").write.partitionBy("run")
    own.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(f"{folder}/logs")  # tasks put their files in place, not the driver one by one
    made = make(logs.parsed(spark.readStream.format("log_tail").load(f"{folder}/logs"), "line"))
    query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out").withColumn("run", F.regexp_extract("run", "run=([0-9]+)", 1).cast("long"))


@query(
    "R03_run_durations",
    f"""WITH e AS ({_EVENT}), h AS (SELECT line_no // {_LINES} AS run, line_no, event, nullif(last_value(CASE event WHEN 'phase_end' THEN took WHEN 'run_end' THEN '' END IGNORE NULLS) OVER (PARTITION BY line_no // {_LINES} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS took FROM e)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY line_no) AS place, took FROM h WHERE event = 'run_end'""",
)
def _(spark, d):
    """The duration each run holds when it ends, by state that is cleared then."""
    ends = _followed(spark, d, logs.run_durations)
    return ends.select("run", F.row_number().over(Window.partitionBy("run").orderBy("offset")).cast("long").alias("place"), "took")


@query(
    "R04_progress_throttle",
    f"""WITH e AS ({_EVENT}), c AS (SELECT line_no // {_LINES} AS run, line_no, stage, percent, lag(percent) OVER (PARTITION BY line_no // {_LINES}, stage ORDER BY line_no) AS before FROM e WHERE event = 'progress')
SELECT run, stage, row_number() OVER (PARTITION BY run, stage ORDER BY line_no) AS place, percent FROM c WHERE before IS DISTINCT FROM percent""",
)
def _(spark, d):
    """Each change of a stage's percentage, also back to one that it had before."""
    changes = _followed(spark, d, logs.percent_changes)
    return changes.select("run", "stage", F.row_number().over(Window.partitionBy("run", "stage").orderBy("offset")).cast("long").alias("place"), "percent")


def _event_stream(spark: SparkSession, d: str, made, name: str) -> DataFrame:
    """What a query over the events' files as streams writes, and is read back with its columns."""
    folder = scratch(spark)
    load(spark, d, "events").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{folder}/events")
    out = made(stream)
    out.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/{name}")


@query(
    "R07_event_pairs",
    "SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR",
)
def _(spark, d):
    """Two streams of the events joined on the user and on time."""
    return _event_stream(spark, d, lambda e: logs.pairs_within(e, e, "6 hours"), "pairs").select("user_id", "first_id", "second_id")


@query("W04_elapsed_of_events", f"WITH e AS ({_EVENT}) SELECT stage, max(seconds) AS longest FROM e WHERE event IN ('phase_end', 'zoom_end') GROUP BY 1")
def _(spark, d):
    return _events(spark, d).where("event IN ('phase_end', 'zoom_end')").groupBy("stage").agg(F.max("seconds").alias("longest"))
