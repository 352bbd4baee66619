"""Further queries: predicates, ordering, catalogues, options and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import elevation as E
from .functions import text as X
from .functions import tiles as G
from .operators import archive, catalog, options, profile, raster, tiling
from .queries import _LINE, _STEP, _line, _KINDED, _MIRRORS, _builds, _c, _mirrors, query
from .session import load
from .streaming.logs import tail
from .views import view

# --- predicates and orders -----------------------------------------------------


@query("F02_zoom_filter", "SELECT zoom_level, tile_column, tile_row, nbytes FROM fx_tiles WHERE zoom_level <= 6")
def _(spark, d):
    return archive.at_zooms(view(spark, d, "fx_tiles"), 6).select(*archive.ADDRESS, "nbytes")


@query("F12_own_files", "SELECT file_id, file_name FROM fx_files WHERE starts_with(file_name, area)")
def _(spark, d):
    return catalog.own_files(view(spark, d, "fx_files")).select("file_id", "file_name")


@query("F13_gzip_magic", "SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS gzip FROM supplier")
def _(spark, d):
    blob = F.when(F.col("s_suppkey") % 3 == 0, F.lit(bytearray(b"\x1f\x8b\x08"))).otherwise(F.col("s_name").cast("binary"))
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.gzip_magic(blob).alias("gzip"))


@query("F14_finite_only", "SELECT line_id, seq, elevation_m FROM fx_profile WHERE seq % 5 <> 0")
def _(spark, d):
    e = F.when(F.col("seq") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("elevation_m"))
    return raster.finite(view(spark, d, "fx_profile").withColumn("elevation_m", e), "elevation_m").select("line_id", "seq", "elevation_m")


@query("F16_contour_zoom", "SELECT gx, gy, priority, z.zoom FROM fx_pixels, (VALUES (8, 200), (10, 100), (12, 20)) z(zoom, least) WHERE elev % least = 0 AND NOT (zoom = 8 AND elev % 500 = 0 AND elev % 1000 <> 0)")
def _(spark, d):
    rows = view(spark, d, "fx_pixels").withColumn("zoom", F.explode(F.array(*map(F.lit, (8, 10, 12)))))
    return rows.where(E.contour_shown(F.col("elev"), F.col("zoom"))).select("gx", "gy", "priority", "zoom")


@query("F17_wanted_layers", "SELECT DISTINCT layer, field FROM fx_fields WHERE field IN ('Brand#11', 'Brand#22', 'Brand#33') AND field <> 'Brand#22'")
def _(spark, d):
    return archive.wanted_layers(view(spark, d, "fx_fields"), "field", "Brand#11,Brand#22,Brand#33", "Brand#22").select("layer", "field").distinct()


@query("F19_addable", f"SELECT file_id, file_name FROM ({_KINDED}) k WHERE NOT EXISTS (SELECT 1 FROM fx_files o WHERE o.file_id % 2 = 0 AND o.file_name = k.file_name)")
def _(spark, d):
    files = view(spark, d, "fx_files")
    c = catalog.described(files).withColumn("format", F.lit("pbf"))
    return catalog.addable(c, files.where("file_id % 2 = 0")).select("file_id", "file_name")


@query("O02_catalogue_order", f"SELECT file_id, row_number() OVER (ORDER BY variant IS NOT NULL, file_name, file_id) AS place FROM ({_KINDED}) WHERE kind = 'terrain'")
def _(spark, d):
    c = catalog.described(view(spark, d, "fx_files")).where("kind = 'terrain'")
    return catalog.ordered(c, "kind", "file_id").select("file_id", "place")


@query("O04_rank_by_cost", "SELECT field, n, row_number() OVER (ORDER BY n DESC, field) AS rank FROM (SELECT field, count(*) AS n FROM fx_fields GROUP BY 1)")
def _(spark, d):
    return archive.ranked(view(spark, d, "fx_fields").groupBy("field").agg(F.count(F.lit(1)).alias("n")), "n", "field")


@query("O07_graph_tile_order", "SELECT DISTINCT cast(floor((lon + 180) / deg) AS bigint) AS x, cast(floor((lat + 90) / deg) AS bigint) AS y, level FROM fx_points, (VALUES (0, 4.0), (1, 1.0), (2, 0.25)) l(level, deg)")
def _(spark, d):
    return tiling.graph_tiles_at(view(spark, d, "fx_points"))


@query("O13_log_tail", "SELECT line_no, line FROM (SELECT * FROM fx_log ORDER BY line_no DESC LIMIT 400) ORDER BY line_no DESC LIMIT 25")
def _(spark, d):
    return tail(view(spark, d, "fx_log")).select("line_no", "line")


@query("O12_level_choice", "SELECT coalesce((SELECT level FROM (SELECT DISTINCT priority AS level, 10.0 * power(2, priority) AS scale FROM fx_pixels) WHERE scale <= (SELECT avg(elev) / 10 FROM fx_pixels) ORDER BY scale DESC LIMIT 1), 0) AS level")
def _(spark, d):
    """Of overviews with the priorities' numbers, the one for a resolution that the elevations say."""
    pixels = view(spark, d, "fx_pixels")
    levels = pixels.select(F.col("priority").alias("level"), (10.0 * F.pow(F.lit(2.0), "priority")).alias("scale")).distinct()
    target = pixels.agg((F.avg("elev") / 10).alias("target"))
    return raster.level_choice(levels.crossJoin(F.broadcast(target)), F.col("target"))


@query("U08_all_areas", "SELECT DISTINCT area FROM (SELECT area FROM fx_files UNION SELECT lower(n_name) FROM nation)")
def _(spark, d):
    return view(spark, d, "fx_files").select("area").union(load(spark, d, "nation").select(F.lower("n_name"))).distinct()


@query("U06_extras", "SELECT DISTINCT zoom_level, tile_column, tile_row FROM fx_tiles WHERE build = 'a' AND zoom_level = 8 EXCEPT SELECT zoom_level, tile_column, tile_row FROM fx_tiles WHERE build = 'b'")
def _(spark, d):
    a, b = _builds(spark, d, "fx_tiles")
    return archive.tiles_only_in(a.where("zoom_level = 8").select(*archive.ADDRESS).distinct(), b)


# --- tile math -------------------------------------------------------------------


@query(
    "G04_tile_range_shrunk",
    """WITH b AS (SELECT box_id, west + 1e-10 AS w, greatest(least(south + 1e-10, 85.0), -85.0) AS s, east - 1e-10 AS e, greatest(least(north - 1e-10, 85.0), -85.0) AS n FROM fx_boxes)
SELECT box_id, cast(floor((w + 180.0) / 360.0 * 256) AS bigint) AS x0, cast(floor((1.0 - ln(tan(radians(n)) + 1.0 / cos(radians(n))) / pi()) / 2.0 * 256) AS bigint) AS y0,
  cast(floor((e + 180.0) / 360.0 * 256) AS bigint) AS x1, cast(floor((1.0 - ln(tan(radians(s)) + 1.0 / cos(radians(s))) / pi()) / 2.0 * 256) AS bigint) AS y1 FROM b""",
)
def _(spark, d):
    r = G.tile_range(*_c("west", "south", "east", "north"), F.lit(8), 1e-10, 85.0)
    return view(spark, d, "fx_boxes").select("box_id", *[v.alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"))])


@query(
    "G06_pixel_centre",
    """SELECT DISTINCT gx, gy, round((gx * 256 + 7 + 0.5) / (64 * 256) * 360.0 - 180.0, 6) AS lon, round(degrees(atan(sinh(pi() * (1.0 - 2.0 * (gy * 256 + 9 + 0.5) / (64 * 256))))), 6) AS lat FROM fx_pixels""",
)
def _(spark, d):
    lon, lat = G.pixel_centre(F.col("gx"), F.col("gy"), F.lit(7), F.lit(9), F.lit(6), 256)
    return view(spark, d, "fx_pixels").select("gx", "gy").distinct().select("gx", "gy", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("G18_graph_box", "SELECT box_id, box_id * 0.25 - 180.0 AS west, box_id * 0.25 - 90.0 AS south, (box_id + 1) * 0.25 - 180.0 AS east, (box_id + 1) * 0.25 - 90.0 AS north FROM (SELECT box_id, cast(0 AS double) FROM fx_boxes)")
def _(spark, d):
    box = G.graph_box(F.col("box_id"), F.col("box_id"), F.lit(2))
    return view(spark, d, "fx_boxes").select("box_id", *[v.alias(n) for v, n in zip(box, ("west", "south", "east", "north"))])


@query("G23_parse_bounds", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN cast(n_nationkey AS double) END AS west FROM nation")
def _(spark, d):
    key = F.col("n_nationkey").cast("string")
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(key, F.lit(", 1,2 ,3"))).when(F.col("n_nationkey") % 3 == 1, F.concat(key, F.lit(",1,2"))).otherwise(F.lit("a,b,c,d"))
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), G.parse_bounds(text)[0].alias("west"))


@query("G24_clamp_bounds", "SELECT point_id, greatest(least(lon * 2, 180.0), -180.0) AS west, greatest(least(lat * 2, 85.0), -85.0) AS south FROM fx_points")
def _(spark, d):
    west, south, _, _ = G.clamp_bounds(F.col("lon") * 2, F.col("lat") * 2, F.col("lon"), F.col("lat"))
    return view(spark, d, "fx_points").select("point_id", west.alias("west"), south.alias("south"))


@query("G22_box_centre", "SELECT box_id, round((west + east) / 2, 6) AS lon, round((south + north) / 2, 6) AS lat FROM fx_boxes")
def _(spark, d):
    lon, lat = G.box_centre(*_c("west", "south", "east", "north"))
    return view(spark, d, "fx_boxes").select("box_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


# --- elevation -------------------------------------------------------------------


@query("T10_tile_cover", """SELECT box_id, cast(x AS bigint) AS x, cast(y AS bigint) AS y FROM (SELECT box_id, floor((west + 180.0) / 360.0 * 64) AS x0, floor((1.0 - ln(tan(radians(north)) + 1.0 / cos(radians(north))) / pi()) / 2.0 * 64) AS y0,
  floor((east + 180.0) / 360.0 * 64) AS x1, floor((1.0 - ln(tan(radians(south)) + 1.0 / cos(radians(south))) / pi()) / 2.0 * 64) AS y1 FROM fx_boxes),
  unnest(generate_series(cast(greatest(x0 - 1, 0) AS bigint), cast(least(x1 + 1, 63) AS bigint))) a(x), unnest(generate_series(cast(greatest(y0 - 1, 0) AS bigint), cast(least(y1 + 1, 63) AS bigint))) b(y)""")
def _(spark, d):
    return tiling.cover_boxes(view(spark, d, "fx_boxes"), 6, 1).select("box_id", "x", "y")


@query("T12_macrotiles", "SELECT zoom_level, tile_column // 8 AS mx, tile_row // 8 AS my, count(*) AS tiles FROM fx_tiles GROUP BY 1, 2, 3")
def _(spark, d):
    return tiling.macrotiles(view(spark, d, "fx_tiles"), 8)


@query("T20_cross_fade", "SELECT a.gx, a.gy, round(greatest(a.elev * (1 - 0.25) + (b.elev - 3000) * 0.25, -10.0), 6) AS elev FROM fx_pixels a JOIN fx_pixels b ON a.gx = b.gx AND a.gy = b.gy AND a.priority = 1 AND b.priority = 2")
def _(spark, d):
    px = view(spark, d, "fx_pixels")
    both = px.where("priority = 1").select("gx", "gy", F.col("elev").alias("a")).join(px.where("priority = 2").select("gx", "gy", F.col("elev").alias("b")), ["gx", "gy"])
    return both.select("gx", "gy", F.round(E.cross_fade(F.col("a"), F.col("b") - 3000, F.lit(0.25)), 6).alias("elev"))


@query("T24_refine_factor", "SELECT DISTINCT l_linenumber AS n, greatest(cast(ceil(l_linenumber / 3.0) AS bigint), 1) AS factor FROM lineitem")
def _(spark, d):
    n = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return n.withColumn("factor", E.refine_factor(F.col("n"), F.lit(3.0)))


@query("A22_ring_coverage", """WITH c AS (SELECT DISTINCT gx, gy FROM fx_pixels WHERE priority = 3), p AS (SELECT DISTINCT gx, gy FROM fx_pixels),
  r AS (SELECT * FROM (VALUES (0, 0), (4, 0), (3, 3), (0, 4), (-3, 3), (-4, 0), (-3, -3), (0, -4), (3, -3)) v(dx, dy))
SELECT p.gx, p.gy, round(avg(CASE WHEN c.gx IS NULL THEN 0.0 ELSE 1.0 END), 9) AS weight FROM p CROSS JOIN r LEFT JOIN c ON c.gx = p.gx + dx AND c.gy = p.gy + dy GROUP BY 1, 2""")
def _(spark, d):
    px = view(spark, d, "fx_pixels")
    points = px.select("gx", "gy").distinct()
    return raster.ring_coverage(points, px.where("priority = 3"), 4).withColumn("weight", F.round("weight", 9))


@query("A23_box_blur", """WITH g AS (SELECT x AS gx, y AS gy, CASE WHEN EXISTS (SELECT 1 FROM fx_pixels p WHERE p.priority = 4 AND p.gx = x AND p.gy = y) THEN 1.0 ELSE 0.0 END AS w FROM range(64) a(x), range(64) b(y)),
  h AS (SELECT g.gx, g.gy, avg(o.w) AS w FROM g, range(-2, 3) s(k), g o WHERE o.gy = g.gy AND o.gx = least(greatest(g.gx + k, 0), 63) GROUP BY 1, 2)
SELECT g.gx, g.gy, round(avg(o.w), 6) AS w FROM h g, range(-2, 3) s(k), h o WHERE o.gx = g.gx AND o.gy = least(greatest(g.gy + k, 0), 63) GROUP BY 1, 2""")
def _(spark, d):
    grid = spark.range(64).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("gy"))
    has = view(spark, d, "fx_pixels").where("priority = 4").select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.lit(1.0).alias("w"))
    return raster.box_blur(grid.join(has, ["gx", "gy"], "left").fillna(0.0, ["w"]), 2, passes=1).withColumn("w", F.round("w", 6))


# --- names and documents -----------------------------------------------------------


@query("X03_formats", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'pbf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'other' END AS format, CASE c_custkey % 4 WHEN 0 THEN 'application/x-protobuf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' ELSE 'application/octet-stream' END AS content_type FROM customer")
def _(spark, d):
    text = F.element_at(F.array(F.lit(" MVT"), F.lit("jpeg "), F.lit("WebP"), F.lit("Other")), (F.col("c_custkey") % 4 + 1).cast("int"))
    out = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.normal_format(text).alias("format"))
    return out.withColumn("content_type", X.content_type(F.col("format")))


@query("X11_banner_phase", "SELECT line_no, CASE WHEN line_no % 2 = 0 THEN concat('phase ', cast(line_no AS varchar)) END AS phase FROM fx_log")
def _(spark, d):
    line = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("[INFO] phase "), F.col("line_no").cast("string"))).otherwise(F.lit("[WARN] Building"))
    return view(spark, d, "fx_log").select("line_no", X.banner_phase(line).alias("phase"))


@query("X12_java_version", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN cast(s_suppkey AS int) ELSE cast(s_suppkey % 9 AS int) END AS major FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    text = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0.11"))).otherwise(F.concat(F.lit("1."), (k % 9).cast("string"), F.lit(".0_452")))
    return load(spark, d, "supplier").select(k.alias("id"), X.java_major(text).alias("major"))


@query("X25_md5", "SELECT doc_id, doc_id % 2 = 0 AS ok FROM documents")
def _(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.md5(F.col("doc_id").cast("string"))).otherwise(F.lit("no md5"))
    return load(spark, d, "documents").select("doc_id", X.is_md5(text).alias("ok"))


@query("X26_extract_name", "SELECT c_custkey AS id, replace(lower(replace(c_name, '#', '-')), '-', '_') AS name FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.extract_name(F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("name"))


@query("X28_symbol_ids", "SELECT feature_id, dense_rank() OVER (ORDER BY field) AS symbol FROM fx_fields")
def _(spark, d):
    return catalog.symbol_ids(view(spark, d, "fx_fields"), "field").select("feature_id", F.col("symbol_id").alias("symbol"))


@query("X30_drop_equal_subclass", "SELECT feature_id, nullif(layer, CASE WHEN feature_id % 2 = 0 THEN layer ELSE field END) AS subclass FROM fx_fields")
def _(spark, d):
    return view(spark, d, "fx_fields").select("feature_id", F.nullif(F.col("layer"), F.when(F.col("feature_id") % 2 == 0, F.col("layer")).otherwise(F.col("field"))).alias("subclass"))


@query("X16_typed_options", "SELECT name AS key, value, CASE WHEN name < 'k2' THEN 'int' ELSE 'text' END AS kind, name >= 'k2' AS ok FROM fx_meta WHERE build = 'a'")
def _(spark, d):
    a, _ = _builds(spark, d, "fx_meta")
    values = a.select(F.col("name").alias("key"), "value")
    schema = values.select("key", F.when(F.col("key") < "k2", "int").otherwise("text").alias("kind"))
    return options.typed(values, schema)


@query("P03_step_status", """WITH f AS (SELECT c_custkey AS step, c_custkey % 4 AS m FROM customer)
SELECT step, CASE m WHEN 0 THEN 'missing' WHEN 1 THEN 'untracked' WHEN 2 THEN 'options_changed' ELSE 'built' END AS status FROM f""")
def _(spark, d):
    f = load(spark, d, "customer").select(F.col("c_custkey").alias("step"), (F.col("c_custkey") % 4).alias("m"))
    path = F.col("step").cast("string")
    outputs = f.select("step", path.alias("path"))
    listing = f.where("m <> 0").select(path.alias("path"), F.lit(10).cast("long").alias("size"))
    record = f.where("m >= 2").select("step", F.lit("maxzoom").alias("name"), F.lit("14").alias("value"))
    current = f.where("m >= 2").select("step", F.lit("maxzoom").alias("name"), F.when(F.col("m") == 2, "13").otherwise("14").alias("value"))
    return options.step_status(outputs, listing, record, current)


@query("S21_extract_paths", "SELECT n_name AS id, concat(r_name, '/', n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM region")
def _(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    own = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent"))
    return catalog.extract_paths(own.union(r.select("r_name", F.lit(None).cast("string"))))


@query("S26_archive_parts", "SELECT concat('n', cast(n_regionkey AS varchar)) AS stem, count(*) AS parts, cast(sum(n_nationkey) AS bigint) AS bytes FROM nation GROUP BY 1")
def _(spark, d):
    name = F.format_string("n%d.7z.%03d", F.col("n_regionkey").cast("int"), F.col("n_nationkey").cast("int"))
    listing = load(spark, d, "nation").select(name.alias("name"), F.col("n_nationkey").cast("long").alias("size"))
    return catalog.archive_groups(listing).withColumn("parts", F.size("parts").cast("long"))


@query("S41_files_that_exist", "SELECT DISTINCT cast(floor(lon) AS bigint) AS lon, cast(floor(lat) AS bigint) AS lat FROM fx_points p WHERE EXISTS (SELECT 1 FROM fx_boxes b, unnest(generate_series(cast(floor(west) AS bigint), greatest(cast(ceil(east) AS bigint) - 1, cast(floor(west) AS bigint)))) x(a), unnest(generate_series(cast(floor(south) AS bigint), greatest(cast(ceil(north) AS bigint) - 1, cast(floor(south) AS bigint)))) y(o) WHERE a = floor(p.lon) AND o = floor(p.lat))")
def _(spark, d):
    files = view(spark, d, "fx_points").select(G.floor(F.col("lon")).alias("lon"), G.floor(F.col("lat")).alias("lat")).distinct()
    return tiling.degree_files(view(spark, d, "fx_boxes"), files)


@query("O06_mirror_order", f"WITH m AS ({_MIRRORS.format(s='varchar', t='orders')}) SELECT mirror, row_number() OVER (PARTITION BY hash ORDER BY date, file_len, mirror) AS place FROM m")
def _(spark, d):
    return catalog.mirror_order(_mirrors(spark, d), "hash", "mirror").select("mirror", "place")


@query("K09_tile_responses", """WITH r AS (SELECT event_id AS id, 6 AS z, event_id % 64 AS x, event_id % 70 AS y, CASE WHEN event_id % 10 = 0 THEN 'none' ELSE 'a' END AS name FROM events),
  t AS (SELECT DISTINCT tile_column AS x, tile_row FROM fx_tiles WHERE zoom_level = 6 AND build = 'a')
SELECT id, CASE WHEN name = 'none' THEN 404 WHEN y > 63 THEN 400 WHEN t.x IS NULL THEN 204 ELSE 200 END AS status FROM r LEFT JOIN t ON t.x = r.x AND t.tile_row = 63 - r.y""")
def _(spark, d):
    asked = load(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(6).alias("z"), (F.col("event_id") % 64).alias("x"), (F.col("event_id") % 70).alias("y"), F.when(F.col("event_id") % 10 == 0, "none").otherwise("a").alias("name"))
    a, _ = _builds(spark, d, "fx_tiles")
    tiles = a.where("zoom_level = 6").select(*archive.ADDRESS).distinct().withColumns({"name": F.lit("a"), "tile_data": F.lit(bytearray(b"\x1f\x8b"))})
    known = spark.createDataFrame([("a", "pbf")], "name string, format string")
    answers = catalog.tile_responses(asked.select("name", "z", "x", "y").distinct(), known, tiles)
    return asked.join(answers, ["name", "z", "x", "y"]).select("id", "status")


@query("W10_latest_status", "SELECT user_id AS step, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("step"), "event_id", F.col("event_type").alias("status"), "value")
    return options.latest_status(rows, "step", "event_id", ["status", "value"])


@query("A24_newest_change", "SELECT event_type, cast(floor(epoch(max(ts))) AS bigint) AS newest FROM events GROUP BY 1")
def _(spark, d):
    return catalog.newest_change(load(spark, d, "events"), "event_type", "ts").withColumn("newest", F.unix_timestamp("newest"))


@query("A25_visible_layers", "SELECT layer, count(*) FILTER (value_id % 2 = 0) AS shown, count(*) AS total FROM fx_fields GROUP BY 1")
def _(spark, d):
    return catalog.visible_layers(view(spark, d, "fx_fields"), "layer", F.col("value_id") % 2 == 0)


@query("A29_grouped_options", "SELECT layer, string_agg(field, ',' ORDER BY seq) AS fields FROM (SELECT layer, field, min(feature_id) AS seq FROM fx_fields GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return options.grouped_options(view(spark, d, "fx_fields"), "layer", "field", "feature_id").select("layer", F.array_join("options", ",").alias("fields"))


@query("J16_manoeuvre_points", """WITH p AS (SELECT line_id, seq, elevation_m, max(seq) OVER (PARTITION BY line_id) AS last FROM fx_profile)
SELECT line_id, m.k AS manoeuvre, elevation_m FROM p JOIN (VALUES (0, 1), (1, 40), (2, 100000)) m(k, spot) ON p.seq = least(m.spot, p.last)""")
def _(spark, d):
    points = view(spark, d, "fx_profile").select("line_id", "seq", "elevation_m")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, at in ((0, 1), (1, 40), (2, 100000))])).alias("m")
    manoeuvres = points.select("line_id").distinct().select("line_id", asked).select("line_id", F.col("m.k").alias("manoeuvre"), F.col("m.at").alias("spot"))
    return profile.manoeuvre_points(manoeuvres, points).select("line_id", "manoeuvre", "elevation_m")


@query("R04_event_windows", "SELECT cast(epoch(time_bucket(INTERVAL '1 day', ts)) AS bigint) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def _(spark, d):
    from .streaming.logs import windowed_counts

    return windowed_counts(load(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "events")


@query("W02_profile_segments", "SELECT line_id, seq, lead(seq) OVER (PARTITION BY line_id ORDER BY seq) AS next FROM fx_profile")
def _(spark, d):
    return profile.segments(view(spark, d, "fx_profile"), ["seq"]).select("line_id", "seq", F.col("next_seq").alias("next"))


@query("S33_vector_tile_round_trip", "SELECT feature_id, 'k' AS key, field AS value FROM fx_fields")
def _(spark, d):
    """Tags of small vector tiles, made from field names and decoded again."""
    from .sources.vectors import register

    register(spark)
    text = F.substring("field", 1, 20)
    size = lambda b: F.unhex(F.lpad(F.hex(F.octet_length(b)), 2, "0"))
    part = lambda tag, b: F.concat(F.lit(bytearray([tag])), size(b), b)
    value = part(0x22, part(0x0A, text.cast("binary")))
    feature = F.lit(bytearray(b"\x12\x06\x12\x02\x00\x00\x18\x01"))
    layer = F.concat(F.lit(bytearray(b"\x0a\x01x")), feature, F.lit(bytearray(b"\x1a\x01k")), value)
    rows = view(spark, d, "fx_fields").select("feature_id", part(0x1A, layer).alias("tile_data"))
    return spark.sql("SELECT t.feature_id, d.key, d.value FROM {t} t, LATERAL decode_tile(t.tile_data) d", t=rows)


@query("X27_gzip_round_trip", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def _(spark, d):
    from .sources.grids import pack_blobs, unpack_blobs

    blobs = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").cast("binary").alias("tile_data"))
    return unpack_blobs(pack_blobs(blobs)).select("id", F.col("tile_data").cast("string").alias("name"))


@query("W01_trip_offsets", "SELECT trip, count(*) AS legs, cast(max(before) AS bigint) AS last_offset FROM (SELECT o_custkey AS trip, coalesce(sum(o_orderkey % 9 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) GROUP BY 1")
def _(spark, d):
    legs = load(spark, d, "orders").select(F.col("o_custkey").alias("trip_id"), F.col("o_orderkey").alias("leg"), (F.col("o_orderkey") % 9 + 2).alias("size"))
    return profile.running_offset(legs).groupBy(F.col("trip_id").alias("trip")).agg(F.count(F.lit(1)).alias("legs"), F.max("offset").alias("last_offset"))


@query("W01_leg_lengths", f"WITH p AS ({_LINE}), s AS (SELECT line_id, seq, coalesce({_STEP}, 0) AS step FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq)), d AS (SELECT line_id, seq, sum(step) OVER (PARTITION BY line_id ORDER BY seq) AS distance_m FROM s) SELECT line_id, cast(seq // 10 AS bigint) AS leg, round(max(distance_m) - min(distance_m), 4) AS length_m FROM d GROUP BY 1, 2")
def _(spark, d):
    """Lines cut into legs of ten points, each as long as the line gets longer on it."""
    far = profile.with_distance(_line(spark, d)).groupBy("line_id", F.floor(F.col("seq") / 10).alias("leg"))
    return far.agg(F.round(F.max("distance_m") - F.min("distance_m"), 4).alias("length_m"))
