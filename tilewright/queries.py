"""Queries over the driver's tables, each with the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import elevation as E
from .functions import text as X
from .functions import tiles as G
from .operators import archive, catalog, geometry, masks, options, profile, raster
from .plans import steps
from .session import load
from .streaming import logs
from .views import checked, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = checked(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from . import more_queries, shape_queries, source_queries  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more_queries, shape_queries, source_queries  # noqa: F401

    return dict(_SQL)


def _c(*names: str):
    return tuple(F.col(n) for n in names)


def _builds(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    v = view(spark, sf_dir, name)
    return v.where("build = 'a'").drop("build"), v.where("build = 'b'").drop("build")


def _tiles(build: str) -> str:
    return f"(SELECT DISTINCT zoom_level, tile_column, tile_row FROM fx_tiles WHERE build = '{build}')"


# --- archives ----------------------------------------------------------------


@query("A01_zoom_stats", "SELECT zoom_level, count(*) AS tiles, cast(sum(nbytes) AS bigint) AS bytes FROM fx_tiles GROUP BY zoom_level")
def _(spark, d):
    return archive.zoom_stats(view(spark, d, "fx_tiles"))


@query(
    "A02_archive_totals",
    """SELECT count(*) AS tiles, cast(coalesce(sum(octet_length(encode(text))), 0) AS bigint) AS bytes,
  (SELECT count(DISTINCT text) FROM documents) AS unique_tiles,
  (SELECT cast(coalesce(sum(octet_length(encode(t))), 0) AS bigint) FROM (SELECT DISTINCT text AS t FROM documents)) AS unique_bytes,
  round(1.0 - (SELECT count(DISTINCT text) FROM documents) / count(*), 9) AS dedup_ratio FROM documents""",
)
def _(spark, d):
    docs = load(spark, d, "documents").select("text", F.octet_length("text").alias("nbytes"))
    blobs = archive.distinct_blobs(docs, "text", ["nbytes"])
    return archive.archive_totals(docs, blobs).withColumn("dedup_ratio", F.round("dedup_ratio", 9))


@query(
    "A06_zoom_delta",
    """WITH a AS (SELECT zoom_level, count(*) AS t, cast(sum(nbytes) AS bigint) AS n FROM fx_tiles WHERE build = 'a' GROUP BY 1),
  b AS (SELECT zoom_level, count(*) AS t, cast(sum(nbytes) AS bigint) AS n FROM fx_tiles WHERE build = 'b' AND zoom_level <> 7 GROUP BY 1)
SELECT coalesce(a.zoom_level, b.zoom_level) AS zoom_level, coalesce(a.t, 0) AS tiles_a, cast(coalesce(a.n, 0) AS bigint) AS bytes_a, coalesce(b.t, 0) AS tiles_b, cast(coalesce(b.n, 0) AS bigint) AS bytes_b,
  round(CASE WHEN coalesce(a.n, 0) > 0 THEN (coalesce(b.n, 0) - a.n) / a.n * 100.0 END, 6) AS change_pct FROM a FULL JOIN b ON a.zoom_level = b.zoom_level""",
)
def _(spark, d):
    a, b = _builds(spark, d, "fx_tiles")
    return archive.zoom_delta(a, b.where("zoom_level <> 7")).withColumn("change_pct", F.round("change_pct", 6))


@query("A07_byte_share", "SELECT zoom_level, count(*) AS tiles, cast(sum(nbytes) AS bigint) AS bytes, round(sum(nbytes) / (SELECT sum(nbytes) FROM fx_tiles), 9) AS share FROM fx_tiles GROUP BY 1")
def _(spark, d):
    return archive.byte_share(archive.zoom_stats(view(spark, d, "fx_tiles"))).withColumn("share", F.round("share", 9))


@query("A08_max_zoom", "SELECT least(max(zoom_level), 10) AS max_zoom FROM fx_tiles")
def _(spark, d):
    return archive.max_zoom(view(spark, d, "fx_tiles"), 10)


@query(
    "A09_attr_cost",
    """WITH v AS (SELECT build AS tile, layer, field AS key, cast(value_id AS varchar) AS value FROM fx_fields)
SELECT k.key, cast(key_bytes AS bigint) AS key_bytes, cast(value_bytes AS bigint) AS value_bytes, tag_bytes, cast(key_bytes + value_bytes + tag_bytes AS bigint) AS total_bytes FROM
  (SELECT key, sum(octet_length(encode(key))) AS key_bytes FROM (SELECT DISTINCT tile, layer, key FROM v) GROUP BY 1) k
  JOIN (SELECT key, sum(octet_length(encode(value))) AS value_bytes FROM (SELECT DISTINCT tile, layer, key, value FROM v) GROUP BY 1) o ON k.key = o.key
  JOIN (SELECT key, 2 * count(*) AS tag_bytes FROM v GROUP BY 1) t ON k.key = t.key""",
)
def _(spark, d):
    v = view(spark, d, "fx_fields").select(F.col("build").alias("tile"), "layer", F.col("field").alias("key"), F.col("value_id").cast("string").alias("value"))
    return archive.attribute_cost(v)


@query(
    "A10_layer_pivot",
    """SELECT l_linestatus AS layer, cast(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS bigint) AS A,
  cast(coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS bigint) AS N, cast(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS bigint) AS R
FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("layer"), F.col("l_returnflag").alias("v"), F.col("l_quantity").cast("long").alias("n"))
    return archive.layer_pivot(rows, "layer", "v", "n", ["A", "N", "R"])


@query(
    "A11_size_ladder",
    """WITH s AS (SELECT l_returnflag AS variant, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS bytes FROM lineitem GROUP BY 1)
SELECT variant, bytes, round(bytes / (SELECT bytes FROM s WHERE variant = 'N') * 100.0, 6) AS percent FROM s""",
)
def _(spark, d):
    s = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("variant")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    return archive.size_ladder(s, "variant", "N").withColumn("percent", F.round("percent", 6))


@query(
    "A17_package_report",
    """SELECT count(*) AS written, cast(sum(nbytes) AS bigint) AS raw_bytes, cast(sum(nbytes // 3) AS bigint) AS packed_bytes, round(sum(nbytes // 3) / sum(nbytes), 9) AS ratio FROM fx_tiles""",
)
def _(spark, d):
    t = view(spark, d, "fx_tiles").withColumn("packed", F.expr("nbytes div 3"))
    return archive.package_report(t, "nbytes", "packed").withColumn("ratio", F.round("ratio", 9))


_MIRRORS = "SELECT o_orderkey AS mirror, concat('h', cast(o_custkey % 5 AS {s})) AS hash, cast(o_orderdate AS date) AS date, cast(floor(o_totalprice) AS bigint) % 7 AS file_len FROM {t}"


def _mirrors(spark, d):
    return spark.sql(_MIRRORS.format(s="string", t="{orders}"), orders=load(spark, d, "orders"))


@query(
    "A18_best_hash",
    f"""WITH m AS ({_MIRRORS.format(s="varchar", t="orders")}), g AS (SELECT hash, count(*) AS n, max(date) AS date FROM m GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY date DESC, hash) AS k FROM g)
SELECT CASE WHEN b.n IS NOT NULL AND 1.5 * a.n < b.n THEN b.hash ELSE a.hash END AS hash FROM (SELECT * FROM r WHERE k = 1) a LEFT JOIN (SELECT * FROM r WHERE k = 2) b ON true""",
)
def _(spark, d):
    return archive.best_hash(_mirrors(spark, d))


@query("A19_unique_or_null", f"WITH m AS ({_MIRRORS.format(s='varchar', t='orders')}) SELECT hash, CASE WHEN count(DISTINCT file_len) = 1 THEN max(file_len) END AS file_len FROM m GROUP BY 1")
def _(spark, d):
    return archive.unique_or_null(_mirrors(spark, d), "hash", "file_len")


@query("A20_ring_bounds", "SELECT point_id // 20 AS ring_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM fx_points GROUP BY 1")
def _(spark, d):
    return geometry.bounding_box(view(spark, d, "fx_points").withColumn("ring_id", F.floor(F.col("point_id") / 20)), ["ring_id"])


@query("J01_compact_view", "SELECT t.tile_data_id, zoom_level, tile_column, tile_row, nbytes, build, tile_data FROM fx_tiles t JOIN fx_blobs b ON t.tile_data_id = b.tile_data_id")
def _(spark, d):
    return archive.compact_view(view(spark, d, "fx_tiles"), view(spark, d, "fx_blobs"))


@query("J02_keep_common_tiles", f"SELECT zoom_level, tile_column, tile_row FROM {_tiles('a')} INTERSECT SELECT zoom_level, tile_column, tile_row FROM {_tiles('b')}")
def _(spark, d):
    a, b = _builds(spark, d, "fx_tiles")
    return archive.common_tiles(a.select(*archive.ADDRESS).distinct(), b)


@query("J03_orphan_blobs", "SELECT tile_data_id, tile_data FROM fx_blobs WHERE tile_data_id NOT IN (SELECT tile_data_id FROM fx_tiles)")
def _(spark, d):
    return archive.orphan_blobs(view(spark, d, "fx_blobs"), view(spark, d, "fx_tiles"))


@query("U01_tiles_only_in_a", "SELECT zoom_level, tile_column, tile_row, nbytes FROM fx_tiles t WHERE build = 'a' AND NOT EXISTS (SELECT 1 FROM fx_tiles o WHERE o.build = 'b' AND o.zoom_level = t.zoom_level AND o.tile_column = t.tile_column AND o.tile_row = t.tile_row)")
def _(spark, d):
    a, b = _builds(spark, d, "fx_tiles")
    return archive.tiles_only_in(a, b).select(*archive.ADDRESS, "nbytes")


@query(
    "J06_metadata_diff",
    """SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_in_a' WHEN a.name IS NULL THEN 'only_in_b' ELSE 'changed' END AS change, a.value AS value_a, b.value AS value_b
FROM (SELECT * FROM fx_meta WHERE build = 'a') a FULL JOIN (SELECT * FROM fx_meta WHERE build = 'b') b ON a.name = b.name WHERE a.value IS DISTINCT FROM b.value""",
)
def _(spark, d):
    return archive.map_diff(*_builds(spark, d, "fx_meta"))


@query(
    "J07_layer_diff",
    """WITH a AS (SELECT DISTINCT layer, field FROM fx_fields WHERE build = 'a'), b AS (SELECT DISTINCT layer, field FROM fx_fields WHERE build = 'b'),
  x AS (SELECT coalesce(a.layer, b.layer) AS layer, a.field AS fa, b.field AS fb FROM a FULL JOIN b ON a.layer = b.layer AND a.field = b.field WHERE a.field IS NULL OR b.field IS NULL)
SELECT layer, coalesce(string_agg(fa, ',' ORDER BY fa), '') AS only_in_a, coalesce(string_agg(fb, ',' ORDER BY fb), '') AS only_in_b FROM x GROUP BY 1""",
)
def _(spark, d):
    out = archive.field_diff(*_builds(spark, d, "fx_fields"))
    return out.select("layer", F.array_join("only_in_a", ",").alias("only_in_a"), F.array_join("only_in_b", ",").alias("only_in_b"))


@query(
    "J13_parent_rollup",
    """SELECT zoom_level - 1 AS zoom_level, tile_column // 2 AS tile_column, tile_row // 2 AS tile_row, count(DISTINCT (tile_column % 2) * 2 + tile_row % 2) AS children, count(*) AS tiles, cast(sum(nbytes) AS bigint) AS bytes
FROM fx_tiles WHERE zoom_level > 0 GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return archive.parent_rollup(view(spark, d, "fx_tiles"))


@query(
    "K13_replace_merge",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY zoom_level, tile_column, tile_row ORDER BY build DESC, nbytes, tile_data_id) AS k FROM fx_tiles)
SELECT zoom_level, tile_column, tile_row, tile_data_id, nbytes FROM r WHERE k = 1""",
)
def _(spark, d):
    a, b = _builds(spark, d, "fx_tiles")
    return archive.replace_merge(a, b, order=[F.col("nbytes"), F.col("tile_data_id")])


@query(
    "U05_wanted_with_children",
    f"""WITH w AS (SELECT * FROM {_tiles('a')} WHERE zoom_level < 7), s AS (SELECT * FROM {_tiles('b')}),
  l AS (SELECT * FROM w EXCEPT SELECT * FROM s)
SELECT * FROM w UNION SELECT zoom_level + 1, tile_column * 2 + dx, tile_row * 2 + dy FROM l, (VALUES (0), (1)) x(dx), (VALUES (0), (1)) y(dy)""",
)
def _(spark, d):
    a, b = _builds(spark, d, "fx_tiles")
    return archive.wanted_with_children(a.where("zoom_level < 7").select(*archive.ADDRESS).distinct(), b)


@query("O03_top_zooms", "SELECT zoom_level, count(*) AS tiles, cast(sum(nbytes) AS bigint) AS bytes FROM fx_tiles GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def _(spark, d):
    return archive.top_zooms(view(spark, d, "fx_tiles"))


@query(
    "O08_feature_cap",
    """WITH r AS (SELECT layer, feature_id, row_number() OVER (PARTITION BY layer ORDER BY feature_id) AS rank, count(*) OVER (PARTITION BY layer) AS n FROM fx_fields)
SELECT layer, feature_id, rank, greatest(n - 3, 0) AS truncated FROM r WHERE rank <= 3""",
)
def _(spark, d):
    return archive.cap_per_group(view(spark, d, "fx_fields").select("layer", "feature_id"), ["layer"], ["feature_id"], 3).withColumn("rank", F.col("rank").cast("long"))


@query("F01_point_lookup", "SELECT tile_data_id, nbytes FROM fx_tiles WHERE zoom_level = 6 AND tile_column = 5 AND tile_row = 9")
def _(spark, d):
    return view(spark, d, "fx_tiles").where("zoom_level = 6 AND tile_column = 5 AND tile_row = 9").select("tile_data_id", "nbytes")


# --- tile math ---------------------------------------------------------------


@query(
    "G01_point_to_tile",
    """SELECT point_id, least(greatest(cast(floor((lon + 180.0) / 360.0 * 16384) AS bigint), 0), 16383) AS x,
  least(greatest(cast(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 16384) AS bigint), 0), 16383) AS y FROM fx_points""",
)
def _(spark, d):
    x, y = G.tile_of(F.col("lon"), F.col("lat"), F.lit(14))
    return view(spark, d, "fx_points").select("point_id", x.alias("x"), y.alias("y"))


@query(
    "G03_tile_range",
    """SELECT box_id, cast(floor((west + 180.0) / 360.0 * 1024) AS bigint) AS x0, cast(floor((1.0 - ln(tan(radians(north)) + 1.0 / cos(radians(north))) / pi()) / 2.0 * 1024) AS bigint) AS y0,
  cast(floor((east + 180.0) / 360.0 * 1024) AS bigint) AS x1, cast(floor((1.0 - ln(tan(radians(south)) + 1.0 / cos(radians(south))) / pi()) / 2.0 * 1024) AS bigint) AS y1 FROM fx_boxes""",
)
def _(spark, d):
    r = G.tile_range(*_c("west", "south", "east", "north"), F.lit(10))
    return view(spark, d, "fx_boxes").select("box_id", *[v.alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"))])


@query(
    "G05_tile_bounds",
    """SELECT DISTINCT zoom_level, tile_column, tile_row, round(tile_column / power(2, zoom_level) * 360.0 - 180.0, 6) AS west,
  round(degrees(atan(sinh(pi() * (1.0 - 2.0 * (tile_row + 1) / power(2, zoom_level))))), 6) AS south, round((tile_column + 1) / power(2, zoom_level) * 360.0 - 180.0, 6) AS east,
  round(degrees(atan(sinh(pi() * (1.0 - 2.0 * tile_row / power(2, zoom_level))))), 6) AS north FROM fx_tiles""",
)
def _(spark, d):
    box = G.tile_box(*_c("tile_column", "tile_row", "zoom_level"))
    return view(spark, d, "fx_tiles").select(*archive.ADDRESS).distinct().select(*archive.ADDRESS, *[F.round(v, 6).alias(n) for v, n in zip(box, ("west", "south", "east", "north"))])


@query(
    "G07_ground_resolution",
    "SELECT DISTINCT zoom_level, tile_row, round(40075016.686 * cos(atan(sinh(pi() * (1.0 - 2.0 * (tile_row + 0.5) / power(2, zoom_level))))) / (power(2, zoom_level) * 512), 6) AS metres FROM fx_tiles",
)
def _(spark, d):
    return view(spark, d, "fx_tiles").select("zoom_level", "tile_row").distinct().withColumn("metres", F.round(G.ground_resolution(F.col("tile_row"), F.col("zoom_level"), 512), 6))


@query(
    "G08_haversine",
    """SELECT point_id, round(2 * 6371008.8 * asin(sqrt(power(sin(radians(45.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45.0)) * power(sin(radians(5.0 - lon) / 2), 2))), 3) AS metres FROM fx_points""",
)
def _(spark, d):
    return view(spark, d, "fx_points").select("point_id", F.round(G.haversine(F.col("lon"), F.col("lat"), F.lit(5.0), F.lit(45.0)), 3).alias("metres"))


@query(
    "G09_mercator",
    "SELECT point_id, round(6378137.0 * radians(lon), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM fx_points",
)
def _(spark, d):
    x, y = G.to_mercator(F.col("lon"), F.col("lat"))
    return view(spark, d, "fx_points").select("point_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("G10_lambert93_round_trip", "SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_points WHERE lon BETWEEN -6 AND 10 AND lat BETWEEN 40 AND 52")
def _(spark, d):
    p = view(spark, d, "fx_points").where("lon BETWEEN -6 AND 10 AND lat BETWEEN 40 AND 52")
    x, y = G.to_lambert93(F.col("lon"), F.col("lat"))
    lon, lat = G.from_lambert93(F.col("x"), F.col("y"))
    return p.withColumn("x", x).withColumn("y", y).select("point_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("G11_tms_flip", "SELECT zoom_level, tile_row, CASE WHEN tile_row - 8 BETWEEN 0 AND power(2, zoom_level) - 1 THEN cast(power(2, zoom_level) AS bigint) - 1 - (tile_row - 8) END AS flipped FROM (SELECT DISTINCT zoom_level, tile_row FROM fx_tiles)")
def _(spark, d):
    return view(spark, d, "fx_tiles").select("zoom_level", "tile_row").distinct().withColumn("flipped", G.flip_row(F.col("zoom_level"), F.col("tile_row") - 8))


@query("G12_tile_id", "SELECT zoom_level, tile_column, tile_row, cast((power(4, zoom_level) - 1) / 3 AS bigint) + cast(power(2, zoom_level) AS bigint) * tile_row + tile_column AS id FROM fx_tiles")
def _(spark, d):
    return view(spark, d, "fx_tiles").select(*archive.ADDRESS, G.tile_id(*_c("zoom_level", "tile_column", "tile_row")).alias("id"))


@query(
    "G13_ancestors",
    """SELECT DISTINCT cast(zoom_level - k AS int) AS zoom, tile_column >> k AS x, tile_row >> k AS y FROM fx_tiles, unnest(generate_series(1, zoom_level)) u(k)""",
)
def _(spark, d):
    up = F.explode(G.ancestors(*_c("zoom_level", "tile_column", "tile_row"))).alias("a")
    return view(spark, d, "fx_tiles").select(up).select(F.col("a.zoom").cast("int").alias("zoom"), "a.x", "a.y").distinct()


@query(
    "G14_degree_name",
    """SELECT point_id, concat(CASE WHEN floor(lat) < 0 THEN 'S' ELSE 'N' END, lpad(cast(cast(abs(floor(lat)) AS bigint) AS varchar), 2, '0'),
  CASE WHEN floor(lon) < 0 THEN 'W' ELSE 'E' END, lpad(cast(cast(abs(floor(lon)) AS bigint) AS varchar), 3, '0')) AS name, cast(floor(lon) AS int) AS lon, cast(floor(lat) AS int) AS lat FROM fx_points""",
)
def _(spark, d):
    named = view(spark, d, "fx_points").select("point_id", G.degree_name(F.col("lon"), F.col("lat")).alias("name"))
    lon, lat = G.parse_degree_name(F.col("name"))
    return named.select("point_id", "name", lon.cast("int").alias("lon"), lat.cast("int").alias("lat"))


@query(
    "G16_degree_cover",
    """SELECT box_id, cast(x AS bigint) AS lon, cast(y AS bigint) AS lat FROM fx_boxes,
  unnest(generate_series(cast(floor(west) AS bigint), greatest(cast(ceil(east) AS bigint) - 1, cast(floor(west) AS bigint)))) a(x),
  unnest(generate_series(cast(floor(south) AS bigint), greatest(cast(ceil(north) AS bigint) - 1, cast(floor(south) AS bigint)))) b(y)""",
)
def _(spark, d):
    return view(spark, d, "fx_boxes").select("box_id", F.explode(G.degree_cover(*_c("west", "south", "east", "north"))).alias("c")).select("box_id", "c.lon", "c.lat")


@query(
    "G17_graph_path",
    """WITH t AS (SELECT point_id, level, cast(floor((lon + 180.0) / deg) AS bigint) AS x, cast(floor((lat + 90.0) / deg) AS bigint) AS y, cast(360 / deg AS bigint) AS n
  FROM fx_points, (VALUES (0, 4.0), (1, 1.0), (2, 0.25)) l(level, deg)), d AS (SELECT *, lpad(cast(y * n + x AS varchar), CASE WHEN level = 2 THEN 9 ELSE 6 END, '0') AS s FROM t)
SELECT point_id, level, x, y, concat(cast(level AS varchar), '/', s[1:3], '/', s[4:6], CASE WHEN level = 2 THEN concat('/', s[7:9]) ELSE '' END, '.gph') AS path FROM d""",
)
def _(spark, d):
    p = view(spark, d, "fx_points").withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    deg = G.graph_degrees(F.col("level"))
    p = p.withColumn("x", G.floor((F.col("lon") + 180.0) / deg)).withColumn("y", G.floor((F.col("lat") + 90.0) / deg))
    return p.select("point_id", "level", "x", "y", G.graph_path(*_c("x", "y", "level")).alias("path"))


@query(
    "G19_graph_cover",
    """SELECT box_id, level, x, y, x * deg - 180.0 AS west, y * deg - 90.0 AS south FROM fx_boxes, (VALUES (0, cast(4.0 AS double)), (1, cast(1.0 AS double)), (2, cast(0.25 AS double))) l(level, deg),
  unnest(generate_series(cast(floor((west + 180.0) / deg) AS bigint), cast(floor((east + 180.0) / deg) AS bigint))) a(x),
  unnest(generate_series(cast(floor((south + 90.0) / deg) AS bigint), cast(floor((north + 90.0) / deg) AS bigint))) b(y)""",
)
def _(spark, d):
    b = view(spark, d, "fx_boxes").withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    b = b.select("box_id", "level", F.explode(G.graph_cover(*_c("west", "south", "east", "north", "level"))).alias("c")).select("box_id", "level", "c.x", "c.y")
    west, south, _, _ = G.graph_box(*_c("x", "y", "level"))
    return b.withColumn("west", west).withColumn("south", south)


@query(
    "G26_densify",
    """WITH p AS (SELECT point_id % 50 AS line_id, point_id AS seq, lon, lat FROM fx_points),
  s AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
  n AS (SELECT *, coalesce(cast(floor(2 * 6371008.8 * asin(sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2))) / 500000) AS int), 0) AS k FROM s)
SELECT line_id, seq, cast(part AS int) AS part, round(CASE WHEN part = 0 THEN lon ELSE lon + (lon2 - lon) * part / k END, 6) AS lon, round(CASE WHEN part = 0 THEN lat ELSE lat + (lat2 - lat) * part / k END, 6) AS lat
FROM n, unnest(generate_series(0, greatest(k - 1, 0))) u(part)""",
)
def _(spark, d):
    p = view(spark, d, "fx_points").select((F.col("point_id") % 50).alias("line_id"), F.col("point_id").alias("seq"), "lon", "lat")
    return profile.densify(p, 500000).withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


# --- geometry ----------------------------------------------------------------

_INSIDE = "((lon > -40 AND lon < 40 AND lat > -30 AND lat < 30) AND NOT (lon > -10 AND lon < 10 AND lat > -10 AND lat < 10))"


@query(
    "F05_points_in_shape",
    """WITH e AS (SELECT ring_id, is_hole, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM fx_ring WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
  h AS (SELECT point_id, is_hole, count(*) % 2 AS odd FROM fx_points, e WHERE x2 IS NOT NULL AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 GROUP BY 1, 2)
SELECT p.point_id, lon, lat FROM fx_points p JOIN h o ON o.point_id = p.point_id AND o.is_hole = 0 AND o.odd = 1 WHERE NOT EXISTS (SELECT 1 FROM h i WHERE i.point_id = p.point_id AND i.is_hole = 1 AND i.odd = 1)""",
)
def _(spark, d):
    return geometry.points_in_shape(view(spark, d, "fx_points"), view(spark, d, "fx_ring"))


@query(
    "F03_box_overlap",
    """SELECT a.box_id AS a, b.box_id AS b, a.west < b.east AND a.east > b.west AND a.south < b.north AND a.north > b.south AS opened,
  NOT (a.east < b.west OR a.west > b.east OR a.north < b.south OR a.south > b.north) AS closed FROM fx_boxes a JOIN fx_boxes b ON a.box_id = b.box_id - 1""",
)
def _(spark, d):
    box = view(spark, d, "fx_boxes")
    a, b = (box.select((F.col("box_id") + plus).alias("k"), F.col("box_id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("west", "south", "east", "north")]) for n, plus in (("a", 1), ("b", 0)))
    sides = [tuple(F.col(f"{c}_{n}") for c in ("west", "south", "east", "north")) for n in "ab"]
    return a.join(b, "k").select("a", "b", geometry.boxes_overlap_open(*sides).alias("opened"), geometry.boxes_overlap_closed(*sides).alias("closed"))


@query(
    "F07_boxes_touching_shape",
    """SELECT box_id, name FROM fx_boxes WHERE west <= 40 AND east >= -40 AND south <= 30 AND north >= -30 AND NOT (west > -10 AND east < 10 AND south > -10 AND north < 10)""",
)
def _(spark, d):
    return geometry.boxes_touching_shape(view(spark, d, "fx_boxes"), view(spark, d, "fx_ring")).select("box_id", "name")


@query("J10_points_in_boxes", "SELECT point_id, box_id FROM fx_points JOIN fx_boxes ON lon BETWEEN west AND east AND lat BETWEEN south AND north")
def _(spark, d):
    return geometry.points_in_boxes(view(spark, d, "fx_points"), view(spark, d, "fx_boxes")).select("point_id", "box_id")


# --- elevation ---------------------------------------------------------------

_RGB = "SELECT gx, gy, priority, (elev // 256) % 256 AS r, elev % 256 AS g, (gx * 7 + gy) % 256 AS b FROM fx_pixels"


def _rgb(spark, d):
    return view(spark, d, "fx_pixels").selectExpr("gx", "gy", "priority", "(elev div 256) % 256 AS r", "elev % 256 AS g", "(gx * 7 + gy) % 256 AS b")


@query("T01_decode", f"WITH p AS ({_RGB}) SELECT gx, gy, priority, r * 256.0 + g + b / 256.0 - 32768.0 AS terrarium, round(-10000.0 + (r * 65536.0 + g * 256.0 + b) * 0.1, 4) AS mapbox FROM p")
def _(spark, d):
    return _rgb(spark, d).select("gx", "gy", "priority", E.decode_terrarium(*_c("r", "g", "b")).alias("terrarium"), F.round(E.decode_mapbox(*_c("r", "g", "b")), 4).alias("mapbox"))


@query(
    "T03_encode",
    """WITH v AS (SELECT gx, gy, priority, round(elev / 4.0 / 0.5) * 0.5 AS s FROM fx_pixels), w AS (SELECT *, floor(s + 32768.0) AS t, cast(round((s + 10000.0) * 10.0) AS bigint) AS m FROM v)
SELECT gx, gy, priority, cast(floor(t / 256) AS int) AS tr, cast(t % 256 AS int) AS tg, cast(least(round((s + 32768.0 - t) * 256.0), 255) AS int) AS tb,
  cast(m // 65536 AS int) AS mr, cast((m // 256) % 256 AS int) AS mg, cast(m % 256 AS int) AS mb FROM w""",
)
def _(spark, d):
    e = F.col("elev") / 4.0
    t, m = E.encode_terrarium(e, F.lit(0.5)), E.encode_mapbox(e, F.lit(0.5))
    return view(spark, d, "fx_pixels").select("gx", "gy", "priority", *[c.alias(n) for c, n in zip((*t, *m), ("tr", "tg", "tb", "mr", "mg", "mb"))])


@query("T04_step_ramp", "SELECT DISTINCT zoom_level, least(2 + 11 - zoom_level, greatest(6, 2)) AS digits, power(2.0, least(2 + 11 - zoom_level, 6)) / 256 AS step FROM fx_tiles")
def _(spark, d):
    digits = E.quantisation_digits(F.col("zoom_level"), F.lit(11), F.lit(2), F.lit(6))
    return view(spark, d, "fx_tiles").select("zoom_level").distinct().select("zoom_level", digits.alias("digits"), E.quantisation_step(digits, "terrarium").alias("step"))


@query("T17_clamp_min", "SELECT gx, gy, priority, CASE WHEN priority % 2 = 0 THEN elev ELSE greatest(elev, 500) END AS elev FROM fx_pixels")
def _(spark, d):
    least = F.when(F.col("priority") % 2 == 1, 500)
    return view(spark, d, "fx_pixels").withColumn("elev", E.clamp_min(F.col("elev"), least))


@query(
    "T21_contour_class",
    """SELECT gx, gy, priority, elev, CASE WHEN elev % 1000 = 0 THEN 1000 WHEN elev % 500 = 0 THEN 500 WHEN elev % 250 = 0 THEN 250 WHEN elev % 200 = 0 THEN 200
  WHEN elev % 100 = 0 THEN 100 WHEN elev % 50 = 0 THEN 50 WHEN elev % 20 = 0 THEN 20 ELSE 10 END AS div FROM fx_pixels""",
)
def _(spark, d):
    return view(spark, d, "fx_pixels").withColumn("div", E.contour_band(F.col("elev")))


@query("J11_priority_sample", "SELECT gx, gy, arg_max(elev, priority) AS elev, max(priority) AS priority FROM fx_pixels GROUP BY 1, 2")
def _(spark, d):
    return raster.highest_priority(view(spark, d, "fx_pixels"))


@query(
    "T15_composite",
    """WITH RECURSIVE o AS (SELECT gx, gy, row_number() OVER (PARTITION BY gx, gy ORDER BY priority) AS k, cast(elev AS double) AS v, priority / 8.0 AS w FROM fx_pixels),
  f AS (SELECT gx, gy, k, v AS acc FROM o WHERE k = 1 UNION ALL SELECT o.gx, o.gy, o.k, f.acc * (1 - o.w) + o.v * o.w FROM f JOIN o ON o.gx = f.gx AND o.gy = f.gy AND o.k = f.k + 1)
SELECT gx, gy, round(arg_max(acc, k), 6) AS elev FROM f GROUP BY 1, 2""",
)
def _(spark, d):
    p = view(spark, d, "fx_pixels").groupBy("gx", "gy").agg(F.array_sort(F.collect_list(F.struct("priority", "elev"))).alias("s"))
    values = F.transform("s", lambda s: F.struct(s["elev"].cast("double").alias("value"), (s["priority"] / 8.0).alias("weight"), F.lit(None).cast("double").alias("least")))
    return p.select("gx", "gy", F.round(raster.composite(values), 6).alias("elev"))


@query("A21_pyramid_avg", "SELECT cast(gx // 2 AS bigint) AS gx, cast(gy // 2 AS bigint) AS gy, round(avg(elev), 6) AS elev, count(elev) AS covered FROM fx_pixels WHERE priority = 1 GROUP BY 1, 2")
def _(spark, d):
    return raster.pyramid_level(view(spark, d, "fx_pixels").where("priority = 1")).withColumn("elev", F.round("elev", 6))


@query(
    "T19_pyramid",
    """WITH p0 AS (SELECT gx, gy, cast(elev AS double) AS elev FROM fx_pixels WHERE priority = 2), p1 AS (SELECT gx // 2 AS gx, gy // 2 AS gy, avg(elev) AS elev FROM p0 GROUP BY 1, 2),
  p2 AS (SELECT gx // 2 AS gx, gy // 2 AS gy, avg(elev) AS elev FROM p1 GROUP BY 1, 2)
SELECT cast(gx AS bigint) AS gx, cast(gy AS bigint) AS gy, round(elev, 6) AS elev, 0 AS level FROM p0 UNION ALL SELECT gx, gy, round(elev, 6), 1 FROM p1 UNION ALL SELECT gx, gy, round(elev, 6), 2 FROM p2""",
)
def _(spark, d):
    p = view(spark, d, "fx_pixels").where("priority = 2").select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "elev")
    return raster.pyramid(p, 2).withColumn("elev", F.round("elev", 6))


@query(
    "A16_window_maximum",
    """WITH p AS (SELECT DISTINCT gx, gy FROM fx_pixels), g AS (SELECT * FROM fx_pixels WHERE priority = 1)
SELECT p.gx, p.gy, max(g.elev) AS highest FROM p JOIN g ON abs(g.gx - p.gx) <= 4 AND abs(g.gy - p.gy) <= 4 GROUP BY 1, 2""",
)
def _(spark, d):
    px = view(spark, d, "fx_pixels")
    return raster.window_maximum(px, px.where("priority = 1"), 4)


@query(
    "T06_bilinear",
    """WITH g AS (SELECT gx, gy, cast(elev AS double) AS v FROM fx_pixels WHERE priority = 1),
  p AS (SELECT point_id, (lon + 180) / 6.0 AS x, (lat + 85) / 3.0 AS y FROM fx_points), b AS (SELECT *, cast(floor(x) AS bigint) AS gx, cast(floor(y) AS bigint) AS gy FROM p),
  n AS (SELECT b.*, a.v AS v00, coalesce(c.v, a.v) AS v10, coalesce(e.v, a.v) AS v01, coalesce(f.v, c.v, a.v) AS v11 FROM b LEFT JOIN g a ON a.gx = b.gx AND a.gy = b.gy
    LEFT JOIN g c ON c.gx = b.gx + 1 AND c.gy = b.gy LEFT JOIN g e ON e.gx = b.gx AND e.gy = b.gy + 1 LEFT JOIN g f ON f.gx = b.gx + 1 AND f.gy = b.gy + 1)
SELECT point_id, round((v00 * (1 - (x - gx)) + v10 * (x - gx)) * (1 - (y - gy)) + (v01 * (1 - (x - gx)) + v11 * (x - gx)) * (y - gy), 5) AS elev FROM n""",
)
def _(spark, d):
    p = view(spark, d, "fx_points").select("point_id", ((F.col("lon") + 180) / 6.0).alias("x"), ((F.col("lat") + 85) / 3.0).alias("y"))
    return raster.bilinear_sample(p, view(spark, d, "fx_pixels").where("priority = 1").select("gx", "gy", "elev")).select("point_id", F.round("elev", 5).alias("elev"))


# --- profiles ----------------------------------------------------------------


def _line(spark, d):
    return view(spark, d, "fx_profile").withColumns({"lon": F.col("lon0") + F.col("seq") * 0.001, "lat": F.lit(45.0) + F.col("seq") * 0.0005})


_LINE = "SELECT *, lon0 + seq * cast(0.001 AS double) AS lon, 45.0 + seq * cast(0.0005 AS double) AS lat FROM fx_profile"
_STEP = "2 * 6371008.8 * asin(sqrt(power(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * power(sin(radians(lon - lag(lon) OVER w) / 2), 2)))"


@query(
    "W01_profile_distance",
    f"""WITH p AS ({_LINE}), s AS (SELECT line_id, seq, coalesce({_STEP}, 0) AS step FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq))
SELECT line_id, seq, round(sum(step) OVER (PARTITION BY line_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS distance_m FROM s""",
)
def _(spark, d):
    return profile.with_distance(_line(spark, d)).select("line_id", "seq", F.round("distance_m", 4).alias("distance_m"))


@query("A12_profile_summary", "SELECT line_id, min(e) AS min_m, max(e) AS max_m, count(*) FILTER (e IS NULL) AS gaps, cast(max(seq) AS double) AS length_m FROM (SELECT line_id, seq, CASE WHEN seq % 7 <> 0 THEN elevation_m END AS e FROM fx_profile) GROUP BY 1")
def _(spark, d):
    p = view(spark, d, "fx_profile").withColumn("elevation_m", F.expr("CASE WHEN seq % 7 <> 0 THEN elevation_m END")).withColumn("distance_m", F.col("seq").cast("double"))
    return profile.summary(p)


@query(
    "A13_hysteresis_ascent",
    """WITH RECURSIVE f AS (SELECT line_id, seq, elevation_m AS anchor, cast(0 AS double) AS up, cast(0 AS double) AS down FROM fx_profile WHERE seq = 1 UNION ALL
  SELECT p.line_id, p.seq, CASE WHEN abs(p.elevation_m - f.anchor) >= 3 THEN p.elevation_m ELSE f.anchor END, f.up + CASE WHEN p.elevation_m - f.anchor >= 3 THEN p.elevation_m - f.anchor ELSE 0 END,
    f.down + CASE WHEN f.anchor - p.elevation_m >= 3 THEN f.anchor - p.elevation_m ELSE 0 END FROM f JOIN fx_profile p ON p.line_id = f.line_id AND p.seq = f.seq + 1)
SELECT line_id, round(arg_max(up, seq), 4) AS ascent_m, round(arg_max(down, seq), 4) AS descent_m FROM f GROUP BY 1""",
)
def _(spark, d):
    out = profile.hysteresis_ascent(view(spark, d, "fx_profile"))
    return out.withColumn("ascent_m", F.round("ascent_m", 4)).withColumn("descent_m", F.round("descent_m", 4))


@query(
    "A14_naive_ascent",
    """WITH s AS (SELECT line_id, elevation_m - lag(elevation_m) OVER (PARTITION BY line_id ORDER BY seq) AS rise FROM fx_profile)
SELECT line_id, round(coalesce(sum(greatest(rise, 0)), 0), 4) AS ascent_m, round(coalesce(sum(greatest(-rise, 0)), 0), 4) AS descent_m FROM s GROUP BY 1""",
)
def _(spark, d):
    out = profile.naive_ascent(view(spark, d, "fx_profile"))
    return out.withColumn("ascent_m", F.round("ascent_m", 4)).withColumn("descent_m", F.round("descent_m", 4))


@query("A15_grid_accuracy", "SELECT round(avg(abs(a.elev - b.elev)), 6) AS mean_abs, cast(max(abs(a.elev - b.elev)) AS bigint) AS worst, round(avg(CASE WHEN abs(a.elev - b.elev) <= 500 THEN 1.0 ELSE 0.0 END) * 100, 6) AS near_pct FROM fx_pixels a JOIN fx_pixels b ON a.gx = b.gx AND a.gy = b.gy AND a.priority = 1 AND b.priority = 2")
def _(spark, d):
    px = view(spark, d, "fx_pixels")
    both = px.where("priority = 1").select("gx", "gy", F.col("elev").alias("a")).join(px.where("priority = 2").select("gx", "gy", F.col("elev").alias("b")), ["gx", "gy"])
    return profile.accuracy(both, "a", "b", 500).withColumn("mean_abs", F.round("mean_abs", 6)).withColumn("near_pct", F.round("near_pct", 6))


@query("W06_leg_offset", "SELECT o_custkey AS trip_id, o_orderkey AS leg, o_orderkey % 9 + 2 AS size, cast(coalesce(sum(o_orderkey % 9 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS \"offset\" FROM orders")
def _(spark, d):
    return profile.running_offset(load(spark, d, "orders").select(F.col("o_custkey").alias("trip_id"), F.col("o_orderkey").alias("leg"), (F.col("o_orderkey") % 9 + 2).alias("size")))


# --- masks -------------------------------------------------------------------


@query("J14_mask_intersect", f"SELECT * FROM {_tiles('a')} INTERSECT SELECT * FROM {_tiles('b')}")
def _(spark, d):
    return masks.intersection(*_builds(spark, d, "fx_tiles"))


@query("J15_mask_union", "SELECT DISTINCT zoom_level, tile_column, tile_row FROM fx_tiles")
def _(spark, d):
    return masks.union(*_builds(spark, d, "fx_tiles"))


@query(
    "Q05_mask_contains",
    """WITH l AS (SELECT DISTINCT zoom_level, tile_column, tile_row FROM fx_tiles WHERE zoom_level IN (5, 7) AND tile_data_id % 3 = 0)
SELECT DISTINCT t.zoom_level, t.tile_column, t.tile_row FROM fx_tiles t JOIN l ON t.zoom_level >= l.zoom_level AND t.tile_column >> (t.zoom_level - l.zoom_level) = l.tile_column AND t.tile_row >> (t.zoom_level - l.zoom_level) = l.tile_row""",
)
def _(spark, d):
    t = view(spark, d, "fx_tiles")
    return masks.contained(t.select(*archive.ADDRESS), t.where("zoom_level IN (5, 7) AND tile_data_id % 3 = 0"))


@query("Q01_mask_with_ancestors", "SELECT DISTINCT cast(zoom_level - k AS int) AS zoom_level, tile_column >> k AS tile_column, tile_row >> k AS tile_row FROM fx_tiles, unnest(generate_series(0, zoom_level)) u(k)")
def _(spark, d):
    return masks.with_ancestors(view(spark, d, "fx_tiles"))


@query("Q04_mask_round_trip", "SELECT DISTINCT tile_column, tile_row FROM fx_tiles WHERE zoom_level = 6")
def _(spark, d):
    from .operators.masks import ExpandMask

    spark.udtf.register("expand_mask", ExpandMask)
    text = masks.mask_text(masks.mask_bits(view(spark, d, "fx_tiles"), 6))
    return spark.sql("SELECT t.tile_column, t.tile_row FROM {m} m, LATERAL expand_mask(m.mask, 6) t WHERE t.zoom_level = 6", m=text)


@query("O11_mask_zoom", "SELECT coalesce(min(CASE WHEN n >= 2000 THEN z END), max(z)) AS zoom FROM (SELECT zoom_level AS z, count(*) AS n FROM fx_tiles GROUP BY 1)")
def _(spark, d):
    return masks.zoom_by_size(view(spark, d, "fx_tiles").groupBy(F.col("zoom_level").alias("zoom")).agg(F.count(F.lit(1)).alias("length")), 2000)


# --- logs, names, options ----------------------------------------------------

_EVENT = r"""SELECT line_no, event, elapsed, CASE WHEN event IN ('phase_end', 'zoom_end') THEN coalesce(stage, '') ELSE stage END AS stage,
  CASE event WHEN 'progress' THEN trim(regexp_extract(counter, '([A-Za-z][A-Za-z_ ]*):', 1)) WHEN 'zoom_end' THEN concat('z', zoom) END AS label,
  CASE event WHEN 'progress' THEN least(cast(regexp_extract(counter, '([0-9]{1,3})%', 1) AS int), 100) END AS percent, CASE WHEN event IN ('phase_end', 'zoom_end') THEN took END AS took,
  CASE WHEN event IN ('phase_end', 'zoom_end') THEN coalesce(try_cast(regexp_extract(took, '([0-9]+)h', 1) AS int), 0) * 3600 + coalesce(try_cast(regexp_extract(took, '([0-9]+)m', 1) AS int), 0) * 60 + coalesce(try_cast(regexp_extract(took, '([0-9]+)s', 1) AS int), 0) END AS seconds, line
FROM (SELECT *, CASE WHEN elapsed IS NULL THEN 'log' WHEN c = 'FINISHED!' THEN 'run_end' WHEN took IS NOT NULL AND zoom IS NOT NULL THEN 'zoom_end' WHEN took IS NOT NULL THEN 'phase_end'
    WHEN stage IS NOT NULL AND c = 'Starting...' THEN 'phase_start' WHEN stage IS NOT NULL AND counter IS NOT NULL THEN 'progress' ELSE 'log' END AS event
  FROM (SELECT * EXCLUDE (zoom), CASE WHEN cast(zoom AS int) <= 255 THEN zoom END AS zoom,
      list_filter(regexp_extract_all(c, '[A-Za-z][A-Za-z_ ]*:\s*\[[^\]]*\]'), lambda x: coalesce(try_cast(regexp_extract(x, '([0-9]{1,3})%', 1) AS int), 999) <= 255)[1] AS counter
    FROM (SELECT *, nullif(regexp_extract(c, '^Finished (?:z([0-9]+) )?in (\S+)', 1), '') AS zoom, nullif(regexp_extract(c, '^Finished (?:z([0-9]+) )?in (\S+)', 2), '') AS took
    FROM (SELECT line_no, line, nullif(regexp_extract(t, '^([0-9]+:[0-9]{2}:[0-9]{2})\s+[A-Z]+\s+(\[[^\]]+\]\s+)?-', 1), '') AS elapsed, nullif(regexp_extract(t, '^[0-9]+:[0-9]{2}:[0-9]{2}\s+[A-Z]+\s+\[([^\]]+)\]', 1), '') AS stage,
        trim(regexp_extract(t, '^[0-9]+:[0-9]{2}:[0-9]{2}\s+[A-Z]+\s+(?:\[[^\]]+\]\s+)?-\s?(.*)$', 1)) AS c
      FROM (SELECT *, regexp_replace(regexp_replace(line, concat(chr(27), '\[[0-9;]*[a-zA-Z]'), '', 'g'), '\s+$', '') AS t FROM fx_log)))))"""


def _events(spark, d):
    return view(spark, d, "fx_log").withColumn("e", X.log_event(F.col("line"))).select("line_no", "e.*")


@query("X10_log_events", f"WITH e AS ({_EVENT}) SELECT line_no, event, elapsed, stage, label, percent, took, seconds FROM e")
def _(spark, d):
    return _events(spark, d).select("line_no", "event", "elapsed", "stage", "label", "percent", "took", "seconds")


@query("A26_event_tallies", f"WITH e AS ({_EVENT}) SELECT event, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    return _events(spark, d).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "W04_last_elapsed",
    f"""WITH e AS ({_EVENT}) SELECT line_no, took FROM (SELECT line_no, event, nullif(last_value(CASE event WHEN 'phase_end' THEN took WHEN 'run_end' THEN '' END IGNORE NULLS) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS took FROM e) WHERE event = 'run_end'""",
)
def _(spark, d):
    """One duration is held for the run, whatever the stage; the end of the run gives it out."""
    return logs.held_durations(_events(spark, d)).select("line_no", "took")


@query(
    "W05_percent_changes",
    f"""WITH e AS ({_EVENT}), c AS (SELECT line_no, stage, percent, lag(percent) OVER (PARTITION BY stage ORDER BY line_no) AS before FROM e WHERE event = 'progress')
SELECT line_no, stage, percent FROM c WHERE before IS DISTINCT FROM percent""",
)
def _(spark, d):
    e = _events(spark, d).where("event = 'progress'").select("line_no", "stage", "percent")
    before = F.lag("percent").over(Window.partitionBy("stage").orderBy("line_no"))
    return e.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("percent"))).drop("before")


_NAMES = r"""SELECT file_id, file_name, size_bytes, nullif(regexp_extract(substr(file_name, 12), '^_?([^.]*)\.(mbtiles|vtiles)', 1), '') AS suffix, regexp_extract(substr(file_name, 12), '\.(mbtiles|vtiles)', 1) AS extension,
  nullif(regexp_extract(substr(file_name, 12), '\.(mbtiles|vtiles)\.(.+)$', 2), '') AS "trailing" FROM fx_files WHERE starts_with(file_name, 'rhone-alpes')"""
_KINDED = f"SELECT *, CASE WHEN suffix IN ('routes', 'terrain', 'hillshade', 'contours') THEN suffix ELSE 'basemap' END AS kind, coalesce(\"trailing\", CASE WHEN suffix NOT IN ('routes', 'terrain', 'hillshade', 'contours') THEN suffix END) AS variant FROM ({_NAMES})"


@query("X01_name_split", f"SELECT file_id, suffix, extension, \"trailing\", kind, variant FROM ({_KINDED})")
def _(spark, d):
    return catalog.described(view(spark, d, "fx_files")).select("file_id", "suffix", "extension", "trailing", "kind", "variant")


@query("O14_default_artifacts", f"SELECT kind, file_id, file_name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY variant IS NOT NULL, file_name, file_id) AS k FROM ({_KINDED})) WHERE k = 1")
def _(spark, d):
    c = catalog.described(view(spark, d, "fx_files"))
    first = Window.partitionBy("kind").orderBy(*catalog.canonical_order(), "file_id")
    return c.withColumn("k", F.row_number().over(first)).where("k = 1").select("kind", "file_id", "file_name")


@query("A05_area_sizes", f"SELECT 'rhone-alpes' AS area, kind, count(*) AS files, cast(sum(size_bytes) AS bigint) AS bytes, max(file_name) AS last_name FROM ({_KINDED}) GROUP BY kind")
def _(spark, d):
    return catalog.area_sizes(catalog.described(view(spark, d, "fx_files")))


@query("X14_human_seconds", "SELECT n, CASE WHEN n >= 3600 THEN concat(cast(n // 3600 AS varchar), 'h', lpad(cast((n // 60) % 60 AS varchar), 2, '0'), 'm', lpad(cast(n % 60 AS varchar), 2, '0'), 's') WHEN n >= 60 THEN concat(cast(n // 60 AS varchar), 'm', lpad(cast(n % 60 AS varchar), 2, '0'), 's') ELSE concat(cast(n AS varchar), 's') END AS text FROM (SELECT event_id * 7 AS n FROM events)")
def _(spark, d):
    n = load(spark, d, "events").select((F.col("event_id") * 7).alias("n"))
    return n.withColumn("text", X.human_seconds(F.col("n")))


@query("J17_options_changed", "SELECT coalesce(a.name, b.name) AS name FROM (SELECT * FROM fx_meta WHERE build = 'a') a FULL JOIN (SELECT * FROM fx_meta WHERE build = 'b') b ON a.name = b.name WHERE a.value IS DISTINCT FROM b.value")
def _(spark, d):
    return options.changed_keys(*_builds(spark, d, "fx_meta"))


@query("J18_preset_merge", "SELECT name, arg_max(value, build) AS value FROM fx_meta GROUP BY 1")
def _(spark, d):
    return options.merge_presets(*_builds(spark, d, "fx_meta"), ["name"])


@query("J19_hash_by_length", f"WITH m AS ({_MIRRORS.format(s='varchar', t='orders')}), s AS (SELECT file_len, max(hash) AS hash FROM m WHERE mirror % 40 = 1 GROUP BY 1 HAVING count(DISTINCT hash) = 1) SELECT mirror, m.file_len, s.hash FROM m LEFT JOIN s ON m.file_len = s.file_len WHERE mirror % 40 <> 1")
def _(spark, d):
    m = _mirrors(spark, d)
    return catalog.with_hash_by_length(m.where("mirror % 40 = 1"), m.where("mirror % 40 <> 1").drop("date")).select("mirror", "file_len", "hash")


@query("O05_newest_mirrors", f"WITH m AS ({_MIRRORS.format(s='varchar', t='orders')}) SELECT hash AS name, cast(date AS varchar) AS date, place FROM (SELECT hash, date, row_number() OVER (PARTITION BY hash ORDER BY date DESC) AS place FROM (SELECT DISTINCT hash, date FROM m)) WHERE place <= 2")
def _(spark, d):
    m = _mirrors(spark, d).select(F.col("hash").alias("name"), "date").distinct()
    return catalog.newest_per_name(m, 2).select("name", F.col("date").cast("string").alias("date"), F.col("place").cast("long").alias("place"))


_NEEDS = "n AS (SELECT p_partkey AS step, CASE WHEN p_partkey < 7 THEN p_partkey % 6 + 1 ELSE p_partkey // 7 END AS needs FROM part UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size < p_partkey AND p_partkey > 60)"


@query("P01_plan_closure", f"WITH RECURSIVE {_NEEDS}, c AS (SELECT step, needs FROM n UNION SELECT c.step, n.needs FROM c JOIN n ON c.needs = n.step) SELECT step, needs FROM c WHERE step <> needs")
def _(spark, d):
    """Steps that need others, some of them in a circle."""
    p = load(spark, d, "part")
    first = p.select(F.col("p_partkey").alias("step"), F.when(F.col("p_partkey") < 7, F.col("p_partkey") % 6 + 1).otherwise(F.floor(F.col("p_partkey") / 7)).cast("long").alias("needs"))
    second = p.where("p_size < p_partkey AND p_partkey > 60").select(F.col("p_partkey").alias("step"), F.col("p_size").cast("long").alias("needs"))
    return steps.closure(spark, first.union(second))