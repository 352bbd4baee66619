"""Catalogues of areas, files, mirrors and extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .order import numbered


def described(files: DataFrame) -> DataFrame:
    """``files (area, file_name, ...)`` with suffix, extension, trailing, variant and kind; files of other areas are left out."""
    suffix, extension, trailing = T.file_name_parts(F.col("file_name"), F.col("area"))
    out = files.withColumns({"suffix": suffix, "extension": extension, "trailing": trailing}).where("extension IS NOT NULL")
    return out.withColumns({"variant": T.variant(F.col("suffix"), F.col("trailing")), "kind": T.kind_of_name(F.col("suffix"))})


def canonical_order() -> list[Column]:
    """Canonical files first, then variants, each by name."""
    return [F.col("variant").isNotNull(), F.col("file_name")]


def default_artifacts(catalogue: DataFrame) -> DataFrame:
    """The first file of each area and kind in canonical order."""
    first = Window.partitionBy("area", "kind").orderBy(*canonical_order())
    return catalogue.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def area_sizes(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("area", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.max("file_name").alias("last_name"))


def listed(catalogue: DataFrame, area: str | None = None) -> DataFrame:
    """The catalogue by area and file name, of one area if it is named."""
    rows = catalogue if area is None else catalogue.where(F.col("area") == area)
    return rows.orderBy("area", "file_name")


def servable(catalogue: DataFrame) -> DataFrame:
    """Files that hold map tiles: readable, and no routing package."""
    return catalogue.where("error IS NULL AND (format IS NULL OR format <> 'gph3')")


def own_files(files: DataFrame) -> DataFrame:
    """Files whose name begins with their area's; a longer area's name begins with a shorter one's too."""
    return files.where(F.startswith("file_name", F.col("area")))


def ordered(catalogue: DataFrame, by: str, tie: str) -> DataFrame:
    """``place`` in each group of ``by``: canonical files first, then variants."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*canonical_order(), tie))
    return catalogue.withColumn("place", place.cast("long"))


def newest_change(files: DataFrame, by: str, at: str) -> DataFrame:
    return files.groupBy(by).agg(F.max(at).alias("newest"))


def visible_layers(layers: DataFrame, by: str, visible: Column) -> DataFrame:
    """``(by, shown, total)``: how many of a source's layers are shown."""
    return layers.groupBy(by).agg(F.count_if(visible).alias("shown"), F.count(F.lit(1)).alias("total"))


def visible_kinds(layers: DataFrame, wanted: str = "all") -> DataFrame:
    """``layers (kind, source_visible, layer_visible)`` with ``on``: rasters pass any filter of kinds, others only their own or all."""
    allowed = (F.col("kind") == "rasters") | F.lit(wanted == "all") | (F.col("kind") == wanted)
    return layers.withColumn("on", F.col("source_visible") & F.col("layer_visible") & allowed)


def symbol_ids(rows: DataFrame, symbol: str) -> DataFrame:
    """``rows`` with ``symbol_id``: a number for each distinct symbol, in order. The ids are given out over the distinct values."""
    return rows.join(numbered(rows.select(symbol).distinct(), "symbol_id", symbol), symbol)


def mirror_order(mirrors: DataFrame, by: str, tie: str) -> DataFrame:
    """``place`` in each group: by date and then length, those without one last."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("date"), F.asc_nulls_last("file_len"), tie))
    return mirrors.withColumn("place", place.cast("long"))


def newest_jar(files: DataFrame, by: str) -> DataFrame:
    """``(by, jar)``: of each folder's jars with their dependencies, the highest name."""
    return files.where(F.endswith("file_name", F.lit("-with-deps.jar"))).groupBy(by).agg(F.max("file_name").alias("jar"))


def with_md5(listing: DataFrame) -> DataFrame:
    """Data files of ``listing (href)`` with the ``md5`` link of the same name; null where there is none."""
    suffix = ".md5"
    is_md5 = F.endswith("href", F.lit(suffix))
    sums = listing.where(is_md5).select(F.regexp_replace("href", r"\.md5$", "").alias("_of"), F.col("href").alias("md5")).distinct()
    data = listing.where(~is_md5)
    return data.join(sums, data["href"] == sums["_of"], "left").drop("_of")


def addable(catalogue: DataFrame, listed: DataFrame) -> DataFrame:
    """Readable files that are no routing package and not listed yet."""
    return catalogue.where("format IS NULL OR format <> 'gph3'").join(listed.select("file_name").distinct(), "file_name", "left_anti")


def newest_per_name(listing: DataFrame, keep: int = 2) -> DataFrame:
    """The ``keep`` newest dated files of each name and the one called latest, which comes first."""
    dated = Window.partitionBy("name", F.col("date").isNull()).orderBy(F.desc("date"))
    ranked = listing.withColumn("_n", F.row_number().over(dated)).where(F.col("date").isNull() | (F.col("_n") <= keep)).drop("_n")
    order = Window.partitionBy("name").orderBy(F.col("date").isNotNull(), F.desc("date"))
    return ranked.withColumn("place", F.row_number().over(order))


def with_hash_by_length(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """Rows without a hash get that of the known rows of their length, where all of those agree."""
    sure = known.groupBy("file_len").agg(F.count_distinct("hash").alias("n"), F.max("hash").alias("hash")).where("n = 1").drop("n")
    return unknown.drop("hash").join(sure, "file_len", "left")


def resolved(extracts: DataFrame, name: str, fallback: DataFrame | None = None) -> DataFrame:
    """The extract of an id, else the first of a name, whatever the case, that has a url; at most one row.

    ``fallback`` is a second index that is asked only where the first is empty.
    """
    if fallback is not None:
        empty = extracts.limit(1).agg((F.count(F.lit(1)) == 0).alias("_empty"))
        # One row decides; the other index is read where it is needed.
        extracts = extracts.unionByName(fallback.join(F.broadcast(empty.where("_empty")), F.lit(True)).drop("_empty"))
    rank = F.when(F.lower("id") == name.lower(), 0).when(F.lower("name") == name.lower(), 1)
    has_url = F.col("url").isNotNull() if "url" in extracts.columns else F.lit(True)
    return extracts.where(has_url).withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", "id").limit(1).drop("_rank")


def extract_paths(extracts: DataFrame, hops: int = 10) -> DataFrame:
    """``path`` from the root for each ``(id, parent)``; null where parents form a circle or are over ``hops`` deep."""
    out = extracts.select("id", F.col("id").alias("path"), F.col("parent").alias("up"))
    for _ in range(hops):
        above = extracts.select(F.col("id").alias("up"), F.col("parent").alias("_next"))
        out = out.join(above, "up", "left").select(
            "id", F.when(F.col("up").isNotNull(), F.concat("up", F.lit("/"), "path")).otherwise(F.col("path")).alias("path"), F.col("_next").alias("up")
        )
    return out.select("id", F.when(F.col("up").isNull(), F.col("path")).alias("path"))


#: Names of archives and of the parts of split ones.
ARCHIVE = r"^(.*?)(?:\.part[0-9]+)?\.(?:zip|7z|tar|tgz|tar\.gz)(?:\.([0-9]{3}))?$"


def archive_stem(name: Column) -> Column:
    """The name that the parts of a split archive share; null for other files."""
    return F.when(name.rlike(ARCHIVE), F.regexp_extract(name, ARCHIVE, 1))


def archive_groups(listing: DataFrame) -> DataFrame:
    """Parts of split archives together: (stem, parts in order, bytes)."""
    rows = listing.withColumn("stem", archive_stem(F.col("name"))).where("stem IS NOT NULL")
    return rows.groupBy("stem").agg(F.array_sort(F.collect_list("name")).alias("parts"), F.sum("size").alias("bytes"))


def wanted_archives(listing: DataFrame, box: tuple[float, float, float, float], allow_all: bool = False) -> DataFrame:
    """``(stem, parts, named)``: the groups of remote files that a box (west, south, east, north) needs.

    Files whose name has a degree square are kept where it shares area with the box; others can only be had
    all together: they are kept if ``allow_all``, else their presence is an error when rows are read.
    """
    from ..functions.tiles import parse_degree_name

    named = listing.withColumn("stem", F.coalesce(archive_stem(F.col("name")), F.col("name")))
    groups = named.groupBy("stem").agg(F.array_sort(F.collect_list("name")).alias("parts"))
    square = F.regexp_extract("stem", "(?i)([NS][0-9]{2}[EW][0-9]{3})", 1)
    lon, lat = parse_degree_name(square)
    w, s, e, n = box
    inside = (lon < e) & (lon + 1 > w) & (lat < n) & (lat + 1 > s)
    refused = F.lit(True) if allow_all else F.raise_error(F.lit("files without coordinates in their names: allow the full download")).cast("boolean")
    return groups.where(F.when(square != "", inside).otherwise(refused)).select("stem", "parts", (square != "").alias("named"))


def touching_files(index: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Files of a bounds index (path, west, south, east, north) that share area with the box; those without known bounds are kept."""
    w, s, e, n = box
    return index.where(F.col("west").isNull() | ((F.col("west") < e) & (F.col("east") > w) & (F.col("south") < n) & (F.col("north") > s)))


def tile_json(artifacts: DataFrame, base: str) -> DataFrame:
    """A TileJSON document for each artifact (name, format, minzoom, maxzoom, bounds)."""
    url = F.concat(F.lit(base.rstrip("/") + "/"), "name", F.lit("/{z}/{x}/{y}"))
    return artifacts.select("name", F.to_json(F.struct(F.lit("3.0.0").alias("tilejson"), "name", F.array(url).alias("tiles"), "minzoom", "maxzoom", "bounds")).alias("document"))


def tile_responses(requests: DataFrame, artifacts: DataFrame, tiles: DataFrame) -> DataFrame:
    """What a lookup of (name, z, x, y) gives: 404 unknown archive, 400 row outside the zoom, 204 no tile, 200 with it."""
    from ..functions.tiles import flip_row

    row = flip_row(F.col("z"), F.col("y"))
    known = artifacts.select("name", "format").withColumn("_known", F.lit(True))
    own = tiles.select("name", F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"), F.col("tile_row").alias("_row"), "tile_data")
    both = requests.withColumn("_row", row).join(known, "name", "left").join(own, ["name", "z", "x", "_row"], "left")
    status = F.when(F.col("_known").isNull(), 404).when(F.col("_row").isNull(), 400).when(F.col("tile_data").isNull(), 204).otherwise(200)
    gzip = F.when(T.gzip_magic(F.col("tile_data")), "gzip")
    return both.select("name", "z", "x", "y", status.alias("status"), T.content_type(F.col("format")).alias("content_type"), gzip.alias("content_encoding"), "tile_data")
