"""Tile archives as tables: statistics, comparison, merging, deduplication.

An archive is a table with zoom_level, tile_column, tile_row and a size or blob; the compact layout
keeps blobs apart under tile_data_id. Addresses may repeat: operators keep them as a bag unless they
say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

ADDRESS = ["zoom_level", "tile_column", "tile_row"]


def _count() -> Column:
    return F.count(F.lit(1))


def total(column: str | Column) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def zoom_stats(tiles: DataFrame, size: str = "nbytes") -> DataFrame:
    """Tiles and bytes of each zoom."""
    return tiles.groupBy("zoom_level").agg(_count().alias("tiles"), total(size).alias("bytes"))


def archive_totals(addresses: DataFrame, blobs: DataFrame | None, size: str = "nbytes") -> DataFrame:
    """One row: addressed tiles and bytes, unique blobs and bytes (null without a blob table), and the share saved."""
    out = addresses.agg(_count().alias("tiles"), total(size).alias("bytes"))
    if blobs is None:
        return out.select("*", F.lit(None).cast("long").alias("unique_tiles"), F.lit(None).cast("long").alias("unique_bytes"), F.lit(0.0).alias("dedup_ratio"))
    own = blobs.agg(_count().alias("unique_tiles"), total(size).alias("unique_bytes"))
    # Both sides have one row.
    return out.join(own, F.lit(True)).withColumn("dedup_ratio", F.when(F.col("tiles") > 0, 1.0 - F.col("unique_tiles") / F.col("tiles")).otherwise(0.0))


def distinct_blobs(tiles: DataFrame, blob: str, keep: list[str]) -> DataFrame:
    """One row for each content, by a 256-bit digest, with its number of addresses."""
    return tiles.groupBy(F.sha2(F.col(blob).cast("binary"), 256).alias("digest")).agg(_count().alias("addresses"), *[F.min(c).alias(c) for c in keep])


def compact_view(shallow: DataFrame, blobs: DataFrame) -> DataFrame:
    """The classic view of a compact archive; addresses without a blob are not in it."""
    return shallow.join(blobs, "tile_data_id")


def common_tiles(tiles: DataFrame, other: DataFrame) -> DataFrame:
    return tiles.join(other.select(*ADDRESS).distinct(), ADDRESS, "left_semi")


def tiles_only_in(tiles: DataFrame, other: DataFrame) -> DataFrame:
    return tiles.join(other.select(*ADDRESS).distinct(), ADDRESS, "left_anti")


def orphan_blobs(blobs: DataFrame, shallow: DataFrame) -> DataFrame:
    return blobs.join(shallow.select("tile_data_id").distinct(), "tile_data_id", "left_anti")


def change_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, (after - before) / before * 100.0)


def zoom_delta(a: DataFrame, b: DataFrame, size: str = "nbytes") -> DataFrame:
    """Both archives' zooms side by side; a missing side is 0, the change null where there was nothing."""
    left, right = (zoom_stats(t, size).withColumnsRenamed({"tiles": f"tiles_{n}", "bytes": f"bytes_{n}"}) for t, n in ((a, "a"), (b, "b")))
    out = left.join(right, "zoom_level", "full_outer").fillna(0, ["tiles_a", "bytes_a", "tiles_b", "bytes_b"])
    return out.withColumn("change_pct", change_percent(F.col("bytes_a"), F.col("bytes_b")))


def byte_share(stats: DataFrame) -> DataFrame:
    """Each row's share of all bytes (a window over one row a zoom)."""
    return stats.withColumn("share", F.col("bytes") / F.sum("bytes").over(Window.partitionBy(F.lit(0))))


def max_zoom(tiles: DataFrame, most: int) -> DataFrame:
    return tiles.agg(F.least(F.max("zoom_level"), F.lit(most)).alias("max_zoom"))


def map_diff(a: DataFrame, b: DataFrame, key: str = "name", value: str = "value", leave_out: tuple[str, ...] = ("json",)) -> DataFrame:
    """(key, change, value_a, value_b): only_in_a, only_in_b or changed; equal entries are left out."""
    x = a.where(~F.col(key).isin(*leave_out)).select(key, F.col(value).alias("value_a"), F.lit(True).alias("_a"))
    y = b.where(~F.col(key).isin(*leave_out)).select(key, F.col(value).alias("value_b"), F.lit(True).alias("_b"))
    change = F.when(F.col("_b").isNull(), "only_in_a").when(F.col("_a").isNull(), "only_in_b").when(~F.col("value_a").eqNullSafe(F.col("value_b")), "changed")
    return x.join(y, key, "full_outer").select(key, change.alias("change"), "value_a", "value_b").where("change IS NOT NULL")


def field_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(layer, only_in_a, only_in_b): fields of layers, as sorted arrays; layers without a difference are left out."""
    x = a.select("layer", "field", F.lit(True).alias("_a")).distinct()
    y = b.select("layer", "field", F.lit(True).alias("_b")).distinct()
    own = lambda side: F.array_sort(F.collect_list(F.when(F.col(side).isNull(), F.col("field"))))
    return x.join(y, ["layer", "field"], "full_outer").where("_a IS NULL OR _b IS NULL").groupBy("layer").agg(own("_b").alias("only_in_a"), own("_a").alias("only_in_b"))


def parent_rollup(tiles: DataFrame, size: str = "nbytes") -> DataFrame:
    """Each parent with its number of different children present, tiles and bytes."""
    return (
        tiles.where("zoom_level > 0")
        .groupBy((F.col("zoom_level") - 1).alias("zoom_level"), F.shiftright("tile_column", 1).alias("tile_column"), F.shiftright("tile_row", 1).alias("tile_row"))
        .agg(F.count_distinct((F.col("tile_column") % 2) * 2 + F.col("tile_row") % 2).alias("children"), _count().alias("tiles"), total(size).alias("bytes"))
    )


def replace_merge(*archives: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row an address: that of the last archive that has it; within an archive the first by ``order``."""
    both = None
    for n, a in enumerate(archives):
        a = a.withColumn("_source", F.lit(n))
        both = a if both is None else both.unionByName(a)
    first = Window.partitionBy(*ADDRESS).orderBy(F.desc("_source"), *(order or []))
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_source")


def wanted_with_children(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted addresses and the children of those that are averaged from below and not stored."""
    lacking = tiles_only_in(wanted, stored)
    below = lacking.select(
        (F.col("zoom_level") + 1).alias("zoom_level"),
        F.explode(F.array(*[F.struct((F.col("tile_column") * 2 + dx).alias("x"), (F.col("tile_row") * 2 + dy).alias("y")) for dx in (0, 1) for dy in (0, 1)])).alias("t"),
    ).select("zoom_level", F.col("t.x").alias("tile_column"), F.col("t.y").alias("tile_row"))
    return wanted.select(*ADDRESS).union(below).distinct()


def top_zooms(tiles: DataFrame, n: int = 5, size: str = "nbytes") -> DataFrame:
    return zoom_stats(tiles, size).orderBy(F.desc("zoom_level")).limit(n)


def cap_per_group(rows: DataFrame, group: list[str], order: list[str | Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with ``truncated``: how many were left out."""
    sizes = rows.groupBy(*group).agg(_count().alias("_size"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(sizes, group).withColumn("truncated", F.greatest(F.col("_size") - most, F.lit(0))).drop("_size")


def layer_pivot(rows: DataFrame, layer: str, variant: str, size: str, variants: list[str]) -> DataFrame:
    """Bytes of each layer, a column for each build variant."""
    return rows.groupBy(layer).pivot(variant, variants).agg(F.sum(size)).fillna(0, variants)


def size_ladder(stats: DataFrame, name: str, base: str) -> DataFrame:
    """Each row's bytes as a percentage of those of the rows called ``base``, of which one is expected."""
    one = stats.agg(F.max(F.when(F.col(name) == base, F.col("bytes"))).alias("_base"))
    # One row, whatever the table.
    return stats.join(F.broadcast(one), F.lit(True)).withColumn("percent", F.col("bytes") / F.col("_base") * 100.0).drop("_base")


def at_zooms(tiles: DataFrame, most: int, exact: bool = False) -> DataFrame:
    """The tiles of one zoom, or of all up to it."""
    return tiles.where(F.col("zoom_level") == most if exact else F.col("zoom_level") <= most)


def wanted_layers(rows: DataFrame, layer: str, include: str | None, exclude: str | None) -> DataFrame:
    """Rows of the layers in the comma list ``include`` (all, if null) and not in ``exclude``."""
    has = lambda text: F.array_contains(F.split(F.lit(text), ","), F.col(layer))
    out = rows if include is None else rows.where(has(include))
    return out if exclude is None else out.where(~has(exclude))


def ranked(costs: DataFrame, cost: str, tie: str) -> DataFrame:
    """``rank`` by descending cost, of a table with one row a key."""
    return numbered(costs, "rank", F.desc(cost), F.col(tie))


def keep_by_mask(tiles: DataFrame, mask_tiles: DataFrame) -> DataFrame:
    """The tiles that a mask, given as its tiles (leaves stand for all below them), holds."""
    from .masks import contained

    inside = contained(tiles.select(*ADDRESS).distinct(), mask_tiles)
    return tiles.join(inside, ADDRESS, "left_semi")


def package_report(tiles: DataFrame, raw: str, packed: str) -> DataFrame:
    out = tiles.agg(_count().alias("written"), total(raw).alias("raw_bytes"), total(packed).alias("packed_bytes"))
    return out.withColumn("ratio", F.when(F.col("raw_bytes") > 0, F.col("packed_bytes") / F.col("raw_bytes")).otherwise(0.0))


def best_hash(mirrors: DataFrame) -> DataFrame:
    """Of hashes by newest date, the newest - or the second if it has over one and a half times as many mirrors."""
    ranked = mirrors.groupBy("hash").agg(_count().alias("n"), F.max("date").alias("date")).orderBy(F.desc("date"), "hash").limit(2)
    two = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("date")).alias("age"), "hash", "n"))).alias("r"))
    second = (F.size("r") > 1) & (1.5 * F.col("r")[0]["n"] < F.try_element_at("r", F.lit(2))["n"])
    return two.select(F.when(second, F.try_element_at("r", F.lit(2))["hash"]).otherwise(F.try_element_at("r", F.lit(1))["hash"]).alias("hash"))


def unique_or_null(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key, null where rows of the key disagree."""
    return rows.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.max(value)).alias(value))


def attribute_cost(values: DataFrame) -> DataFrame:
    """Bytes of each attribute key: the key once a (tile, layer), a value once a (tile, layer, key), two for each reference.

    ``values`` has a row for each reference: tile, layer, key, value.
    """
    scope = ["tile", "layer", "key"]
    keys = values.select(*scope).distinct().groupBy("key").agg(F.sum(F.octet_length("key")).alias("key_bytes"))
    own = values.select(*scope, "value").distinct().groupBy("key").agg(F.sum(F.octet_length("value")).alias("value_bytes"))
    used = values.groupBy("key").agg((_count() * 2).alias("tag_bytes"))
    return keys.join(own, "key").join(used, "key").withColumn("total_bytes", F.col("key_bytes") + F.col("value_bytes") + F.col("tag_bytes"))
