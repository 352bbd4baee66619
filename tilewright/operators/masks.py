"""Tile masks: quadtrees of tiles as sets of addresses, as bits and as base64 text.

A mask is worked with as the set of its tiles; the depth-first bit text exists at the edge only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def _children(z: int, x: int, y: int) -> list[tuple[int, int, int]]:
    return [(z + 1, 2 * x + dx, 2 * y + dy) for dy in (0, 1) for dx in (0, 1)]


def bits_to_text(bits: list[int]) -> str:
    """Base64 of the bits, first bit highest, filled with zeros to whole groups of 24."""
    bits = bits + [0] * (-len(bits) % 24)
    return base64.b64encode(bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))).decode()


def text_to_bits(text: str) -> list[int]:
    raw = base64.b64decode(text.replace("-", "+").replace("_", "/"))
    return [b >> (7 - i) & 1 for b in raw for i in range(8)]


def walk(bits: list[int], max_zoom: int) -> Iterator[tuple[int, int, int]]:
    """Tiles (zoom, x, y) inside the mask; an inside leaf stands for everything below it. ValueError if bits run out."""
    at = 0
    stack = [(0, 0, 0)]
    while stack:
        node = stack.pop()
        if at + 2 > len(bits):
            raise ValueError("the mask is cut off")
        split, own = bits[at], bits[at + 1]
        at += 2
        if own:
            yield node
        if split:
            stack.extend(reversed(_children(*node)))
        elif own:
            z, x, y = node
            for deeper in range(1, max_zoom - z + 1):
                for dy in range(1 << deeper):
                    for dx in range(1 << deeper):
                        yield z + deeper, (x << deeper) + dx, (y << deeper) + dy


@udtf(returnType="zoom_level int, tile_column long, tile_row long")
class ExpandMask:
    """SQL: ``expand_mask(text, max_zoom)``, the tiles of a base64 mask."""

    def eval(self, text: str, max_zoom: int):
        if text is not None:
            yield from walk(text_to_bits(text), max_zoom)


def with_ancestors(tiles: DataFrame) -> DataFrame:
    """The tiles and all tiles above them, once each."""
    up = F.explode(F.sequence(F.lit(0), F.col("zoom_level").cast("int")))
    return tiles.select(up.alias("up"), *[F.col(c) for c in ("zoom_level", "tile_column", "tile_row")]).select(
        (F.col("zoom_level") - F.col("up")).alias("zoom_level"),
        F.call_function("shiftright", F.col("tile_column"), F.col("up")).alias("tile_column"),
        F.call_function("shiftright", F.col("tile_row"), F.col("up")).alias("tile_row"),
    ).distinct()


def full_parents(tiles: DataFrame) -> DataFrame:
    """Parents that have all four children among ``tiles``."""
    parent = [(F.col("zoom_level") - 1).alias("zoom_level"), F.shiftright("tile_column", 1).alias("tile_column"), F.shiftright("tile_row", 1).alias("tile_row")]
    return tiles.distinct().where("zoom_level > 0").groupBy(*parent).count().where("count = 4").drop("count")


def mask_bits(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """One row with ``bits``: the depth-first bits of the mask of ``tiles`` of ``max_zoom`` and above.

    Nodes are made bottom up, a zoom at a time: a node is inside if it is a tile or has one below, so tiles need
    no ancestors among them; a node whose four children are all full collapses to a full leaf. The text is put
    together from the nodes' strings along the tree, so it costs a grouping a zoom. The whole mask is one string:
    an export, of thousands of tiles. To filter tiles by a mask, use its tiles (:func:`contained`).
    """
    own = lambda zoom, bits: tiles.where(F.col("zoom_level") == zoom).select("tile_column", "tile_row").distinct().withColumn("bits", F.lit(bits))
    level = own(max_zoom, "01")
    for zoom in range(max_zoom - 1, -1, -1):
        quadrant = (F.col("tile_row") % 2) * 2 + F.col("tile_column") % 2
        parts = level.groupBy(F.shiftright("tile_column", 1).alias("tile_column"), F.shiftright("tile_row", 1).alias("tile_row")).agg(
            F.map_from_entries(F.collect_list(F.struct(quadrant.cast("int"), "bits"))).alias("q")
        )
        below = F.concat(*[F.coalesce(F.try_element_at("q", F.lit(i)), F.lit("00")) for i in range(4)])
        made = parts.select("tile_column", "tile_row", F.when(below == "01010101", "01").otherwise(F.concat(F.lit("11"), below)).alias("bits"))
        level = made.unionByName(own(zoom, "1100000000")).groupBy("tile_column", "tile_row").agg(F.max_by("bits", F.when(F.col("bits") == "1100000000", 0).otherwise(1)).alias("bits"))
    return level.select("bits")


def mask_text(bits: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else bits_to_text([int(c) for c in b]))

    return bits.withColumn("mask", encode("bits"))


def mask_of(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """One row with ``mask``: the text of a mask of tiles from an archive, a list or a shape, down to ``max_zoom`` or the deepest tile."""
    deepest = tiles.agg(F.max("zoom_level")).first()[0]
    return mask_text(mask_bits(tiles, min(max_zoom, deepest or 0)))


def mask_zoom(tiles: DataFrame, zooms: range, least: int = 512) -> DataFrame:
    """One row, ``zoom``: the first whose mask has ``least`` characters, else the last tried."""
    sizes = None
    for zoom in zooms:
        one = mask_text(mask_bits(tiles, zoom)).select(F.lit(zoom).alias("zoom"), F.length("mask").alias("length"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return zoom_by_size(sizes, least)


def contained(tiles: DataFrame, mask_leaves: DataFrame) -> DataFrame:
    """The tiles that a leaf of the mask or one above them holds: an equi-join on their ancestors."""
    own = tiles.withColumn("_up", F.explode(F.sequence(F.lit(0), F.col("zoom_level").cast("int"))))
    leaves = mask_leaves.select(F.col("zoom_level").alias("_z"), F.col("tile_column").alias("_x"), F.col("tile_row").alias("_y")).distinct()
    at = (
        (F.col("zoom_level") - F.col("_up") == F.col("_z"))
        & (F.call_function("shiftright", F.col("tile_column"), F.col("_up")) == F.col("_x"))
        & (F.call_function("shiftright", F.col("tile_row"), F.col("_up")) == F.col("_y"))
    )
    return own.join(leaves, at, "left_semi").drop("_up").distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("zoom_level", "tile_column", "tile_row").intersect(b.select("zoom_level", "tile_column", "tile_row"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("zoom_level", "tile_column", "tile_row").union(b.select("zoom_level", "tile_column", "tile_row")).distinct()


def zoom_by_size(sizes: DataFrame, least: int = 512) -> DataFrame:
    """The first zoom whose mask has ``least`` characters, else the last zoom, of ``sizes (zoom, length)``."""
    return sizes.agg(F.coalesce(F.min(F.when(F.col("length") >= least, F.col("zoom"))), F.max("zoom")).alias("zoom"))
