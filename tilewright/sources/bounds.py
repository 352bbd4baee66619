"""An index of files' bounds that is kept: only new and changed files are opened, and a box reads few of its files.

The index is a table of Parquet in a folder of versions; a version is whole when its folder has its mark, and readers take
the newest whole one. Files are known by path, size and time of change. Rows are in the order of a space-filling curve, in files
of bounded size, so what a box touches lies in few of them and Parquet's own bounds leave out the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Bounds = tuple[float, float, float, float]
_COLUMNS = "path string, size long, modified timestamp, west double, south double, east double, north double, place long"
#: Rows of a file of the index.
_FILE = 100_000


def curve_place(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Bits of the middle's longitude and latitude in turn, 15 of each: near places have near numbers, mostly."""
    x = F.least(F.greatest(((west + east) / 2 + 180) / 360 * 32768, F.lit(0)), F.lit(32767)).cast("long")
    y = F.least(F.greatest(((south + north) / 2 + 90) / 180 * 32768, F.lit(0)), F.lit(32767)).cast("long")
    out = F.lit(0).cast("long")
    for bit in range(15):
        for k, v in enumerate((x, y)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, bit).bitwiseAND(F.lit(1).cast("long")), 2 * bit + k))
    return out


def _versions(spark: SparkSession, index: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(index)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(at) if fs.exists(at) else []:
        m = re.fullmatch(r"v([0-9]+)", status.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(m[1]))
    return sorted(found)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The newest whole version; without any, no rows."""
    found = _versions(spark, index)
    return spark.read.schema(_COLUMNS).parquet(f"{index}/v{found[-1]}") if found else spark.createDataFrame([], _COLUMNS)


def refresh(spark: SparkSession, files: DataFrame, index: str, bounds_of: Callable[[str], Bounds | None]) -> DataFrame:
    """Writes a version of the index for ``files (path, size, modified)`` and gives the paths that were opened for it.

    ``bounds_of`` opens a file and gives west, south, east and north, or None where it has none: such files are kept with
    nulls. Files that are gone leave the index; those with the size and time of the version before are not opened.
    """
    before = read_index(spark, index)
    known = files.select("path", "size", "modified").join(before, ["path", "size", "modified"], "left_semi").select("path")
    fresh = files.select("path", "size", "modified").join(known, "path", "left_anti")

    def open_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [bounds_of(p) or (None,) * 4 for p in f["path"]]
            yield f.assign(**{c: pd.Series([b[i] for b in found], index=f.index, dtype=float) for i, c in enumerate(("west", "south", "east", "north"))})

    opened = fresh.mapInPandas(open_, "path string, size long, modified timestamp, west double, south double, east double, north double")
    sides = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("west", "south", "east", "north")]
    placed = opened.select("path", "size", "modified", *sides).withColumn("place", F.coalesce(curve_place(*[F.col(c) for c in ("west", "south", "east", "north")]), F.lit(-1).cast("long")))
    stays = before.join(known, "path", "left_semi")
    number = (_versions(spark, index) or [0])[-1] + 1
    whole = stays.unionByName(placed.select(*stays.columns))
    parts = max(1, -(-files.count() // _FILE))
    whole.repartitionByRange(parts, "place").sortWithinPartitions("place").write.option("parquet.block.row.count.limit", 5000).mode("overwrite").parquet(f"{index}/v{number}")
    return read_index(spark, index).join(stays.select("path"), "path", "left_anti").select("path")


def touching(spark: SparkSession, index: str, box: Bounds) -> DataFrame:
    """Rows of the index that share area with the box; files without bounds are among them, since nothing rules them out."""
    w, s, e, n = box
    inside = (F.col("west") < e) & (F.col("east") > w) & (F.col("south") < n) & (F.col("north") > s)
    return read_index(spark, index).where(F.col("west").isNull() | inside)


def raster_bounds(path: str) -> Bounds | None:
    """Bounds of a raster file in its own units, from its tags alone; None for a file that is no raster."""
    from .rasters import _opened, levels

    with _opened(path) as source:

        def read(offset: int, size: int) -> bytes:
            source.seek(offset)
            return source.read(size)

        try:
            first = levels(read)[0]
        except (ValueError, KeyError, IndexError, OSError):
            return None
    (west, north), (dx, dy) = first.origin, first.scale
    return west, north - dy * first.height, west + dx * first.width, north


def listed(spark: SparkSession, path: str, ending: str = "*.tif*") -> DataFrame:
    """``(path, size, modified)`` of the files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", ending).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
