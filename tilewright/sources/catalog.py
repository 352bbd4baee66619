"""Directories of tile archives, mirror listings and statistics files as tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mbtiles

PROBED = "metadata map<string,string>, min_zoom int, max_zoom int, layout string, error string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(area, path, file_name, size_bytes, modified)`` of files one folder below ``root``; dot files and dot folders are left out.

    The area is the folder's name. Contents are not read. A root that is not there has no files.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "area string, path string, file_name string, size_bytes long, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    out = files.select(
        F.element_at(parts, -2).alias("area"), "path", F.element_at(parts, -1).alias("file_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")
    )
    return out.where("NOT startswith(file_name, '.') AND NOT startswith(area, '.')")


def probe(files: DataFrame) -> DataFrame:
    """The files with what their archive says of itself; a file that cannot be read is listed with its error."""
    keep = files.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", " + PROBED

    def one(path: str) -> tuple:
        path = path.removeprefix("file:")
        path = "/" + path.lstrip("/")
        try:
            layout = mbtiles.layout(path)
            with mbtiles._open(path) as db:
                metadata = {str(k): None if v is None else str(v) for k, v in db.execute("SELECT name, value FROM metadata")}
                table = {"compact": "tiles_shallow", "legacy": "map", "classic": "tiles"}[layout]
                low, high = db.execute(f"SELECT min(zoom_level), max(zoom_level) FROM {table}").fetchone()
            return metadata, low, high, layout, None
        except Exception as e:  # whatever is wrong with the file is what the row says
            return None, None, None, None, f"{type(e).__name__}: {e}"

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = pd.DataFrame([one(p) for p in f["path"]], columns=["metadata", "min_zoom", "max_zoom", "layout", "error"], index=f.index)
            found[["min_zoom", "max_zoom"]] = found[["min_zoom", "max_zoom"]].astype("Int32")
            yield pd.concat([f, found], axis=1)[[*keep, *found.columns]]

    return files.mapInPandas(each, schema)


def hrefs(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(href, name, date)`` of a mirror's listing: dated files (yymmdd), and those called latest with a null date."""
    found = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), 1))).alias("href"))
    dated = r"([A-Za-z0-9-]+)-(?:([0-9]{6})|latest)\.osm\.pbf$"
    date = F.regexp_extract("href", dated, 2)
    rows = found.where(F.col("href").rlike(dated))
    return rows.select("href", F.regexp_extract("href", dated, 1).alias("name"), F.when(date != "", F.try_to_date(date, "yyMMdd")).alias("date"))


def layer_stats(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of each layer from tab-separated statistics with a header: column 6 is the layer, column 7 the bytes."""
    rows = spark.read.csv(path, sep="\t", header=True)
    layer, size = (F.col(f"`{rows.columns[i]}`") for i in (5, 6))
    return rows.groupBy(layer.alias("layer")).agg(F.sum(size.try_cast("long")).alias("bytes"))


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """Elevation sources from a JSON list, the lowest priority first; a document with ``sources`` reads alike."""
    schema = "name string, type string, path string, clamp_min double"
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"sources array<struct<{schema.replace(' string', ':string').replace(' double', ':double')}>>")["sources"], F.from_json("value", f"array<struct<{schema.replace(' string', ':string').replace(' double', ':double')}>>"))
    return text.select(F.posexplode(listed).alias("priority", "s")).select("priority", "s.*")


def bounds_of_header(text: Column) -> Column:
    """Struct (west, south, east, north) of ``name: value`` lines of an extract's statistics."""
    side = lambda key: F.regexp_extract(text, rf"(?m)\b{key}\s*[:=]\s*(-?[0-9.]+)", 1).try_cast("double")
    return F.struct(side("minlon").alias("west"), side("minlat").alias("south"), side("maxlon").alias("east"), side("maxlat").alias("north"))


def tile_list(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a tab-separated list with a header: x, y, zoom."""
    rows = spark.read.csv(path, sep="\t", header=True)
    x, y, z = (F.col(f"`{c}`") for c in rows.columns[:3])
    return rows.select(z.cast("int").alias("zoom_level"), x.cast("long").alias("tile_column"), y.cast("long").alias("tile_row"))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of settings, presets or state, a row each, by path or pattern; one that is missing or malformed has nulls."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return spark.range(1).select(F.from_json(F.lit(None).cast("string"), schema).alias("d")).select("d.*")
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """Write a small JSON document: under another name first, so that readers see the old one or the new one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at, part = fs_path(path), fs_path(f"{path}.part")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray((json.dumps(document, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``files (path, data)``, binary or text, below ``folder``; ``(path, bytes)`` of what was written.

    Each file is renamed when whole, so a repeated task leaves the same files.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["data"]):
                at = f"{folder}/{path}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(data)
                os.replace(part, at)
            yield pd.DataFrame({"path": f["path"], "bytes": f["data"].map(len)})

    return files.select("path", F.col("data").cast("binary").alias("data")).mapInPandas(each, "path string, bytes long")
