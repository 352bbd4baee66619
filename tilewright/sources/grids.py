"""Elevation files: .hgt grids, float rasters' blocks and PNG tiles, read with Spark's binaryFile source.

Each reader is a small codec over one file's bytes; Spark lists the files and deals them out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = -32768


def parse_hgt(raw: bytes) -> np.ndarray:
    """Square grid of big-endian 16-bit heights, north first; ValueError if it is not square."""
    n = int(round((len(raw) / 2) ** 0.5))
    if n < 2 or n * n * 2 != len(raw):
        raise ValueError(f"{len(raw)} bytes are no square grid")
    return np.frombuffer(raw, ">i2").reshape(n, n).astype(np.int16)


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, gx, gy, elev) of every sample of .hgt files; voids are null, gy 0 is the north."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, raw in zip(f["path"], f["content"]):
                grid = parse_hgt(raw)
                gy, gx = np.divmod(np.arange(grid.size), grid.shape[1])
                elev = pd.array(grid.ravel().astype(np.int64), "Int32")
                elev[grid.ravel() == VOID] = pd.NA
                yield pd.DataFrame({"path": at, "name": at.rpartition("/")[2].removesuffix(".hgt"), "gx": gx.astype(np.int32), "gy": gy.astype(np.int32), "elev": elev})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(each, "path string, name string, gx int, gy int, elev int")


def hgt_bytes(data: Column) -> Column:
    """The content of a .hgt file from a square of doubles, NaN or null for a void."""

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda d: np.nan_to_num(np.frombuffer(d), nan=VOID).astype(">i2").tobytes())

    return packed(data)


def undo_float_predictor(raw: bytes, width: int, height: int) -> np.ndarray:
    """Rows of 32-bit floats from bytes that hold each row's differences, highest bytes of all values first."""
    rows = np.frombuffer(raw, np.uint8, 4 * width * height).reshape(height, 4 * width)
    rows = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(height, 4, width)
    return rows.transpose(0, 2, 1).copy().view(">f4")[:, :, 0].astype(np.float32)


def decode_block(raw: bytes, width: int, height: int, codec: str, predictor: int = 1, nodata: float | None = None) -> np.ndarray | None:
    """One block of a float raster: none, deflate or zstd, predictor 1 or 3. None for an empty block; nodata becomes NaN."""
    if not raw:
        return None
    if codec == "deflate":
        raw = zlib.decompress(raw)
    elif codec == "zstd":
        import pyarrow

        raw = pyarrow.decompress(raw, 4 * width * height, codec="zstd").to_pybytes()
    elif codec != "none":
        raise ValueError(f"no codec {codec}")
    if predictor == 3:
        out = undo_float_predictor(raw, width, height)
    elif predictor == 1:
        out = np.frombuffer(raw, "<f4", width * height).reshape(height, width).copy()
    else:
        raise ValueError(f"no predictor {predictor}")
    if nodata is not None:
        out[out == np.float32(nodata)] = np.nan
    return out


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB picture (height, width, 3) as PNG."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, 3 * w)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit PNG without interlacing; ValueError for anything else."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", b""
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        head, data = (body if kind == b"IHDR" else head), (data + body if kind == b"IDAT" else data)
        at += 12 + size
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("unsupported PNG")
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
    return _unfiltered(rows[:, 0].copy(), rows[:, 1:].reshape(h, w, channels).astype(np.int32)).astype(np.uint8)


def _unfiltered(kind: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Pixels from a PNG's lines ``[y, x, channel]`` and each line's filter.

    Lines that differ from the one before or from the pixel before at most are sums. Means and Paeth's choice need the
    pixels to the left, above and between, all of which lie on the two anti-diagonals before: one goes at a time.
    """
    h, w, channels = line.shape
    out = np.zeros((h + 1, w + 1, channels), np.int32)
    if kind.max(initial=0) < 3:
        for y in range(h):
            own = np.cumsum(line[y], axis=0) if kind[y] == 1 else line[y] + (out[y, 1:] if kind[y] == 2 else 0)
            out[y + 1, 1:] = own & 255
        return out[1:, 1:]
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(np.broadcast_to(kind[y, None], left.shape), [0, left, up, (left + up) >> 1, paeth])
        out[y + 1, x + 1] = (line[y, x] + guess) & 255
    return out[1:, 1:]


def tile_pixels(tiles: DataFrame, encoding: str = "terrarium") -> DataFrame:
    """(zoom_level, tile_column, tile_row, gx, gy, elev) of PNG elevation tiles; other blobs and non-square pictures give nothing."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for z, x, y, raw in zip(f["zoom_level"], f["tile_column"], f["tile_row"], f["tile_data"]):
                try:
                    px = decode_png(raw).astype(np.float64) if raw is not None else None
                except ValueError:
                    continue
                if px is None or px.shape[0] != px.shape[1] or px.shape[2] < 3:
                    continue
                r, g, b = px[:, :, 0], px[:, :, 1], px[:, :, 2]
                elev = r * 256 + g + b / 256 - 32768 if encoding == "terrarium" else -10000 + (r * 65536 + g * 256 + b) * 0.1
                gy, gx = np.divmod(np.arange(elev.size), elev.shape[1])
                yield pd.DataFrame({"zoom_level": z, "tile_column": x, "tile_row": y, "gx": gx.astype(np.int32), "gy": gy.astype(np.int32), "elev": elev.ravel()})

    rows = tiles.select("zoom_level", "tile_column", "tile_row", "tile_data")
    return rows.mapInPandas(each, "zoom_level int, tile_column long, tile_row long, gx int, gy int, elev double")


def pack_blobs(tiles: DataFrame, level: int = 9) -> DataFrame:
    """The tiles with gzip blobs and both sizes."""
    import gzip

    @F.pandas_udf("binary")
    def packed(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else gzip.compress(bytes(b), level, mtime=0))

    return tiles.withColumn("raw_bytes", F.octet_length("tile_data")).withColumn("tile_data", packed("tile_data")).withColumn("packed_bytes", F.octet_length("tile_data"))


def unpack_blobs(tiles: DataFrame) -> DataFrame:
    """The tiles with gzip blobs unpacked; other blobs stay."""
    import gzip

    @F.pandas_udf("binary")
    def unpacked(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: gzip.decompress(b) if b is not None and bytes(b[:2]) == b"\x1f\x8b" else b)

    return tiles.withColumn("tile_data", unpacked("tile_data"))


def recompress(tiles: DataFrame, level: int = 9) -> tuple[DataFrame, DataFrame]:
    """The tiles with their blobs packed anew, and one row ``(tiles, before_bytes, after_bytes, saved)``."""
    before = F.sum(F.octet_length("_before"))
    packed = pack_blobs(unpack_blobs(tiles.withColumn("_before", F.col("tile_data"))), level)
    report = packed.agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(before, F.lit(0)).alias("before_bytes"), F.coalesce(F.sum("packed_bytes"), F.lit(0)).alias("after_bytes"))
    saved = F.when(F.col("before_bytes") > 0, 1.0 - F.col("after_bytes") / F.col("before_bytes")).otherwise(0.0)
    return packed.drop("_before", "raw_bytes", "packed_bytes"), report.withColumn("saved", saved)


def write_tree(blobs: DataFrame, folder: str) -> DataFrame:
    """Write ``blobs (path, tile_data)`` as files below ``folder``, gzip unpacked; ``(path, bytes)`` of what was written.

    Each file is renamed when whole, so a repeated task leaves the same tree.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for f in frames:
            sizes = []
            for path, blob in zip(f["path"], f["tile_data"]):
                at = f"{folder}/{path}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    sizes.append(out.write(bytes(blob or b"")))
                os.replace(part, at)
            yield pd.DataFrame({"path": f["path"], "bytes": sizes})

    return unpack_blobs(blobs.select("path", "tile_data")).mapInPandas(each, "path string, bytes long")


def located_hgt(wanted: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """``wanted (lon, lat)`` squares with the ``path`` of their file in ``listing (path)``, null where there is none.

    A file in the folder of its latitude comes before one directly under the root.
    """
    from ..functions.tiles import degree_name

    name = degree_name(F.col("lon"), F.col("lat"))
    turn = lambda k, path: F.struct(F.lit(k).alias("rank"), path.alias("path"))
    base = F.lit(root.rstrip("/") + "/")
    turns = F.array(turn(0, F.concat(base, F.substring(name, 1, 3), F.lit("/"), name, F.lit(".hgt"))), turn(1, F.concat(base, name, F.lit(".hgt"))))
    asked = wanted.select("lon", "lat").distinct().withColumn("t", F.explode(turns)).select("lon", "lat", "t.rank", "t.path")
    have = listing.select(F.col("path").alias("has")).distinct()
    return asked.join(have, asked["path"] == have["has"], "left").groupBy("lon", "lat").agg(F.min_by("has", F.when(F.col("has").isNotNull(), F.col("rank"))).alias("path"))


def hgt_coverage(listing: DataFrame) -> DataFrame:
    """The squares (lon, lat) that ``listing (path)`` has files of, each once, in order; other names are passed over."""
    from ..functions.tiles import parse_degree_name

    file = F.element_at(F.split("path", "/"), -1)
    lon, lat = parse_degree_name(F.when(file.rlike("(?i)^[ns][0-9]{2}[ew][0-9]{3}.*[.]hgt$"), file))
    return listing.select(lon.cast("int").alias("lon"), lat.cast("int").alias("lat")).where("lon IS NOT NULL").distinct().orderBy("lon", "lat")
