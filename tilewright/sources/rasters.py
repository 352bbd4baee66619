"""Tiled float rasters (TIFF): levels and blocks as tables, sampling as joins.

A first pass reads the tags of each file, a few kilobytes wherever they lie in it, and lists one row a block:
where its bytes are. The rows are dealt out, and tasks read and decode their own byte ranges, so a raster of any
size is spread over the cluster by block. Paths are of any file system that Arrow and Spark both reach.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .grids import decode_block

# Fixed values of the TIFF format: sizes of field types, tags, compression schemes.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, COMPRESSION, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, BITS, FORMAT = 256, 257, 259, 317, 322, 323, 324, 325, 258, 339
SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
CODECS = {1: "none", 8: "deflate", 32946: "deflate", 50000: "zstd"}


@dataclass
class Level:
    """One resolution: size, block size, origin and scale in map units, and where its blocks lie."""

    width: int
    height: int
    block: tuple[int, int]
    origin: tuple[float, float]
    scale: tuple[float, float]
    codec: str
    predictor: int
    nodata: float | None
    offsets: list[int]
    counts: list[int]


#: Directories and entries of a directory that are read at most: a chain that points back to itself ends.
MOST_LEVELS, MOST_ENTRIES = 32, 4096

Read = Callable[[int, int], bytes]


def _directories(read: Read) -> Iterator[dict[int, tuple]]:
    raw = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise ValueError("not a TIFF")
    (kind,) = struct.unpack(order + "H", raw[2:4])
    if kind not in (42, 43):
        raise ValueError("not a TIFF")
    big = kind == 43
    word = order + ("Q" if big else "I")
    at = struct.unpack(word, raw[8:16] if big else raw[4:8])[0]
    entry, head, value = (20, 8, 8) if big else (12, 2, 4)
    seen: set[int] = set()
    while at and at not in seen and len(seen) < MOST_LEVELS:
        seen.add(at)
        (n,) = struct.unpack(order + ("Q" if big else "H"), read(at, head))
        if n > MOST_ENTRIES:
            raise ValueError(f"a directory of {n} entries")
        body = read(at + head, n * entry + value)
        tags: dict[int, tuple] = {}
        for here in range(0, n * entry, entry):
            tag, code = struct.unpack_from(order + "HH", body, here)
            (count,) = struct.unpack_from(word, body, here + 4)
            if code not in TYPE_SIZE:
                continue
            size = TYPE_SIZE[code] * count
            own = body[here + entry - value : here + entry]
            own = own[:size] if size <= value else read(struct.unpack(word, own)[0], size)
            if code == 2:
                tags[tag] = (own.rstrip(b"\0").decode(),)
            elif code in TYPE_CODE:
                tags[tag] = struct.unpack(f"{order}{count}{TYPE_CODE[code]}", own)
        yield tags
        (at,) = struct.unpack(word, body[n * entry :])


def levels(source: bytes | Read) -> list[Level]:
    """All levels, the full resolution first, of a file's bytes or of a function (offset, size) that reads them.

    Directories that are no tiled 32-bit floats (masks, thumbnails) are passed over; ValueError if none is left.
    """
    read = source if callable(source) else lambda at, size: source[at : at + size]
    out: list[Level] = []
    nodata = None
    for tags in _directories(read):
        nodata = float(tags[NODATA][0]) if nodata is None and NODATA in tags else nodata
        codec = CODECS.get(tags.get(COMPRESSION, (1,))[0])
        if tags.get(BITS, (0,))[0] != 32 or tags.get(FORMAT, (1,))[0] != 3 or TILE_WIDTH not in tags or codec is None:
            continue
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        if out:  # overviews have the scale of their size
            scale = (out[0].scale[0] * out[0].width / width, out[0].scale[1] * out[0].height / height)
            origin = out[0].origin
        else:
            scale = tuple(map(float, tags.get(SCALE, (1.0, 1.0))[:2]))
            tie = tags.get(TIEPOINT, (0.0,) * 6)
            origin = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1])
        out.append(Level(width, height, (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]), origin, scale, codec, tags.get(PREDICTOR, (1,))[0], nodata, list(tags[OFFSETS]), list(tags[COUNTS])))
    if not out:
        raise ValueError("no tiled 32-bit float image in the file")
    for level in out:
        level.nodata = nodata
    return out


def _opened(path: str):
    """An Arrow file of a path as Spark lists it (``file:/a``, ``hdfs://h/a``)."""
    from pyarrow import fs as pafs

    fs, at = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.open_input_file(at)


_PLACE = "level int, gx0 int, gy0 int, width int, height int, origin_x double, origin_y double, scale_x double, scale_y double"


def list_blocks(spark: SparkSession, path: str | list[str], level: int | None = None) -> DataFrame:
    """``(path, level, gx0, gy0, width, height, origin_x, ..., codec, predictor, nodata, offset, size)``: one row a block of one level or all.

    ``path`` is a file, a folder, a glob or a list of them. Only the tags are read.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in f["path"]:
                with _opened(at) as source:

                    def read(offset: int, size: int) -> bytes:
                        source.seek(offset)
                        return source.read(size)

                    found = levels(read)
                for k, own in enumerate(found):
                    if level is not None and k != level:
                        continue
                    across = -(-own.width // own.block[0])
                    y, x = np.divmod(np.arange(len(own.offsets)), across)
                    yield pd.DataFrame(
                        {
                            "path": at, "level": k, "gx0": x * own.block[0], "gy0": y * own.block[1], "width": own.block[0], "height": own.block[1],
                            "origin_x": own.origin[0], "origin_y": own.origin[1], "scale_x": own.scale[0], "scale_y": own.scale[1],
                            "codec": own.codec, "predictor": own.predictor, "nodata": np.nan if own.nodata is None else own.nodata, "offset": own.offsets, "size": own.counts,
                        }
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path).select("path")
    return files.mapInPandas(each, f"path string, {_PLACE}, codec string, predictor int, nodata double, offset long, size long")


def read_blocks(spark: SparkSession, path: str | list[str], level: int = 0) -> DataFrame:
    """``(path, level, gx0, gy0, width, height, origin_x, origin_y, scale_x, scale_y, data)``: the blocks of a level.

    ``data`` is little-endian 32-bit floats, row by row, NaN without a value; null for an empty block.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, own in f.groupby("path", sort=False):
                data = []
                with _opened(at) as source:
                    for b in own.itertuples():
                        source.seek(b.offset)
                        grid = decode_block(source.read(b.size), b.width, b.height, b.codec, b.predictor, None if np.isnan(b.nodata) else b.nodata)
                        data.append(None if grid is None else grid.astype("<f4").tobytes())
                yield own.drop(columns=["codec", "predictor", "nodata", "offset", "size"]).assign(data=data)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return list_blocks(spark, path, level).repartition(parts, "path", "gx0", "gy0").mapInPandas(each, f"path string, {_PLACE}, data binary")


def block_pixels(blocks: DataFrame) -> DataFrame:
    """``(path, level, gx, gy, elev)`` of every pixel that has a value."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b in f.itertuples():
                if b.data is None:
                    continue
                v = np.frombuffer(b.data, "<f4")
                at = np.flatnonzero(~np.isnan(v))
                y, x = np.divmod(at, b.width)
                yield pd.DataFrame({"path": b.path, "level": b.level, "gx": (b.gx0 + x).astype(np.int64), "gy": (b.gy0 + y).astype(np.int64), "elev": v[at].astype(np.float64)})

    return blocks.mapInPandas(each, "path string, level int, gx long, gy long, elev double")


def write_tiff(pixels: np.ndarray, block: int, origin: tuple[float, float], scale: float, nodata: float, deflate: bool = True) -> bytes:
    """A small tiled float raster of one level, for tests and exports of one grid."""
    import zlib

    h, w = pixels.shape
    parts = []
    for y in range(0, h, block):
        for x in range(0, w, block):
            b = np.full((block, block), nodata, "<f4")
            piece = pixels[y : y + block, x : x + block]
            b[: piece.shape[0], : piece.shape[1]] = piece
            parts.append(zlib.compress(b.tobytes()) if deflate else b.tobytes())
    body, offsets = b"", []
    for p in parts:
        offsets.append(8 + len(body))
        body += p
    text = f"{nodata}\0".encode()
    tags = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [32]), (COMPRESSION, 3, [8 if deflate else 1]), (TILE_WIDTH, 3, [block]), (TILE_HEIGHT, 3, [block]),
        (OFFSETS, 4, offsets), (COUNTS, 4, [len(p) for p in parts]), (FORMAT, 3, [3]), (SCALE, 12, [scale, scale, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, *origin, 0.0]), (NODATA, 2, text),
    ]
    start = 8 + len(body)
    extra_at, extra, entries = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, values in sorted(tags, key=lambda t: t[0]):
        raw = values if code == 2 else struct.pack(f"<{len(values)}{TYPE_CODE[code]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, code, len(values), extra_at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", start) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra
