"""Elevation squares, tiled rasters and polygon files as Spark formats: ``hgt``, ``raster`` and ``poly``.

With ``option("pushFilters", "true")`` comparisons of whole-number columns with values are the readers' own: they leave out files
by name, blocks by place and lines of a file by offset, and Spark does not repeat them. :func:`.mbtiles.pushed` loads a table
that way and says why that is not the default. A partition is some files, or some blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .grids import VOID, decode_block
from .rasters import levels
from .vectors import parse_poly

_SQUARE = re.compile(r"([NS])(\d\d)([EW])(\d\d\d)\.hgt$")
#: Pixels of a partition, about.
PIXELS = 1 << 22


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    path = path.replace("file:", "file://", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str, ending: str) -> list[tuple[str, int]]:
    """Paths and sizes of a folder's files with an ending, or of the one file."""
    fs, at = _system(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith((".", "_")))


@dataclass
class Limits:
    """What pushed comparisons leave of a whole number: from, to, and the values of a list."""

    low: float = -math.inf
    high: float = math.inf
    among: set | None = None

    def add(self, f) -> None:
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else {v for v in f.value if v is not None}
            self.among = values if self.among is None else self.among & values
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = (values >= self.low) & (values <= self.high)
        return out if self.among is None else out & np.isin(values, list(self.among))


@dataclass
class _Work(InputPartition):
    parts: list = field(default_factory=list)


class _Pruned(DataSourceReader):
    #: Columns of whole numbers, or names, that the reader compares itself.
    own: tuple[str, ...] = ()

    def __init__(self, path: str, push: bool = True):
        self.path, self.push = path, push
        self.limits: dict[str, Limits] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if not self.push:
                yield f
            elif name in self.own and isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                self.limits.setdefault(name, Limits()).add(f)
            elif not (name in self.own and isinstance(f, IsNotNull)):
                yield f

    def holds(self, name: str, values) -> np.ndarray:
        values = np.asarray(values)
        return self.limits[name].holds(values) if name in self.limits else np.ones(values.shape, bool)

    def packed(self, parts: list[tuple[int, object]]) -> list[_Work]:
        """Partitions of about ``PIXELS`` pixels out of parts of so many."""
        out, held = [_Work()], 0
        for size, part in parts:
            if held and held + size > PIXELS:
                out.append(_Work())
                held = 0
            out[-1].parts.append(part)
            held += size
        return out


class _Squares(_Pruned):
    own = ("lon_deg", "lat_deg", "gx", "gy")

    def partitions(self):
        parts = []
        for path, size in _files(self.path, ".hgt"):
            if m := _SQUARE.search(path):
                lat, lon = int(m[2]) * (1 if m[1] == "N" else -1), int(m[4]) * (1 if m[3] == "E" else -1)
                if self.holds("lon_deg", lon) and self.holds("lat_deg", lat):
                    parts.append((size // 2, (path, lon, lat, size)))
        return self.packed(parts)

    def read(self, work: _Work) -> Iterator[pa.RecordBatch]:
        fs, _ = _system(self.path)
        for path, lon, lat, size in work.parts:
            n = math.isqrt(size // 2)
            if n < 2 or n * n * 2 != size:
                raise ValueError(f"{path}: {size} bytes are no square grid")
            gy, gx = np.flatnonzero(self.holds("gy", np.arange(n))), np.flatnonzero(self.holds("gx", np.arange(n)))
            with fs.open_input_file(path) as source:
                for lines in np.split(gy, np.flatnonzero(np.diff(gy) > 1) + 1) if len(gy) else []:  # lines that follow each other
                    source.seek(int(lines[0]) * n * 2)
                    some = np.frombuffer(source.read(len(lines) * n * 2), ">i2").reshape(len(lines), n)[:, gx].ravel().astype(np.int32)
                    yield pa.record_batch(
                        {
                            "lon_deg": pa.array(np.full(len(some), lon, np.int32)),
                            "lat_deg": pa.array(np.full(len(some), lat, np.int32)),
                            "gx": pa.array(np.tile(gx, len(lines)).astype(np.int32)),
                            "gy": pa.array(np.repeat(lines, len(gx)).astype(np.int32)),
                            "elev": pa.array(some, mask=some == VOID),
                        }
                    )


class _Rasters(_Pruned):
    own = ("level", "gx", "gy")

    def partitions(self):
        fs, _ = _system(self.path)
        parts = []
        for path, _ in _files(self.path, ".tif"):
            with fs.open_input_file(path) as source:

                def read(offset: int, size: int) -> bytes:
                    source.seek(offset)
                    return source.read(size)

                found = levels(read)
            for k, own in enumerate(found):
                if not self.holds("level", k):
                    continue
                w, h = own.block
                y, x = np.divmod(np.arange(len(own.offsets)), -(-own.width // w))
                for i in range(len(own.offsets)):
                    inside = self.holds("gx", x[i] * w + np.arange(w)).any() and self.holds("gy", y[i] * h + np.arange(h)).any()
                    if inside and own.counts[i]:
                        parts.append((w * h, (path, k, int(x[i]) * w, int(y[i]) * h, w, h, own.width, own.height, own.codec, own.predictor, own.nodata, own.offsets[i], own.counts[i])))
        return self.packed(parts)

    def read(self, work: _Work) -> Iterator[pa.RecordBatch]:
        fs, _ = _system(self.path)
        for path, k, x0, y0, w, h, width, height, codec, predictor, nodata, offset, size in work.parts:
            with fs.open_input_file(path) as source:
                source.seek(offset)
                grid = decode_block(source.read(size), w, h, codec, predictor, nodata)
            if grid is None:
                continue
            gx, gy = x0 + np.arange(w), y0 + np.arange(h)
            wanted = np.isfinite(grid) & (self.holds("gx", gx) & (gx < width))[None, :] & (self.holds("gy", gy) & (gy < height))[:, None]
            y, x = np.nonzero(wanted)
            yield pa.record_batch(
                {
                    "path": pa.array([path] * len(x), pa.string()),
                    "level": pa.array(np.full(len(x), k, np.int32)),
                    "gx": pa.array(gx[x].astype(np.int64)),
                    "gy": pa.array(gy[y].astype(np.int64)),
                    "elev": pa.array(grid[y, x].astype(np.float64)),
                }
            )


class _Polys(_Pruned):
    own = ("file",)

    def partitions(self):
        name = lambda path: path.rpartition("/")[2].removesuffix(".poly")
        return self.packed([(size, path) for path, size in _files(self.path, ".poly") if self.holds("file", name(path))])

    def holds(self, name: str, values) -> np.ndarray:
        own = self.limits.get(name)
        return np.asarray(own is None or own.among is None or values in own.among)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull)):
                yield from super().pushFilters([f])
            else:
                yield f

    def read(self, work: _Work) -> Iterator[tuple]:
        fs, _ = _system(self.path)
        for path in work.parts:
            with fs.open_input_file(path) as source:
                name, rings = parse_poly(source.read().decode())
            stem = path.rpartition("/")[2].removesuffix(".poly")
            for i, (hole, points) in enumerate(rings):
                for seq, (lon, lat) in enumerate(points):
                    yield stem, name, i, int(hole), seq, lon, lat


def _format(kind: str, columns: str, reader: type[_Pruned]) -> type[DataSource]:
    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return reader(self.options["path"], self.options.get("pushFilters") == "true")

    return Format


FORMATS = (
    _format("hgt", "lon_deg int, lat_deg int, gx int, gy int, elev int", _Squares),
    _format("raster", "path string, level int, gx long, gy long, elev double", _Rasters),
    _format("poly", "file string, name string, ring_id int, is_hole int, seq int, lon double, lat double", _Polys),
)


def register(spark: SparkSession) -> None:
    """Make the formats known; where a reader is asked to, it takes filters from here on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for one in FORMATS:
        spark.dataSource.register(one)
