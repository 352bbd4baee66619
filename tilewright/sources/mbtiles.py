"""Tile archives (SQLite files) as a Spark data source.

``spark.read.format("mbtiles").load(path)`` gives zoom_level, tile_column, tile_row (TMS), tile_data;
``option("table", "metadata")`` gives name, value and ``option("table", "addresses")`` the tiles with ``nbytes`` in the
place of their content, which is not read then. Partitions are ranges of columns, and of rows where a column
is large, of about ``option("splitBytes")`` each, small zooms together. With ``option("pushFilters", "true")`` comparisons of
the address with values go into the file; see :func:`pushed` for when. Classic, compact and legacy layouts read alike.

Writing makes one part archive a task and joins them when the job commits, in a single file that
appears under its name only when whole: an export of what fits one file. ``write_shards`` writes any number of
tiles, a file for each block of them. ``option("layout", "compact")`` keeps each content once. Paths are of a file
system every executor has mounted.
"""

from __future__ import annotations

import hashlib
import os
import sqlite3
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..session import bounded_batches

ADDRESS = ("zoom_level", "tile_column", "tile_row")
TILES = "zoom_level int, tile_column bigint, tile_row bigint, tile_data binary"
ADDRESSES = "zoom_level int, tile_column bigint, tile_row bigint, nbytes bigint"
#: Bytes of a partition, about.
SPLIT = 64 << 20
_COMPARED = {EqualTo: "=", LessThanOrEqual: "<=", LessThan: "<", GreaterThanOrEqual: ">=", GreaterThan: ">"}
#: How each layout joins addresses and blobs.
LAYOUTS = {
    "compact": "SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles_shallow JOIN tiles_data USING (tile_data_id)",
    "legacy": "SELECT zoom_level, tile_column, tile_row, tile_data FROM map JOIN images USING (tile_id)",
    "classic": "SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles",
}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def layout(path: str) -> str:
    with _open(path) as db:
        tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master")}
    if {"tiles_shallow", "tiles_data"} <= tables:
        return "compact"
    return "legacy" if {"map", "images"} <= tables else "classic"


def new_archive(path: str, layout: str = "classic") -> sqlite3.Connection:
    db = sqlite3.connect(path)
    db.execute("PRAGMA page_size = 4096")
    if layout == "compact":
        db.execute("CREATE TABLE tiles_data (tile_data_id TEXT PRIMARY KEY, tile_data BLOB)")
        db.execute("CREATE TABLE tiles_shallow (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data_id TEXT, PRIMARY KEY (zoom_level, tile_column, tile_row))")
        db.execute(f"CREATE VIEW tiles AS {LAYOUTS['compact']}")
    else:
        db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
    db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
    return db


def _plain(row) -> tuple:
    return row[0], row[1], row[2], bytes(row[3]) if row[3] is not None else None


def add_compact(db: sqlite3.Connection, rows) -> None:
    """Put tiles into a compact archive: an address takes its new content, contents are kept once."""
    for z, x, y, blob in map(_plain, rows):
        digest = hashlib.sha256(blob or b"").hexdigest()
        db.execute("INSERT OR IGNORE INTO tiles_data VALUES (?, ?)", (digest, blob))
        db.execute("INSERT OR REPLACE INTO tiles_shallow VALUES (?, ?, ?, ?)", (z, x, y, digest))


def delete_compact(db: sqlite3.Connection, addresses) -> None:
    """Take addresses out of a compact archive, and contents that no address has any more."""
    db.executemany("DELETE FROM tiles_shallow WHERE zoom_level = ? AND tile_column = ? AND tile_row = ?", addresses)
    db.execute("DELETE FROM tiles_data WHERE tile_data_id NOT IN (SELECT tile_data_id FROM tiles_shallow)")


def write_shards(tiles: DataFrame, folder: str, side: int = 256) -> DataFrame:
    """Write ``tiles`` as one archive for each block of ``side`` by ``side`` tiles of a zoom; a row a file comes back.

    ``(zoom_level, mx, my, path, tiles, bytes)``. A file is put together by one task, from rows that come in batches of some
    megabytes in the order of the blocks, and renamed when whole, so a repeated task replaces it with the same.
    """

    def begin(key: tuple) -> tuple[sqlite3.Connection, str, str]:
        z, mx, my = key
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/z{z:02d}-{mx}-{my}.mbtiles"
        part = f"{path}.{uuid.uuid4().hex}.part"
        return new_archive(part), part, path

    def end(key: tuple, db: sqlite3.Connection, part: str, path: str) -> pd.DataFrame:
        tiles, size = db.execute("SELECT count(*), coalesce(sum(length(tile_data)), 0) FROM tiles").fetchone()
        db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
        db.commit()
        db.close()
        os.replace(part, path)
        return pd.DataFrame({"zoom_level": [key[0]], "mx": [key[1]], "my": [key[2]], "path": [path], "tiles": [tiles], "bytes": [size]})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, None
        for f in frames:
            for now, some in f.groupby(["zoom_level", "mx", "my"]):
                now = tuple(map(int, now))
                if now != key:
                    if own:
                        yield end(key, *own)
                    key, own = now, begin(now)
                rows = zip(*(some[c].tolist() for c in (*ADDRESS, "tile_data")))
                own[0].executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", map(_plain, rows))
        if own:
            yield end(key, *own)

    bounded_batches(tiles.sparkSession)
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    block = ["zoom_level", "mx", "my"]
    rows = tiles.select(*ADDRESS, "tile_data", at("tile_column").alias("mx"), at("tile_row").alias("my"))
    return rows.repartition(*block).sortWithinPartitions(*block).mapInPandas(write, "zoom_level int, mx long, my long, path string, tiles long, bytes long")


#: Columns and rows, from and to, of a zoom.
Range = tuple[int, int, int, int, int]


@dataclass
class _Ranges(InputPartition):
    ranges: list[Range] | None


def split(sizes: Iterator[tuple[int, int, int]], rows: Callable[[int, int], Iterator[tuple[int, int]]], most: int) -> list[list[Range]]:
    """Ranges of like bytes from ``sizes`` (zoom, column, bytes) in order; ``rows`` gives the (row, bytes) of a column that is large."""
    out: list[list[Range]] = [[]]
    held, top = 0, 1 << 62

    def add(one: Range, size: int) -> None:
        nonlocal held
        if held and held + size > most:
            out.append([])
            held = 0
        last = out[-1][-1] if out[-1] else None
        # A range grows where the next columns, or rows of the same column, follow.
        if last and last[0] == one[0] and last[3:] == one[3:] == (0, top):
            out[-1][-1] = (*last[:2], one[2], 0, top)
        elif last and last[:3] == one[:3]:
            out[-1][-1] = (*last[:4], one[4])
        else:
            out[-1].append(one)
        held += size

    for zoom, column, size in sizes:
        if size <= most:
            add((zoom, column, column, 0, top), size)
        else:
            for row, own in rows(zoom, column):
                add((zoom, column, column, row, row), own)
    return [part for part in out if part]


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, most: int, push: bool = True):
        self.path, self.table, self.most, self.push = path, table, most, push
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if not self.push or self.table == "metadata" or name not in ADDRESS:
                yield f
            elif type(f) in _COMPARED:
                self.where.append((f"{name} {_COMPARED[type(f)]} ?", [f.value]))
            elif isinstance(f, In):
                values = [v for v in f.value if v is not None]
                self.where.append((f"{name} IN ({', '.join('?' * len(values))})", values))
            elif isinstance(f, IsNotNull):
                self.where.append((f"{name} IS NOT NULL", []))
            else:
                yield f

    def _select(self, columns: str, more: str = "true", values: tuple = ()) -> tuple[str, list]:
        """A query of the tiles that pass the filters."""
        text = "".join(f" AND {w}" for w, _ in self.where)
        return f"SELECT {columns} FROM ({LAYOUTS[layout(self.path)]}) WHERE {more}{text}", [*values, *(v for _, vs in self.where for v in vs)]

    def partitions(self):
        if self.table == "metadata":
            return [_Ranges(None)]
        size = "coalesce(sum(length(tile_data)), 0) + 64 * count(*)"  # length() does not read the content
        with _open(self.path) as db:
            query, values = self._select(f"zoom_level, tile_column, {size}")
            sizes = db.execute(f"{query} GROUP BY 1, 2 ORDER BY 1, 2", values)

            def rows(zoom: int, column: int) -> Iterator[tuple[int, int]]:
                query, values = self._select(f"tile_row, {size}", "zoom_level = ? AND tile_column = ?", (zoom, column))
                return db.execute(f"{query} GROUP BY 1 ORDER BY 1", values)

            return [_Ranges(part) for part in split(sizes, rows, self.most)] or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        with _open(self.path) as db:
            if partition.ranges is None:
                yield from db.execute("SELECT name, value FROM metadata")
                return
            content = "length(tile_data)" if self.table == "addresses" else "tile_data"
            for one in partition.ranges:
                query, values = self._select(f"zoom_level, tile_column, tile_row, {content}", "zoom_level = ? AND tile_column BETWEEN ? AND ? AND tile_row BETWEEN ? AND ?", one)
                yield from db.execute(query, values)


@dataclass
class _Part(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, metadata: dict[str, str], layout: str = "classic"):
        self.path, self.metadata, self.layout = path, metadata, layout

    def write(self, rows) -> _Part:
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        db = new_archive(part)
        db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", map(_plain, rows))
        db.commit()
        db.close()
        return _Part(part)

    def commit(self, messages) -> None:
        whole = f"{self.path}.{uuid.uuid4().hex}.part"
        db = new_archive(whole, self.layout)
        for m in messages:
            if m is None:
                continue
            db.execute("ATTACH ? AS part", (m.path,))
            if self.layout == "compact":
                add_compact(db, db.execute("SELECT * FROM part.tiles"))
            else:
                db.execute("INSERT INTO tiles SELECT * FROM part.tiles")
            db.commit()
            db.execute("DETACH part")
            os.remove(m.path)
        db.executemany("INSERT INTO metadata VALUES (?, ?)", sorted(self.metadata.items()))
        if self.layout == "classic":
            db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
        db.commit()
        db.execute("VACUUM")
        db.close()
        os.replace(whole, self.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class MBTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return {"metadata": "name string, value string", "addresses": ADDRESSES}.get(self.options.get("table", "tiles"), TILES)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "tiles"), int(self.options.get("splitBytes", SPLIT)), self.options.get("pushFilters") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} exists")
        return _Writer(path, {k.removeprefix("metadata."): v for k, v in self.options.items() if k.startswith("metadata.")}, self.options.get("layout", "classic"))


def register(spark: SparkSession) -> None:
    """Make the format known; where a reader is asked to, it takes filters from here on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MBTiles)


def pushed(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """A table of a format of this package that takes the filters put on it, to be used with one set of filters.

    Spark keeps the filters that a Python reader took with what was loaded, not with the plan: another plan of the same
    loaded table, or the table twice in one plan, would read by the last filters alone. So filters are taken only where
    ``pushFilters`` says so, and each use loads anew, as this function does.
    """
    return spark.read.format(kind).options(pushFilters="true", **options).load(path)
