"""A stream source that follows growing log files: every whole line once, with the file and the offset it starts at.

Spark's own file source takes a file when it is there and never again. This one keeps, for each file, how many bytes have
been read; what ends without a line break waits for the rest. Offsets are in the query's checkpoint, so a query that
is started again goes on where it was.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are looked at together for the last line break, and that one task reads, of a file or of several, about.
_LOOK, _PART = 1 << 16, 4 << 20
#: Files that are looked at for their last line break at a time.
_AT_ONCE = 16


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    return pafs.FileSystem.from_uri(path)


class _Ranges(InputPartition):
    """What one task reads: ``(root, path, start, end)`` of each file, since a task for each small file costs more than its lines."""

    def __init__(self, ranges: list[tuple[str, str, int, int]]):
        self.ranges = ranges


class _Tail(DataSourceStreamReader):
    def __init__(self, roots: list[str]):
        self.roots = roots
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = {}
        for root in self.roots:
            fs, at = _file_system(root)
            for info in fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)):
                if info.type == pafs.FileType.File and not info.base_name.startswith((".", "_")):
                    found[f"{root}\n{info.path}"] = fs, info
        grown = {name: v for name, v in found.items() if self.seen.get(name, (-1, 0))[0] != v[1].size}
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            whole = pool.map(lambda v: _whole_lines(v[0], v[1].path, v[1].size), grown.values())
            self.seen |= {name: (v[1].size, end) for (name, v), end in zip(grown.items(), whole)}
        return {"files": json.dumps({name: self.seen[name][1] for name in found}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Ranges]:
        before, now = (json.loads(o["files"]) for o in (start, end))
        out, held = [], _PART
        for name, size in now.items():
            root, path = name.split("\n")
            for lo in range(before.get(name, 0), size, _PART):
                hi = min(lo + _PART, size)
                if held + hi - lo > _PART:
                    out.append(_Ranges([]))
                    held = 0
                out[-1].ranges.append((root, path, lo, hi))
                held += hi - lo
        return out

    def read(self, part: _Ranges) -> Iterator[tuple[str, int, str]]:
        """The lines that start inside each range; the one over its end is read on."""
        systems = {root: _file_system(root)[0] for root, *_ in part.ranges}
        for root, path, start, end in part.ranges:
            with io.BufferedReader(systems[root].open_input_file(path), _LOOK) as source:
                at = start
                if at:  # a line that starts before belongs to the range before
                    source.seek(at - 1)
                    at += len(source.readline()) - 1
                source.seek(at)
                while at < end:
                    line = source.readline()
                    yield path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                    at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _whole_lines(fs: pafs.FileSystem, path: str, size: int) -> int:
    """Bytes of a file up to its last line break."""
    with fs.open_input_file(path) as source:
        while size:
            lo = max(0, size - _LOOK)
            source.seek(lo)
            at = source.read(size - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            size = lo
    return 0


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(folder)``; option ``folders`` names several, one a line."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        roots = self.options.get("folders", self.options.get("path", "")).split("\n")
        return _Tail([r for r in roots if r])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
