"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

Layout of a file, in order:

* data frames: ids of consecutive documents, little-endian unsigned 16- or 32-bit, each frame an
  independent zstandard frame with its own content checksum;
* one skippable frame (magic 0x184D2A50) with the document index;
* one skippable frame (magic 0x184D2A5E) with the public seek table: for each frame before it the
  compressed size, the decompressed size and the low 32 bits of the XXH64 of its content, then the
  number of frames, a descriptor byte and 0x8F92EAB1.

Any zstandard decoder reads the data frames; this reader decompresses only those a document lies in.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, materialize, need, scratch_path
from .tokens import encoder, tokenizer_path

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, DESCRIPTOR = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 16


class FrameWriter:
    """Writes one file; holds one frame of ids and the index, never the whole file."""

    def __init__(self, out, width: int = 2, level: int = 3):
        self.out, self.width, self.level = out, width, level
        self.held, self.size = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        raw = memoryview(np.ascontiguousarray(ids, f"<u{self.width}").tobytes())
        for at in range(0, len(raw), FRAME_BYTES):
            part = raw[at : at + FRAME_BYTES]
            self.held.append(part)
            self.size += len(part)
            if self.size >= FRAME_BYTES:
                self._flush()

    def _flush(self) -> None:
        if self.size:
            raw = b"".join(self.held)
            packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        null = np.array([d is None for d in self.doc_ids], np.uint8).tobytes()
        ids = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
        body = zstandard.ZstdCompressor(write_checksum=True).compress(null + ids + np.array(self.lengths, "<i8").tobytes())
        index = struct.pack("<BQ", self.width, len(self.doc_ids)) + body
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Random access to one file. Raises ValueError where a checksum, size or magic does not hold."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or descriptor != DESCRIPTOR or not count:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * count - 8)
        head = source.read(8 + 12 * count)
        if struct.unpack("<II", head[:8]) != (SEEK_MAGIC, 12 * count + 9):
            raise ValueError("the seek table's frame is damaged")
        table = np.frombuffer(head, "<u4", offset=8).reshape(count, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(table[:-1, 1])])
        source.seek(int(self.at[-2]))
        index = source.read(int(table[-1, 0]))
        if struct.unpack("<I", index[:4])[0] != INDEX_MAGIC or xxhash.xxh64_intdigest(index[8:]) & 0xFFFFFFFF != self.sums[-1]:
            raise ValueError("the document index is damaged")
        self.width, n = struct.unpack("<BQ", index[8:17])
        body = zstandard.ZstdDecompressor().decompress(index[17:])
        null, ids = np.frombuffer(body, np.uint8, n), np.frombuffer(body, "<i8", n, n)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ids)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(body, "<i8", n, 9 * n))])
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.source.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.at[k + 1] - self.at[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.frames_read += 1
            self._last = (k, raw)
        return self._last[1]

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document; decompresses the frames it lies in and no other."""
        lo, hi = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        out, k = [], int(np.searchsorted(self.raw_at, lo, "right")) - 1
        while lo < hi:
            raw, base = self._frame(k), int(self.raw_at[k])
            part = raw[lo - base : hi - base]
            out.append(part)
            lo += len(part)
            k += 1
        return np.frombuffer(b"".join(out), f"<u{self.width}").astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the ids of all ``docs`` in ascending doc_id order, one file a range of doc_ids.

    Returns the manifest ``(shard, path, n_docs, n_tokens)``, itself written to the shared folder.
    Null texts are empty; null doc_ids sort first; equal doc_ids are ordered by text. A file is written
    under a name of the attempt and then renamed, so a repeated or lost task leaves a whole file.
    An empty table gives an empty manifest.
    """
    path = tokenizer or tokenizer_path()

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(path)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end, writer, sink = np.array([end_id], "<u4"), None, None
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/shard-{task.partitionId():06d}.zst"
        mine = f"{base}/.attempt-{task.partitionId()}-{task.taskAttemptId()}"
        for f in gathered(frames):
            for doc_id, ids in zip(f["doc_id"], enc.encode(f["text"].tolist())):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(mine)
                    writer = FrameWriter(sink, width)
                writer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer:
            writer.close()
            sink.close()
            fs.move(mine, name)
            yield pd.DataFrame({"shard": [task.partitionId()], "path": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [len(writer.lengths)], "n_tokens": [int(sum(writer.lengths))]})

    rows = need(docs, ["doc_id", "text"]).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInPandas(write, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; the running sum is over one row per file.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        for f in frames:
            for path, base in zip(f["path"], f["base"]):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as source:
                    reader = FrameReader(source, source.size())
                    n = len(reader.doc_ids)
                    for lo in range(0, n, 10_000):
                        some = range(lo, min(n, lo + 10_000))
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.array([reader.doc_ids[i] for i in some], "Int64"),
                                "start": [int(base) + int(reader.starts[i]) for i in some],
                                "n_tokens": [int(reader.starts[i + 1] - reader.starts[i]) for i in some],
                                "ids_crc32": [zlib.crc32(reader.document(i).tobytes()) for i in some],
                            }
                        )

    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))
    return files.repartition(max(1, manifest.count()), "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return the digest read back from them."""
    spark: SparkSession = docs.sparkSession
    return read_token_files(write_token_files(docs, scratch_path(spark, "token-files"), tokenizer, end_id))


def to_bytes(documents: list[tuple[int | None, np.ndarray]], width: int = 2) -> bytes:
    """A whole file in memory, for tests and small exports."""
    out = io.BytesIO()
    writer = FrameWriter(out, width)
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    return out.getvalue()
