"""What the operators share: scratch tables in the shared folder, table loading and column checks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables made in this driver process and not deleted since.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, with its scheme.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a session on one machine
    (tests) gets a temporary folder as its checkpoint folder; on a cluster it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return qualified(spark, at.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark finds it in, for readers other than Spark."""
    if "://" in path:
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return found if "://" in found else found.replace(":/", ":///", 1)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside at its end; what is needed beyond it has to be written by then."""
    first = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[first:]:
            drop_files(spark, path)
        del _MADE[first:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts lineage with replicated, re-readable files, so a lost executor costs a reread only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_files(spark, folder)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whole texts, and bytes of them, that go to a Python worker at a time; the session's own settings hold where they are smaller.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def need(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash with a working one.

    Also bounds the rows and bytes of a batch that goes to Python, for this session, so that workers hold
    some megabytes of text whatever a partition's size.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, BATCH_ROWS)
    if not 0 < int(conf.get(_BYTES).rstrip("bB")) <= BATCH_BYTES:
        conf.set(_BYTES, BATCH_BYTES)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(*[df[c] for c in columns])


#: Rows of one id column that are broadcast at most (under 20 MB); more are joined by shuffle.
SMALL = 1_000_000


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str, own: str | Column | None = None) -> DataFrame:
    """Semi or anti join with a table of ids: broadcast where their counted number is small, else by shuffle.

    ``on`` is the column of ``ids``, and of ``df`` too unless ``own`` says what it is there.
    """
    ids = ids.select(F.col(on).alias("_id")).distinct()
    if ids.count() <= SMALL:
        ids = F.broadcast(ids)
    return df.join(ids, (own if isinstance(own, Column) else df[own or on]) == ids["_id"], how)


#: Rows from which a key counts as hot.
HOT = 100_000


def join_counted(rows: DataFrame, counts: DataFrame, key: str | list[str], n: str, hot: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``counts``: a written table with one row a key, and in ``n`` how many rows have it.

    Hot keys, of which there are few (the rows by ``hot`` at most), are joined by broadcast where their counted
    number is small, so that no task gets all the rows of one.
    """
    many = counts.where(F.col(n) > hot)
    if not 0 < many.count() <= SMALL:
        return rows.join(counts, key)
    cold = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(counts.where(F.col(n) <= hot), key)
    return rows.join(F.broadcast(many), key).unionByName(cold)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two numbers that tell rows ``(doc_id, text)`` apart: the doc_id (-1 for none) and a hash of both; equal rows have equal keys."""
    return F.coalesce(df["doc_id"], F.lit(-1)), F.xxhash64(df["doc_id"], df["text"])


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, remembered in this process until something else is asked for: workers outlive stages."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Drops what :func:`held` remembers."""
    _HELD.clear()


def give_back() -> None:
    """Returns to the system the memory that this process has freed; its allocators keep much of it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(each: Callable[[Iterator], Iterator], holds: bool = False) -> Callable[[Iterator], Iterator]:
    """``each`` as a task whose worker is small before and after it.

    Workers outlive stages, and wait beside a JVM that works: at the task's end freed memory goes back, at its
    beginning what an earlier operator :func:`held`, unless ``each`` ``holds`` something itself.
    """

    @functools.wraps(each)
    def run(frames: Iterator) -> Iterator:
        if not holds:
            forget()
        try:
            yield from each(frames)
        finally:
            give_back()

    return run


def gathered(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The frames put together until they hold about ``chars`` characters of text."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        held.append(f)
        size += sum(len(t) for t in f[column] if isinstance(t, str))  # pandas' .str would keep the frame in a circle
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
