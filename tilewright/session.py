"""Session settings, table loading and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` wins over both."""
    builder = SparkSession.builder.appName("tilewright")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new name below the folder that ``spark.checkpoint.dir`` names, with its scheme.

    Where that is unset, which only a session on one machine may leave so, it is in a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tilewright-")
    return f"{base.rstrip('/')}/tilewright-{uuid.uuid4().hex}"


def scratch(spark: SparkSession) -> str:
    """A new folder as a plain path, for readers and writers other than Spark's; every machine has to mount it."""
    path = shared_path(spark)
    scheme, found, _ = path.partition("://")
    if found and scheme != "file":
        raise ValueError(f"files that Spark does not write itself need a mounted spark.checkpoint.dir, not {scheme}://")
    path = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` from Parquet files in the shared folder: computed once, and reread where an executor is lost."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written`."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """At most so many bytes of rows go to a Python worker at a time, for this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("bB")) <= most:
        spark.conf.set(name, most)
