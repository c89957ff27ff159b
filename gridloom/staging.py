"""Cutting lineage through tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Only a session without other machines (master ``local``) may go without the setting: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


BATCH_BYTES = 4 << 20


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it the session has another setting; its own one comes back at the end."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Within it Spark hands Python at most about ``most`` bytes at a time: workers hold a batch several times over.

    The session's own setting comes back at the end.
    """
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most)):
        yield


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a frame that reads it back.

    The files outlive lost executors, and later plans start from them instead of from the whole lineage. They go when
    the application ends, or earlier by ``release``. Batches for Python are small while it is written, and the shuffle
    files of the write go with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark), setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode("error").parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that go when the application ends; nothing is there yet."""
    at, files = _path(spark, f"{stage_root(spark)}/scratch-{uuid.uuid4().hex}")
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{at}/{name}"


def release(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that no plan will read again."""
    for t in tables:
        at, files = _path(t.sparkSession, t.staged_at)
        files.delete(at, True)
