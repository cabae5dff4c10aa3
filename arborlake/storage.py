"""Shared-folder tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Set by ``session.local_session`` alone, where the session names no folder.
LOCAL_KEY = "arborlake.local.dir"


def work_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, storage that every executor can read."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(LOCAL_KEY, None)
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/arborlake/{label}-{uuid.uuid4().hex}"
    for made in _OPEN.get()[-1:]:
        made.append(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: no recomputation, real statistics for later joins."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What the enclosing ``scratch`` blocks have to remove; each thread of a driver has blocks of its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch blocks", default=())


def together(*steps: Callable[[], Any]) -> list[Any]:
    """Run Spark jobs that do not need each other side by side; they belong to the ``scratch`` block of the caller."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, step) for step in steps]]


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    target, files = _target(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _target(spark, path)
    return files.exists(target)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the stage tables made inside when the block ends. What is to last must be written elsewhere inside it:
    results that still have to be computed need their stage tables."""
    made: list[str] = []
    outer = _OPEN.set((*_OPEN.get(), made))
    try:
        yield made
    finally:
        _OPEN.reset(outer)
        for path in made:
            remove(spark, path)
