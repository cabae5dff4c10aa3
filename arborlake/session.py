"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from arborlake.storage import CHECKPOINT_KEY, LOCAL_KEY

# Byte paths, UTC times and exact arithmetic; the rest is left to the cluster's own settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, unless the session has it already."""
    if _SHIPPED.get("to") is spark.sparkContext:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="arborlake-"), "arborlake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED["to"] = spark.sparkContext


_SHIPPED: dict[str, object] = {}


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("arborlake")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configured(builder).getOrCreate()
    if not spark.sparkContext.getConf().get(CHECKPOINT_KEY):
        # one machine and no folder named: the driver is the executor
        spark.conf.set(LOCAL_KEY, tempfile.mkdtemp(prefix="arborlake-"))
    spark.sparkContext.setLogLevel("ERROR")
    ship_code(spark)
    return spark
