"""Watch logs: raw notification flags to change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.functions import paths as P

# The notification bits of the kernel's watch interface.
MODIFY, ATTRIB, CLOSE_WRITE, MOVED_FROM, MOVED_TO, CREATE, DELETE, ISDIR = (
    0x2, 0x4, 0x8, 0x40, 0x80, 0x100, 0x200, 0x40000000,
)


def _has(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits).cast("long")) != 0


def watch_kind(mask: str | Column) -> Column:
    """First rule that matches; a created file waits for its first write and gives null."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return (
        F.when(_has(m, DELETE | MOVED_FROM), F.lit("delete"))
        .when(_has(m, CLOSE_WRITE), F.lit("close_write"))
        .when(_has(m, ATTRIB), F.lit("attrib"))
        .when(_has(m, MODIFY), F.lit("modify"))
        .when(_has(m, CREATE), F.when(_has(m, ISDIR), F.lit("create_dir")))
        .when(_has(m, MOVED_TO), F.lit("moved_to"))
    )


def classify_watch(raw: DataFrame, emitted: DataFrame | None = None) -> DataFrame:
    """Records of a watch log with columns mask, path and the stat columns; works on a stream too.

    ``emitted`` (origin_id, path, seq, emitted) is the outcome of the modify throttle. Created and
    moved-in directories have ``expands`` set; ``listing.expand_subtrees`` adds what lies below.
    """
    kind = watch_kind("mask")
    rows = raw.withColumn("kind", kind).where("kind is not null")
    if emitted is not None:
        rows = rows.join(emitted, ["origin_id", "path", "seq"], "left").where(
            (F.col("kind") != "modify") | F.col("emitted")
        ).drop("emitted")
    is_dir = _has(F.col("mask"), ISDIR)
    deleted = F.col("kind") == "delete"
    stat = lambda name: F.when(deleted, F.lit(0)).otherwise(F.col(name)).cast("long").alias(name)
    keep = [n for n in raw.columns if n not in ("mask", "path", "size", "mtime_us", "ctime_us", "is_dir")]
    return rows.select(
        *keep, "path", P.file_name("path").alias("file_name"), F.lit("").alias("parent_path"),
        is_dir.alias("is_dir"), stat("size"), stat("mtime_us"), stat("ctime_us"), F.lit(0).cast("long").alias("parent_mtime_us"),
        F.when(deleted, F.lit(S.DELETE)).otherwise(F.lit(S.UPDATE)).alias("event_kind"), F.lit(S.REALTIME).alias("source"),
        F.col("kind").isin("close_write", "create_dir", "moved_to").alias("is_atomic_write"),
        F.lit(False).alias("audit_skipped"),
        ((F.col("kind") == "create_dir") | ((F.col("kind") == "moved_to") & is_dir)).alias("expands"),
    )
