"""Object-store inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.predicates import effective_limit
from arborlake.operators.paging import KeysetPage, after_cursor, keyset_page

STORE_PAGE = 1_000
DEFAULT_PAGE, MAX_PAGE = 100, 1_000
POLL_ORDER = ["last_modified_unix_ms", "key"]

# The fields an object listing offers.
OBJECT_FIELDS = [
    ("Key", "string"), ("Size", "u64"), ("LastModified", "unix-ms"), ("ETag", "string"), ("StorageClass", "string"),
    ("OwnerId", "string"), ("OwnerDisplayName", "string"),
]


def normalize_objects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(object rows, quarantine with the reason). Raw rows have bucket, key, size, last_modified
    (timestamp) and optionally etag, storage_class, owner and checksum columns."""
    have = set(raw.columns)
    opt = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    ms = F.coalesce(F.floor(F.unix_micros("last_modified") / 1000).cast("long"), F.lit(0))
    reason = (
        F.when(F.col("key").isNull(), F.lit("missing key"))
        .when(F.col("size") < 0, F.lit("negative size"))
        .when(ms < 0, F.lit("time before the epoch"))
    )
    rows = raw.withColumn("_reason", reason)
    good = rows.where("_reason is null").select(
        "bucket", "key", F.coalesce("size", F.lit(0)).cast("long").alias("size"), ms.alias("last_modified_unix_ms"),
        *[opt(n).alias(n) for n in ("etag", "storage_class", "owner_id", "owner_display_name")],
        F.to_json(F.struct(
            F.coalesce(opt("checksum_algorithm", "array<string>"), F.array().cast("array<string>")).alias("checksum_algorithm"),
            opt("checksum_type").alias("checksum_type"),
        ), {"ignoreNullFields": "false"}).alias("metadata"),
    )
    return good, rows.where("_reason is not null").withColumnRenamed("_reason", "reason")


def object_snapshot_all(objects: DataFrame, bucket: str | None = None, prefix: str = "") -> DataFrame:
    """All objects below a key prefix, of one bucket if given: a filter that the scan takes over."""
    chosen = objects if bucket is None else objects.where(F.col("bucket") == bucket)
    return chosen.where(F.col("key").startswith(prefix)) if prefix else chosen


def object_poll_all(objects: DataFrame, after: tuple | None = None, bucket: str | None = None, prefix: str = "") -> DataFrame:
    """All objects changed after the (last_modified, key) place that an earlier poll ended with."""
    return after_cursor(object_snapshot_all(objects, bucket, prefix), POLL_ORDER, after)


def object_snapshot(objects: DataFrame, bucket: str, prefix: str = "", limit: int | None = None, cursor: tuple | None = None) -> KeysetPage:
    """Objects of a bucket below a key prefix, in key order; the cursor is the last key."""
    n = min(effective_limit(limit, DEFAULT_PAGE, MAX_PAGE), STORE_PAGE)
    return keyset_page(object_snapshot_all(objects, bucket, prefix), ["key"], n, cursor)


def object_poll(objects: DataFrame, bucket: str, prefix: str = "", limit: int | None = None, cursor: tuple | None = None) -> KeysetPage:
    """Objects changed after the (last_modified, key) cursor, oldest first."""
    n = effective_limit(limit, DEFAULT_PAGE, MAX_PAGE)
    return keyset_page(object_snapshot_all(objects, bucket, prefix), POLL_ORDER, n, cursor)


def object_fields(endpoints: DataFrame) -> DataFrame:
    """The fixed field catalogue for every endpoint (object_ref)."""
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("field_type")) for n, t in OBJECT_FIELDS])
    return endpoints.select("object_ref", F.inline(fields))
