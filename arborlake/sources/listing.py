"""File listings: scans, audits, targeted scans and subtree expansion.

A *listing* is a table (group_id, path, is_dir, size, mtime_us, ctime_us, dev, ino) of byte-text
paths. Any inventory can provide it; ``read_tree`` derives one from files Spark can see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.functions import paths as P
from arborlake.operators.arbitrate import not_covered
from arborlake.operators.ordered import number_rows
from arborlake.operators.rollup import directory_fingerprints
from arborlake.skew import lookup_join

NODE = ["group_id", "path"]


def read_tree(spark: SparkSession, root: str, group_id: str) -> DataFrame:
    """Listing of the files below ``root``; directories are the ancestors of files, with unknown
    times. File contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "modificationTime", "length")
    )
    local = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    listed = files.select(
        F.lit(group_id).alias("group_id"), P.make_relative(local, root.rstrip("/")).alias("path"), F.lit(False).alias("is_dir"),
        F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"),
    )
    return with_directories(listed)


def with_directories(files: DataFrame) -> DataFrame:
    """Add the ancestor directories that a list of files implies."""
    dirs = (
        files.select("group_id", P.parent_path("path").alias("dir")).distinct()
        .select("group_id", F.explode(P.self_and_ancestors("dir")).alias("path")).distinct()
        .select(*NODE, F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_us"))
    )
    return files.select(*NODE, "is_dir", "size", "mtime_us").unionByName(dirs)


def scan_tree(listing: DataFrame) -> DataFrame:
    """One scan record per entry, with its parent's path and modification time. Directories have
    size 0 and, as their own scan finds them, no parent."""
    parents = listing.where("is_dir").select("group_id", F.col("path").alias("parent_path"), F.col("mtime_us").alias("_pm"))
    files = listing.withColumn("parent_path", F.when(~F.col("is_dir"), P.parent_path("path")))
    joined = lookup_join(files, parents, ["group_id", "parent_path"], "left", salt_from=["path"])
    ctime = F.coalesce("ctime_us", F.lit(0)) if "ctime_us" in listing.columns else F.lit(0)
    return joined.select(
        *NODE,
        P.file_name("path").alias("file_name"),
        F.coalesce("parent_path", F.lit("")).alias("parent_path"),
        "is_dir",
        F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"),
        "mtime_us",
        F.when(F.col("is_dir"), F.lit(0)).otherwise(ctime).cast("long").alias("ctime_us"),
        F.coalesce("_pm", F.lit(0)).alias("parent_mtime_us"),
        F.lit(S.UPDATE).alias("event_kind"),
        F.lit(S.SCAN).alias("source"),
        F.lit(False).alias("is_atomic_write"),
        F.lit(False).alias("audit_skipped"),
    )


def audit_log(scan: DataFrame, origin_id: Column, epoch: int, now_us: int, start_seq: int = 0) -> DataFrame:
    """A whole scan between an audit start and an audit end, per group."""
    keyed = scan.withColumn("_k", P.preorder_key("path"))
    numbered = number_rows(keyed, ["group_id"], "_k", "seq", start_seq + 1).drop("_k")
    records = numbered.withColumn("rec_type", F.lit(S.DATA)).withColumn("epoch_id", F.lit(None).cast("long"))
    bounds = numbered.groupBy("group_id").agg(F.max("seq").alias("_last"))
    frame = lambda kind, seq: bounds.select(
        "group_id", F.lit(kind).alias("rec_type"), seq.cast("long").alias("seq"), F.lit(epoch).cast("long").alias("epoch_id")
    )
    log = (
        records.unionByName(frame(S.EPOCH_START, F.lit(start_seq)), allowMissingColumns=True)
        .unionByName(frame(S.EPOCH_END, F.col("_last") + 1), allowMissingColumns=True)
    )
    return log.select(
        *[
            {"origin_id": origin_id, "arrival_us": F.lit(now_us), "timestamp_us": F.lit(now_us), "is_primary": F.lit(True)}
            .get(f.name, F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.LOG.fields
        ]
    )


class ScanLimitExceeded(ValueError):
    """A targeted scan met more entries than it may return."""


class ScanRootMissing(LookupError):
    """The root itself is not in the listing."""


def scan_targeted(
    listing: DataFrame, path: str, recursive: bool = True, max_depth: int | None = None, max_events: int | None = None
) -> DataFrame:
    """The target, or directories down to ``max_depth`` and the files inside them (so files reach
    one level deeper). Fails when more than ``max_events`` entries of a group
    qualify, where a limit is given."""
    if path == P.SLASH and listing.where(F.col("path") == P.SLASH).isEmpty():
        raise ScanRootMissing(path)
    if not recursive:
        hit = listing.where(F.col("path") == path)
    else:
        # nothing is listed below a missing target
        depth = P.relative_depth("path", path)
        under = listing.where(P.is_under("path", path))
        present = under.where(F.col("path") == path).select("group_id").distinct()
        hit = lookup_join(under, present, ["group_id"], "left_semi", salt_from=["path"])
        if max_depth is not None:
            hit = hit.where(F.when(F.col("is_dir"), depth <= max_depth).otherwise(depth <= max_depth + 1))
    if max_events is not None:
        over = hit.groupBy("group_id").count().where(F.col("count") > max_events).first()
        if over is not None:
            raise ScanLimitExceeded(f"{over['count']} entries below {path} in {over.group_id}")
    return scan_tree(hit)


def drop_loops(listing: DataFrame) -> DataFrame:
    """Leave out what lies below a directory whose (dev, ino) was already seen at an earlier path in
    pre-order; a directory without an inode number stands for itself."""
    ident = ["group_id", "dev", "ino"]
    dirs = listing.where("is_dir and ino is not null").select(*ident, "path", P.preorder_key("path").alias("_k"))
    first = dirs.groupBy(*ident).agg(F.min("_k").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = lookup_join(dirs, first, ident, "inner", salt_from=["path"]).where("_k <> _first").select(*NODE)
    return not_covered(listing, again)


def expand_subtrees(listing: DataFrame, new_dirs: DataFrame) -> DataFrame:
    """Everything below directories that were created or moved in, as atomic realtime updates.
    ``new_dirs`` has (group_id, path)."""
    dirs = new_dirs.select("group_id", F.col("path").alias("dir")).distinct()
    exploded = listing.select("*", F.explode(P.ancestors("path")).alias("dir"))
    below = lookup_join(exploded, dirs, ["group_id", "dir"], "left_semi", salt_from=["path"]).drop("dir").distinct()
    return below.select(
        *NODE, P.file_name("path").alias("file_name"), F.lit("").alias("parent_path"), "is_dir", "size", "mtime_us",
        F.lit(0).cast("long").alias("parent_mtime_us"), F.lit(S.UPDATE).alias("event_kind"),
        F.lit(S.REALTIME).alias("source"), F.lit(True).alias("is_atomic_write"), F.lit(False).alias("audit_skipped"),
    )


DEEP_SCAN_ROUNDS = 24


def audit_decisions(listing: DataFrame, previous: DataFrame, audit_round: int, deep_every: int = DEEP_SCAN_ROUNDS) -> DataFrame:
    """Per directory: scan its files or only report it as skipped.

    ``previous`` has (group_id, dir, mtime_us, fingerprint, last_deep_round) of the last audit. A
    directory is scanned when it is new, its time or its children changed, or its last full scan
    is ``deep_every`` rounds ago. The result is the ``previous`` of the next audit.
    """
    prints = directory_fingerprints(listing).select("group_id", "dir", "fingerprint")
    dirs = listing.where("is_dir").select("group_id", F.col("path").alias("dir"), "mtime_us")
    # an empty directory has the fingerprint of no children
    now = dirs.join(prints, ["group_id", "dir"], "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit(0)))
    old = previous.select("group_id", "dir", *[F.col(n).alias(f"_{n}") for n in ("mtime_us", "fingerprint", "last_deep_round")])
    joined = now.join(old, ["group_id", "dir"], "left")
    same_time = F.abs(F.col("mtime_us") - F.col("_mtime_us")) < 1
    same_children = F.col("fingerprint") == F.col("_fingerprint")
    recent = (F.lit(audit_round) - F.col("_last_deep_round")) < deep_every
    deep = ~(F.coalesce(same_time, F.lit(False)) & F.coalesce(same_children, F.lit(False)) & F.coalesce(recent, F.lit(False)))
    return joined.select(
        "group_id", "dir", "mtime_us", "fingerprint", deep.alias("deep"),
        F.when(deep, F.lit(audit_round)).otherwise(F.col("_last_deep_round")).cast("int").alias("last_deep_round"),
    )


def audit_scan(listing: DataFrame, decisions: DataFrame) -> DataFrame:
    """Scan records of an audit that skips: directories always, files only where the directory is
    scanned."""
    deep = decisions.select("group_id", "dir", "deep")
    at = F.when(F.col("is_dir"), F.col("path")).otherwise(P.parent_path("path"))
    joined = lookup_join(scan_tree(listing).withColumn("dir", at), deep, ["group_id", "dir"], "inner", salt_from=["path"])
    return joined.where("is_dir or deep").withColumn("audit_skipped", F.col("is_dir") & ~F.col("deep")).drop("dir", "deep")
