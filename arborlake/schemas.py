"""Row layouts. Paths are byte text (see ``functions.paths``); times are microseconds."""

from __future__ import annotations

from pyspark.sql import types as T

# Record kinds, tracks and outcomes of the data model.
UPDATE, DELETE = "Update", "Delete"
REALTIME, SCAN = "Realtime", "Scan"
DATA, EPOCH_START, EPOCH_END, WATCH_OVERFLOW = "data", "epoch_start", "epoch_end", "watch_overflow"
IGNORED, CREATED, MODIFIED, DELETED = "Ignored", "UpsertCreated", "UpsertModified", "DeleteApplied"


_TYPES = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType()}
_TEXTS = T.ArrayType(T.StringType())


def _schema(spec: str, **others: T.DataType) -> T.StructType:
    """Columns as ``name type`` items; ``others`` gives the types that are not plain ones."""
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, others.get(kind) or _TYPES[kind]) for name, kind in pairs])


LOG = _schema(
    """group_id string, origin_id string, seq long, arrival_us long, timestamp_us long, rec_type string,
    epoch_id long, path string, parent_path string, is_dir boolean, size long, mtime_us long, ctime_us long,
    parent_mtime_us long, event_kind string, source string, is_atomic_write boolean, audit_skipped boolean,
    is_primary boolean"""
)

STATE = _schema(
    """group_id string, path string, size long, modified_time_us long, created_time_us long, is_dir boolean,
    source string, monitoring_attested boolean, last_confirmed_at_us long, suspect_until_us long,
    blind_spot boolean, is_tombstoned boolean, tombstone_expires_at_us long, tombstoned_at_shadow_us long,
    last_realtime_event_shadow_us long, last_seen_epoch long, subtree_changed_at_us long"""
)

GROUPS = _schema(
    """group_id string, primary_object_ref string, clock_us long, active_epoch long, completed_epochs long,
    audit_start_us long, overflow_pending boolean, coverage_recovered_at_us long, audited boolean, revision long"""
)

OUTCOMES = _schema(
    """group_id string, path string, seq long, origin_id string, arrival_us long, outcome string,
    significant boolean, stamps boolean, is_dir boolean, mtime_us long, ctime_us long"""
)

GRANTS = _schema(
    """object_ref string, host_ref string, host_ip string, host_name string, site string, zone string,
    host_labels labels, mount_point string, fs_source string, fs_type string,
    mount_options texts, interfaces texts, active boolean""",
    labels=T.MapType(T.StringType(), T.StringType()),
    texts=_TEXTS,
)

SELECTOR = _schema("mount_point string, fs_source string, fs_type string, host_ip string, host_ref string")

ROOTS = _schema(
    "id string, selector selector, subpath_scope string, watch boolean, scan boolean, audit_interval_ms long",
    selector=SELECTOR,
)
