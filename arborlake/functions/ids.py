"""Identifier and fingerprint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


# The escape sign itself comes first, because the other replacements introduce it.
_FREQUENT = "~:/ @?=&%#+,"


def stable_escape(value) -> Column:
    """Keep ``[A-Za-z0-9-_.]``; write every other UTF-8 byte as ``~`` and two hex digits.

    Ids that need no escape and ids with only the frequent signs take plain string replacement;
    the per-character lambda runs for the others alone.
    """
    v = _c(value)
    replaced = v
    for sign in _FREQUENT:
        replaced = F.replace(replaced, F.lit(sign), F.lit(f"~{ord(sign):02x}"))
    chars = F.split(F.decode(F.encode(v, "UTF-8"), "ISO-8859-1"), "")
    escaped = F.array_join(
        F.transform(
            chars,
            lambda ch: F.when(ch.rlike(r"^[A-Za-z0-9._-]?$"), ch).otherwise(
                F.concat(F.lit("~"), F.lower(F.hex(F.encode(ch, "ISO-8859-1"))))
            ),
        ),
        "",
    )
    return (
        F.when(v.rlike(r"^[A-Za-z0-9._-]*\z"), v)
        .when(v.rlike(r"^[A-Za-z0-9._~:/ @?=&%#+,-]*\z"), replaced)
        .otherwise(escaped)
    )


def graph_gid(kind, instance, local_id) -> Column:
    return F.concat_ws(":", _c(kind), stable_escape(instance), stable_escape(local_id))


def graph_edge_id(source_gid, edge_kind, target_gid) -> Column:
    return F.concat(
        F.lit("edge:"), stable_escape(source_gid), F.lit(":"), _c(edge_kind), F.lit(":"), stable_escape(target_gid)
    )


def stat_fingerprint(size, mtime) -> Column:
    return F.concat(F.lit("size="), _c(size).cast("string"), F.lit(";mtime="), _c(mtime).cast("string"))


def object_fingerprint(etag, size, modified_ms) -> Column:
    return F.coalesce(_c(etag), stat_fingerprint(size, modified_ms))


def count_fingerprint(noun: str, count) -> Column:
    return F.concat(F.lit(noun + "="), _c(count).cast("string"))


def _optional(value) -> Column:
    v = _c(value)
    return F.when(v.isNull(), F.lit("None")).otherwise(F.concat(F.lit("Some("), v.cast("string"), F.lit(")")))


def version_fingerprint(seq_no, primary_term) -> Column:
    return F.concat(F.lit("seq_no="), _optional(seq_no), F.lit(";primary_term="), _optional(primary_term))


def root_id_base(raw) -> Column:
    cleaned = F.regexp_replace(_c(raw), r"[^A-Za-z0-9._-]", "-")
    trimmed = F.regexp_replace(cleaned, r"^-+|-+$", "")
    return F.when(trimmed == "", F.lit("root")).otherwise(trimmed)
