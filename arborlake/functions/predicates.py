"""Scope patterns, limits, coverage modes and argument checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def scope_match(value, scopes) -> Column:
    """``*``, equality, or one wildcard that splits a scope into prefix and suffix."""
    v, s = _c(value), _c(scopes)
    return F.exists(
        s,
        lambda scope: (scope == "*")
        | (scope == v)
        | (
            (F.instr(scope, "*") > 0)
            & v.startswith(F.substring_index(scope, "*", 1))
            & v.endswith(scope.substr(F.instr(scope, "*") + 1, F.length(scope)))
        ),
    )


def effective_limit(requested: int | None, default: int, maximum: int) -> int:
    return min(max(default if requested is None else requested, 1), max(maximum, 1))


def effective_limit_column(requested, default, maximum) -> Column:
    wanted = F.greatest(F.coalesce(_c(requested), _c(default)), F.lit(1))
    return F.least(wanted, F.greatest(_c(maximum), F.lit(1)))


def coverage_mode(watch, scan, watch_capacity=None) -> Column:
    """A watch without any watch capacity counts as no watch when a scan exists."""
    w, s = _c(watch), _c(scan)
    watching = w if watch_capacity is None else w & (_c(watch_capacity) > 0)
    return (
        F.when(watching & s, F.lit("realtime_hotset_plus_audit"))
        .when(s, F.lit("audit_with_metadata"))
        .otherwise(F.lit("watch_degraded"))
    )


def coverage_capabilities(mode) -> Column:
    m = _c(mode)
    scanned = m.isin("realtime_hotset_plus_audit", "audit_with_metadata")
    return F.struct(
        F.lit(True).alias("exists_coverage"),
        F.lit(True).alias("file_count_coverage"),
        scanned.alias("file_metadata_coverage"),
        scanned.alias("mtime_size_coverage"),
        (m == "realtime_hotset_plus_audit").alias("watch_freshness_coverage"),
    )


class QueryParameterError(ValueError):
    """A request that the engine refuses before it plans anything."""


GROUP_ORDERS = ("group-key", "file-count", "file-age")
READ_CLASSES = ("fresh", "materialized", "trusted-materialized")


def check_tree_parameters(
    *,
    path: str | None = None,
    path_b64: str | None = None,
    group_page_size: int | None = None,
    entry_page_size: int | None = None,
    group_order: str = "group-key",
    read_class: str = "trusted-materialized",
    max_depth: int | None = None,
) -> None:
    if path is not None and path_b64 is not None:
        raise QueryParameterError("path and path_b64 exclude each other")
    if group_page_size is not None and not 1 <= group_page_size <= 1000:
        raise QueryParameterError("group_page_size must be between 1 and 1000")
    if entry_page_size is not None and not 1 <= entry_page_size <= 10000:
        raise QueryParameterError("entry_page_size must be between 1 and 10000")
    if group_order not in GROUP_ORDERS:
        raise QueryParameterError(f"unknown group_order {group_order!r}")
    if read_class not in READ_CLASSES:
        raise QueryParameterError(f"unknown read_class {read_class!r}")
    if max_depth is not None and max_depth < 0:
        raise QueryParameterError("max_depth must not be negative")


def check_stats_parameters(*, read_class: str = "trusted-materialized", **others) -> None:
    if read_class == "fresh":
        raise QueryParameterError("stats does not read fresh")
    given = sorted(k for k, v in others.items() if v is not None)
    if given:
        raise QueryParameterError(f"stats does not take {', '.join(given)}")
    if read_class not in READ_CLASSES:
        raise QueryParameterError(f"unknown read_class {read_class!r}")


def tree_request_error(path, path_b64, group_page_size, entry_page_size, group_order, read_class, max_depth) -> Column:
    """Why a request of a table of requests is refused, null where it is not; the rules of ``check_tree_parameters``.
    A null order or read class stands for its default."""
    order, read = F.coalesce(_c(group_order), F.lit("group-key")), F.coalesce(_c(read_class), F.lit("trusted-materialized"))
    return (
        F.when(_c(path).isNotNull() & _c(path_b64).isNotNull(), F.lit("path and path_b64 exclude each other"))
        .when(~_c(group_page_size).between(1, 1000), F.lit("group_page_size must be between 1 and 1000"))
        .when(~_c(entry_page_size).between(1, 10000), F.lit("entry_page_size must be between 1 and 10000"))
        .when(~order.isin(*GROUP_ORDERS), F.concat(F.lit("unknown group_order '"), order, F.lit("'")))
        .when(~read.isin(*READ_CLASSES), F.concat(F.lit("unknown read_class '"), read, F.lit("'")))
        .when(_c(max_depth) < 0, F.lit("max_depth must not be negative"))
    )
