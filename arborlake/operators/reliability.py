"""Reliability of node sets and quiet-window stability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons in ascending severity, with the blocking label of each.
REASONS = ["Unattested", "SuspectNodes", "BlindSpotsDetected", "WatchOverflowPendingMaterialization"]
BLOCKED = ["unattested_nodes", "suspect_nodes", "blind_spots_detected", "watch_overflow_pending_materialization"]

QUIET_WINDOW_MS = 5_000


def reason_code(attested: Column, suspect: Column, blind: Column) -> Column:
    """Worst reason of one node; null when it is reliable."""
    return F.when(blind, F.lit(2)).when(suspect, F.lit(1)).when(~attested, F.lit(0))


def worst(*codes: Column) -> Column:
    return F.greatest(*codes) if len(codes) > 1 else codes[0]


def overflow_code(pending: Column) -> Column:
    return F.when(pending, F.lit(3))


def reason_label(code: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in REASONS]), code)


def blocked_label(code: Column) -> Column:
    return F.get(F.array(*[F.lit(b) for b in BLOCKED]), code)


def stability(
    code: Column, overflow: Column, anchor_us: Column, recovered_us: Column, as_of_us: Column, evaluate: bool,
    window_ms: int = QUIET_WINDOW_MS,
) -> dict[str, Column]:
    """Columns of the stability verdict. Without any anchor nothing has been observed to be quiet."""
    if not evaluate:
        none = F.lit(None)
        return {
            "stability_mode": F.lit("none"),
            "stability_state": F.lit("not-evaluated"),
            "quiet_window_ms": none.cast("long"),
            "observed_quiet_for_ms": none.cast("long"),
            "remaining_ms": none.cast("long"),
            "blocked_reasons": F.array().cast("array<string>"),
        }
    window = F.lit(window_ms).cast("long")
    last = F.greatest(anchor_us, recovered_us)
    observed = F.when(last.isNotNull(), F.floor(F.greatest(as_of_us - last, F.lit(0)) / 1000)).cast("long")
    blocked = F.filter(
        F.array(F.when(overflow, F.lit(BLOCKED[3])), blocked_label(code)), lambda b: b.isNotNull()
    )
    state = (
        F.when(code == 1, F.lit("unstable"))
        .when(code.isNotNull() | overflow, F.lit("unknown"))
        .when(F.coalesce(observed, F.lit(0)) >= window, F.lit("stable"))
        .otherwise(F.lit("unstable"))
    )
    return {
        "stability_mode": F.lit("quiet-window"),
        "stability_state": state,
        "quiet_window_ms": window,
        "observed_quiet_for_ms": observed,
        "remaining_ms": F.when(observed.isNotNull(), F.greatest(window - observed, F.lit(0))),
        "blocked_reasons": blocked,
    }
