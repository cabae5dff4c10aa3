"""Group status, readiness, observation evidence and the trust gate. All tables here have one row
per group, root or node, so they are small next to the state table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators import rollup as U

PENDING, WAITING, READY = "pending_materialization", "waiting_for_materialized_root", "ready"


def live_readiness(audited: Column, live_nodes: Column) -> Column:
    """Pending until the primary's first audit end, then ready with live nodes, else waiting."""
    return F.when(~audited, F.lit(PENDING)).when(live_nodes > 0, F.lit(READY)).otherwise(F.lit(WAITING))


def snapshot_readiness(readiness: Column, group: Column, primary: Column, total: Column, live: Column) -> Column:
    """Readiness as a status row shows it: waiting with live nodes is ready, ready without any
    node is waiting for a placeholder primary and pending for a real one."""
    placeholder = primary.isin("", "unassigned") | (primary == group)
    return (
        F.when((readiness == WAITING) & (live > 0), F.lit(READY))
        .when((readiness == READY) & (total == 0) & (live == 0), F.when(placeholder, F.lit(WAITING)).otherwise(F.lit(PENDING)))
        .otherwise(readiness)
    )


def group_status(state: DataFrame, groups: DataFrame, as_of_us: int) -> DataFrame:
    """Status row of every group: health counters, clock lag, overflow, readiness, revision."""
    any_live = state.groupBy("group_id").agg(F.count_if(U.alive()).alias("_any_live"))
    health = U.health_stats(state, as_of_us)
    zero = ["live_nodes", "tombstoned_count", "attested_count", "suspect_count", "blind_spot_count", "total_nodes"]
    g = groups.join(health, "group_id", "left").join(any_live, "group_id", "left").fillna(0, [*zero, "_any_live"])
    ready = live_readiness(F.col("audited"), F.col("_any_live"))
    return g.select(
        "group_id", "primary_object_ref", *zero,
        F.col("clock_us").alias("shadow_time_us"),
        F.when(F.col("clock_us") == 0, F.lit(0)).otherwise(F.greatest(F.lit(as_of_us) - F.col("clock_us"), F.lit(0)))
        .cast("long").alias("shadow_lag_us"),
        "overflow_pending",
        snapshot_readiness(ready, F.col("group_id"), F.col("primary_object_ref"), F.col("total_nodes"), F.col("live_nodes"))
        .alias("readiness"),
        "revision",
    )


def _bound(primary: Column, group: Column) -> Column:
    return (F.trim(primary) != "") & (primary != "unassigned") & (primary != group)


def live_ready(s: str = "") -> Column:
    c = lambda n: F.col(f"{s}{n}")
    return (
        (c("readiness") == READY) & ~c("overflow_pending") & ((c("live_nodes") > 0) | (c("total_nodes") > 0))
        & _bound(c("primary_object_ref"), c("group_id"))
    )


def readiness_classes(status: DataFrame, schedule: DataFrame) -> DataFrame:
    """(group_id, readiness_class) for scheduled groups: ready, waiting, pending, missing or
    blocked; without a schedule only the ready groups of the status rows."""
    known = status.select("group_id", "readiness", live_ready().alias("_live_ready"))
    if schedule.isEmpty():
        return known.where("_live_ready").select("group_id", F.lit("ready").alias("readiness_class"))
    joined = schedule.select("group_id").distinct().join(known, "group_id", "left")
    return joined.select(
        "group_id",
        F.when(F.col("readiness").isNull(), F.lit("missing"))
        .when(F.col("_live_ready"), F.lit("ready"))
        .when(F.col("readiness") == WAITING, F.lit("waiting"))
        .when(F.col("readiness") == PENDING, F.lit("pending"))
        .otherwise(F.lit("blocked"))
        .alias("readiness_class"),
    )


def readiness_concern(classes: DataFrame, status: DataFrame, schedule: DataFrame, evidence: DataFrame, delivered: bool) -> DataFrame:
    """One row: group counts per class and the first concern that applies.

    ``evidence`` lists groups with stream evidence; ``delivered`` says whether any event at all
    was received.
    """
    n = lambda name: F.count_if(F.col("readiness_class") == name)
    flags = classes.join(evidence.select("group_id").distinct().withColumn("_seen", F.lit(True)), "group_id", "left").agg(
        F.count("*").alias("scheduled"), n("ready").alias("ready"), n("waiting").alias("waiting"),
        n("pending").alias("pending"), n("missing").alias("missing"),
        F.count_if((F.col("readiness_class") == "missing") & F.col("_seen")).alias("_missing_seen"),
    )
    scheduled = not schedule.isEmpty()
    has_nodes = not status.where("live_nodes > 0 or total_nodes > 0").isEmpty()
    full = F.lit(scheduled) & (F.col("missing") == 0)
    concern = (
        F.when(F.lit(not scheduled and not has_nodes), F.lit("stale_empty"))
        .when(F.lit(scheduled) & (F.col("_missing_seen") > 0), F.lit("coverage_gap"))
        .when(full & (F.col("pending") == F.col("scheduled")) & F.lit(not delivered), F.lit("replay_pending"))
        .when(full & (F.col("pending") == F.col("scheduled")) & F.lit(delivered), F.lit("coverage_gap"))
        .when(full & (F.col("waiting") == F.col("scheduled")), F.lit("waiting_for_materialized_root"))
        .when(F.lit(scheduled) & (F.col("ready") > 0) & (F.col("waiting") + F.col("pending") > 0), F.lit("mixed_readiness"))
    )
    return flags.select("scheduled", "ready", "waiting", "pending", "missing", concern.alias("concern"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """Status of several reporters, as (node, group_id) rows: the groups of a node are unioned and
    its newest values kept."""
    values = [c for c in reports.columns if c not in ("node", "group_id", "reported_at_us")]
    return reports.groupBy("node", "group_id").agg(
        *[F.max_by(v, "reported_at_us").alias(v) for v in values], F.count("*").alias("reporters")
    )


# ---------------------------------------------------------------- observation


def _candidate() -> Column:
    return (
        F.col("active") & F.col("is_group_primary") & F.col("scan_enabled") & ~F.col("status").startswith("waiting_for_root:")
    )


def _completed() -> Column:
    done = F.col("last_audit_completed_at_us")
    return F.coalesce(
        (done >= F.coalesce("last_audit_started_at_us", F.lit(0)))
        & (done >= F.coalesce("last_rescan_requested_at_us", F.lit(0))),
        F.lit(False),
    )


def _implicit() -> Column:
    return (
        F.col("status").isin("ready", "ok") & (F.col("coverage_mode") == "audit_only") & ~F.col("rescan_pending")
        & F.col("last_rescan_requested_at_us").isNull() & F.col("last_audit_started_at_us").isNull()
        & F.col("last_audit_completed_at_us").isNull()
    )


def _published() -> Column:
    counts = ["forwarded_batch_count", "forwarded_event_count", "forwarded_path_event_count", "emitted_batch_count",
              "emitted_event_count", "emitted_path_event_count"]
    some = F.lit(False)
    for c in counts:
        some = some | (F.col(c) > 0)
    return some | F.col("last_forwarded_at_us").isNotNull() | F.col("last_emitted_at_us").isNotNull()


def _head(status: Column) -> Column:
    return F.substring_index(status, ":", 1)


def _troubled(status: Column) -> Column:
    return status.contains("degraded") | status.contains("error") | status.contains("failed") | status.contains("overflow")


@dataclass(frozen=True)
class SourceStatus:
    """``logical``: root_id, status, matched_grants, active_members. ``concrete``: one row per root
    and member. ``degraded``: root_id."""

    logical: DataFrame
    concrete: DataFrame
    degraded: DataFrame


def _facts(source: SourceStatus, sink: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per group id seen anywhere, with every fact the rules below need."""
    c = source.concrete.withColumn("_cand", _candidate())
    owner = F.col("_cand") & (_completed() | _implicit())
    concrete = c.groupBy(F.col("logical_root_id").alias("group_id")).agg(
        F.max("_cand").alias("candidate_root"),
        F.max(F.col("active") & F.col("scan_enabled")).alias("observed_scan"),
        F.max(owner).alias("owner"),
        F.max(F.col("_cand") & ~_completed()).alias("needs_owner"),
        F.max(F.col("_cand") & _published()).alias("published"),
    )
    st = F.col("status")
    usable = (F.col("matched_grants") > 0) & (F.col("active_members") > 0)
    logical = source.logical.groupBy(F.col("root_id").alias("group_id")).agg(
        F.max(usable).alias("usable_root"),
        F.max(
            usable & ~_head(st).isin("retiring", "retired", "no_visible_export_match")
            & ~st.startswith("waiting_for_root:") & ~_troubled(st)
        ).alias("service_ready"),
        F.max(usable & (_head(st) != "ready") & _troubled(st)).alias("troubled"),
    )
    sinks = sink.select(
        "group_id", F.lit(True).alias("has_sink"),
        (
            (~F.col("primary_object_ref").isin("", "unassigned") & (F.col("primary_object_ref") != F.col("group_id")))
            | (F.col("live_nodes") > 0) | (F.col("total_nodes") > 0) | (F.col("readiness") == READY)
        ).alias("present"),
        (F.col("readiness") != READY).alias("unready"),
        F.col("overflow_pending").alias("overflow"),
        live_ready().alias("live_ready"),
    )
    flag = lambda df, key, name: df.select(F.col(key).alias("group_id")).distinct().withColumn(name, F.lit(True))
    table = (
        concrete.join(logical, "group_id", "full_outer").join(sinks, "group_id", "full_outer")
        .join(flag(schedule, "group_id", "scheduled"), "group_id", "full_outer")
        .join(flag(source.degraded, "root_id", "degraded_root"), "group_id", "full_outer")
    )
    t = table.fillna(False)
    return t.select(
        "*",
        (F.col("scheduled") | F.col("present")).alias("local"),
        (F.col("owner") | (~F.col("observed_scan") & F.col("service_ready"))).alias("owner_evidence"),
        (F.col("published") & F.col("live_ready")).alias("ready_and_published"),
    )


def observation_evidence(source: SourceStatus, sink: DataFrame, schedule: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """(group_id, candidate, initial_audit, degraded, overflow_pending) per group.

    Without ``required`` the candidates are the usable roots with presence in the sink; with it
    (a table of group_id) exactly those groups are judged.
    """
    facts = _facts(source, sink, schedule)
    blocked_source = F.col("needs_owner") & ~F.col("owner_evidence") & ~F.col("ready_and_published") & F.col("local")
    if required is None:
        cand = (F.col("candidate_root") | F.col("usable_root")) & F.col("local")
        initial = (cand & (~F.col("has_sink") | F.col("unready"))) | blocked_source
        return facts.select(
            "group_id", cand.alias("candidate"), initial.alias("initial_audit"),
            ((cand & F.col("degraded_root")) | F.col("troubled")).alias("degraded"),
            (cand & F.col("overflow")).alias("overflow_pending"),
        )
    asked = required.select("group_id").distinct().join(facts, "group_id", "left").fillna(False)
    scanned = F.col("candidate_root") & F.col("local")
    initial = (
        (scanned & (~F.col("has_sink") | F.col("unready"))) | blocked_source
        | (~F.col("owner_evidence") & ~F.col("ready_and_published"))
        | (~F.col("scheduled") & ~F.col("has_sink")) | ~F.col("live_ready")
    )
    return asked.select(
        "group_id", F.lit(True).alias("candidate"), initial.alias("initial_audit"),
        (F.col("degraded_root") | F.col("troubled")).alias("degraded"), F.col("overflow").alias("overflow_pending"),
    )


FRESH_ONLY, UNTRUSTED, TRUSTED = "fresh-only", "materialized-untrusted", "trusted-materialized"


def observation_state(evidence: DataFrame) -> DataFrame:
    """One row (state, reasons). Any group in an initial audit, degraded or overflowing makes the
    observation untrusted. No candidate at all is also untrusted: nothing has been observed."""
    n = evidence.agg(
        F.count_if("candidate").alias("c"), F.count_if("initial_audit").alias("i"),
        F.count_if("degraded").alias("d"), F.count_if("overflow_pending").alias("o"),
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("c") == 0, F.lit("no_candidate_groups")),
            F.when(F.col("i") > 0, F.lit("initial_audit_incomplete")),
            F.when(F.col("d") > 0, F.lit("degraded_groups")),
            F.when(F.col("o") > 0, F.lit("watch_overflow_pending")),
        ),
        lambda r: r.isNotNull(),
    )
    return n.select(F.when(F.size(reasons) == 0, F.lit(TRUSTED)).otherwise(F.lit(UNTRUSTED)).alias("state"), reasons.alias("reasons"))


class NotReady(RuntimeError):
    """A trusted read before the evidence allows it."""


def uncovered_groups(source: SourceStatus, sink: DataFrame, schedule: DataFrame, required: DataFrame) -> DataFrame:
    """Required groups that keep a trusted read closed, with the first missing piece of evidence."""
    facts = _facts(source, sink, schedule)
    asked = required.select("group_id").distinct().join(facts, "group_id", "left").fillna(False)
    evidence = observation_evidence(source, sink, schedule, required)
    reason = (
        F.when(~F.col("owner_evidence") & ~F.col("ready_and_published"), F.lit("source evidence"))
        .when(~F.col("scheduled") & ~F.col("has_sink"), F.lit("not scheduled"))
        .when(~F.col("live_ready"), F.lit("sink not ready"))
        .when(F.col("initial_audit"), F.lit("initial audit"))
        .when(F.col("degraded"), F.lit("degraded"))
        .when(F.col("overflow_pending"), F.lit("watch overflow"))
    )
    return (
        asked.join(evidence, "group_id").withColumn("reason", reason).where("reason is not null").select("group_id", "reason")
    )


def trust_gate(read_class: str, source: SourceStatus, sink: DataFrame, schedule: DataFrame, required: DataFrame) -> str:
    """State to report for a read, or ``NotReady`` before any row is produced."""
    if read_class == "fresh":
        return FRESH_ONLY
    blocked = uncovered_groups(source, sink, schedule, required)
    if required.isEmpty():
        trusted = observation_state(observation_evidence(source, sink, schedule)).first().state == TRUSTED
        first = None
    else:
        first = blocked.orderBy("group_id").first()
        trusted = first is None
    if read_class == "trusted-materialized" and not trusted:
        raise NotReady("no trusted observation" if first is None else f"group {first.group_id!r}: {first.reason}")
    return TRUSTED if trusted else UNTRUSTED
