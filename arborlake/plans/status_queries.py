"""Observation evidence, the trust gate, keyed state machines and state versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import keyed as K
from arborlake.operators import status as T
from arborlake.plans import views as V
from arborlake.plans.function_queries import BASE, STATE
from arborlake.plans.registry import query
from arborlake.sources.state_store import StateStore
from arborlake.storage import fresh_path

# ---------------------------------------------------------------- observation

SQL_STATUS = """
WITH logical AS (
  SELECT n_nationkey AS k, n_name AS root_id, ['ready', 'degraded:slow', 'retiring', 'waiting_for_root:x', 'ok'][n_nationkey % 5 + 1] AS status,
         n_nationkey % 4 AS matched_grants, n_nationkey % 3 AS active_members FROM nation),
concrete AS (
  SELECT s_suppkey AS s, n_name AS logical_root_id, s_suppkey % 10 > 0 AS active, s_suppkey % 4 > 0 AS is_group_primary, s_suppkey % 7 > 0 AS scan_enabled,
         CASE WHEN s_suppkey % 11 = 0 THEN 'waiting_for_root:y' ELSE 'ready' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'audit_only' ELSE 'full' END AS coverage_mode,
         s_suppkey % 13 = 0 AS rescan_pending, CASE WHEN s_suppkey % 3 = 0 THEN 100 END AS started, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey * 2 END AS completed,
         CASE WHEN s_suppkey % 5 = 0 THEN 60 END AS requested, s_suppkey % 6 AS emitted FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cust AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
sink AS (
  SELECT n_name AS group_id, CASE WHEN n_nationkey % 7 = 0 THEN 'unassigned' ELSE 'p' || n_nationkey END AS primary_object_ref, coalesce(n, 0) * (n_nationkey % 2) AS live_nodes,
         coalesce(n, 0) * (n_nationkey % 2) AS total_nodes, ['ready', 'ready', 'pending_materialization', 'waiting_for_materialized_root'][n_nationkey % 4 + 1] AS readiness,
         n_nationkey % 8 = 0 AS overflow_pending FROM nation LEFT JOIN cust ON cust.k = n_nationkey WHERE n_nationkey % 6 > 0),
cf AS (
  SELECT logical_root_id AS group_id, bool_or(cand) AS candidate_root, bool_or(active AND scan_enabled) AS observed_scan, bool_or(cand AND (done OR implicit)) AS owner,
         bool_or(cand AND NOT done) AS needs_owner, bool_or(cand AND emitted > 0) AS published FROM (
    SELECT *, active AND is_group_primary AND scan_enabled AND NOT starts_with(status, 'waiting_for_root:') AS cand,
      coalesce(completed >= coalesce(started, 0) AND completed >= coalesce(requested, 0), false) AS done,
      status IN ('ready', 'ok') AND coverage_mode = 'audit_only' AND NOT rescan_pending AND started IS NULL AND completed IS NULL AND requested IS NULL AS implicit FROM concrete) GROUP BY 1),
facts AS (
  SELECT l.root_id AS group_id, l.k, coalesce(candidate_root, false) AS candidate_root, matched_grants > 0 AND active_members > 0 AS usable_root,
    matched_grants > 0 AND active_members > 0 AND l.status IN ('ready', 'ok') AS service_ready, matched_grants > 0 AND active_members > 0 AND l.status = 'degraded:slow' AS troubled,
    coalesce(observed_scan, false) AS observed_scan, coalesce(owner, false) AS owner, coalesce(needs_owner, false) AS needs_owner, coalesce(published, false) AS published,
    s.group_id IS NOT NULL AS has_sink, l.k % 4 = 1 AS scheduled, l.k % 9 = 0 AS degraded_root,
    coalesce(primary_object_ref <> 'unassigned' OR live_nodes > 0 OR s.readiness = 'ready', false) AS present, coalesce(s.readiness <> 'ready', false) AS unready,
    coalesce(overflow_pending, false) AS overflow, coalesce(s.readiness = 'ready' AND NOT overflow_pending AND live_nodes > 0 AND primary_object_ref <> 'unassigned', false) AS live_ready
  FROM logical l LEFT JOIN cf ON cf.group_id = l.root_id LEFT JOIN sink s ON s.group_id = l.root_id),
f AS (SELECT *, scheduled OR present AS local, owner OR (NOT observed_scan AND service_ready) AS owner_evidence, published AND live_ready AS rp FROM facts),
ev AS (
  SELECT group_id, (candidate_root OR usable_root) AND local AS candidate,
    ((candidate_root OR usable_root) AND local AND (NOT has_sink OR unready)) OR (needs_owner AND NOT owner_evidence AND NOT rp AND local) AS initial_audit,
    ((candidate_root OR usable_root) AND local AND degraded_root) OR troubled AS degraded, (candidate_root OR usable_root) AND local AND overflow AS overflow_pending FROM f),
req AS (
  SELECT group_id, k, true AS candidate, (candidate_root AND local AND (NOT has_sink OR unready)) OR (needs_owner AND NOT owner_evidence AND NOT rp AND local)
    OR (NOT owner_evidence AND NOT rp) OR (NOT scheduled AND NOT has_sink) OR NOT live_ready AS initial_audit, degraded_root OR troubled AS degraded, overflow AS overflow_pending,
    owner_evidence, rp, scheduled, has_sink, live_ready FROM f WHERE k % 2 = 1)"""


def statuses(spark, d):
    n, k = V.table(spark, d, "nation"), F.col("n_nationkey")
    pick = lambda *v: F.array(*[F.lit(x) for x in v])
    logical = n.select(
        F.col("n_name").alias("root_id"), F.get(pick("ready", "degraded:slow", "retiring", "waiting_for_root:x", "ok"), k % 5).alias("status"),
        (k % 4).alias("matched_grants"), (k % 3).alias("active_members"),
    )
    s = F.col("s_suppkey")
    zero = F.lit(0)
    never = F.lit(None).cast("long")
    concrete = V.table(spark, d, "supplier").join(n, F.col("s_nationkey") == k).select(
        F.col("n_name").alias("logical_root_id"), (s % 10 > 0).alias("active"), (s % 4 > 0).alias("is_group_primary"), (s % 7 > 0).alias("scan_enabled"),
        F.when(s % 11 == 0, F.lit("waiting_for_root:y")).otherwise(F.lit("ready")).alias("status"),
        F.when(s % 2 == 0, F.lit("audit_only")).otherwise(F.lit("full")).alias("coverage_mode"), (s % 13 == 0).alias("rescan_pending"),
        F.when(s % 3 == 0, F.lit(100)).alias("last_audit_started_at_us"), F.when(s % 9 == 0, s * 2).alias("last_audit_completed_at_us"),
        F.when(s % 5 == 0, F.lit(60)).alias("last_rescan_requested_at_us"), (s % 6).alias("emitted_event_count"),
        *[zero.alias(c) for c in ("forwarded_batch_count", "forwarded_event_count", "forwarded_path_event_count", "emitted_batch_count", "emitted_path_event_count")],
        never.alias("last_forwarded_at_us"), never.alias("last_emitted_at_us"),
    )
    counts = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nodes = F.coalesce("n", F.lit(0)) * (k % 2)
    sink = n.join(counts, "n_nationkey", "left").where(k % 6 > 0).select(
        F.col("n_name").alias("group_id"), F.when(k % 7 == 0, F.lit("unassigned")).otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("primary_object_ref"),
        nodes.alias("live_nodes"), nodes.alias("total_nodes"), F.get(pick(T.READY, T.READY, T.PENDING, T.WAITING), k % 4).alias("readiness"),
        (k % 8 == 0).alias("overflow_pending"),
    )
    schedule = n.where(k % 4 == 1).select(F.col("n_name").alias("group_id"))
    degraded = n.where(k % 9 == 0).select(F.col("n_name").alias("root_id"))
    return T.SourceStatus(logical, concrete, degraded), sink, schedule, n.where(k % 2 == 1).select(F.col("n_name").alias("group_id"))


@query("observation_evidence", SQL_STATUS + " SELECT * FROM ev")
def observation_evidence(spark, d):
    source, sink, schedule, _ = statuses(spark, d)
    return T.observation_evidence(source, sink, schedule)


@query("required_group_evidence", SQL_STATUS + " SELECT group_id, candidate, initial_audit, degraded, overflow_pending FROM req")
def required_group_evidence(spark, d):
    return T.observation_evidence(*statuses(spark, d))


@query("observation_state", SQL_STATUS + """
SELECT CASE WHEN bool_or(initial_audit OR degraded OR overflow_pending) OR count(*) FILTER (candidate) = 0 THEN 'materialized-untrusted' ELSE 'trusted-materialized' END AS state,
  array_to_string(list_filter([CASE WHEN count(*) FILTER (candidate) = 0 THEN 'no_candidate_groups' END, CASE WHEN bool_or(initial_audit) THEN 'initial_audit_incomplete' END,
    CASE WHEN bool_or(degraded) THEN 'degraded_groups' END, CASE WHEN bool_or(overflow_pending) THEN 'watch_overflow_pending' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ev""")
def observation_state(spark, d):
    source, sink, schedule, _ = statuses(spark, d)
    state = T.observation_state(T.observation_evidence(source, sink, schedule))
    return state.select("state", F.array_join("reasons", ",").alias("reasons"))


@query("trust_gate", SQL_STATUS + """
SELECT group_id, CASE WHEN NOT owner_evidence AND NOT rp THEN 'source evidence' WHEN NOT scheduled AND NOT has_sink THEN 'not scheduled' WHEN NOT live_ready THEN 'sink not ready'
  WHEN initial_audit THEN 'initial audit' WHEN degraded THEN 'degraded' ELSE 'watch overflow' END AS reason FROM req
WHERE (NOT owner_evidence AND NOT rp) OR (NOT scheduled AND NOT has_sink) OR NOT live_ready OR initial_audit OR degraded OR overflow_pending""")
def trust_gate(spark, d):
    return T.uncovered_groups(*statuses(spark, d))


# ---------------------------------------------------------------- keyed state machines

RECURSIVE = BASE.replace("WITH", "WITH RECURSIVE", 1)


@query("modify_throttle", RECURSIVE + f""",
e AS MATERIALIZED (SELECT origin_id, path, seq, arrival_us AS at_us, ['modify', 'modify', 'close_write', 'attrib'][seq % 4 + 1] AS kind,
  row_number() OVER (PARTITION BY origin_id, path ORDER BY seq) AS n FROM base),
r AS (
  SELECT origin_id, path, seq, n, true AS emitted, CASE WHEN kind = 'modify' THEN at_us END AS last FROM e WHERE n = 1
  UNION ALL
  SELECT e.origin_id, e.path, e.seq, e.n, NOT (kind = 'modify' AND coalesce(at_us - last < {3 * V.DAY_US}, false)),
    CASE WHEN kind = 'modify' AND NOT coalesce(at_us - last < {3 * V.DAY_US}, false) THEN at_us WHEN kind = 'close_write' THEN NULL ELSE last END
  FROM r JOIN e ON e.origin_id = r.origin_id AND e.path = r.path AND e.n = r.n + 1)
SELECT origin_id, path, seq, emitted FROM r""")
def modify_throttle(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("modify", "modify", "close_write", "attrib")])
    rows = V.base_log(spark, d).withColumn("kind", F.get(kinds, F.col("seq") % 4))
    return K.throttle_modifies(rows, 3 * V.DAY_US)


@query("drift_estimates", RECURSIVE + """,
e AS (SELECT origin_id, seq, source = 'Realtime' AS realtime, mtime_us / 1e6 - arrival_us / 1e6 AS sample FROM base),
g AS (SELECT *, count(*) FILTER (realtime) OVER (PARTITION BY origin_id ORDER BY seq) AS rt FROM e),
a AS (SELECT *, list_sort(list(sample) OVER (PARTITION BY origin_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS win FROM g WHERE realtime OR rt < 50),
p AS (SELECT *, CASE WHEN len(win) >= 10 THEN CAST(trunc(win[greatest(CAST(floor(len(win) * 0.999) AS BIGINT) - 1, 0) + 1] * 1000000.0) AS BIGINT) END AS proposed FROM a),
m AS MATERIALIZED (SELECT g.origin_id, g.seq, g.rt, proposed, row_number() OVER (PARTITION BY g.origin_id ORDER BY g.seq) AS n FROM g LEFT JOIN p USING (origin_id, seq)),
r AS (
  SELECT origin_id, seq, rt, n, CAST(0 AS BIGINT) AS drift FROM m WHERE n = 1
  UNION ALL
  SELECT m.origin_id, m.seq, m.rt, m.n, CASE WHEN proposed IS NOT NULL AND (m.rt < 50 OR abs(proposed - drift) <= 86400000000) THEN proposed ELSE drift END
  FROM r JOIN m ON m.origin_id = r.origin_id AND m.n = r.n + 1)
SELECT origin_id, seq, drift AS drift_us, rt >= 50 AS graduated FROM r""")
def drift_estimates(spark, d):
    rows = V.base_log(spark, d).select(
        "origin_id", "seq", (F.col("source") == "Realtime").alias("realtime"), "mtime_us", F.col("arrival_us").alias("local_us")
    )
    return K.drift_estimates(rows, window=100, graduation=50, max_jump_us=V.DAY_US)


SIGNALS = ["overflow", "overflow", "overflow", "error", "error", "error", "audit_drift", "recovered", "timeout", "init_failed"]


@query("sentinel_actions", RECURSIVE + f""",
e AS MATERIALIZED (SELECT origin_id AS root_key, seq, arrival_us AS at_us, {SIGNALS}[(seq * 7 // 3) % 10 + 1] AS kind, seq % 60 AS amount,
  row_number() OVER (PARTITION BY origin_id ORDER BY seq) AS n FROM base),
r AS (
  SELECT root_key, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, 0 AS ov, CAST(NULL AS BIGINT) AS last, 0 AS errs, false AS deg, CAST([] AS VARCHAR[]) AS actions FROM e WHERE n = 1
  UNION ALL
  SELECT root_key, seq, n, CASE WHEN kind <> 'overflow' THEN ov WHEN c >= 3 THEN 0 ELSE c END, CASE WHEN kind = 'overflow' THEN at_us ELSE last END,
    CASE kind WHEN 'error' THEN errs + 1 WHEN 'recovered' THEN 0 ELSE errs END,
    CASE WHEN (kind = 'overflow' AND c >= 3) OR kind IN ('timeout', 'init_failed') OR (kind = 'audit_drift' AND amount >= 50) OR (kind = 'error' AND errs >= 2) THEN true
         WHEN kind = 'recovered' OR (kind = 'audit_drift' AND amount = 0) THEN false ELSE deg END,
    list_filter([
      CASE WHEN (kind = 'overflow' AND c >= 3) OR (kind = 'error' AND errs >= 2 AND NOT deg) THEN 'rescan' END,
      CASE WHEN kind = 'overflow' AND c >= 3 AND NOT deg THEN 'degraded|repeated watch overflow' WHEN kind = 'init_failed' AND NOT deg THEN 'degraded|watch init failed: x'
           WHEN kind = 'audit_drift' AND amount >= 50 AND NOT deg THEN 'degraded|audit drift: ' || amount || ' corrections'
           WHEN kind = 'error' AND errs >= 2 AND NOT deg THEN 'degraded|' || (errs + 1) || ' consecutive errors' WHEN kind = 'timeout' THEN 'degraded|HOST_FS_TIMEOUT: x'
           WHEN deg AND (kind = 'recovered' OR (kind = 'audit_drift' AND amount = 0)) THEN 'recovered' END], lambda x: x IS NOT NULL)
  FROM (SELECT e.*, r.ov, r.last, r.errs, r.deg, CASE WHEN coalesce(e.at_us - r.last > 86400000000, false) THEN 0 ELSE r.ov END + 1 AS c
        FROM r JOIN e ON e.root_key = r.root_key AND e.n = r.n + 1))
SELECT root_key, seq, split_part(a, '|', 1) AS action, CASE WHEN contains(a, '|') THEN split_part(a, '|', 2) END AS reason FROM (SELECT root_key, seq, unnest(actions) AS a FROM r)""")
def sentinel_actions(spark, d):
    kinds = F.array(*[F.lit(x) for x in SIGNALS])
    rows = V.base_log(spark, d).select(
        F.col("origin_id").alias("root_key"), "seq", F.get(kinds, F.floor(F.col("seq") * 7 / 3) % 10).alias("kind"), F.col("arrival_us").alias("at_us"),
        (F.col("seq") % 60).alias("amount"), F.lit("x").alias("detail"),
    )
    return K.sentinel_actions(rows, window_us=V.DAY_US).select("root_key", "seq", "action", "reason")


# ---------------------------------------------------------------- versions


@query("state_version", STATE + " SELECT group_id, path, size, is_tombstoned, suspect_until_us FROM st WHERE group_id <> 'g0'")
def state_version(spark, d):
    """Write a version without an unwanted group and read it back."""
    groups = V.winner_groups(spark, d).withColumn("active_epoch", F.lit(None).cast("long")).withColumn("completed_epochs", F.lit(1).cast("long")) \
        .withColumn("audit_start_us", F.lit(None).cast("long"))
    store = StateStore(spark, fresh_path(spark, "versions"))
    wanted = groups.where("group_id <> 'g0'").select("group_id")
    store.write(V.winner_state(spark, d), groups, None, batch_id=1, in_scope=wanted)
    state, _, _ = store.read()
    return state.select("group_id", "path", "size", "is_tombstoned", "suspect_until_us")
