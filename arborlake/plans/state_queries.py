"""Joins, roll-ups, tree queries and paging over the derived state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.functions import paths as P
from arborlake.operators import arbitrate as A
from arborlake.operators import paging as G
from arborlake.operators import heads as H
from arborlake.operators import rollup as U
from arborlake.operators import routing
from arborlake.operators import status as T
from arborlake.operators import tree_query as Q
from arborlake.operators import tree_request as B
from arborlake.operators.ordered import number_rows, running_max
from arborlake.plans import views as V
from arborlake.plans.function_queries import (
    BASE, LISTING, SCAN_SQL, SQL_OUT, STATE, ancestors, depth, lineage, name_of, outcome_rows, parent, rebase, under, with_,
)
from arborlake.plans.registry import query
from arborlake.sources import listing as L
from arborlake.sources.state_store import StateStore
from arborlake.storage import fresh_path

NOW = V.AS_OF_US
GRANTS = with_(V.SQL_GRANTS)

# ---------------------------------------------------------------- C: joins


@query("match_roots", GRANTS + " SELECT root_id, object_ref FROM matched")
def match_roots(spark, d):
    return routing.match_roots(V.roots(spark, d), V.grants(spark, d)).select("root_id", "object_ref")


@query("roots_preview", GRANTS + """
SELECT root_id, object_ref, mount_point || CASE WHEN subpath_scope = '/' THEN '' ELSE subpath_scope END AS monitor_path FROM matched
UNION ALL SELECT id, NULL, NULL FROM roots WHERE id NOT IN (SELECT root_id FROM matched)""")
def roots_preview(spark, d):
    matched, unmatched = routing.preview_roots(V.roots(spark, d), V.grants(spark, d))
    return matched.select("root_id", "object_ref", "monitor_path").unionByName(unmatched, allowMissingColumns=True)


def odd_roots(spark, d):
    """Root declarations with mistakes, one per supplier."""
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(
        F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("r"), (k % 60).cast("string"))).alias("id"),
        F.struct(
            F.when(k % 4 == 0, F.lit("mnt")).when(k % 4 == 1, F.lit("/mnt")).alias("mount_point"),
            F.when(k % 6 == 2, F.lit("nfs")).alias("fs_source"), F.lit(None).cast("string").alias("fs_type"),
            F.lit(None).cast("string").alias("host_ip"), F.lit(None).cast("string").alias("host_ref"),
        ).alias("selector"),
        F.when(k % 5 == 0, F.lit("data")).otherwise(F.lit("/")).alias("subpath_scope"), (k % 3 > 0).alias("watch"), (k % 2 > 0).alias("scan"),
    )


@query("validate_roots", """
WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE 'r' || (s_suppkey % 60) END AS id FROM supplier)
SELECT id AS root_id, error, count(*) AS n FROM (
  SELECT id, 'empty id' AS error FROM r WHERE trim(id) = '' UNION ALL
  SELECT id, 'duplicate id' FROM (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM r) WHERE c > 1 UNION ALL
  SELECT id, 'empty selector' FROM r WHERE k % 4 > 1 AND k % 6 <> 2 UNION ALL
  SELECT id, 'relative mount point' FROM r WHERE k % 4 = 0 UNION ALL
  SELECT id, 'relative subpath scope' FROM r WHERE k % 5 = 0 UNION ALL
  SELECT id, 'neither watch nor scan' FROM r WHERE k % 3 = 0 AND k % 2 = 0) GROUP BY 1, 2""")
def validate_roots(spark, d):
    return routing.validate_roots(odd_roots(spark, d)).groupBy("root_id", "error").agg(F.count("*").alias("n"))


@query("elect_primary", GRANTS + """
SELECT root_id, coalesce(min(CASE WHEN active THEN object_ref END), min(object_ref)) AS primary_object_ref FROM matched GROUP BY root_id""")
def elect_primary(spark, d):
    return routing.elect_primary(V.roots(spark, d), V.grants(spark, d))


@query("elect_sink_primary", GRANTS + """
SELECT r.id AS root_id, coalesce(p, r.id) AS primary_object_ref FROM roots r LEFT JOIN (
  SELECT root_id, coalesce(min(CASE WHEN active AND object_ref <> root_id THEN object_ref END), min(CASE WHEN object_ref <> root_id THEN object_ref END),
    min(object_ref)) AS p FROM matched GROUP BY root_id) ON root_id = r.id""")
def elect_sink_primary(spark, d):
    return routing.elect_primary(V.roots(spark, d), V.grants(spark, d), skip_own_id=True)


@query("member_fan_out", GRANTS + " SELECT DISTINCT r.id AS root_id, object_ref, active FROM roots r LEFT JOIN matched m ON m.root_id = r.id")
def member_fan_out(spark, d):
    return routing.fan_out(V.roots(spark, d), V.grants(spark, d))


@query("event_routes", GRANTS + """
SELECT object_ref, max(root_id) AS group_id FROM matched GROUP BY 1
UNION ALL SELECT id, id FROM roots WHERE id NOT IN (SELECT object_ref FROM matched)""")
def event_routes(spark, d):
    return routing.event_routes(V.roots(spark, d), V.grants(spark, d))


def routes(spark, d):
    """Origins of the log that are routed; host h4 is unknown."""
    members = V.base_log(spark, d).select("origin_id", "group_id").distinct().where(~F.col("origin_id").startswith("h4"))
    prim = V.primaries(V.base_log(spark, d)).withColumnRenamed("group_id", "root_id")
    return members.withColumnRenamed("origin_id", "object_ref"), prim


@query("route_events", BASE + """
, p AS (SELECT group_id, min(origin_id) AS po FROM base GROUP BY 1)
SELECT seq, CASE WHEN starts_with(origin_id, 'h4') THEN NULL ELSE group_id END AS group_id, NOT starts_with(origin_id, 'h4') AND origin_id = po AS is_primary
FROM base JOIN p USING (group_id)""")
def route_events(spark, d):
    good, lost = routing.route_events(V.base_log(spark, d), *routes(spark, d))
    return good.select("seq", "group_id", "is_primary").unionByName(lost.select("seq", "group_id", "is_primary"))


def probes(spark, d):
    """Records later than the state they are checked against; only scan records can be rejected."""
    return V.base_log(spark, d).withColumn("path", F.concat("path", F.when(F.col("seq") % 2 == 0, F.lit("/new")).otherwise(F.lit("")))) \
        .withColumn("parent_path", P.parent_path("path")).withColumn("parent_mtime_us", F.when(F.col("seq") % 3 > 0, F.col("mtime_us")).otherwise(F.lit(0)))


PROBES = STATE + f""",
probe0 AS (SELECT * REPLACE (path || CASE WHEN seq % 2 = 0 THEN '/new' ELSE '' END AS path) FROM base),
probe AS (SELECT *, {parent('path')} AS parent_path, CASE WHEN seq % 3 > 0 THEN mtime_us ELSE 0 END AS parent_mtime_us FROM probe0)"""


@query("tombstoned_ancestor_reject", PROBES + f"""
SELECT seq FROM probe p WHERE p.source <> 'Scan' OR NOT EXISTS (
  SELECT 1 FROM (SELECT group_id AS g, seq AS s, unnest({ancestors('path')}) AS a FROM probe) x JOIN st ON st.group_id = x.g AND st.path = x.a AND st.is_tombstoned
  WHERE x.s = p.seq)""")
def tombstoned_ancestor_reject(spark, d):
    return A.reject_below_tombstones(probes(spark, d), V.winner_state(spark, d)).select("seq")


@query("stale_parent_reject", PROBES + """
SELECT p.seq FROM probe p LEFT JOIN st own ON own.group_id = p.group_id AND own.path = p.path
LEFT JOIN st par ON par.group_id = p.group_id AND par.path = p.parent_path
WHERE NOT (p.source = 'Scan' AND own.path IS NULL AND p.event_kind = 'Update' AND p.parent_mtime_us > 0 AND coalesce(p.parent_mtime_us < par.modified_time_us, false))""")
def stale_parent_reject(spark, d):
    return A.reject_stale_parents(probes(spark, d), V.winner_state(spark, d)).select("seq")


@query("audit_skip_cover", STATE + f""",
sk AS (SELECT group_id, path FROM st WHERE is_dir AND NOT is_tombstoned)
SELECT group_id, path FROM st WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT group_id AS g, path AS p, unnest({lineage('path')}) AS a FROM st) x JOIN sk ON sk.group_id = x.g AND sk.path = x.a
  WHERE x.g = st.group_id AND x.p = st.path)""")
def audit_skip_cover(spark, d):
    state = V.winner_state(spark, d)
    return A.not_covered(state, state.where("is_dir and not is_tombstoned")).select("group_id", "path")


@query("subtree_expansion", LISTING + f"""
SELECT group_id, path, {name_of('path')} AS file_name, is_dir, size, mtime_us FROM listing
WHERE (starts_with(path, '/src1/') AND group_id = 'd0') OR (starts_with(path, '/src2/en/'))""")
def subtree_expansion(spark, d):
    rows = V.listing(spark, d)
    new = rows.where("(group_id = 'd0' and path = '/src1') or path = '/src2/en' or (group_id = 'd0' and path = '/src1/fr')")
    return L.expand_subtrees(rows, new.where("is_dir")).select("group_id", "path", "file_name", "is_dir", "size", "mtime_us")


def previous_audit(spark, d):
    """Last audit of the same listing: some directories had other times or children."""
    old = V.listing(spark, d).where("is_dir or mtime_us % 5 <> 1 or group_id = 'd1'")
    seen = L.audit_decisions(old, spark.createDataFrame([], "group_id string, dir string, mtime_us long, fingerprint long, last_deep_round int"), 1)
    n = F.length("dir")
    return seen.where(~F.col("dir").startswith("/src9")).withColumn(
        "mtime_us", F.when(F.col("dir").endswith("fr"), F.col("mtime_us") + 5).otherwise(F.col("mtime_us"))
    ).withColumn("last_deep_round", F.when(n == 1, F.lit(1)).otherwise(F.lit(20)).cast("int"))


@query("audit_decisions", LISTING + f""",
kids AS (SELECT group_id, {parent('path')} AS dir, sum(CASE WHEN NOT is_dir AND mtime_us % 5 = 1 AND group_id = 'd0' THEN 1 ELSE 0 END) AS gone FROM listing GROUP BY 1, 2)
SELECT l.group_id, l.path AS dir, starts_with(l.path, '/src9') OR ends_with(l.path, 'fr') OR coalesce(gone, 0) > 0 OR length(l.path) = 1 AS deep
FROM listing l LEFT JOIN kids k ON k.group_id = l.group_id AND k.dir = l.path WHERE l.is_dir""")
def audit_decisions(spark, d):
    return L.audit_decisions(V.listing(spark, d), previous_audit(spark, d), 26).select("group_id", "dir", "deep")


@query("audit_scan", LISTING + f""",
kids AS (SELECT group_id, {parent('path')} AS dir, sum(CASE WHEN NOT is_dir AND mtime_us % 5 = 1 AND group_id = 'd0' THEN 1 ELSE 0 END) AS gone FROM listing GROUP BY 1, 2),
dec AS (SELECT l.group_id, l.path AS dir, starts_with(l.path, '/src9') OR ends_with(l.path, 'fr') OR coalesce(gone, 0) > 0 OR length(l.path) = 1 AS deep
  FROM listing l LEFT JOIN kids k ON k.group_id = l.group_id AND k.dir = l.path WHERE l.is_dir)
SELECT l.group_id, l.path, l.is_dir AND NOT deep AS audit_skipped FROM listing l
JOIN dec ON dec.group_id = l.group_id AND dec.dir = CASE WHEN l.is_dir THEN l.path ELSE {parent('l.path')} END WHERE l.is_dir OR deep""")
def audit_scan(spark, d):
    rows = V.listing(spark, d)
    return L.audit_scan(rows, L.audit_decisions(rows, previous_audit(spark, d), 26)).select("group_id", "path", "audit_skipped")


@query("loop_removal", LISTING + f""",
di AS (SELECT *, CASE WHEN NOT is_dir THEN mtime_us WHEN length(path) > 6 AND length(path) % 2 = 0 THEN 7 ELSE NULL END AS ino FROM listing),
first AS (SELECT group_id, path, row_number() OVER (PARTITION BY group_id, ino ORDER BY string_split(path, '/')) AS n FROM di WHERE is_dir AND ino IS NOT NULL),
again AS (SELECT group_id, path FROM first WHERE n > 1)
SELECT group_id, path FROM di WHERE NOT EXISTS (
  SELECT 1 FROM again a WHERE a.group_id = di.group_id AND (a.path = di.path OR starts_with(di.path, a.path || '/')))""")
def loop_removal(spark, d):
    n = F.length("path")
    rows = V.listing(spark, d).withColumn("dev", F.lit(1).cast("long")).withColumn(
        "ino", F.when(~F.col("is_dir"), F.col("mtime_us")).when((n > 6) & (n % 2 == 0), F.lit(7)).cast("long")
    )
    return L.drop_loops(rows).select("group_id", "path")


@query("endpoint_gate", with_(V.SQL_OBJECTS) + """
SELECT key, bucket, CASE WHEN object_ref = 'ep-3' THEN 'unknown endpoint' WHEN object_ref = 'ep-2' THEN 'inactive endpoint'
    WHEN NOT starts_with(bucket, 'm.') AND object_ref = 'ep-0' THEN 'bucket out of scope'
    WHEN object_ref = 'ep-1' AND NOT ends_with(bucket, '.com') THEN 'bucket out of scope'
    WHEN object_ref = 'ep-1' AND NOT starts_with(key, 'en') THEN 'prefix out of scope' END AS denied_reason FROM objs""")
def endpoint_gate(spark, d):
    objs = V.objects(spark, d)
    eps = objs.select("object_ref").distinct()
    ref = F.col("object_ref")
    scopes = lambda *v: F.array(*[F.lit(x) for x in v])
    products = eps.where(ref != "ep-3").select(
        ref, (ref != "ep-2").alias("active"), scopes("*.com").alias("bucket_scopes"),
        F.when(ref == "ep-1", scopes("en*")).otherwise(scopes("*")).alias("prefix_scopes"),
    )
    none = F.array().cast("array<string>")
    grants = eps.select(
        ref, F.lit(True).alias("active"), F.when(ref == "ep-0", scopes("m.*")).otherwise(none).alias("bucket_scopes"), none.alias("prefix_scopes")
    )
    asked = objs.select("object_ref", "bucket", F.col("key").alias("prefix"))
    return routing.gate_requests(asked, products, grants, ["bucket", "prefix"]).select(
        F.col("prefix").alias("key"), "bucket", "denied_reason"
    )


@query("group_keys", GRANTS + """
SELECT o_orderkey, coalesce(mount_point, ref) AS group_key FROM (SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS ref FROM orders)
LEFT JOIN grants ON object_ref = ref""")
def group_keys(spark, d):
    rows = V.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("object_ref")
    )
    return routing.group_keys(rows, V.grants(spark, d), "mount-point").select("o_orderkey", "group_key")


# ---------------------------------------------------------------- D: aggregations

AGG = """count(*) AS total_nodes, count(*) FILTER (NOT is_dir) AS total_files, count(*) FILTER (is_dir) AS total_dirs,
  CAST(coalesce(sum(size) FILTER (NOT is_dir), 0) AS BIGINT) AS total_size, max(modified_time_us) FILTER (NOT is_dir) AS latest_file_mtime_us,
  count(*) FILTER (monitoring_attested) AS attested_count, count(*) FILTER (blind_spot) AS blind_spot_count"""


@query("rollup_tree", STATE + f"""
SELECT group_id, dir, {AGG} FROM (
  SELECT *, unnest({ancestors('path')}) AS dir FROM live UNION ALL SELECT *, path FROM live WHERE is_dir) GROUP BY group_id, dir""")
def rollup_tree(spark, d):
    return U.rollup_tree(V.winner_state(spark, d))


def two_versions(spark, d):
    """A store with a state before (some rows missing, others older, newer, or dropped since) and the present one."""
    state = V.winner_state(spark, d)
    n = F.pmod(F.crc32(F.encode(F.concat("group_id", "path"), "UTF-8")), F.lit(7))
    older = state.where(n != 0).withColumns({
        "modified_time_us": F.when(n == 1, F.col("modified_time_us") + 10**9).when(n == 2, F.col("modified_time_us") - 10**9).otherwise(F.col("modified_time_us")),
        "size": F.when(n == 3, F.col("size") + 5).otherwise(F.col("size")),
        "is_tombstoned": F.when(n == 4, ~F.col("is_tombstoned")).otherwise(F.col("is_tombstoned")),
    })
    extra = state.where(n == 5).withColumn("path", F.concat("path", F.lit("-gone")))
    groups = A.initial_groups(V.primaries(V.base_log(spark, d)))
    store = StateStore(spark, fresh_path(spark, "two-versions"))
    store.write(older.unionByName(extra), groups, None, 0)
    store.write(state, groups, None, 1)
    return store


@query("rollup_refresh", STATE + f"""
SELECT group_id, dir, {AGG} FROM (
  SELECT *, unnest({ancestors('path')}) AS dir FROM live UNION ALL SELECT *, path FROM live WHERE is_dir) GROUP BY group_id, dir""")
def rollup_refresh(spark, d):
    """The stored aggregates after a second batch equal those of the whole state."""
    return two_versions(spark, d).rollup()


def stats_sql(q: str) -> str:
    return STATE + f""",
known AS (SELECT DISTINCT group_id FROM st WHERE {under('path', q)}),
moved AS (SELECT *, {rebase('path', q)} AS np FROM live WHERE group_id NOT IN (SELECT group_id FROM known)),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, np ORDER BY string_split(path, '/') DESC) AS k FROM moved WHERE np IS NOT NULL) WHERE k = 1),
own AS (SELECT group_id, modified_time_us AS m FROM live WHERE path = '{q}' AND NOT is_dir),
mx AS (SELECT group_id, max(modified_time_us) AS m FROM live WHERE {under('path', q)} AND NOT is_dir GROUP BY 1),
direct AS (SELECT group_id, {AGG} FROM live WHERE {under('path', q)} AND path <> '{q}' GROUP BY group_id),
joined AS (SELECT * FROM direct UNION ALL SELECT group_id, {AGG} FROM rb GROUP BY group_id)
SELECT g.group_id, coalesce(total_nodes, 0) AS total_nodes, coalesce(total_files, 0) AS total_files, coalesce(total_dirs, 0) AS total_dirs,
  coalesce(total_size, 0) AS total_size,
  CASE WHEN own.m IS NOT NULL AND own.m = mx.m THEN NULL ELSE latest_file_mtime_us END AS latest_file_mtime_us,
  coalesce(attested_count, 0) AS attested_count, coalesce(blind_spot_count, 0) AS blind_spot_count
FROM (SELECT DISTINCT group_id FROM st) g LEFT JOIN joined USING (group_id) LEFT JOIN own USING (group_id) LEFT JOIN mx USING (group_id)"""


@query("subtree_stats", stats_sql("/u3/d5"))
def subtree_stats(spark, d):
    return U.subtree_stats(V.winner_state(spark, d), "/u3/d5")


@query("stored_subtree_stats", stats_sql("/u3"))
def stored_subtree_stats(spark, d):
    """The same answer from one stored head for each group that knows the path."""
    store = two_versions(spark, d)
    return H.subtree_stats(store.heads(), store.read()[0], "/u3")


@query("subtree_stats_of_a_file", stats_sql("/u3/d5/f1"))
def subtree_stats_of_a_file(spark, d):
    return U.subtree_stats(V.winner_state(spark, d), "/u3/d5/f1")


HEALTH = f"""
health AS (SELECT group_id, count(*) FILTER (NOT is_tombstoned AND path <> '/') AS live_nodes, count(*) FILTER (is_tombstoned) AS tombstoned_count,
  count(*) FILTER (NOT is_tombstoned AND path <> '/' AND monitoring_attested) AS attested_count,
  count(*) FILTER (NOT is_tombstoned AND coalesce({NOW} < suspect_until_us, false)) AS suspect_count,
  count(*) FILTER (NOT is_tombstoned AND path <> '/' AND blind_spot) AS blind_spot_count, count(*) AS total_nodes FROM st GROUP BY group_id)"""


@query("stored_health_stats", STATE + "," + HEALTH + " SELECT * FROM health")
def stored_health_stats(spark, d):
    """The same counters from the heads of the roots."""
    store = two_versions(spark, d)
    return H.health_stats(store.heads(), store.read()[0], NOW)


@query("health_stats", STATE + "," + HEALTH + " SELECT * FROM health")
def health_stats(spark, d):
    return U.health_stats(V.winner_state(spark, d), NOW)


STATUS = STATE + "," + HEALTH + "," + V.SQL_GROUPS + f""",
stat AS (SELECT group_id, primary_object_ref, live_nodes, tombstoned_count, attested_count, suspect_count, blind_spot_count, total_nodes,
  clock_us AS shadow_time_us, greatest({NOW} - clock_us, 0) AS shadow_lag_us, overflow_pending,
  CASE WHEN NOT audited THEN 'pending_materialization' WHEN live_nodes > 0 THEN 'ready' ELSE 'waiting_for_materialized_root' END AS readiness, revision
  FROM grp JOIN health USING (group_id))"""


def status(spark, d):
    return T.group_status(V.winner_state(spark, d), V.winner_groups(spark, d), NOW)


@query("group_status", STATUS + " SELECT * FROM stat")
def group_status(spark, d):
    return status(spark, d)


@query("fleet_totals", STATUS + """
SELECT CAST(sum(live_nodes) AS BIGINT) AS live_nodes, CAST(sum(tombstoned_count) AS BIGINT) AS tombstoned_count, CAST(sum(attested_count) AS BIGINT) AS attested_count,
  CAST(sum(suspect_count) AS BIGINT) AS suspect_count, CAST(sum(blind_spot_count) AS BIGINT) AS blind_spot_count, max(shadow_time_us) AS shadow_time_us, count(*) AS groups FROM stat""")
def fleet_totals(spark, d):
    return U.fleet_totals(status(spark, d))


CODE = f"CASE WHEN blind_spot THEN 2 WHEN coalesce({NOW} < suspect_until_us, false) THEN 1 WHEN NOT monitoring_attested THEN 0 END"
REASON = "['Unattested', 'SuspectNodes', 'BlindSpotsDetected', 'WatchOverflowPendingMaterialization']"


@query("node_set_reliability", STATE + f"""
SELECT dir, max({CODE}) IS NULL AS reliable, {REASON}[max({CODE}) + 1] AS unreliable_reason FROM (SELECT *, {parent('path')} AS dir FROM live) GROUP BY dir""")
def node_set_reliability(spark, d):
    nodes = Q.list_nodes(V.winner_state(spark, d), "/", NOW).withColumn("dir", P.parent_path("path"))
    return Q.node_set_reliability(nodes, "dir")


@query("quiet_anchor", STATE + """,
k AS (SELECT group_id, count(*) FILTER (path = '/u3/d5') AS own, max(subtree_changed_at_us) FILTER (path = '/u3/d5') AS o,
  max(subtree_changed_at_us) FILTER (starts_with(path, '/u3/d5/')) AS b FROM st WHERE path = '/u3/d5' OR starts_with(path, '/u3/d5/') GROUP BY 1)
SELECT group_id, CASE WHEN own > 0 THEN o ELSE b END AS quiet_anchor_us FROM k""")
def quiet_anchor(spark, d):
    return U.quiet_anchor(V.winner_state(spark, d), "/u3/d5")


@query("directory_fingerprints", LISTING + f"""
SELECT group_id, {parent('path')} AS dir, count(*) AS entries, count(*) FILTER (is_dir) AS dirs, count(*) FILTER (NOT is_dir) AS files
FROM listing WHERE path <> '/' GROUP BY 1, 2""")
def directory_fingerprints(spark, d):
    return U.directory_fingerprints(V.listing(spark, d)).select("group_id", "dir", "entries", "dirs", "files")


FRESH = BASE + f""",
moved AS (SELECT *, {rebase('path', '/u3')} AS np FROM base),
win AS (SELECT origin_id, np AS path, size, mtime_us AS modified_time_us, is_dir FROM (
  SELECT *, row_number() OVER (PARTITION BY origin_id, np ORDER BY mtime_us DESC, event_kind = 'Delete' DESC, seq) AS n FROM moved WHERE np IS NOT NULL)
  WHERE n = 1 AND event_kind <> 'Delete'),
fresh AS (SELECT *, true AS monitoring_attested, false AS blind_spot FROM win)"""


@query("fresh_find", FRESH + f" SELECT origin_id, path, {name_of('path')} AS file_name, size, modified_time_us, is_dir FROM win")
def fresh_find(spark, d):
    return Q.fresh_find(V.base_log(spark, d), "/u3").select("origin_id", "path", "file_name", "size", "modified_time_us", "is_dir")


@query("fresh_stats", FRESH + f" SELECT origin_id, {AGG} FROM fresh GROUP BY 1")
def fresh_stats(spark, d):
    return U.fresh_stats(Q.fresh_find(V.base_log(spark, d), "/u3"), ["origin_id"])


def by_group(spark, d):
    stats = U.fresh_stats(Q.fresh_find(V.base_log(spark, d), "/u3"), ["origin_id"])
    return stats.withColumn("group_id", F.split_part("origin_id", F.lit("::"), F.lit(2)))


@query("fresh_ranked_stats", FRESH + f"""
SELECT origin_id, total_files, total_size, row_number() OVER (ORDER BY total_files DESC, origin_id) AS rank FROM (SELECT origin_id, {AGG} FROM fresh GROUP BY 1)""")
def fresh_ranked_stats(spark, d):
    stats = U.fresh_stats(Q.fresh_find(V.base_log(spark, d), "/u3"), ["origin_id"]).withColumnRenamed("origin_id", "group_id")
    ranks = G.rank_groups(stats.select("group_id"), stats, "file-count")
    return stats.join(ranks, "group_id").select(
        F.col("group_id").alias("origin_id"), "total_files", "total_size", F.col("rank").cast("long").alias("rank")
    )


@query("probe_metrics", FRESH + f"""
, s AS (SELECT string_split(origin_id, '::')[2] AS group_id, {AGG} FROM fresh GROUP BY origin_id)
SELECT group_id, max(total_files) AS files, max(latest_file_mtime_us) AS newest FROM s GROUP BY 1""")
def probe_metrics(spark, d):
    rows = by_group(spark, d)
    a = U.probe_metric(rows, "file-count").withColumnRenamed("metric", "files")
    return a.join(U.probe_metric(rows, "file-age").withColumnRenamed("metric", "newest"), "group_id")


@query("apply_counters", BASE + """
SELECT origin_id, group_id, count(*) AS accepted, count(*) FILTER (seq % 50 = 0) AS control, count(*) FILTER (seq % 50 > 0) AS data, max(timestamp_us) AS last_received_us FROM base GROUP BY 1, 2""")
def apply_counters(spark, d):
    log = V.base_log(spark, d).withColumn("rec_type", F.when(F.col("seq") % 50 == 0, F.lit(S.WATCH_OVERFLOW)).otherwise(F.lit(S.DATA)))
    return A.apply_counters(log).select(
        "origin_id", "group_id", "accepted", F.col("control").cast("long"), F.col("data").cast("long"), "last_received_us"
    )


@query("merge_reports", """
SELECT 'n' || (s_nationkey % 4) AS node, 'g' || (s_suppkey % 6) AS group_id, arg_max(s_acctbal, s_suppkey) AS live_nodes, count(*) AS reporters FROM supplier GROUP BY 1, 2""")
def merge_reports(spark, d):
    rows = V.table(spark, d, "supplier").select(
        F.concat(F.lit("n"), (F.col("s_nationkey") % 4).cast("string")).alias("node"),
        F.concat(F.lit("g"), (F.col("s_suppkey") % 6).cast("string")).alias("group_id"), F.col("s_suppkey").alias("reported_at_us"),
        F.col("s_acctbal").alias("live_nodes"),
    )
    return T.merge_reports(rows)


@query("live_parents", STATE + f" SELECT DISTINCT group_id, {parent('path')} AS path FROM live WHERE path <> '/'")
def live_parents(spark, d):
    return U.live_parents(V.winner_state(spark, d))


def schedule(spark, d):
    """Groups scheduled on nodes; one of them has no status row."""
    group = F.when(F.col("seq") % 500 == 0, F.lit("g9")).otherwise(F.col("group_id"))
    return V.base_log(spark, d).select(group.alias("group_id")).distinct()


READY = STATUS + """,
sched AS (SELECT DISTINCT CASE WHEN seq % 500 = 0 THEN 'g9' ELSE group_id END AS group_id FROM base),
cls AS (SELECT s.group_id, CASE WHEN readiness IS NULL THEN 'missing'
    WHEN readiness = 'ready' AND NOT overflow_pending AND (live_nodes > 0 OR total_nodes > 0) AND primary_object_ref <> s.group_id THEN 'ready'
    WHEN readiness = 'waiting_for_materialized_root' THEN 'waiting' WHEN readiness = 'pending_materialization' THEN 'pending' ELSE 'blocked' END AS readiness_class
  FROM sched s LEFT JOIN stat USING (group_id))"""


@query("readiness_classes", READY + " SELECT * FROM cls")
def readiness_classes(spark, d):
    return T.readiness_classes(status(spark, d), schedule(spark, d))


@query("readiness_concern", READY + """
SELECT count(*) AS scheduled, count(*) FILTER (readiness_class = 'ready') AS ready, count(*) FILTER (readiness_class = 'waiting') AS waiting,
  count(*) FILTER (readiness_class = 'pending') AS pending, count(*) FILTER (readiness_class = 'missing') AS missing, 'coverage_gap' AS concern FROM cls""")
def readiness_concern(spark, d):
    rows, sched = status(spark, d), schedule(spark, d)
    return T.readiness_concern(T.readiness_classes(rows, sched), rows, sched, sched, True)


# ---------------------------------------------------------------- E: ordered state, the parts SQL can state

FOLD = with_(V.SQL_FOLD)


@query("shadow_clock", BASE + " SELECT group_id, seq, max(timestamp_us) OVER (PARTITION BY group_id ORDER BY seq) AS clock_us FROM base")
def shadow_clock(spark, d):
    return running_max(V.base_log(spark, d), ["group_id"], "seq", "timestamp_us", "clock_us").select("group_id", "seq", "clock_us")


@query("logical_clock", BASE + " SELECT origin_id, seq, row_number() OVER (PARTITION BY origin_id ORDER BY seq) AS logical_ts FROM base")
def logical_clock(spark, d):
    return number_rows(V.base_log(spark, d), ["origin_id"], "seq", "logical_ts").select("origin_id", "seq", "logical_ts")


@query("epoch_tracking", FOLD + """,
pts AS (SELECT group_id, seq, CASE WHEN rec_type = 'epoch_start' THEN epoch_id ELSE sum(CASE WHEN rec_type = 'epoch_end' THEN 1 ELSE 0 END)
  OVER (PARTITION BY group_id ORDER BY seq) END AS epoch FROM foldlog WHERE rec_type IN ('epoch_start', 'epoch_end'))
SELECT f.group_id, f.seq, CAST(coalesce(p.epoch, 0) AS BIGINT) AS epoch FROM (SELECT * FROM foldlog WHERE rec_type = 'data') f ASOF LEFT JOIN pts p ON f.group_id = p.group_id AND f.seq > p.seq""")
def epoch_tracking(spark, d):
    log = V.fold_log(spark, d)
    groups = A.initial_groups(V.primaries(V.base_log(spark, d)))
    data = log.where("rec_type = 'data'").withColumn("_epoch0", F.lit(0).cast("long"))
    return A.with_epoch(data, A.control_points(log, groups)).select("group_id", "seq", "epoch")


@query("overflow_marker", FOLD + """,
o AS (SELECT f.group_id, f.seq, f.arrival_us, rec_type = 'epoch_end' AS e FROM foldlog f WHERE rec_type IN ('epoch_end', 'watch_overflow')),
l AS (SELECT *, lag(e) OVER (PARTITION BY group_id ORDER BY seq) AS pe FROM o)
SELECT group_id, NOT arg_max(e, seq) AS overflow_pending, max(CASE WHEN e AND NOT pe THEN arrival_us END) AS recovered_at_us,
  count(*) FILTER (e AND NOT pe) AS recoveries FROM l GROUP BY 1""")
def overflow_marker(spark, d):
    log = V.fold_log(spark, d)
    rows = A.coverage_changes(log, A.initial_groups(V.primaries(V.base_log(spark, d))))
    return rows.select(
        "group_id", F.col("_overflow").alias("overflow_pending"), F.col("_recovered").alias("recovered_at_us"), F.col("_recoveries").cast("long").alias("recoveries")
    )


@query("missing_items", STATE + f""",
sk AS (SELECT group_id, path FROM st WHERE is_dir AND last_seen_epoch = 1)
SELECT group_id, path FROM live WHERE last_seen_epoch < 2 AND NOT coalesce(last_confirmed_at_us > {NOW}, false) AND NOT EXISTS (
  SELECT 1 FROM sk WHERE sk.group_id = live.group_id AND (sk.path = live.path OR starts_with(live.path, sk.path || '/')))""")
def missing_items(spark, d):
    state = V.winner_state(spark, d)
    return A.missing_items(state, 2, NOW, state.where("is_dir and last_seen_epoch = 1")).select("group_id", "path")


@query("collect_tombstones", STATE + f" SELECT group_id, path FROM st WHERE NOT (is_tombstoned AND (tombstone_expires_at_us IS NULL OR tombstone_expires_at_us <= {NOW}))")
def collect_tombstones(spark, d):
    return A.collect_tombstones(V.winner_state(spark, d), NOW).select("group_id", "path")


@query("change_stamps", with_(SQL_OUT) + f"""
SELECT group_id, path, arg_max(arrival_us, seq) AS changed_us FROM (SELECT group_id, unnest({lineage('path')}) AS path, arrival_us, seq FROM outc WHERE stamps) GROUP BY 1, 2""")
def change_stamps(spark, d):
    return A.change_stamps(outcome_rows(spark, d))


@query("generation_fence", """
SELECT o_orderkey, o_custkey FROM (SELECT *, max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders)
WHERE b IS NULL OR o_custkey > b""")
def generation_fence(spark, d):
    rows = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return routing.accepted_generations(rows, "o_orderkey", "o_custkey")


@query("apply_roots", GRANTS + """,
held AS (SELECT DISTINCT host_ref AS group_id FROM grants WHERE host_ref NOT LIKE '%7'),
new AS (SELECT * FROM roots WHERE id NOT LIKE '%3' AND id NOT LIKE '%4'),
allowed AS (SELECT id FROM new WHERE id NOT LIKE '%6'),
moved AS (SELECT DISTINCT host_ref AS group_id FROM grants WHERE object_ref IN (SELECT object_ref FROM matched WHERE root_id IN (SELECT id FROM allowed))),
names AS (SELECT id AS group_id FROM new UNION SELECT group_id FROM held)
SELECT n.group_id, CASE
    WHEN w.id IS NOT NULL AND n.group_id IN (SELECT id FROM allowed) AND n.group_id LIKE 'NATION_1%' THEN 'reset'
    WHEN w.id IS NOT NULL AND n.group_id IN (SELECT id FROM allowed) AND n.group_id IN (SELECT group_id FROM held) THEN 'kept'
    WHEN w.id IS NOT NULL AND n.group_id IN (SELECT id FROM allowed) THEN 'new'
    WHEN w.id IS NOT NULL AND n.group_id NOT LIKE 'NATION_1%' AND n.group_id IN (SELECT group_id FROM held) THEN 'retained'
    WHEN w.id IS NULL AND n.group_id NOT IN (SELECT group_id FROM moved) THEN 'retained' ELSE 'dropped' END AS fate
FROM names n LEFT JOIN new w ON w.id = n.group_id""")
def apply_roots(spark, d):
    roots, grants = V.roots(spark, d), V.grants(spark, d)
    old = roots.withColumn("subpath_scope", F.when(F.col("id").startswith("NATION_1"), F.lit("/old")).otherwise(F.col("subpath_scope")))
    new = roots.where("id not like '%3' and id not like '%4'")
    held = grants.where("host_ref not like '%7'").select(F.col("host_ref").alias("group_id"))
    old_routes = grants.select("object_ref", F.col("host_ref").alias("group_id"))
    allowed = new.where("id not like '%6'").select(F.col("id").alias("group_id"))
    return routing.apply_roots(held, old, new, grants, old_routes, allowed).select("group_id", "fate")


# ---------------------------------------------------------------- F: order and pages


@query("preorder_positions", STATE + " SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY string_split(path, '/')) AS pos FROM live")
def preorder_positions(spark, d):
    keyed = U.live(V.winner_state(spark, d)).select("group_id", "path", P.preorder_key("path").alias("_k"))
    return number_rows(keyed, ["group_id"], "_k", "pos").select("group_id", "path", "pos")


@query("length_then_path", FRESH + " SELECT origin_id, path, length(path) AS n FROM win ORDER BY length(path), path, origin_id LIMIT 100")
def length_then_path(spark, d):
    rows = Q.fresh_find(V.base_log(spark, d), "/u3").select("origin_id", "path", F.length("path").cast("long").alias("n"))
    return G.entry_page(rows, [F.col("n"), F.col("path"), F.col("origin_id")], 100)


@query("entry_page", STATE + """
SELECT group_id, path FROM live ORDER BY group_id, string_split(path, '/') LIMIT 50 OFFSET 20""")
def entry_page(spark, d):
    rows = U.live(V.winner_state(spark, d)).select("group_id", "path")
    return G.entry_page(rows, [F.col("group_id"), P.preorder_key("path")], 50, 20)


@query("entry_pages_per_group", STATE + """
SELECT group_id, path, position FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY path) AS position FROM live) WHERE position > 10 AND position <= 40""")
def entry_pages_per_group(spark, d):
    rows = G.top_per_group(U.live(V.winner_state(spark, d)), ["group_id"], [F.col("path")], 30, 10)
    return rows.select("group_id", "path", F.col("position").cast("long").alias("position"))


@query("frozen_entry_page", STATE + """
SELECT group_id, path, position FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY string_split(path, '/')) AS position FROM live) WHERE position > 100 AND position <= 130""")
def frozen_entry_page(spark, d):
    rows = U.live(V.winner_state(spark, d)).select("group_id", "path")
    pit = G.freeze_pages(rows, ["group_id"], P.preorder_key("path"))
    return G.page_of(G.read_pit(spark, pit), 30, 100)


@query("byte_budget_page", STATE + """
SELECT group_id, path FROM (SELECT *, sum(length('{"path":"' || path || '","size":' || size || ',"position":' || position || '}') + 1)
    OVER (PARTITION BY group_id ORDER BY position) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY path) AS position FROM live) WHERE position <= 40) WHERE b + 100 <= 1000""")
def byte_budget_page(spark, d):
    page = G.top_per_group(U.live(V.winner_state(spark, d)).select("group_id", "path", "size"), ["group_id"], [F.col("path")], 40)
    return G.require_fit(G.byte_budget_page(page, ["group_id"], "position", 1000, 100)).select("group_id", "path")


@query("rank_groups", STATE + f"""
, a AS (SELECT group_id, count(*) FILTER (NOT is_dir) AS f FROM live GROUP BY 1)
SELECT group_id, row_number() OVER (ORDER BY f DESC, group_id) AS rank FROM a""")
def rank_groups(spark, d):
    state = V.winner_state(spark, d)
    stats = U.subtree_stats(state, "/")
    return G.rank_groups(state.select("group_id").distinct(), stats, "file-count").select("group_id", F.col("rank").cast("long").alias("rank"))


@query("frozen_group_page", STATE + """
, a AS (SELECT group_id, max(modified_time_us) FILTER (NOT is_dir) AS f FROM live GROUP BY 1), r AS (SELECT group_id, row_number() OVER (ORDER BY f DESC, group_id) AS rank FROM a)
SELECT group_id, path, rank FROM live JOIN r USING (group_id) WHERE rank > 1 AND rank <= 3""")
def frozen_group_page(spark, d):
    state = V.winner_state(spark, d)
    ranks = G.rank_groups(state.select("group_id").distinct(), U.subtree_stats(state, "/"), "file-age")
    frozen = G.open_pit(U.live(state).select("group_id", "path").join(ranks.select("group_id", "rank"), "group_id"))
    return G.group_page(G.read_pit(spark, frozen), 2, 1).groups.select("group_id", "path", F.col("rank").cast("long").alias("rank"))


@query("keyset_cursor", with_(V.SQL_OBJECTS) + " SELECT key, last_modified_unix_ms FROM objs WHERE last_modified_unix_ms > 90000 OR (last_modified_unix_ms = 90000 AND key > 'en/')")
def keyset_cursor(spark, d):
    return G.after_cursor(V.objects(spark, d), ["last_modified_unix_ms", "key"], (90_000, "en/")).select("key", "last_modified_unix_ms")


# ---------------------------------------------------------------- G: user queries

TREE = STATE + "," + V.SQL_GROUPS + f""",
known AS (SELECT DISTINCT group_id FROM st WHERE {under('path', '/u3')}),
moved AS (SELECT *, {rebase('path', '/u3')} AS np FROM live WHERE group_id NOT IN (SELECT group_id FROM known)),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, np ORDER BY string_split(path, '/') DESC) AS k FROM moved WHERE np IS NOT NULL) WHERE k = 1),
dn AS (SELECT * FROM live WHERE {under('path', '/u3')}),
allrows AS (SELECT group_id, path, size, modified_time_us, is_dir, monitoring_attested, suspect_until_us, blind_spot, subtree_changed_at_us, 'direct' AS mode FROM dn
  UNION ALL SELECT group_id, np, size, modified_time_us, is_dir, monitoring_attested, suspect_until_us, blind_spot, subtree_changed_at_us, 'rebased' FROM rb),
kids AS (SELECT DISTINCT group_id, {parent('path')} AS path FROM allrows)"""


def tree(spark, d, **options):
    return Q.tree(V.winner_state(spark, d), V.winner_groups(spark, d), "/u3", as_of_us=NOW, **options)


@query("tree_entries", TREE + f"""
SELECT a.group_id, a.path, {depth('a.path', '/u3')} AS depth, size, modified_time_us, is_dir, (mode = 'rebased' OR is_dir) AND k.path IS NOT NULL AS has_children
FROM allrows a LEFT JOIN kids k ON k.group_id = a.group_id AND k.path = a.path WHERE a.path <> '/u3' AND {depth('a.path', '/u3')} <= 2""")
def tree_entries(spark, d):
    return tree(spark, d, max_depth=2).entries.drop("position")


@query("tree_entry_page", TREE + f"""
SELECT group_id, path, position FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN mode = 'direct' THEN replace(path, '/', chr(1)) ELSE path END) AS position
  FROM allrows WHERE path <> '/u3') WHERE position > 5 AND position <= 25""")
def tree_entry_page(spark, d):
    return tree(spark, d, offset=5, limit=20).entries.select("group_id", "path", F.col("position").cast("long").alias("position"))


HEADS = f"""
SELECT g.group_id, CASE WHEN kn.group_id IS NULL THEN 'rebased' ELSE 'direct' END AS mode, coalesce(n, 0) > 0 AS exists,
  EXISTS (SELECT 1 FROM kids k WHERE k.group_id = g.group_id AND k.path = '/u3') AS has_children,
  c IS NULL AS reliable, {REASON}[c + 1] AS unreliable_reason,
  CASE WHEN c = 1 THEN 'unstable' WHEN c IS NOT NULL OR overflow_pending THEN 'unknown' WHEN coalesce(quiet, 0) >= 5000 THEN 'stable' ELSE 'unstable' END AS stability_state,
  CAST(quiet AS BIGINT) AS observed_quiet_for_ms, array_to_string(list_filter([CASE WHEN overflow_pending THEN 'watch_overflow_pending_materialization' END,
    ['unattested_nodes', 'suspect_nodes', 'blind_spots_detected', 'watch_overflow_pending_materialization'][c + 1]], lambda x: x IS NOT NULL), ',') AS blocked
FROM (SELECT g.*, m.n, greatest(m.code, CASE WHEN g.overflow_pending THEN 3 END) AS c, CASE WHEN greatest(m.anchor, g.coverage_recovered_at_us) IS NOT NULL THEN greatest({NOW} - greatest(m.anchor, g.coverage_recovered_at_us), 0) // 1000 END AS quiet
  FROM grp g LEFT JOIN heads m USING (group_id)) g LEFT JOIN known kn ON kn.group_id = g.group_id"""


def head_columns(heads):
    return heads.select(
        "group_id", "mode", "exists", "has_children", "reliable", "unreliable_reason", "stability_state", "observed_quiet_for_ms",
        F.array_join("blocked_reasons", ",").alias("blocked"),
    )


@query("tree_heads", TREE + f""",
heads AS (SELECT group_id, count(*) AS n, max({CODE}) AS code,
  CASE WHEN max(mode) = 'rebased' OR count(*) FILTER (path = '/u3') = 0 THEN max(subtree_changed_at_us) ELSE max(subtree_changed_at_us) FILTER (path = '/u3') END AS anchor0
  FROM allrows GROUP BY 1),
anchors AS (SELECT group_id, max(subtree_changed_at_us) AS anchor FROM (SELECT * FROM st WHERE {under('path', '/u3')}) GROUP BY 1),
heads2 AS (SELECT h.group_id, n, code, coalesce(a.anchor, anchor0) AS anchor FROM heads h LEFT JOIN anchors a USING (group_id)) """ + HEADS.replace("heads m", "heads2 m"))
def tree_heads(spark, d):
    return head_columns(tree(spark, d).heads)


@query("tree_page_heads", TREE + f""",
pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN mode = 'direct' THEN replace(path, '/', chr(1)) ELSE path END) AS position
  FROM allrows WHERE path <> '/u3') WHERE position > 5 AND position <= 8),
heads AS (SELECT a.group_id, count(*) AS n, CASE WHEN max(mode) = 'rebased' THEN max({CODE}) ELSE greatest((SELECT max({CODE}) FROM pg WHERE pg.group_id = a.group_id),
    max(CASE WHEN NOT monitoring_attested THEN 0 END), max(CASE WHEN blind_spot THEN 2 END)) END AS code,
  CASE WHEN max(mode) = 'rebased' THEN max(subtree_changed_at_us) ELSE (SELECT max(subtree_changed_at_us) FROM pg WHERE pg.group_id = a.group_id) END AS anchor FROM allrows a GROUP BY 1) """ + HEADS)
def tree_page_heads(spark, d):
    return head_columns(tree(spark, d, offset=5, limit=3).heads)


@query("tree_request_pages", TREE + f""",
ranks AS (SELECT g.group_id, row_number() OVER (ORDER BY count(a.path) FILTER (NOT is_dir AND (mode = 'rebased' OR a.path <> '/u3')) DESC, g.group_id) AS rank
  FROM (SELECT DISTINCT group_id FROM st) g LEFT JOIN allrows a ON a.group_id = g.group_id GROUP BY g.group_id)
SELECT rank, group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN mode = 'direct' THEN string_split(path, '/') END, path) AS position
FROM allrows JOIN ranks USING (group_id) WHERE path <> '/u3'""")
def tree_request_pages(spark, d):
    """One request walked to its end: groups by file count in pages of two, entries in pages, as far as a byte budget goes."""
    from arborlake.plans.status_queries import statuses

    source, sink, schedule, _ = statuses(spark, d)
    store, secret = two_versions(spark, d), b"key of the service"
    request = B.TreeRequest("/u3", group_order="file-count", group_page_size=2, entry_page_size=10_000, limit_bytes=1 << 20, read_class="materialized")
    page = B.open_request(store, request, B.Evidence(source, sink, schedule), "query", secret, NOW)
    pages = [page.entries]
    while page.cursor:
        page = B.next_page(store, page.cursor, "query", secret)
        pages.append(page.entries)
    rows = reduce(lambda a, b: a.unionByName(b), pages)
    return rows.select(F.col("rank").cast("long").alias("rank"), "group_id", "path", F.col("position").cast("long").alias("position"))


@query("list_nodes", TREE + f"""
SELECT group_id, path, size, is_dir, monitoring_attested, coalesce({NOW} < suspect_until_us, false) AS is_suspect, blind_spot AS is_blind_spot FROM allrows WHERE {depth('path', '/u3')} <= 1""")
def list_nodes(spark, d):
    return Q.list_nodes(V.winner_state(spark, d), "/u3", NOW, recursive=False).select(
        "group_id", "path", "size", "is_dir", "monitoring_attested", "is_suspect", "is_blind_spot"
    )


def page_root_sql(q: str) -> str:
    """The root of a page at ``q``: its own rows, or in a group that does not know it the nodes that carry on from it."""
    return f"""
SELECT '{q}' AS asked, group_id, coalesce(max(size) FILTER (path = '{q}' AND alive), 0) AS size,
  coalesce(max(modified_time_us) FILTER (path = '{q}' AND alive), 0) AS modified_time_us,
  coalesce(bool_or(is_dir) FILTER (path = '{q}' AND alive), true) AS is_dir, count(*) FILTER (alive) > 0 AS exists,
  count(*) FILTER (alive AND {parent('path')} = '{q}') > 0 AS has_children
FROM (
  SELECT group_id, path, size, modified_time_us, is_dir, NOT is_tombstoned AS alive FROM st WHERE {under('path', q)}
  UNION ALL
  SELECT group_id, np, size, modified_time_us, is_dir, np IS NOT NULL FROM (
    SELECT g.group_id, m.np, m.size, m.modified_time_us, m.is_dir, row_number() OVER (PARTITION BY g.group_id, m.np ORDER BY string_split(m.path, '/') DESC) AS k
    FROM (SELECT DISTINCT group_id FROM st WHERE group_id NOT IN (SELECT group_id FROM st WHERE {under('path', q)})) g
    LEFT JOIN (SELECT *, {rebase('path', q)} AS np FROM live) m ON m.group_id = g.group_id AND m.np IS NOT NULL
  ) WHERE k = 1
) GROUP BY group_id"""


@query("page_roots", STATE + page_root_sql("/mnt") + " UNION ALL " + page_root_sql("/u3/d5"))
def page_roots(spark, d):
    """A placeholder and a real directory."""
    state = V.winner_state(spark, d)
    roots = [Q.page_roots(state, q).select(
        F.lit(q).alias("asked"), "group_id", "size", "modified_time_us", "is_dir", "exists", "has_children"
    ) for q in ("/mnt", "/u3/d5")]
    return roots[0].unionByName(roots[1])


@query("children", STATE + " SELECT group_id, path, is_dir FROM live WHERE starts_with(path, '/u3/d5/') AND strpos(substr(path, 8), '/') = 0")
def children(spark, d):
    return Q.children(V.winner_state(spark, d), "/u3/d5").select("group_id", "path", "is_dir")


@query("stats_envelopes", stats_sql("/u3/d5").replace("coalesce(blind_spot_count, 0) AS blind_spot_count", "CAST(0 AS BIGINT) AS blind_spot_count, 'ok' AS status"))
def stats_envelopes(spark, d):
    return Q.stats(V.winner_state(spark, d), "/u3/d5").drop("message")


@query("partial_failures", STATE + """
SELECT group_id, CASE WHEN group_id = 'g1' THEN NULL ELSE count(*) FILTER (NOT is_tombstoned) END AS total_nodes,
  CASE WHEN group_id = 'g1' THEN 'error' ELSE 'ok' END AS status, CASE WHEN group_id = 'g1' THEN 'undecodable' END AS message FROM st GROUP BY 1""")
def partial_failures(spark, d):
    state = V.winner_state(spark, d)
    failed = state.where("group_id = 'g1'").select("group_id").distinct().withColumn("message", F.lit("undecodable"))
    return Q.stats(state, "/", failed).select("group_id", "total_nodes", "status", "message")


@query("fresh_payload", FRESH + f""",
kids AS (SELECT DISTINCT origin_id, {parent('path')} AS path FROM win)
SELECT w.origin_id, w.path, {depth('w.path', '/u3')} AS depth, is_dir, k.path IS NOT NULL AS has_children FROM win w LEFT JOIN kids k ON k.origin_id = w.origin_id AND k.path = w.path
WHERE w.path <> '/u3' AND {depth('w.path', '/u3')} <= 2""")
def fresh_payload(spark, d):
    nodes = Q.fresh_find(V.base_log(spark, d), "/u3")
    return Q.fresh_payload(nodes, "/u3", max_depth=2).entries.select("origin_id", "path", "depth", "is_dir", "has_children")


@query("find_node", STATE + " SELECT group_id, path, size FROM live WHERE path = '/u3/d5/f7' ORDER BY group_id LIMIT 1")
def find_node(spark, d):
    return Q.find_node(V.winner_state(spark, d), "/u3/d5/f7").select("group_id", "path", "size")


@query("merge_responses", FRESH + """
SELECT path, arg_max(size, origin_id) AS size, max(origin_id) AS origin_id FROM win GROUP BY path""")
def merge_responses(spark, d):
    nodes = Q.fresh_find(V.base_log(spark, d), "/u3").select("path", "size", "origin_id", F.col("origin_id").alias("response_no"))
    return Q.merge_responses(nodes)


@query("merge_reliability", STATE + """
SELECT count(*) = 0 AS reliable, CASE max(code) WHEN 0 THEN 'Unattested' WHEN 1 THEN 'SuspectNodes' WHEN 2 THEN 'BlindSpotsDetected' END AS unreliable_reason
FROM (SELECT CASE WHEN blind_spot THEN 2 WHEN NOT monitoring_attested THEN 0 END AS code FROM live) WHERE code IS NOT NULL""")
def merge_reliability(spark, d):
    """One response per group."""
    nodes = V.winner_state(spark, d).where("not is_tombstoned")
    rows = nodes.withColumn("reason_code", F.when(F.col("blind_spot"), F.lit(2)).when(~F.col("monitoring_attested"), F.lit(0)))
    return Q.merge_reliability(rows.groupBy("group_id").agg(F.max("reason_code").alias("reason_code")))
