"""The arbitration fold over the change log, checked by a one-event-at-a-time recursion in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.operators import arbitrate as A
from arborlake.operators.path_fold import Policy
from arborlake.plans import views as V
from arborlake.plans.function_queries import with_
from arborlake.plans.registry import query

POLICY = Policy(tombstone_ttl_us=2 * V.DAY_US, tolerance_us=3_600_000_000, suspect_window_us=V.DAY_US)

_FOLDS: dict = {}


def fold(spark, d) -> A.FoldResult:
    """The whole log in one batch, once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDS:
        log = V.stored(spark, d, "fold-log", V.fold_log)
        _FOLDS[key] = A.apply_log(A.empty_state(spark), A.initial_groups(V.primaries(V.base_log(spark, d))), log, POLICY)
    return _FOLDS[key]


FENCE = lambda mark: f"coalesce({mark} > 0 AND ts > 0 AND ts <= {mark}, false)"

_COLUMNS = ["x", "size", "mtime", "ctime", "is_dir", "source", "attested", "confirmed", "suspect", "blind", "tomb", "expiry",
            "tomb_at", "last_rt", "seen", "stamp"]
_BOOL = {"x", "is_dir", "attested", "blind", "tomb"}
_OWN = ", ".join(
    f"{'bool_or' if c in _BOOL else 'max'}(a.{c}) FILTER (WHERE a.path = e.path AND a.x) AS s_{c}" for c in _COLUMNS
)

# One event of every group per round. All paths are there from the start, absent ones with x = false;
# the row '#' of a group counts rounds and revisions and, in its otherwise unused columns size, mtime,
# ctime and confirmed, the outcomes created, modified, deleted and ignored.
SQL_RECURSION = V.SQL_FOLD + f""",
ctl AS (
  SELECT group_id, seq, rec_type, epoch_id, arrival_us,
         CASE WHEN rec_type = 'epoch_start' THEN epoch_id ELSE sum(CASE WHEN rec_type = 'epoch_end' THEN 1 ELSE 0 END) OVER w END AS epoch,
         CASE WHEN lag(rec_type) OVER w = 'epoch_start' THEN lag(arrival_us) OVER w ELSE arrival_us END AS started,
         coalesce(max(CASE WHEN rec_type = 'epoch_start' OR epoch_id >= 1 THEN seq END) OVER (PARTITION BY group_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS skip_from
  FROM foldlog WHERE rec_type IN ('epoch_start', 'epoch_end') WINDOW w AS (PARTITION BY group_id ORDER BY seq)),
timed AS (
  SELECT f.* EXCLUDE (seq), f.seq, max(f.timestamp_us) OVER w AS clock, last_value(p.epoch IGNORE NULLS) OVER w AS epoch
  FROM foldlog f LEFT JOIN ctl p ON p.group_id = f.group_id AND p.seq = f.seq WINDOW w AS (PARTITION BY f.group_id ORDER BY f.seq)),
ev AS MATERIALIZED (
  SELECT f.group_id, row_number() OVER (PARTITION BY f.group_id ORDER BY f.seq) AS n, f.seq, f.rec_type, coalesce(f.path, '') AS path,
         coalesce(f.parent_path, '') AS parent_path, f.is_dir, f.size, f.mtime_us AS mtime, f.ctime_us AS ctime, f.parent_mtime_us AS pm,
         f.event_kind = 'Delete' AS del, f.source = 'Scan' AS scan, f.is_atomic_write AND f.source = 'Realtime' AS atomic, f.audit_skipped AS skipped,
         f.timestamp_us AS ts, f.arrival_us AS now, f.clock, CAST(coalesce(f.epoch, 0) AS BIGINT) AS epoch, c.epoch_id AS end_id, c.started
  FROM timed f LEFT JOIN ctl c ON c.group_id = f.group_id AND c.seq = f.seq AND c.rec_type = 'epoch_end'
  WHERE f.rec_type = 'data' OR f.rec_type = 'epoch_end'),
covered AS MATERIALIZED (
  SELECT DISTINCT d.group_id, d.path, c.seq AS end_seq FROM ctl c
  JOIN foldlog k ON k.group_id = c.group_id AND k.audit_skipped AND k.seq > c.skip_from AND k.seq < c.seq
  JOIN (SELECT DISTINCT group_id, path FROM base) d ON d.group_id = c.group_id AND (d.path = k.path OR starts_with(d.path, k.path || '/'))
  WHERE c.rec_type = 'epoch_end' AND c.epoch_id >= 1),
t USING KEY (group_id, path) AS (
  SELECT DISTINCT group_id, path, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS rev, false AS x, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS mtime,
    CAST(NULL AS BIGINT) AS ctime, CAST(NULL AS BOOLEAN) AS is_dir, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BOOLEAN) AS attested,
    CAST(NULL AS BIGINT) AS confirmed, CAST(NULL AS BIGINT) AS suspect, CAST(NULL AS BOOLEAN) AS blind, false AS tomb, CAST(NULL AS BIGINT) AS expiry,
    CAST(NULL AS BIGINT) AS tomb_at, CAST(NULL AS BIGINT) AS last_rt, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS stamp
  FROM (SELECT group_id, path FROM base UNION SELECT group_id, '#' FROM base)
  UNION
  SELECT r.group_id, r.path, o.n, r.rev + CASE WHEN r.path = '#' AND sig THEN 1 ELSE 0 END,
    CASE WHEN own THEN act <> 'rm' AND (r.x OR act IN ('new', 'newtomb')) WHEN down OR gone THEN false ELSE r.x END,
    CASE WHEN r.path = '#' THEN coalesce(r.size, 0) + CASE WHEN act = 'new' OR (act = 'upd' AND s_tomb) THEN 1 ELSE 0 END WHEN own AND act IN ('new', 'upd') THEN o.size WHEN own AND act = 'newtomb' THEN 0 ELSE r.size END,
    CASE WHEN r.path = '#' THEN coalesce(r.mtime, 0) + CASE WHEN act = 'upd' AND NOT s_tomb THEN 1 ELSE 0 END WHEN own AND act IN ('new', 'upd', 'newtomb') THEN o.mtime ELSE r.mtime END,
    CASE WHEN r.path = '#' THEN coalesce(r.ctime, 0) + CASE WHEN act IN ('tomb', 'newtomb', 'rm') THEN 1 ELSE 0 END WHEN own AND act IN ('new', 'upd', 'newtomb') THEN o.ctime ELSE r.ctime END,
    CASE WHEN own AND act IN ('new', 'upd', 'newtomb') THEN o.is_dir ELSE r.is_dir END,
    CASE WHEN own AND act IN ('new', 'upd', 'newtomb') THEN CASE WHEN o.scan THEN 'Scan' ELSE 'Realtime' END ELSE r.source END,
    CASE WHEN own AND act = 'newtomb' THEN false WHEN own AND act IN ('new', 'upd') AND NOT o.scan THEN true
         WHEN own AND (act = 'new' OR (act = 'upd' AND s_mtime <> o.mtime)) THEN false ELSE r.attested END,
    CASE WHEN r.path = '#' THEN coalesce(r.confirmed, 0) + CASE WHEN act IN ('ign', 'seen') THEN 1 ELSE 0 END WHEN own AND act IN ('new', 'newtomb') THEN CASE WHEN act = 'new' AND NOT o.scan THEN o.now END WHEN own AND act = 'upd' AND NOT o.scan THEN o.now ELSE r.confirmed END,
    CASE WHEN own AND act IN ('tomb', 'newtomb') THEN NULL
         WHEN own AND act IN ('new', 'upd') AND NOT o.scan THEN CASE WHEN NOT o.atomic THEN o.now + {POLICY.suspect_window_us} END
         WHEN own AND (act = 'new' OR (act = 'upd' AND s_mtime <> o.mtime)) THEN CASE WHEN o.clock - o.mtime < {POLICY.suspect_window_us} THEN o.now + {POLICY.suspect_window_us} END
         ELSE r.suspect END,
    CASE WHEN own AND act = 'newtomb' THEN false WHEN own AND act = 'new' THEN o.scan AND o.epoch >= 1 WHEN own AND act = 'upd' AND NOT o.scan THEN false
         WHEN own AND act = 'upd' AND s_mtime <> o.mtime AND o.epoch >= 1 THEN true ELSE r.blind END,
    CASE WHEN own AND act IN ('tomb', 'newtomb') THEN true WHEN own AND act IN ('new', 'upd') THEN false ELSE r.tomb END,
    CASE WHEN own AND act IN ('tomb', 'newtomb') THEN o.now + {POLICY.tombstone_ttl_us} WHEN own AND act IN ('new', 'upd') THEN NULL ELSE r.expiry END,
    CASE WHEN own AND act IN ('tomb', 'newtomb') THEN o.ts WHEN own AND act IN ('new', 'upd') THEN NULL ELSE r.tomb_at END,
    CASE WHEN own AND act IN ('tomb', 'newtomb') THEN o.ts WHEN own AND act = 'new' THEN CASE WHEN NOT o.scan THEN o.ts END WHEN own AND act = 'upd' AND NOT o.scan THEN o.ts ELSE r.last_rt END,
    CASE WHEN own AND act = 'newtomb' THEN 0 WHEN own AND act IN ('new', 'upd', 'seen') THEN o.epoch ELSE r.seen END,
    CASE WHEN (own OR up) AND sig AND act <> 'rm' THEN o.now WHEN own AND act IN ('new', 'newtomb') THEN NULL ELSE r.stamp END
  FROM (
    SELECT *, act IN ('new', 'newtomb', 'tomb', 'rm') OR (act = 'upd' AND (s_tomb OR (NOT skipped AND (s_size <> size OR s_mtime <> mtime OR s_is_dir <> is_dir)))) AS sig,
      (act = 'tomb' AND is_dir) OR (act = 'upd' AND s_is_dir <> is_dir AND NOT s_tomb) AS purge
    FROM (
      SELECT *, CASE
          WHEN rec_type <> 'data' THEN 'end'
          WHEN del AND NOT scan THEN CASE WHEN sx THEN 'tomb' ELSE 'newtomb' END
          WHEN del THEN CASE WHEN NOT sx OR s_tomb OR {FENCE('s_last_rt')} OR s_mtime > mtime OR (s_mtime = mtime AND s_source = 'Realtime') THEN 'ign' ELSE 'rm' END
          WHEN scan AND anc_tomb THEN 'ign'
          WHEN NOT sx THEN CASE WHEN scan AND parent_path <> '' AND pm > 0 AND coalesce(pm < par_mtime, false) THEN 'ign' ELSE 'new' END
          WHEN s_tomb AND atomic AND {FENCE('s_tomb_at')} THEN 'ign'
          WHEN s_tomb AND NOT atomic AND ({FENCE('s_tomb_at')} OR NOT (mtime > s_mtime AND (coalesce(now >= s_expiry, false) OR mtime - s_mtime >= {POLICY.tolerance_us}))) THEN 'seen'
          WHEN scan AND {FENCE('s_last_rt')} THEN 'seen'
          WHEN s_mtime >= mtime AND NOT (atomic AND s_source = 'Scan') THEN CASE WHEN scan THEN 'seen' ELSE 'ign' END
          ELSE 'upd' END AS act
      FROM (
        SELECT e.group_id, e.n, e.seq, e.rec_type, e.path, e.parent_path, e.is_dir, e.size, e.mtime, e.ctime, e.pm, e.del, e.scan, e.atomic, e.skipped, e.ts, e.now,
          e.clock, e.epoch, e.end_id, e.started, {_OWN}, coalesce(bool_or(a.x) FILTER (WHERE a.path = e.path), false) AS sx,
          coalesce(bool_or(a.x AND a.tomb AND starts_with(e.path, a.path || '/')), false) AS anc_tomb,
          max(a.mtime) FILTER (WHERE a.path = e.parent_path AND a.x) AS par_mtime
        FROM t c JOIN ev e ON c.path = '#' AND e.group_id = c.group_id AND e.n = c.i + 1 JOIN recurring.t a ON a.group_id = e.group_id
        GROUP BY ALL))) o
  JOIN (SELECT * FROM recurring.t) r ON r.group_id = o.group_id
  LEFT JOIN covered k ON k.group_id = r.group_id AND k.path = r.path AND k.end_seq = o.seq,
  LATERAL (SELECT r.path = o.path AND o.rec_type = 'data' AS own, o.purge AND r.x AND starts_with(r.path, o.path || '/') AS down,
    o.sig AND r.x AND starts_with(o.path, r.path || '/') AS up,
    o.rec_type = 'epoch_end' AND o.end_id >= 1 AND r.x AND CASE WHEN r.tomb THEN r.expiry IS NULL OR o.now >= r.expiry
      ELSE r.seen < o.end_id AND NOT coalesce(r.confirmed > o.started, false) AND k.path IS NULL END AS gone) f
  WHERE r.path = '#' OR (own AND act <> 'ign') OR coalesce(down, false) OR coalesce(up, false) OR coalesce(gone, false))"""
RECURSION = "WITH RECURSIVE " + SQL_RECURSION.lstrip()


@query("fold_state", RECURSION + """
SELECT group_id, path, size, mtime AS modified_time_us, ctime AS created_time_us, is_dir, source, attested AS monitoring_attested, confirmed AS last_confirmed_at_us,
  suspect AS suspect_until_us, blind AS blind_spot, tomb AS is_tombstoned, expiry AS tombstone_expires_at_us, tomb_at AS tombstoned_at_shadow_us,
  last_rt AS last_realtime_event_shadow_us, seen AS last_seen_epoch, stamp AS subtree_changed_at_us FROM t WHERE x""")
def fold_state(spark, d):
    return fold(spark, d).state


@query("fold_revisions", RECURSION + """
, rec AS (
  SELECT group_id, count(*) FILTER (e AND NOT pe) AS n FROM (
    SELECT group_id, rec_type = 'epoch_end' AS e, lag(rec_type = 'epoch_end') OVER (PARTITION BY group_id ORDER BY seq) AS pe FROM foldlog
    WHERE rec_type IN ('epoch_end', 'watch_overflow')) GROUP BY 1)
SELECT group_id, rev + coalesce(n, 0) AS revision FROM t LEFT JOIN rec USING (group_id) WHERE path = '#'""")
def fold_revisions(spark, d):
    return fold(spark, d).groups.select("group_id", "revision")


@query("fold_groups", with_(V.SQL_FOLD) + """,
o AS (SELECT group_id, seq, arrival_us, rec_type = 'epoch_end' AS e, lag(rec_type = 'epoch_end') OVER (PARTITION BY group_id ORDER BY seq) AS pe FROM foldlog
  WHERE rec_type IN ('epoch_end', 'watch_overflow'))
SELECT group_id, (SELECT max(timestamp_us) FROM foldlog f WHERE f.group_id = o.group_id) AS clock_us, count(*) FILTER (e) AS completed_epochs,
  NOT arg_max(e, seq) AS overflow_pending, max(CASE WHEN e AND NOT pe THEN arrival_us END) AS coverage_recovered_at_us FROM o GROUP BY 1""")
def fold_groups(spark, d):
    return fold(spark, d).groups.select("group_id", "clock_us", "completed_epochs", "overflow_pending", "coverage_recovered_at_us")


@query("fold_outcomes", RECURSION + """
SELECT group_id, size AS created, mtime AS modified, ctime AS deleted, confirmed AS ignored, rev - 1 AS significant FROM t WHERE path = '#'""")
def fold_outcomes(spark, d):
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return fold(spark, d).outcomes.groupBy("group_id").agg(
        n(S.CREATED).alias("created"), n(S.MODIFIED).alias("modified"), n(S.DELETED).alias("deleted"), n(S.IGNORED).alias("ignored"),
        F.count_if("significant").alias("significant"),
    )
