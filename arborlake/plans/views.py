"""Engine tables derived from the driver tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.functions import paths as P
from arborlake.storage import materialize

DAY_US = 86_400_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- change log

SQL_BASE = """
base AS (
  SELECT event_id AS seq, 'g' || (user_id % 3) AS group_id, 'h' || (user_id % 5) || '::g' || (user_id % 3) AS origin_id,
         CASE WHEN user_id % 3 = 2 THEN '/mnt/vol' ELSE '' END || '/u' || (user_id % 7) || '/d' || (user_id % 11) ||
           CASE WHEN event_id % 97 = 0 THEN '' ELSE '/f' || (event_id % 12) END AS path,
         event_id % 97 = 0 AS is_dir,
         epoch_us(ts) AS arrival_us,
         epoch_us(ts) - (event_id % 17) * 28800000000 AS timestamp_us,
         epoch_us(ts) - (event_id % 13) * 86400000000 AS mtime_us,
         CAST(round(value * 100) AS BIGINT) AS size,
         CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Update' END AS event_kind,
         CASE WHEN event_type IN ('view', 'click') THEN 'Scan' ELSE 'Realtime' END AS source,
         event_type = 'purchase' AS is_atomic_write
  FROM events)"""


def base_log(spark: SparkSession, folder: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    text = lambda c: c.cast("string")
    return table(spark, folder, "events").select(
        e.alias("seq"),
        F.concat(F.lit("g"), text(u % 3)).alias("group_id"),
        F.concat(F.lit("h"), text(u % 5), F.lit("::g"), text(u % 3)).alias("origin_id"),
        F.concat(
            F.when(u % 3 == 2, F.lit("/mnt/vol")).otherwise(F.lit("")), F.lit("/u"), text(u % 7), F.lit("/d"), text(u % 11),
            F.when(e % 97 == 0, F.lit("")).otherwise(F.concat(F.lit("/f"), text(e % 12))),
        ).alias("path"),
        (e % 97 == 0).alias("is_dir"),
        us.alias("arrival_us"),
        (us - (e % 17) * 28_800_000_000).alias("timestamp_us"),
        (us - (e % 13) * DAY_US).alias("mtime_us"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        F.when(F.col("event_type") == "error", F.lit(S.DELETE)).otherwise(F.lit(S.UPDATE)).alias("event_kind"),
        F.when(F.col("event_type").isin("view", "click"), F.lit(S.SCAN)).otherwise(F.lit(S.REALTIME)).alias("source"),
        (F.col("event_type") == "purchase").alias("is_atomic_write"),
    )


SQL_FOLD = SQL_BASE + """,
prim AS (SELECT group_id, min(origin_id) AS primary_object_ref FROM base GROUP BY group_id),
audits AS (
  SELECT group_id, CAST(floor(arrival_us / 864000000000) AS BIGINT) AS w, min(seq) AS a, max(seq) AS b,
         arg_min(arrival_us, seq) AS at_a, arg_max(arrival_us, seq) AS at_b
  FROM base GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY w) - 1 AS audit_id FROM audits),
foldlog AS (
  SELECT group_id, origin_id, seq * 4 + 2 AS seq, arrival_us, timestamp_us, 'data' AS rec_type, NULL AS epoch_id, path,
         CASE WHEN source = 'Scan' AND NOT is_dir THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent_path, is_dir,
         size, mtime_us, mtime_us AS ctime_us,
         CASE WHEN source = 'Scan' AND NOT is_dir AND seq % 3 = 0 THEN mtime_us - 3600000000 ELSE 0 END AS parent_mtime_us,
         CASE WHEN source = 'Scan' AND seq % 31 = 0 THEN 'Delete' ELSE event_kind END AS event_kind, source, is_atomic_write,
         is_dir AND source = 'Scan' AND seq % 2 = 0 AS audit_skipped
  FROM base
  UNION ALL
  SELECT n.group_id, p.primary_object_ref, a * 4 + 1, at_a, at_a, 'epoch_start', audit_id, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL, NULL, NULL, NULL FROM numbered n JOIN prim p USING (group_id)
  UNION ALL
  SELECT n.group_id, p.primary_object_ref, b * 4 + 3, at_b, at_b, 'epoch_end', audit_id, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL, NULL, NULL, NULL FROM numbered n JOIN prim p USING (group_id)
  UNION ALL
  SELECT group_id, origin_id, seq * 4, arrival_us, timestamp_us, 'watch_overflow', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL, NULL, NULL, NULL FROM base WHERE seq % 1009 = 0)"""


def primaries(log: DataFrame) -> DataFrame:
    return log.groupBy("group_id").agg(F.min("origin_id").alias("primary_object_ref"))


def fold_log(spark: SparkSession, folder: str) -> DataFrame:
    """The base log with audits every ten days, overflow signals, scan deletes, parent times and
    skip marks."""
    from pyspark.sql import Window as W

    from arborlake.skew import lookup_join

    base = base_log(spark, folder)
    scan_file = (F.col("source") == S.SCAN) & ~F.col("is_dir")
    prim = primaries(base)
    data = base.select(
        "group_id", "origin_id", "seq", (F.col("seq") * 4 + 2).alias("_seq"), "arrival_us", "timestamp_us",
        F.lit(S.DATA).alias("rec_type"), F.lit(None).cast("long").alias("epoch_id"), "path",
        F.when(scan_file, P.parent_path("path")).otherwise(F.lit("")).alias("parent_path"), "is_dir", "size", "mtime_us",
        F.col("mtime_us").alias("ctime_us"),
        F.when(scan_file & (F.col("seq") % 3 == 0), F.col("mtime_us") - 3_600_000_000).otherwise(F.lit(0)).cast("long").alias("parent_mtime_us"),
        F.when((F.col("source") == S.SCAN) & (F.col("seq") % 31 == 0), F.lit(S.DELETE)).otherwise(F.col("event_kind")).alias("event_kind"),
        "source", "is_atomic_write",
        (F.col("is_dir") & (F.col("source") == S.SCAN) & (F.col("seq") % 2 == 0)).alias("audit_skipped"),
    ).drop("seq").withColumnRenamed("_seq", "seq")
    window = F.floor(F.col("arrival_us") / (10 * DAY_US)).cast("long")
    audits = base.groupBy("group_id", window.alias("w")).agg(
        F.min("seq").alias("a"), F.max("seq").alias("b"),
        F.min_by("arrival_us", "seq").alias("at_a"), F.max_by("arrival_us", "seq").alias("at_b"),
    ).withColumn("audit_id", F.row_number().over(W.partitionBy("group_id").orderBy("w")) - 1).join(prim, "group_id")
    frame = lambda kind, seq, at: audits.select(
        "group_id", F.col("primary_object_ref").alias("origin_id"), seq.alias("seq"), F.col(at).alias("arrival_us"),
        F.col(at).alias("timestamp_us"), F.lit(kind).alias("rec_type"), F.col("audit_id").cast("long").alias("epoch_id"),
    )
    overflow = base.where("seq % 1009 = 0").select(
        "group_id", "origin_id", (F.col("seq") * 4).alias("seq"), "arrival_us", "timestamp_us", F.lit(S.WATCH_OVERFLOW).alias("rec_type")
    )
    log = data
    for part in (frame(S.EPOCH_START, F.col("a") * 4 + 1, "at_a"), frame(S.EPOCH_END, F.col("b") * 4 + 3, "at_b"), overflow):
        log = log.unionByName(part, allowMissingColumns=True)
    routed = lookup_join(log, prim, ["group_id"], "left", salt_from=["seq"])
    return routed.withColumn("is_primary", F.col("origin_id") == F.col("primary_object_ref")).select(*S.LOG.fieldNames())


# ---------------------------------------------------------------- state

AS_OF_US = 1_706_000_000_000_000  # a point inside the data's last ten days

SQL_STATE = SQL_BASE + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, path ORDER BY mtime_us DESC, event_kind = 'Delete' DESC, seq) AS rn FROM base),
st AS (
  SELECT group_id, path, size, mtime_us AS modified_time_us, mtime_us AS created_time_us, is_dir, source,
         source = 'Realtime' AS monitoring_attested,
         CASE WHEN source = 'Realtime' THEN arrival_us END AS last_confirmed_at_us,
         CASE WHEN NOT is_atomic_write THEN mtime_us + 2 * {DAY_US} END AS suspect_until_us,
         source = 'Scan' AND seq % 5 = 0 AS blind_spot,
         event_kind = 'Delete' AS is_tombstoned,
         CASE WHEN event_kind = 'Delete' AND seq % 7 > 0 THEN arrival_us + 2 * {DAY_US} END AS tombstone_expires_at_us,
         CASE WHEN event_kind = 'Delete' THEN timestamp_us END AS tombstoned_at_shadow_us,
         CASE WHEN source = 'Realtime' THEN timestamp_us END AS last_realtime_event_shadow_us,
         seq % 3 AS last_seen_epoch,
         CASE WHEN seq % 4 > 0 THEN arrival_us END AS subtree_changed_at_us
  FROM ranked WHERE rn = 1),
live AS (SELECT * FROM st WHERE NOT is_tombstoned)"""

SQL_GROUPS = f"""
grp AS (
  SELECT group_id, min(origin_id) AS primary_object_ref, max(timestamp_us) AS clock_us, count(*) % 2 = 1 AS overflow_pending,
         CASE WHEN group_id <> 'g0' THEN max(arrival_us) - 6 * {DAY_US} END AS coverage_recovered_at_us,
         group_id <> 'g1' AS audited, count(*) AS revision
  FROM base GROUP BY group_id)"""


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A derived table, written once per session as the state tables it stands for are."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(spark, folder), name)
    return _STORED[key]


def winner_state(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "winner-state", build_winner_state)


def build_winner_state(spark: SparkSession, folder: str) -> DataFrame:
    """A state table that SQL can state too: the newest record of every path."""
    rank = F.struct("mtime_us", (F.col("event_kind") == S.DELETE).cast("int").alias("d"), (-F.col("seq")).alias("s"))
    names = ["seq", "size", "mtime_us", "is_dir", "source", "arrival_us", "timestamp_us", "event_kind", "is_atomic_write"]
    w = base_log(spark, folder).groupBy("group_id", "path").agg(F.max_by(F.struct(*names), rank).alias("n")).select(
        "group_id", "path", "n.*"
    )
    live, gone, seq = F.col("source") == S.REALTIME, F.col("event_kind") == S.DELETE, F.col("seq")
    return w.select(
        "group_id", "path", "size", F.col("mtime_us").alias("modified_time_us"), F.col("mtime_us").alias("created_time_us"), "is_dir",
        "source", live.alias("monitoring_attested"), F.when(live, F.col("arrival_us")).alias("last_confirmed_at_us"),
        F.when(~F.col("is_atomic_write"), F.col("mtime_us") + 2 * DAY_US).alias("suspect_until_us"),
        (~live & (seq % 5 == 0)).alias("blind_spot"), gone.alias("is_tombstoned"),
        F.when(gone & (seq % 7 > 0), F.col("arrival_us") + 2 * DAY_US).alias("tombstone_expires_at_us"),
        F.when(gone, F.col("timestamp_us")).alias("tombstoned_at_shadow_us"),
        F.when(live, F.col("timestamp_us")).alias("last_realtime_event_shadow_us"), (seq % 3).alias("last_seen_epoch"),
        F.when(seq % 4 > 0, F.col("arrival_us")).alias("subtree_changed_at_us"),
    )


def winner_groups(spark: SparkSession, folder: str) -> DataFrame:
    g = base_log(spark, folder).groupBy("group_id").agg(
        F.min("origin_id").alias("primary_object_ref"), F.max("timestamp_us").alias("clock_us"),
        F.max("arrival_us").alias("_at"), F.count("*").alias("revision"),
    )
    return g.select(
        "group_id", "primary_object_ref", "clock_us", (F.col("revision") % 2 == 1).alias("overflow_pending"),
        F.when(F.col("group_id") != "g0", F.col("_at") - 6 * DAY_US).alias("coverage_recovered_at_us"),
        (F.col("group_id") != "g1").alias("audited"), "revision",
    )


# ---------------------------------------------------------------- listing, objects, documents

SQL_LISTING = """
files AS (
  SELECT 'd' || (doc_id % 2) AS group_id, '/' || source || '/' || lang || '/' || doc_id AS path, false AS is_dir,
         n_chars AS size, doc_id * 1000 + 1 AS mtime_us
  FROM documents),
dirs AS (
  SELECT DISTINCT group_id, unnest(['/', regexp_extract(path, '^(/[^/]*)/', 1), regexp_extract(path, '^(/[^/]*/[^/]*)/', 1)]) AS path
  FROM files),
listing AS (
  SELECT group_id, path, is_dir, size, mtime_us FROM files
  UNION ALL SELECT group_id, path, true, 0, length(path) * 500 FROM dirs)"""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    from arborlake.sources.listing import with_directories

    files = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string")).alias("group_id"),
        F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        F.lit(False).alias("is_dir"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000 + 1).alias("mtime_us"),
    )
    return with_directories(files).withColumn(
        "mtime_us", F.when(F.col("is_dir"), F.length("path") * 500).otherwise(F.col("mtime_us")).cast("long")
    )


SQL_OBJECTS = """
objs AS (
  SELECT split_part(url, '/', 3) AS bucket,
         regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) || '@' || page_id AS key,
         length(html) AS size, page_id * 1000 AS last_modified_unix_ms,
         CASE WHEN page_id % 3 > 0 THEN 'e' || page_id END AS etag, 'ep-' || (page_id % 4) AS object_ref
  FROM pages)"""


def objects(spark: SparkSession, folder: str) -> DataFrame:
    pid = F.col("page_id")
    return table(spark, folder, "pages").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("bucket"),
        F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1), F.lit("@"), pid.cast("string")).alias("key"),
        F.length("html").cast("long").alias("size"), (pid * 1000).alias("last_modified_unix_ms"),
        F.when(pid % 3 > 0, F.concat(F.lit("e"), pid.cast("string"))).alias("etag"),
        F.concat(F.lit("ep-"), (pid % 4).cast("string")).alias("object_ref"), F.lit(None).cast("long").alias("grant_epoch"),
    )


SQL_DOCS = """
docs AS (
  SELECT source AS index, CAST(doc_id AS VARCHAR) AS id, doc_id AS seq_no, CASE WHEN doc_id % 2 = 0 THEN CAST(1 AS BIGINT) END AS primary_term,
         '{"lang":"' || lang || '","meta":{"at":' || (doc_id % 50) || ',"chars":' || n_chars || '}}' AS source, 'es-0' AS object_ref,
         CASE WHEN doc_id % 5 = 0 THEN lang END AS routing
  FROM documents)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    d, text = F.col("doc_id"), lambda c: c.cast("string")
    return table(spark, folder, "documents").select(
        F.col("source").alias("index"), text(d).alias("id"), d.alias("seq_no"),
        F.when(d % 2 == 0, F.lit(1)).cast("long").alias("primary_term"),
        F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('","meta":{"at":'), text(d % 50), F.lit(',"chars":'), text(F.col("n_chars")),
                 F.lit("}}")).alias("source"),
        F.lit("es-0").alias("object_ref"), F.when(d % 5 == 0, F.col("lang")).alias("routing"), F.lit(None).cast("long").alias("grant_epoch"),
    )


# ---------------------------------------------------------------- relational catalogue, roots, grants

SQL_COLUMNS = """
cols AS (
  SELECT 'my-' || (p_partkey % 2) AS object_ref, lower(replace(p_brand, '#', '_')) AS schema, replace(lower(p_type), ' ', '_') AS "table",
         'c' || p_partkey AS "column", p_partkey AS ordinal_position, CASE WHEN p_size % 4 > 0 THEN 't' || (p_size % 4) END AS column_type
  FROM part)"""


def columns(spark: SparkSession, folder: str) -> DataFrame:
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    return table(spark, folder, "part").select(
        F.concat(F.lit("my-"), text(k % 2)).alias("object_ref"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("schema"),
        F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("table"), F.concat(F.lit("c"), text(k)).alias("column"),
        k.alias("ordinal_position"), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("t"), text(F.col("p_size") % 4))).alias("column_type"),
    )


SQL_GRANTS = """
nat AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
grants AS (
  SELECT c_name AS object_ref, n_name AS host_ref, '10.0.0.' || n_nationkey AS host_ip, '/mnt/' || lower(n_name) AS mount_point,
         r_name AS fs_source, lower(c_mktsegment) AS fs_type, c_acctbal > 0 AS active
  FROM customer JOIN nat ON c_nationkey = n_nationkey),
roots AS (
  SELECT r_name AS id, NULL AS mount_point, r_name AS fs_source, NULL AS fs_type, NULL AS host_ip, NULL AS host_ref, '/' AS subpath_scope,
         true AS watch, r_regionkey % 2 = 0 AS scan FROM region
  UNION ALL
  SELECT n_name, '/mnt/' || lower(n_name), NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'building' END, NULL, n_name,
         '/data/s' || n_nationkey, n_nationkey % 3 > 0, true FROM nation
  UNION ALL
  SELECT 'none-' || n_name, NULL, NULL, 'tape', NULL, n_name, '/', true, true FROM nation WHERE n_nationkey % 5 = 0),
matched AS (
  SELECT r.id AS root_id, g.*, r.subpath_scope FROM roots r JOIN grants g
    ON (r.mount_point IS NULL OR r.mount_point = g.mount_point) AND (r.fs_source IS NULL OR r.fs_source = g.fs_source)
   AND (r.fs_type IS NULL OR r.fs_type = g.fs_type) AND (r.host_ip IS NULL OR r.host_ip = g.host_ip)
   AND (r.host_ref IS NULL OR r.host_ref = g.host_ref))"""


def nations(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))


def grants(spark: SparkSession, folder: str) -> DataFrame:
    nat = nations(spark, folder)
    return table(spark, folder, "customer").join(nat, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("object_ref"), F.col("n_name").alias("host_ref"),
        F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("host_ip"),
        F.concat(F.lit("/mnt/"), F.lower("n_name")).alias("mount_point"), F.col("r_name").alias("fs_source"),
        F.lower("c_mktsegment").alias("fs_type"), (F.col("c_acctbal") > 0).alias("active"),
    )


def _root(**given):
    fields = []
    for name in ("mount_point", "fs_source", "fs_type", "host_ip", "host_ref"):
        fields.append(given.get(name, F.lit(None)).cast("string").alias(name))
    return F.struct(*fields).alias("selector")


def roots(spark: SparkSession, folder: str) -> DataFrame:
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name")
    a = region.select(
        F.col("r_name").alias("id"), _root(fs_source=F.col("r_name")), F.lit("/").alias("subpath_scope"), F.lit(True).alias("watch"),
        (F.col("r_regionkey") % 2 == 0).alias("scan"),
    )
    b = nation.select(
        name.alias("id"),
        _root(mount_point=F.concat(F.lit("/mnt/"), F.lower(name)), fs_type=F.when(key % 2 == 0, F.lit("building")), host_ref=name),
        F.concat(F.lit("/data/s"), key.cast("string")).alias("subpath_scope"), (key % 3 > 0).alias("watch"), F.lit(True).alias("scan"),
    )
    none = nation.where(key % 5 == 0).select(
        F.concat(F.lit("none-"), name).alias("id"), _root(fs_type=F.lit("tape"), host_ref=name), F.lit("/").alias("subpath_scope"),
        F.lit(True).alias("watch"), F.lit(True).alias("scan"),
    )
    return a.unionByName(b).unionByName(none)
