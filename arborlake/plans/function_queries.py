"""Path, id and predicate functions, and the sources, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.functions import ids
from arborlake.functions import paths as P
from arborlake.functions import predicates as B
from arborlake.operators import arbitrate as A
from arborlake.operators import routing
from arborlake.plans import views as V
from arborlake.plans.registry import query
from arborlake.sources import documents as D
from arborlake.sources import graph_adapters as GA
from arborlake.sources import listing as L
from arborlake.sources import objects as O
from arborlake.sources import relational as R
from arborlake.sources import watch_log


def with_(cte: str) -> str:
    return "WITH " + cte


def under(p: str, q: str) -> str:
    return f"({p} = '{q}' OR starts_with({p}, '{q}/'))"


def parent(p: str) -> str:
    cut = f"regexp_replace({p}, '/[^/]*$', '')"
    return f"CASE WHEN {p} IN ('', '/') OR strpos({p}, '/') = 0 THEN NULL WHEN {cut} = '' THEN '/' ELSE {cut} END"


def depth(p: str, q: str) -> str:
    rest = f"substr({p}, {len(q) + 1})" if q != "/" else p
    test = f"starts_with({p}, '{q}/')" if q != "/" else f"starts_with({p}, '/')"
    return (f"CASE WHEN {p} = '{q}' THEN 0 WHEN {test} THEN "
            f"CAST(len(list_filter(string_split({rest}, '/'), lambda x: x <> '')) AS INTEGER) END")


def ancestors(p: str) -> str:
    return (f"list_transform(range(1, len(string_split({p}, '/'))), lambda i: CASE WHEN i = 1 THEN '/' "
            f"ELSE array_to_string(string_split({p}, '/')[1:i], '/') END)")


def lineage(p: str) -> str:
    return f"list_append({ancestors(p)}, {p})"


def rebase(p: str, q: str) -> str:
    return f"CASE WHEN {under(p, q)} THEN {p} WHEN strpos({p} || '/', '{q}/') > 0 THEN substr({p}, strpos({p} || '/', '{q}/')) END"


def name_of(p: str) -> str:
    return f"CASE WHEN {p} IN ('', '/') THEN '/' ELSE regexp_extract({p}, '([^/]*)/?$', 1) END"


def stat_print(size: str, mtime: str) -> str:
    return f"'size=' || {size} || ';mtime=' || {mtime}"


def escaped(v: str) -> str:
    """stable_escape in SQL: hex pairs of the bytes, decoded back where they need no escape."""
    return (f"array_to_string(list_transform(regexp_extract_all(lower(hex(encode({v}))), '..'), lambda h: "
            f"CASE WHEN regexp_matches(chr(CAST(('0x' || h) AS INTEGER)), '^[A-Za-z0-9._-]$') "
            f"THEN chr(CAST(('0x' || h) AS INTEGER)) ELSE '~' || h END), '')")


BASE, STATE = with_(V.SQL_BASE), with_(V.SQL_STATE)

# ---------------------------------------------------------------- B: functions


@query("is_under", BASE + f" SELECT seq, {under('path', '/mnt/vol/u3')} AS below, {under('path', '/u3/d')} AS not_a_segment FROM base")
def is_under(spark, d):
    return V.base_log(spark, d).select(
        "seq", P.is_under("path", "/mnt/vol/u3").alias("below"), P.is_under("path", "/u3/d").alias("not_a_segment")
    )


@query("rebase_path", BASE + f" SELECT seq, {rebase('path', '/u3')} AS rebased, {rebase('path', '/d1')} AS inner_path FROM base")
def rebase_path(spark, d):
    return V.base_log(spark, d).select("seq", P.rebase("path", "/u3").alias("rebased"), P.rebase("path", "/d1").alias("inner_path"))


@query("parent_path", BASE + f" SELECT seq, {parent('path')} AS parent, {parent(parent('path'))} AS grandparent FROM base")
def parent_path(spark, d):
    return V.base_log(spark, d).select(
        "seq", P.parent_path("path").alias("parent"), P.parent_path(P.parent_path("path")).alias("grandparent")
    )


@query("relative_depth", BASE + f" SELECT seq, {depth('path', '/')} AS from_root, {depth('path', '/mnt')} AS from_mnt FROM base")
def relative_depth(spark, d):
    return V.base_log(spark, d).select(
        "seq", P.relative_depth("path", "/").alias("from_root"), P.relative_depth("path", "/mnt").alias("from_mnt")
    )


@query("file_name", BASE + f" SELECT seq, {name_of('path')} AS name, {name_of(chr(40) + 'path' + chr(32) + '||' + chr(32) + repr('/') + chr(41))} AS slashed FROM base")
def file_name(spark, d):
    return V.base_log(spark, d).select(
        "seq", P.file_name("path").alias("name"), P.file_name(F.concat("path", F.lit("/"))).alias("slashed")
    )


@query("display_path", """
SELECT doc_id, left(text, 40) AS shown, CAST(NULL AS VARCHAR) AS path_b64,
       rtrim(replace(replace(base64(encode(left(text, 40)) || from_hex('ff')), '+', '-'), '/', '_'), '=') AS broken_b64 FROM documents""")
def display_path(spark, d):
    raw = F.encode(F.substring("text", 1, 40), "UTF-8")
    broken = F.concat(raw, F.unhex(F.lit("FF")))
    return V.table(spark, d, "documents").select(
        "doc_id", P.display_path(P.to_byte_text(raw)).alias("shown"), P.path_b64(P.to_byte_text(raw)).alias("path_b64"),
        P.path_b64(P.to_byte_text(broken)).alias("broken_b64"),
    )


@query("make_relative", BASE + """
SELECT seq, CASE WHEN starts_with(path, '/mnt/vol/') THEN substr(path, 9) ELSE path END AS rel,
       CASE WHEN starts_with(path, '/mnt/vol/') THEN '/x/y' || substr(path, 9) ELSE '/x/y' || path END AS prefixed FROM base""")
def make_relative(spark, d):
    return V.base_log(spark, d).select(
        "seq", P.make_relative("path", "/mnt/vol").alias("rel"), P.make_relative("path", "/mnt/vol", "/x/y").alias("prefixed")
    )


@query("scope_match", "SELECT page_id, " + " OR ".join([
    "split_part(url, '/', 3) = 'm.example.com'", "(starts_with(split_part(url, '/', 3), 'blog.') AND ends_with(split_part(url, '/', 3), '.com'))",
]) + " AS allowed FROM pages")
def scope_match(spark, d):
    scopes = F.array(F.lit("m.example.com"), F.lit("blog.*.com"))
    return V.table(spark, d, "pages").select(
        "page_id", B.scope_match(F.split_part("url", F.lit("/"), F.lit(3)), scopes).alias("allowed")
    )


@query("effective_limit", """
SELECT o_orderkey, least(greatest(coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_custkey - 200 END, 100), 1), greatest(o_orderkey % 700, 1)) AS page
FROM orders""")
def effective_limit(spark, d):
    return V.table(spark, d, "orders").select(
        "o_orderkey",
        B.effective_limit_column(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") - 200), F.lit(100).cast("long"), F.col("o_orderkey") % 700).alias("page"),
    )


@query("stable_escape", f"SELECT page_id, {escaped('url')} AS esc, 's3:' || {escaped(chr(39) + 'ep 1' + chr(39))} || ':' || {escaped('url')} AS gid FROM pages")
def stable_escape(spark, d):
    return V.table(spark, d, "pages").select(
        "page_id", ids.stable_escape("url").alias("esc"), ids.graph_gid(F.lit("s3"), F.lit("ep 1"), "url").alias("gid")
    )


@query("root_ids", """
SELECT c_custkey, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS id FROM (
  SELECT c_custkey, b, row_number() OVER (PARTITION BY b ORDER BY c_custkey) AS n FROM (
    SELECT c_custkey, regexp_replace(regexp_replace('/' || c_mktsegment || '/' || c_nationkey || '#', '[^A-Za-z0-9._-]', '-', 'g'), '^-+|-+$', '', 'g') AS b
    FROM customer))""")
def root_ids(spark, d):
    raw = V.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("#")).alias("raw")
    )
    return routing.normalize_root_ids(raw, "raw", "c_custkey").select("c_custkey", "id")


def outcome_rows(spark, d):
    """Outcomes by rule of the sequence number, so that SQL can state them."""
    kinds = F.array(*[F.lit(k) for k in (S.CREATED, S.MODIFIED, S.IGNORED, S.DELETED)])
    return V.base_log(spark, d).select(
        "group_id", "path", "seq", "origin_id", "arrival_us", F.get(kinds, F.col("seq") % 4).alias("outcome"),
        (F.col("seq") % 4 != 2).alias("significant"), (F.col("seq") % 4 < 2).alias("stamps"), "is_dir", "mtime_us",
        F.when(F.col("seq") % 3 == 0, F.lit(0)).otherwise(F.col("mtime_us") - 5_000_000).cast("long").alias("ctime_us"),
    )


SQL_OUT = V.SQL_BASE + """,
outc AS (
  SELECT group_id, path, seq, origin_id, arrival_us, ['UpsertCreated', 'UpsertModified', 'Ignored', 'DeleteApplied'][seq % 4 + 1] AS outcome,
         seq % 4 <> 2 AS significant, seq % 4 < 2 AS stamps, is_dir, mtime_us, CASE WHEN seq % 3 = 0 THEN 0 ELSE mtime_us - 5000000 END AS ctime_us
  FROM base),
lags AS (
  SELECT group_id, origin_id AS object_ref, path, seq, arrival_us AS observed_at_us,
         greatest(arrival_us - CASE WHEN outcome = 'UpsertCreated' AND ctime_us > 0 THEN ctime_us ELSE mtime_us END, 0) // 1000 AS lag_ms,
         CASE WHEN outcome = 'UpsertCreated' THEN 'create' ELSE 'modify' END AS op
  FROM outc WHERE NOT is_dir AND outcome IN ('UpsertCreated', 'UpsertModified'))"""


@query("visibility_lag", with_(SQL_OUT) + " SELECT * FROM lags")
def visibility_lag(spark, d):
    return A.visibility_lag(outcome_rows(spark, d))


@query("lag_retention", with_(SQL_OUT) + f"""
SELECT * FROM lags WHERE observed_at_us >= {V.AS_OF_US} - 31 * 86400000000 AND observed_at_us >= {V.AS_OF_US} - 10 * 86400000000""")
def lag_retention(spark, d):
    return A.retain_lag(A.visibility_lag(outcome_rows(spark, d)), V.AS_OF_US, since_us=V.AS_OF_US - 10 * V.DAY_US)


@query("write_significance", with_(SQL_OUT) + """
SELECT seq, outcome IN ('UpsertCreated', 'DeleteApplied') OR (outcome = 'UpsertModified' AND NOT (is_dir AND seq % 2 = 0)
  AND (seq % 5 <> seq % 7 OR mtime_us <> mtime_us - seq % 2)) AS significant FROM outc""")
def write_significance(spark, d):
    node = lambda size, mtime: F.struct(
        size.alias("size"), mtime.alias("modified_time_us"), F.col("is_dir").alias("is_dir"), F.lit(False).alias("is_tombstoned")
    )
    s = F.col("seq")
    rows = outcome_rows(spark, d).withColumn("skipped", F.col("is_dir") & (s % 2 == 0)).withColumn(
        "before", node(s % 5, F.col("mtime_us"))
    ).withColumn("after", node(s % 7, F.col("mtime_us") - s % 2))
    return rows.select("seq", A.write_significant("outcome", "skipped", "before", "after").alias("significant"))


@query("coverage_mode", """
SELECT c_custkey, CASE WHEN w AND cap > 0 AND s THEN 'realtime_hotset_plus_audit' WHEN s THEN 'audit_with_metadata' ELSE 'watch_degraded' END AS mode,
       s AS metadata, w AND cap > 0 AND s AS fresh
FROM (SELECT c_custkey, c_custkey % 2 = 0 AS w, c_custkey % 3 = 0 AS s, c_custkey % 4 AS cap FROM customer)""")
def coverage_mode(spark, d):
    k = F.col("c_custkey")
    mode = B.coverage_mode(k % 2 == 0, k % 3 == 0, k % 4)
    caps = B.coverage_capabilities(mode)
    return V.table(spark, d, "customer").select(
        "c_custkey", mode.alias("mode"), caps["file_metadata_coverage"].alias("metadata"), caps["watch_freshness_coverage"].alias("fresh")
    )


@query("fingerprints", with_(V.SQL_OBJECTS + "," + V.SQL_DOCS) + f"""
SELECT 'o' || key AS id, coalesce(etag, {stat_print('size', 'last_modified_unix_ms')}) AS fingerprint FROM objs
UNION ALL
SELECT 'd' || id, 'seq_no=Some(' || seq_no || ');primary_term=' || CASE WHEN primary_term IS NULL THEN 'None' ELSE 'Some(' || primary_term || ')' END FROM docs""")
def fingerprints(spark, d):
    o = V.objects(spark, d).select(
        F.concat(F.lit("o"), "key").alias("id"), ids.object_fingerprint("etag", "size", "last_modified_unix_ms").alias("fingerprint")
    )
    return o.unionByName(V.documents(spark, d).select(
        F.concat(F.lit("d"), "id").alias("id"), ids.version_fingerprint("seq_no", "primary_term").alias("fingerprint")
    ))


# ---------------------------------------------------------------- A: sources

LISTING = with_(V.SQL_LISTING)
SCAN_SQL = f"""
scan AS (
  SELECT l.group_id, l.path, {name_of('l.path')} AS file_name, CASE WHEN l.is_dir THEN '' ELSE {parent('l.path')} END AS parent_path, l.is_dir,
         CASE WHEN l.is_dir THEN 0 ELSE l.size END AS size, l.mtime_us, coalesce(CASE WHEN l.is_dir THEN NULL ELSE p.mtime_us END, 0) AS parent_mtime_us
  FROM listing l LEFT JOIN listing p ON p.is_dir AND p.group_id = l.group_id AND p.path = {parent('l.path')})"""
SCAN_COLS = ["group_id", "path", "file_name", "parent_path", "is_dir", "size", "mtime_us", "parent_mtime_us"]


@query("scan_tree", LISTING + "," + SCAN_SQL + " SELECT * FROM scan")
def scan_tree(spark, d):
    return L.scan_tree(V.listing(spark, d)).select(*SCAN_COLS)


@query("audit_log", LISTING + "," + SCAN_SQL + """,
n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY string_split(path, '/')) AS seq FROM scan)
SELECT group_id, seq, 'data' AS rec_type, path, parent_mtime_us FROM n
UNION ALL SELECT group_id, 0, 'epoch_start', NULL, NULL FROM n GROUP BY group_id
UNION ALL SELECT group_id, max(seq) + 1, 'epoch_end', NULL, NULL FROM n GROUP BY group_id""")
def audit_log(spark, d):
    log = L.audit_log(L.scan_tree(V.listing(spark, d)), F.concat(F.lit("h0::"), "group_id"), 1, V.AS_OF_US)
    return log.select("group_id", "seq", "rec_type", "path", "parent_mtime_us")


@query("scan_targeted", LISTING + "," + SCAN_SQL + f"""
SELECT * FROM scan WHERE {under('path', '/src3')} AND CASE WHEN is_dir THEN {depth('path', '/src3')} <= 1 ELSE {depth('path', '/src3')} <= 2 END""")
def scan_targeted(spark, d):
    return L.scan_targeted(V.listing(spark, d), "/src3", recursive=True, max_depth=1).select(*SCAN_COLS)


@query("classify_watch", """
SELECT event_id AS seq, CASE WHEN k = 'delete' THEN 'Delete' ELSE 'Update' END AS event_kind, k IN ('close_write', 'create_dir', 'moved_to') AS is_atomic_write,
       isdir AS is_dir, k = 'create_dir' OR (k = 'moved_to' AND isdir) AS expands
FROM (SELECT event_id, isdir, CASE WHEN m & 576 <> 0 THEN 'delete' WHEN m & 8 <> 0 THEN 'close_write' WHEN m & 4 <> 0 THEN 'attrib'
        WHEN m & 2 <> 0 THEN 'modify' WHEN m & 256 <> 0 THEN CASE WHEN isdir THEN 'create_dir' END WHEN m & 128 <> 0 THEN 'moved_to' END AS k
      FROM (SELECT event_id, event_id % 1024 AS m, event_id % 5 = 0 AS isdir FROM events)) WHERE k IS NOT NULL""")
def classify_watch(spark, d):
    raw = V.base_log(spark, d).select(
        "origin_id", "seq", "path", "size", "mtime_us", F.col("mtime_us").alias("ctime_us"), "arrival_us",
        (F.col("seq") % 1024 + F.when(F.col("seq") % 5 == 0, F.lit(watch_log.ISDIR)).otherwise(F.lit(0))).alias("mask"),
    )
    return watch_log.classify_watch(raw).select("seq", "event_kind", "is_atomic_write", "is_dir", "expands")


OBJS = with_(V.SQL_OBJECTS)


@query("object_snapshot", OBJS + """
SELECT key, size, last_modified_unix_ms FROM objs
WHERE bucket = (SELECT min(bucket) FROM objs WHERE starts_with(key, 'en/')) AND starts_with(key, 'en/') AND key > 'en/1' ORDER BY key LIMIT 5""")
def object_snapshot(spark, d):
    objs = V.objects(spark, d)
    bucket = objs.where(F.col("key").startswith("en/")).agg(F.min("bucket")).first()[0]
    return O.object_snapshot(objs, bucket, "en/", 5, ("en/1",)).rows.select("key", "size", "last_modified_unix_ms")


@query("object_poll", OBJS + """
SELECT key, size, last_modified_unix_ms FROM objs WHERE bucket = (SELECT max(bucket) FROM objs)
  AND (last_modified_unix_ms > 20000 OR (last_modified_unix_ms = 20000 AND key > 'a')) ORDER BY last_modified_unix_ms, key LIMIT 50""")
def object_poll(spark, d):
    objs = V.objects(spark, d)
    bucket = objs.agg(F.max("bucket")).first()[0]
    return O.object_poll(objs, bucket, "", 50, (20_000, "a")).rows.select("key", "size", "last_modified_unix_ms")


@query("object_snapshot_all", OBJS + " SELECT bucket, key, size, last_modified_unix_ms FROM objs WHERE starts_with(key, 'en/')")
def object_snapshot_all(spark, d):
    return O.object_snapshot_all(V.objects(spark, d), prefix="en/").select("bucket", "key", "size", "last_modified_unix_ms")


@query("object_poll_all", OBJS + """
SELECT bucket, key, size, last_modified_unix_ms FROM objs WHERE last_modified_unix_ms > 20000 OR (last_modified_unix_ms = 20000 AND key > 'en/')""")
def object_poll_all(spark, d):
    return O.object_poll_all(V.objects(spark, d), (20_000, "en/")).select("bucket", "key", "size", "last_modified_unix_ms")


_RAW_OBJ = """
raw AS (SELECT bucket, CASE WHEN last_modified_unix_ms % 7000 > 0 THEN key END AS key, size - 1500 AS size, last_modified_unix_ms - 5000 AS ms, etag FROM objs)"""


def raw_objects(spark, d):
    ms = F.col("last_modified_unix_ms")
    return V.objects(spark, d).select(
        "bucket", F.when(ms % 7000 > 0, F.col("key")).alias("key"), (F.col("size") - 1500).alias("size"),
        F.timestamp_millis(ms - 5000).alias("last_modified"), "etag",
    )


@query("object_rows", OBJS + "," + _RAW_OBJ + """
SELECT bucket, key, size, ms AS last_modified_unix_ms, etag, '{"checksum_algorithm":[],"checksum_type":null}' AS metadata
FROM raw WHERE key IS NOT NULL AND size >= 0 AND ms >= 0""")
def object_rows(spark, d):
    return O.normalize_objects(raw_objects(spark, d))[0].select("bucket", "key", "size", "last_modified_unix_ms", "etag", "metadata")


@query("object_quarantine", OBJS + "," + _RAW_OBJ + """
SELECT CASE WHEN key IS NULL THEN 'missing key' WHEN size < 0 THEN 'negative size' ELSE 'time before the epoch' END AS reason, count(*) AS n
FROM raw WHERE key IS NULL OR size < 0 OR ms < 0 GROUP BY 1""")
def object_quarantine(spark, d):
    return O.normalize_objects(raw_objects(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("object_fields", OBJS + """
SELECT object_ref, f.name AS name, f.field_type AS field_type FROM (SELECT DISTINCT object_ref FROM objs), (SELECT unnest([
 {'name': 'Key', 'field_type': 'string'}, {'name': 'Size', 'field_type': 'u64'}, {'name': 'LastModified', 'field_type': 'unix-ms'},
 {'name': 'ETag', 'field_type': 'string'}, {'name': 'StorageClass', 'field_type': 'string'}, {'name': 'OwnerId', 'field_type': 'string'},
 {'name': 'OwnerDisplayName', 'field_type': 'string'}]) AS f)""")
def object_fields(spark, d):
    return O.object_fields(V.objects(spark, d).select("object_ref").distinct())


@query("table_snapshot", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 150")
def table_snapshot(spark, d):
    frozen = R.freeze_table(V.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey")
    return R.table_snapshot(frozen, 100, 150).rows


@query("table_snapshot_all", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def table_snapshot_all(spark, d):
    return R.table_snapshot_all(V.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("table_poll_all", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700")
def table_poll_all(spark, d):
    return R.table_poll_all(V.table(spark, d, "orders"), "o_orderkey", 700, ["o_orderkey", "o_custkey"])


@query("table_snapshot_ties", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 70 OFFSET 30")
def table_snapshot_ties(spark, d):
    return R.table_snapshot(R.freeze_table(V.table(spark, d, "orders"), ["o_custkey", "o_orderkey"]), 70, 30).rows


COLS = with_(V.SQL_COLUMNS)


@query("discover_columns", COLS + """
SELECT schema, "table", "column", ordinal_position, column_type FROM cols
WHERE starts_with(schema, 'brand_') AND ("table" = 'x' OR (starts_with("table", 's') AND ends_with("table", 'll')) OR starts_with("table", 'eco'))""")
def discover_columns(spark, d):
    return R.discover_columns(V.columns(spark, d), ["brand_*"], ["x", "s*ll", "eco*"]).drop("object_ref")


@query("row_to_json", """
SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","seg":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END
  || ',"ratio":' || CASE WHEN c_nationkey = 0 THEN 'null' ELSE CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) END
  || ',"raw":"' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE base64(from_hex('ff' || hex(c_mktsegment))) END
  || '","at":"2020-01-02T03:04:05.000000Z","took":"-1d 02:03:04.500000"}' AS values FROM customer""")
def row_to_json(spark, d):
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    rows = V.table(spark, d, "customer").select(
        "c_custkey", "c_name", F.when(k % 4 > 0, seg).alias("seg"),
        F.when(F.col("c_nationkey") == 0, F.lit(float("nan"))).otherwise(F.col("c_nationkey").cast("double")).alias("ratio"),
        F.when(k % 2 == 0, F.encode(seg, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FF")), F.encode(seg, "UTF-8"))).alias("raw"),
        F.to_timestamp(F.lit("2020-01-02 03:04:05")).alias("at"),
        F.expr("INTERVAL '-1 02:03:04.5' DAY TO SECOND").alias("took"),
    )
    return R.row_to_json(rows)


DOCS = with_(V.SQL_DOCS)


def doc_events(spark, d):
    return D.document_rows(V.documents(spark, d), "meta.at", timestamp_type="long")


@query("doc_snapshot", DOCS + """
SELECT id, index, seq_no % 50 AS at FROM docs
WHERE seq_no % 50 > 3 OR (seq_no % 50 = 3 AND (index > 'src1' OR (index = 'src1' AND id > '2'))) ORDER BY seq_no % 50, index, id LIMIT 40""")
def doc_snapshot(spark, d):
    return D.doc_snapshot(doc_events(spark, d), limit=40, cursor=(3, "src1", "2")).rows.select("id", "index", F.col("timestamp_value").alias("at"))


@query("doc_poll", DOCS + """
SELECT id, index, seq_no % 50 AS at FROM docs
WHERE index <> 'src1' AND (seq_no % 50 > 7 OR (seq_no % 50 = 7 AND (index > 'src12' OR (index = 'src12' AND id > '3'))))
ORDER BY seq_no % 50, index, id LIMIT 60""")
def doc_poll(spark, d):
    page = D.doc_poll(doc_events(spark, d), start=7, condition=F.col("index") != "src1", limit=60, cursor=(7, "src12", "3"))
    return page.rows.select("id", "index", F.col("timestamp_value").alias("at"))


# documents without a time, and every fifth one in a second index under the same id
_TWICE = """, twice AS (
  SELECT id, index, CASE WHEN seq_no % 50 > 2 THEN seq_no % 50 END AS at FROM docs
  UNION ALL SELECT id, 'copy', CASE WHEN seq_no % 50 > 2 THEN seq_no % 50 END FROM docs WHERE seq_no % 5 = 0)"""


def twice(spark, d):
    hits = V.documents(spark, d)
    rows = D.document_rows(hits.unionByName(hits.where("seq_no % 5 = 0").withColumn("index", F.lit("copy"))), "meta.at", timestamp_type="long")
    return rows.withColumn("timestamp_value", F.when(F.col("timestamp_value") > 2, F.col("timestamp_value")))


@query("doc_snapshot_all", DOCS + _TWICE + " SELECT id, index, twice.at AS at FROM twice")
def doc_snapshot_all(spark, d):
    return D.doc_snapshot_all(twice(spark, d)).select("id", "index", F.col("timestamp_value").alias("at"))


@query("doc_poll_all", DOCS + _TWICE + " SELECT id, index, twice.at AS at FROM twice WHERE twice.at >= 7")
def doc_poll_all(spark, d):
    return D.doc_poll_all(twice(spark, d), start=7).select("id", "index", F.col("timestamp_value").alias("at"))


@query("doc_projection", DOCS + """
SELECT index, id, '{"meta":{"chars":' || json_extract_string(source, '$.meta.chars') || '},"lang":"' || json_extract_string(source, '$.lang') || '"}' AS source FROM docs""")
def doc_projection(spark, d):
    return D.doc_snapshot_all(doc_events(spark, d), fields=["meta.chars", "lang", "none.of"]).select("index", "id", "source")


@query("doc_rows", DOCS + """
SELECT index, id, CAST(seq_no % 50 AS VARCHAR) AS at, seq_no, primary_term, routing, CASE WHEN routing IS NULL THEN 0 ELSE 1 END AS metadata_size FROM docs""")
def doc_rows(spark, d):
    rows = D.document_rows(V.documents(spark, d), "meta.at")
    return rows.select(
        "index", "id", F.col("timestamp_value").alias("at"), "seq_no", "primary_term", F.col("metadata")["_routing"].alias("routing"),
        F.size("metadata").alias("metadata_size"),
    )


@query("request_errors", """
SELECT o_orderkey, CASE
  WHEN o_orderkey % 11 = 0 AND o_orderkey % 3 = 0 THEN 'path and path_b64 exclude each other'
  WHEN o_custkey % 1100 NOT BETWEEN 1 AND 1000 AND o_orderkey % 2 = 0 THEN 'group_page_size must be between 1 and 1000'
  WHEN o_orderkey % 10100 NOT BETWEEN 1 AND 10000 THEN 'entry_page_size must be between 1 and 10000'
  WHEN o_orderpriority LIKE '1%' THEN 'unknown group_order ' || chr(39) || o_orderpriority || chr(39)
  WHEN o_orderstatus = 'P' THEN 'unknown read_class ' || chr(39) || 'P' || chr(39)
  WHEN o_custkey % 13 = 0 THEN 'max_depth must not be negative' END AS error
FROM orders""")
def request_errors(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = V.table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, F.lit("/a")).alias("path"), F.when(k % 11 == 0, F.lit("L2E=")).alias("path_b64"),
        F.when(k % 2 == 0, c % 1100).alias("groups"), (k % 10100).alias("entries"),
        F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).otherwise(F.lit("file-age")).alias("by"),
        F.when(F.col("o_orderstatus") == "P", F.lit("P")).when(k % 2 == 0, F.lit("fresh")).alias("read"), F.when(c % 13 == 0, F.lit(-1)).alias("depth"),
    )
    return asked.select("o_orderkey", B.tree_request_error("path", "path_b64", "groups", "entries", "by", "read", "depth").alias("error"))


@query("flatten_mapping", """
WITH f AS (
  SELECT 'i' || doc_id AS index, 'title' AS name, 'text' AS field_type FROM documents
  UNION ALL SELECT 'i' || doc_id, 'title.raw', 'keyword' FROM documents
  UNION ALL SELECT 'i' || doc_id, 'meta.' || lang, 'long' FROM documents
  UNION ALL SELECT 'i' || doc_id, 'meta.deep.' || source, 'date' FROM documents
  UNION ALL SELECT 'i' || doc_id, lang, 'long' FROM documents
  UNION ALL SELECT 'i' || doc_id, 'deep.' || source, 'date' FROM documents
  UNION ALL SELECT 'i' || doc_id, source, 'date' FROM documents
  UNION ALL SELECT 'i' || doc_id, '_id', 'keyword' FROM documents
  UNION ALL SELECT 'i' || doc_id, '_index', 'keyword' FROM documents)
SELECT * FROM f""")
def flatten_mapping(spark, d):
    doc = F.concat(
        F.lit('{"idx":{"mappings":{"properties":{"title":{"type":"text","fields":{"raw":{"type":"keyword"}}},"meta":{"properties":{"'), "lang",
        F.lit('":{"type":"long"},"deep":{"properties":{"'), "source", F.lit('":{"type":"date"}}}}}}}}}'),
    )
    mappings = V.table(spark, d, "documents").select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("index"), doc.alias("mapping"))
    return D.flatten_mapping(mappings)


@query("seeds_to_nodes", """
SELECT kind AS source_kind, 'inst' AS source_instance, local_id, 'asset' AS node_kind,
       coalesce(ref, kind || '://' || local_id) AS native_ref, local_id AS display_name, coalesce(ref, kind || '://' || local_id) AS native_pointer,
       seen AS observed_at
FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'pg' ELSE 'mysql' END AS kind, s_name AS local_id,
        CASE WHEN s_suppkey % 3 = 0 THEN 'ref:' || s_suppkey END AS ref, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey END AS seen FROM supplier)""")
def seeds_to_nodes(spark, d):
    k = F.col("s_suppkey")
    seeds = V.table(spark, d, "supplier").select(
        F.when(k % 2 == 0, F.lit("pg")).otherwise(F.lit(" mysql ")).alias("source_kind"), F.lit("inst").alias("source_instance"),
        F.col("s_name").alias("local_id"), F.when(k % 3 == 0, F.concat(F.lit("ref:"), k.cast("string"))).otherwise(F.lit("  ")).alias("native_ref"),
        F.when(k % 5 == 0, -k).otherwise(k).alias("observed_at"),
    )
    return GA.seeds_to_nodes(seeds).select(
        "source_kind", "source_instance", "local_id", "node_kind", "native_ref", "display_name", "native_pointer", "observed_at"
    )
