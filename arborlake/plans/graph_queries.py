"""The provenance graph over skeletons derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import graph as G
from arborlake.plans import views as V
from arborlake.plans.function_queries import STATE, escaped, name_of, stat_print, with_
from arborlake.plans.registry import query
from arborlake.sources import graph_adapters as GA
from arborlake.storage import materialize

NODE_COLUMNS = ["source_kind", "source_instance", "local_id", "node_kind", "native_ref", "display_name", "native_pointer", "fingerprint", "observed_at"]

OBJ_NODES = """
onodes AS (
  SELECT 's3' AS source_kind, object_ref AS source_instance, bucket AS local_id, 'root' AS node_kind, 's3://' || bucket AS native_ref, bucket AS display_name,
         's3://' || bucket AS native_pointer, NULL AS fingerprint, 0 AS observed_at FROM objs GROUP BY object_ref, bucket
  UNION ALL
  SELECT 's3', object_ref, bucket || '/' || key, 'asset', 's3://' || bucket || '/' || key, key, 's3://' || bucket || '/' || key,
         coalesce(etag, """ + stat_print("size", "last_modified_unix_ms") + """), last_modified_unix_ms FROM objs),
oedges AS (SELECT 's3' AS source_kind, object_ref AS source_instance, bucket AS from_local_id, bucket || '/' || key AS to_local_id, 'contains' AS edge_kind FROM objs)"""
OBJ = with_(V.SQL_OBJECTS) + "," + OBJ_NODES


@query("file_nodes", STATE + f"""
SELECT 'fs' AS source_kind, 'site' AS source_instance, path AS local_id, CASE WHEN is_dir THEN 'namespace' ELSE 'asset' END AS node_kind,
  'fs://site' || path AS native_ref, {name_of('path')} AS display_name, 'fs-index:' || group_id || ':' || path AS native_pointer,
  {stat_print('size', 'modified_time_us')} AS fingerprint, modified_time_us AS observed_at FROM live""")
def file_nodes(spark, d):
    return GA.file_nodes(V.winner_state(spark, d).where("not is_tombstoned"), "site").select(*NODE_COLUMNS)


@query("object_nodes", OBJ + " SELECT * FROM onodes")
def object_nodes(spark, d):
    return GA.object_skeleton(V.objects(spark, d)).nodes.select(*NODE_COLUMNS)


@query("object_edges", OBJ + " SELECT * FROM oedges")
def object_edges(spark, d):
    return GA.object_skeleton(V.objects(spark, d)).edges.select("source_kind", "source_instance", "from_local_id", "to_local_id", "edge_kind")


DOC_NODES = """
dnodes AS (
  SELECT 'es' AS source_kind, object_ref AS source_instance, index AS local_id, 'collection' AS node_kind, 'es://' || object_ref || '/' || index AS native_ref,
    index AS display_name, 'docs=' || count(*) AS fingerprint FROM docs GROUP BY object_ref, index
  UNION ALL
  SELECT 'es', object_ref, index || '/_doc/' || id, 'asset', 'es://' || object_ref || '/' || index || '/_doc/' || id, id,
    'seq_no=Some(' || seq_no || ');primary_term=' || CASE WHEN primary_term IS NULL THEN 'None' ELSE 'Some(' || primary_term || ')' END FROM docs)"""


@query("document_nodes", with_(V.SQL_DOCS) + "," + DOC_NODES + " SELECT * FROM dnodes")
def document_nodes(spark, d):
    return GA.document_skeleton(V.documents(spark, d)).nodes.select(
        "source_kind", "source_instance", "local_id", "node_kind", "native_ref", "display_name", "fingerprint"
    )


EDGE = ["source_kind", "source_instance", "from_local_id", "to_local_id", "edge_kind", "confidence"]


@query("document_edges", with_(V.SQL_DOCS) + """
SELECT 'es' AS source_kind, object_ref AS source_instance, index AS from_local_id, index || '/_doc/' || id AS to_local_id, 'contains' AS edge_kind,
  'observed' AS confidence FROM docs""")
def document_edges(spark, d):
    return GA.document_skeleton(V.documents(spark, d)).edges.select(*EDGE)


def index_fields(spark, d):
    return V.table(spark, d, "documents").select(
        F.lit("es-0").alias("object_ref"), F.col("source").alias("index"), F.concat(F.lit("meta."), "lang").alias("name"), F.lit("long").alias("field_type")
    ).distinct()


@query("index_field_nodes", """
WITH f AS (SELECT DISTINCT source AS index, 'meta.' || lang AS name FROM documents)
SELECT index AS local_id, 'collection' AS node_kind, 'es://es-0/' || index AS native_pointer, 'fields=' || count(*) AS fingerprint FROM f GROUP BY index
UNION ALL SELECT index || '/_field/' || name, 'field', 'es://es-0/' || index || '/_mapping/' || name, 'long' FROM f""")
def index_field_nodes(spark, d):
    return GA.index_field_skeleton(index_fields(spark, d)).nodes.select("local_id", "node_kind", "native_pointer", "fingerprint")


@query("index_field_edges", """
SELECT DISTINCT 'es' AS source_kind, 'es-0' AS source_instance, source AS from_local_id, source || '/_field/meta.' || lang AS to_local_id,
  'has-field' AS edge_kind, 'observed' AS confidence FROM documents""")
def index_field_edges(spark, d):
    return GA.index_field_skeleton(index_fields(spark, d)).edges.select(*EDGE)


@query("relational_nodes", with_(V.SQL_COLUMNS) + """
SELECT DISTINCT object_ref AS source_instance, schema AS local_id, 'namespace' AS node_kind, schema AS display_name, NULL AS fingerprint FROM cols
UNION ALL SELECT object_ref, schema || '/' || "table", 'collection', "table", 'fields=' || count(*) FROM cols GROUP BY object_ref, schema, "table"
UNION ALL SELECT object_ref, schema || '/' || "table" || '/' || "column", 'field', "column", column_type FROM cols""")
def relational_nodes(spark, d):
    return GA.relational_skeleton(V.columns(spark, d)).nodes.select("source_instance", "local_id", "node_kind", "display_name", "fingerprint")


@query("relational_edges", with_(V.SQL_COLUMNS) + """
SELECT DISTINCT object_ref AS source_instance, schema AS from_local_id, schema || '/' || "table" AS to_local_id, 'contains' AS edge_kind, 'observed' AS confidence FROM cols
UNION ALL SELECT object_ref, schema || '/' || "table", schema || '/' || "table" || '/' || "column", 'has-field', 'observed' FROM cols""")
def relational_edges(spark, d):
    return GA.relational_skeleton(V.columns(spark, d)).edges.select("source_instance", "from_local_id", "to_local_id", "edge_kind", "confidence")


def catalogue(spark, d):
    return V.columns(spark, d).groupBy("object_ref", "schema", "table").agg(F.collect_list("column").alias("columns")).withColumn("database", F.lit("db"))


@query("catalogue_nodes", with_(V.SQL_COLUMNS) + """
SELECT DISTINCT object_ref AS source_instance, 'db/' || schema AS local_id, 'namespace' AS node_kind, NULL AS fingerprint FROM cols
UNION ALL SELECT object_ref, 'db/' || schema || '/' || "table", 'collection', 'fields=' || count(*) FROM cols GROUP BY object_ref, schema, "table"
UNION ALL SELECT object_ref, 'db/' || schema || '/' || "table" || '/' || "column", 'field', NULL FROM cols""")
def catalogue_nodes(spark, d):
    return GA.catalogue_skeleton(catalogue(spark, d)).nodes.select("source_instance", "local_id", "node_kind", "fingerprint")


@query("catalogue_edges", with_(V.SQL_COLUMNS) + """
SELECT DISTINCT 'pg' AS source_kind, object_ref AS source_instance, 'db/' || schema AS from_local_id, 'db/' || schema || '/' || "table" AS to_local_id,
  'contains' AS edge_kind, 'declared' AS confidence FROM cols
UNION ALL SELECT 'pg', object_ref, 'db/' || schema || '/' || "table", 'db/' || schema || '/' || "table" || '/' || "column", 'has-field', 'declared' FROM cols""")
def catalogue_edges(spark, d):
    return GA.catalogue_skeleton(catalogue(spark, d)).edges.select(*EDGE)


# ---------------------------------------------------------------- schema and status documents


def schema_documents(spark, d):
    """One graph-schema document per region: a catalog and a vertex label per nation."""
    nat = V.nations(spark, d).join(
        V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers")), "n_nationkey"
    )
    low = F.lower("n_name")
    table = F.struct(F.col("r_name").alias("catalog"), F.lit("public").alias("schema"), F.concat(low, F.lit("_t")).alias("table"))
    return nat.groupBy("r_name").agg(
        F.to_json(F.struct(
            F.array(F.struct(
                F.col("r_name").alias("name"), F.struct(F.concat(F.lit("jdbc:pg://h:5/"), F.lower("r_name"), F.lit("?x=1")).alias("jdbcUri")).alias("jdbc"),
            )).alias("catalogs"),
            F.struct(
                F.collect_list(F.struct(low.alias("label"), F.struct(table.alias("tableSource")).alias("oneToOne"))).alias("vertices"),
                F.collect_list(F.struct(F.concat(low, F.lit("_e")).alias("label"), table.alias("tableSource"))).alias("edges"),
            ).alias("graph"),
        )).alias("body")
    ).select(
        F.concat(F.lit("schema/"), "r_name").alias("local_id"), F.concat("r_name", F.lit(".json")).alias("file_name"),
        F.concat(F.lit("json-doc:"), "r_name").alias("pointer"), "body",
    )


def schema_skeleton(spark, d):
    files = V.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("local_id")).join(
        V.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.concat(F.lower("n_name"), F.lit("_t")).alias("table"), F.lit("fs").alias("kind"), F.lit("site").alias("instance"), "local_id")
    return GA.schema_document_skeleton(
        schema_documents(spark, d), files, {"REGION_0": "first"}, doc_instance="docs", pg_instance="pg-0", label_instance="labels-0", pipeline=("main", "load")
    )


SCHEMA = """WITH n AS (SELECT DISTINCT n_name, r_name, lower(n_name) AS low FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey),
m AS (SELECT *, CASE WHEN r_name = (SELECT 'REGION_0') THEN 'first' ELSE r_name END AS db FROM n)"""


@query("schema_document_nodes", SCHEMA + """
SELECT 'es' AS source_kind, 'schema/' || r_name AS local_id, 'asset' AS node_kind, 'catalogs=1;vertices=' || count(*) || ';edges=' || count(*) AS fingerprint FROM m GROUP BY r_name
UNION ALL SELECT 'pg', lower(r_name) || '/public', 'namespace', 'catalog' FROM m GROUP BY r_name
UNION ALL SELECT 'label', 'label/vertex/' || low, 'entity', 'vertex' FROM m
UNION ALL SELECT 'label', 'label/edge/' || low || '_e', 'entity', 'edge' FROM m
UNION ALL SELECT 'pg', db || '/public', 'namespace', NULL FROM m WHERE db <> lower(r_name) GROUP BY db
UNION ALL SELECT 'pg', db || '/public/' || low || '_t', 'collection', r_name FROM m""")
def schema_document_nodes(spark, d):
    return schema_skeleton(spark, d).nodes.select("source_kind", "local_id", "node_kind", "fingerprint")


@query("schema_document_edges", SCHEMA + """
SELECT 'declares-schema' AS edge_kind, 'schema/' || r_name AS from_local_id, 'load' AS to_local_id, 'declared' AS confidence FROM m GROUP BY r_name
UNION ALL SELECT 'declares-schema', 'schema/' || r_name, lower(r_name) || '/public', 'declared' FROM m GROUP BY r_name
UNION ALL SELECT 'declares-schema', 'schema/' || r_name, 'label/vertex/' || low, 'declared' FROM m
UNION ALL SELECT 'declares-schema', 'schema/' || r_name, 'label/edge/' || low || '_e', 'declared' FROM m
UNION ALL SELECT 'projected-as', db || '/public/' || low || '_t', 'label/vertex/' || low, 'declared' FROM m
UNION ALL SELECT 'projected-as', db || '/public/' || low || '_t', 'label/edge/' || low || '_e', 'declared' FROM m
UNION ALL SELECT 'loaded-into', (SELECT min(s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = m.n_name), db || '/public/' || low || '_t', 'inferred' FROM m""")
def schema_document_edges(spark, d):
    return schema_skeleton(spark, d).cross_edges.select("edge_kind", "from_local_id", "to_local_id", "confidence")


@query("status_document_nodes", """
SELECT 'status/' || s_suppkey AS local_id, 'cache=' || CASE WHEN s_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE 'WARM' END || ';schema_exists=' ||
  CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'unknown' END || ';details=' || CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2 END AS fingerprint FROM supplier""")
def status_document_nodes(spark, d):
    return status_skeleton(spark, d).nodes.select("local_id", "fingerprint")


def status_skeleton(spark, d):
    k = F.col("s_suppkey")
    body = F.concat(
        F.lit('{"GremlinServer":'), F.when(k % 3 == 0, F.lit("{}")).otherwise(F.lit('{"LocalCacheStatus":"WARM","LocalCacheStatusDetail":[1,2]}')),
        F.when(k % 2 == 0, F.lit(',"Schema":{"Exists":true}')).otherwise(F.lit("")), F.lit("}"),
    )
    docs = V.table(spark, d, "supplier").select(F.concat(F.lit("status/"), k.cast("string")).alias("local_id"), F.lit("status").alias("pointer"), body.alias("body"))
    return GA.status_document_skeleton(docs, doc_instance="docs", target=("label", "labels-0", "label/vertex/x"))


@query("status_document_edges", """
SELECT 'es' AS from_kind, 'docs' AS from_instance, 'status/' || s_suppkey AS from_local_id, 'label' AS to_kind, 'labels-0' AS to_instance,
  'label/vertex/x' AS to_local_id, 'has-runtime-status' AS edge_kind, 'observed' AS confidence FROM supplier""")
def status_document_edges(spark, d):
    return status_skeleton(spark, d).cross_edges.select(
        "from_kind", "from_instance", "from_local_id", "to_kind", "to_instance", "to_local_id", "edge_kind", "confidence"
    )


def inventory(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select(
        F.col("source").alias("group_name"), F.concat_ws("/", F.lit("/raw"), "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("doc_id").cast("string").alias("display_name"), F.col("lang").alias("hint"),
    )


@query("inventory_nodes", """
SELECT 'fs' AS source_kind, '/raw/' || source || '/' || doc_id AS local_id, 'asset' AS node_kind, lang AS fingerprint FROM documents
UNION ALL SELECT DISTINCT 'fs', '/raw/' || source, 'namespace', NULL FROM documents UNION ALL SELECT 'fs', '/raw', 'root', NULL UNION ALL SELECT 'pipeline', 'load', 'root', NULL""")
def inventory_nodes(spark, d):
    sk = GA.inventory_skeleton(inventory(spark, d), "/raw", "site", ("main", "load"))
    return sk.nodes.select("source_kind", "local_id", "node_kind", "fingerprint")


@query("inventory_edges", """
SELECT 'contains' AS edge_kind, '/raw/' || source AS from_local_id, '/raw/' || source || '/' || doc_id AS to_local_id FROM documents
UNION ALL SELECT DISTINCT 'contains', '/raw', '/raw/' || source FROM documents UNION ALL SELECT 'parsed-to', '/raw/' || source || '/' || doc_id, 'load' FROM documents""")
def inventory_edges(spark, d):
    sk = GA.inventory_skeleton(inventory(spark, d), "/raw", "site", ("main", "load"))
    names = ["edge_kind", "from_local_id", "to_local_id"]
    return sk.edges.select(*names).unionByName(sk.cross_edges.select(*names))


# ---------------------------------------------------------------- the graph


def full_skeleton(spark, d):
    """Objects and catalogue together, with a lineage edge from every object to the table of its number."""
    # a small file is one split whatever its rows, so these are dealt out before ids are made of them
    columns, objects = V.columns(spark, d).repartition("column"), V.objects(spark, d).repartition("key")
    objs = GA.object_skeleton(objects)
    rel = GA.relational_skeleton(columns)
    pid = F.col("last_modified_unix_ms") / 1000
    o = objects.withColumn("k", pid.cast("long"))
    t = columns.select(F.col("ordinal_position").alias("k"), F.col("object_ref").alias("to_instance"), F.concat_ws("/", "schema", "table").alias("to_local_id"))
    cross = o.join(t, "k").select(
        F.lit("s3").alias("from_kind"), F.col("object_ref").alias("from_instance"), F.concat_ws("/", "bucket", "key").alias("from_local_id"),
        F.lit("mysql").alias("to_kind"), "to_instance", "to_local_id", F.lit(G.LOADED_INTO).alias("edge_kind"), F.lit(G.INFERRED).alias("confidence"),
        F.when(F.col("k") % 2 == 0, F.lit("given")).otherwise(F.lit("  ")).alias("evidence_ref"), F.col("k").alias("observed_at"), F.col("k").alias("ord"),
    )
    return objs.union(rel).union(G.skeleton(spark, cross_edges=cross))


def graph(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _GRAPHS:
        g, ack = G.ingest(G.empty_graph(spark), full_skeleton(spark, d))
        _GRAPHS[key] = (G.Graph(*[materialize(df, "graph") for df in (g.nodes, g.edges, g.evidence)]), materialize(ack, "graph-ack"))
    return _GRAPHS[key]


_GRAPHS: dict = {}

GRAPH = with_(V.SQL_OBJECTS) + "," + V.SQL_COLUMNS + "," + OBJ_NODES + f""",
snodes AS (
  SELECT source_kind, source_instance, local_id, node_kind FROM onodes UNION ALL
  SELECT DISTINCT 'mysql', object_ref, schema, 'namespace' FROM cols UNION ALL
  SELECT DISTINCT 'mysql', object_ref, schema || '/' || "table", 'collection' FROM cols UNION ALL
  SELECT 'mysql', object_ref, schema || '/' || "table" || '/' || "column", 'field' FROM cols),
gn AS (SELECT *, source_kind || ':' || {escaped('source_instance')} || ':' || {escaped('local_id')} AS gid FROM snodes),
sedges AS (
  SELECT * FROM oedges UNION ALL SELECT DISTINCT 'mysql', object_ref, schema, schema || '/' || "table", 'contains' FROM cols UNION ALL
  SELECT 'mysql', object_ref, schema || '/' || "table", schema || '/' || "table" || '/' || "column", 'has-field' FROM cols),
cedges AS (SELECT o.object_ref AS fi, bucket || '/' || key AS fl, c.object_ref AS ti, schema || '/' || "table" AS tl, ordinal_position AS k
  FROM objs o JOIN cols c ON ordinal_position * 1000 = last_modified_unix_ms),
e0 AS (
  SELECT source_kind || ':' || {escaped('source_instance')} || ':' || {escaped('from_local_id')} AS source_gid,
    source_kind || ':' || {escaped('source_instance')} || ':' || {escaped('to_local_id')} AS target_gid, edge_kind,
    'evidence:edge:' || source_kind || ':' || {escaped('source_instance')} || ':' || {escaped('from_local_id')} || ':' || {escaped('to_local_id')} AS ev FROM sedges
  UNION ALL
  SELECT 's3:' || {escaped('fi')} || ':' || {escaped('fl')}, 'mysql:' || {escaped('ti')} || ':' || {escaped('tl')}, 'loaded-into',
    CASE WHEN k % 2 = 0 THEN 'given' ELSE 'evidence:cross-edge:s3:' || {escaped('fi')} || ':' || {escaped('fl')} || ':mysql:' || {escaped('ti')} || ':' || {escaped('tl')} END FROM cedges),
ge AS (SELECT *, 'edge:' || {escaped('source_gid')} || ':' || edge_kind || ':' || {escaped('target_gid')} AS edge_id FROM e0)"""


@query("graph_nodes", GRAPH + f" SELECT gid, source_kind, node_kind, 'evidence:node:' || {escaped('gid')} AS evidence FROM gn")
def graph_nodes(spark, d):
    return graph(spark, d)[0].nodes.select("gid", "source_kind", "node_kind", F.element_at("evidence_refs", 1).alias("evidence"))


@query("graph_edges", GRAPH + " SELECT edge_id, source_gid, target_gid, edge_kind, ev AS evidence FROM ge")
def graph_edges(spark, d):
    return graph(spark, d)[0].edges.select("edge_id", "source_gid", "target_gid", "edge_kind", F.element_at("evidence_refs", 1).alias("evidence"))


@query("graph_evidence", GRAPH + f"""
SELECT 'evidence:node:' || {escaped('gid')} AS evidence_id, source_kind AS anchor_kind, source_kind || '-adapter' AS observed_by, 'snapshot' AS observation_kind, 'observed' AS confidence FROM gn
UNION ALL SELECT DISTINCT ev, split_part(source_gid, ':', 1), split_part(source_gid, ':', 1) || '-adapter', 'snapshot', 'observed' FROM ge WHERE edge_kind <> 'loaded-into'
UNION ALL SELECT DISTINCT ev, 'graph', 'graph', 'inferred', 'inferred' FROM ge WHERE edge_kind = 'loaded-into'""")
def graph_evidence(spark, d):
    return graph(spark, d)[0].evidence.select(
        "evidence_id", F.col("anchor.source_kind").alias("anchor_kind"), "observed_by", "observation_kind", "confidence"
    )


@query("graph_upsert_counts", GRAPH + """
SELECT 'nodes' AS "table", count(*) AS upserted FROM gn UNION ALL SELECT 'edges', count(*) FROM ge
UNION ALL SELECT 'evidence', (SELECT count(*) FROM gn) + (SELECT count(DISTINCT ev) FROM ge)""")
def graph_upsert_counts(spark, d):
    return graph(spark, d)[1]


@query("dangling_edges", GRAPH + """
SELECT edge_id, source_gid NOT IN (SELECT gid FROM gn WHERE node_kind <> 'collection') AS no_source, target_gid NOT IN (SELECT gid FROM gn WHERE node_kind <> 'collection') AS no_target FROM ge
WHERE source_gid NOT IN (SELECT gid FROM gn WHERE node_kind <> 'collection') OR target_gid NOT IN (SELECT gid FROM gn WHERE node_kind <> 'collection')""")
def dangling_edges(spark, d):
    nodes = graph(spark, d)[0].nodes.where("node_kind <> 'collection'")
    return G.dangling_edges(nodes, full_skeleton(spark, d)).select("edge_id", "no_source", "no_target")


@query("list_graph_nodes", GRAPH + " SELECT gid, node_kind FROM gn WHERE source_kind = 's3' AND node_kind = 'asset' ORDER BY gid LIMIT 30")
def list_graph_nodes(spark, d):
    return G.list_nodes(graph(spark, d)[0], "s3", "asset", 30).select("gid", "node_kind")


@query("get_graph_node", GRAPH + " SELECT gid, node_kind FROM gn WHERE gid = 'mysql:my-0:brand_2'")
def get_graph_node(spark, d):
    return G.get_node(graph(spark, d)[0], "mysql:my-0:brand_2").select("gid", "node_kind")


@query("list_graph_edges", GRAPH + " SELECT edge_id FROM ge WHERE source_gid = 'mysql:my-0:brand_2' AND edge_kind = 'contains' ORDER BY edge_id LIMIT 5")
def list_graph_edges(spark, d):
    return G.list_edges(graph(spark, d)[0], source_gid="mysql:my-0:brand_2", edge_kind="contains", limit=5).select("edge_id")


@query("neighbors", GRAPH + " SELECT edge_id, edge_kind FROM ge WHERE source_gid = 'mysql:my-0:brand_2~2feconomy' OR target_gid = 'mysql:my-0:brand_2~2feconomy' ORDER BY edge_id LIMIT 20")
def neighbors(spark, d):
    return G.neighbors(graph(spark, d)[0], "mysql:my-0:brand_2~2feconomy", limit=20).select("edge_id", "edge_kind")


@query("neighbors_of_collections", GRAPH + """
SELECT gid, edge_id FROM ge JOIN gn ON node_kind = 'collection' AND (gid = source_gid OR gid = target_gid)""")
def neighbors_of_collections(spark, d):
    g = graph(spark, d)[0]
    return G.neighbors_of(g, g.nodes.where("node_kind = 'collection'")).select("gid", "edge_id")


@query("graph_coverage", GRAPH + """
SELECT 'source_kind' AS dimension, source_kind AS value, count(*) AS count FROM gn GROUP BY 2 UNION ALL SELECT 'node_kind', node_kind, count(*) FROM gn GROUP BY 2
UNION ALL SELECT 'evidence', 'all', (SELECT count(*) FROM gn) + (SELECT count(DISTINCT ev) FROM ge)""")
def graph_coverage(spark, d):
    return G.coverage(graph(spark, d)[0])


@query("skeleton_union", GRAPH + " SELECT edge_kind, count(*) AS n FROM ge GROUP BY 1")
def skeleton_union(spark, d):
    sk = full_skeleton(spark, d)
    return sk.edges.select("edge_kind").unionByName(sk.cross_edges.select("edge_kind")).groupBy("edge_kind").agg(F.count("*").alias("n"))
