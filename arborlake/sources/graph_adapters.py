"""Turn inventories of files, objects, documents and tables into graph skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import ids
from arborlake.functions import paths as P
from arborlake.operators import graph as G

c = F.col


def _uri(scheme: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", *parts))


def seeds_to_nodes(seeds: DataFrame) -> DataFrame:
    """Seed rows with defaults: kind asset, reference from kind and id, display name the id."""
    text = lambda n: F.nullif(F.trim(c(n)), F.lit("")) if n in seeds.columns else F.lit(None).cast("string")
    number = lambda n: c(n) if n in seeds.columns else F.lit(None).cast("long")
    kind, local = text("source_kind"), text("local_id")
    ref = F.coalesce(text("native_ref"), F.concat(kind, F.lit("://"), local))
    nat = lambda n: F.when(number(n) >= 0, number(n))
    return seeds.select(
        kind.alias("source_kind"), text("source_instance").alias("source_instance"), local.alias("local_id"),
        F.coalesce(text("node_kind"), F.lit("asset")).alias("node_kind"), ref.alias("native_ref"),
        F.coalesce(text("display_name"), local).alias("display_name"),
        F.coalesce(text("native_pointer"), ref).alias("native_pointer"), text("fingerprint").alias("fingerprint"),
        F.coalesce(nat("observed_at"), F.lit(0)).cast("long").alias("observed_at"), nat("grant_epoch").cast("long").alias("grant_epoch"),
    )


def bad_seeds(seeds: DataFrame) -> DataFrame:
    """Seed rows that lack a required text."""
    missing = F.lit(False)
    for n in ("source_kind", "source_instance", "local_id"):
        missing = missing | (F.trim(F.coalesce(c(n), F.lit(""))) == "")
    return seeds.where(missing)


def file_nodes(nodes: DataFrame, instance: str, pointer_scheme: str = "fs-index") -> DataFrame:
    """Directories become namespaces, files assets. ``nodes`` has group_id, path, size,
    modified_time_us, is_dir."""
    path = P.display_path("path")
    return nodes.select(
        F.lit("fs").alias("source_kind"), F.lit(instance).alias("source_instance"), path.alias("local_id"),
        F.when(c("is_dir"), F.lit("namespace")).otherwise(F.lit("asset")).alias("node_kind"),
        F.concat(F.lit(f"fs://{instance}"), path).alias("native_ref"),
        P.display_path(P.file_name("path")).alias("display_name"),
        F.concat_ws(":", F.lit(pointer_scheme), c("group_id"), path).alias("native_pointer"),
        ids.stat_fingerprint("size", "modified_time_us").alias("fingerprint"),
        c("modified_time_us").alias("observed_at"),
    )


def object_skeleton(objects: DataFrame) -> G.Skeleton:
    """Bucket roots, assets and contains edges from (object_ref, bucket, key, size,
    last_modified_unix_ms, etag, grant_epoch)."""
    root_uri = _uri("s3", c("bucket"))
    buckets = objects.groupBy("object_ref", "bucket").agg(F.max("grant_epoch").alias("grant_epoch")).select(
        F.lit("s3").alias("source_kind"), c("object_ref").alias("source_instance"), c("bucket").alias("local_id"),
        F.lit("root").alias("node_kind"), root_uri.alias("native_ref"), c("bucket").alias("display_name"),
        root_uri.alias("native_pointer"), F.lit(None).cast("string").alias("fingerprint"), F.lit(0).alias("observed_at"), "grant_epoch",
    )
    uri, local = _uri("s3", c("bucket"), c("key")), F.concat_ws("/", "bucket", "key")
    assets = objects.select(
        F.lit("s3").alias("source_kind"), c("object_ref").alias("source_instance"), local.alias("local_id"),
        F.lit("asset").alias("node_kind"), uri.alias("native_ref"), c("key").alias("display_name"), uri.alias("native_pointer"),
        ids.object_fingerprint("etag", "size", "last_modified_unix_ms").alias("fingerprint"),
        c("last_modified_unix_ms").alias("observed_at"), "grant_epoch",
    )
    edges = objects.select(
        F.lit("s3").alias("source_kind"), c("object_ref").alias("source_instance"), c("bucket").alias("from_local_id"),
        local.alias("to_local_id"), F.lit(G.CONTAINS).alias("edge_kind"), F.lit(G.OBSERVED).alias("confidence"),
        c("last_modified_unix_ms").alias("observed_at"), "grant_epoch",
    )
    return G.skeleton(objects.sparkSession, buckets.unionByName(assets), edges)


def index_field_skeleton(fields: DataFrame) -> G.Skeleton:
    """Index collections, their fields and has-field edges from (object_ref, index, name, field_type)."""
    uri = _uri("es", c("object_ref"), c("index"))
    indexes = fields.groupBy("object_ref", "index").agg(F.count("name").alias("n")).select(
        F.lit("es").alias("source_kind"), c("object_ref").alias("source_instance"), c("index").alias("local_id"),
        F.lit("collection").alias("node_kind"), uri.alias("native_ref"), c("index").alias("display_name"),
        uri.alias("native_pointer"), ids.count_fingerprint("fields", "n").alias("fingerprint"),
    )
    named = fields.where("name is not null")
    local = F.concat_ws("/", c("index"), F.lit("_field"), c("name"))
    nodes = named.select(
        F.lit("es").alias("source_kind"), c("object_ref").alias("source_instance"), local.alias("local_id"),
        F.lit("field").alias("node_kind"), _uri("es", c("object_ref"), local).alias("native_ref"), c("name").alias("display_name"),
        _uri("es", c("object_ref"), c("index"), F.lit("_mapping"), c("name")).alias("native_pointer"), c("field_type").alias("fingerprint"),
    )
    return G.skeleton(fields.sparkSession, indexes.unionByName(nodes), _edges(named, "es", c("index"), local, G.HAS_FIELD))


def _edges(df: DataFrame, kind: str, src: Column, dst: Column, edge_kind: str, confidence: str = G.OBSERVED) -> DataFrame:
    return df.select(
        F.lit(kind).alias("source_kind"), c("object_ref").alias("source_instance"), src.alias("from_local_id"),
        dst.alias("to_local_id"), F.lit(edge_kind).alias("edge_kind"), F.lit(confidence).alias("confidence"),
    )


def document_skeleton(documents: DataFrame) -> G.Skeleton:
    """Index collections, document assets and contains edges; no document body is copied."""
    uri = _uri("es", c("object_ref"), c("index"))
    indexes = documents.groupBy("object_ref", "index").agg(F.count("id").alias("n"), F.max("grant_epoch").alias("grant_epoch")).select(
        F.lit("es").alias("source_kind"), c("object_ref").alias("source_instance"), c("index").alias("local_id"),
        F.lit("collection").alias("node_kind"), uri.alias("native_ref"), c("index").alias("display_name"),
        uri.alias("native_pointer"), ids.count_fingerprint("docs", "n").alias("fingerprint"), "grant_epoch",
    )
    local = F.concat_ws("/", c("index"), F.lit("_doc"), c("id"))
    doc_uri = _uri("es", c("object_ref"), local)
    assets = documents.select(
        F.lit("es").alias("source_kind"), c("object_ref").alias("source_instance"), local.alias("local_id"),
        F.lit("asset").alias("node_kind"), doc_uri.alias("native_ref"), c("id").alias("display_name"),
        doc_uri.alias("native_pointer"), ids.version_fingerprint("seq_no", "primary_term").alias("fingerprint"), "grant_epoch",
    )
    edges = _edges(documents, "es", c("index"), local, G.CONTAINS)
    return G.skeleton(documents.sparkSession, indexes.unionByName(assets), edges)


def relational_skeleton(columns: DataFrame) -> G.Skeleton:
    """Schemas, tables and columns from (object_ref, schema, table, column, column_type)."""
    return _catalog(columns, "mysql", [c("schema")], G.OBSERVED, typed=True)


def catalogue_skeleton(seeds: DataFrame) -> G.Skeleton:
    """The same shape one level deeper from declared tables (object_ref, database, schema, table,
    columns array)."""
    exploded = seeds.select("object_ref", "database", "schema", "table", F.explode_outer("columns").alias("column"))
    return _catalog(exploded, "pg", [c("database"), c("schema")], G.DECLARED, typed=False)


def _catalog(rows: DataFrame, kind: str, namespace: list[Column], confidence: str, typed: bool) -> G.Skeleton:
    space = F.concat_ws("/", *namespace)
    table, field = F.concat_ws("/", space, c("table")), F.concat_ws("/", space, c("table"), c("column"))
    keys = [n for n in ("object_ref", "database", "schema") if n in rows.columns]
    uri = lambda local: _uri(kind, c("object_ref"), local)

    def nodes(df, local, node_kind, name, fingerprint):
        return df.select(
            F.lit(kind).alias("source_kind"), c("object_ref").alias("source_instance"), local.alias("local_id"),
            F.lit(node_kind).alias("node_kind"), uri(local).alias("native_ref"), c(name).alias("display_name"),
            uri(local).alias("native_pointer"), fingerprint.cast("string").alias("fingerprint"),
        )

    spaces = rows.select(*keys).distinct()
    tables = rows.groupBy(*keys, "table").agg(F.count("column").alias("n"))
    fields = rows.where("column is not null")
    all_nodes = (
        nodes(spaces, space, "namespace", "schema", F.lit(None))
        .unionByName(nodes(tables, table, "collection", "table", ids.count_fingerprint("fields", "n")))
        .unionByName(nodes(fields, field, "field", "column", c("column_type") if typed else F.lit(None)))
    )
    edges = _edges(tables, kind, space, table, G.CONTAINS, confidence).unionByName(
        _edges(fields, kind, table, field, G.HAS_FIELD, confidence)
    )
    return G.skeleton(rows.sparkSession, all_nodes, edges)


# ---------------------------------------------------------------- schema and status documents

_TABLE = "struct<catalog:string,schema:string,table:string>"
_LABEL = f"array<struct<label:string,oneToOne:struct<tableSource:{_TABLE}>,tableSource:{_TABLE}>>"
SCHEMA_DOC = (
    "struct<catalogs:array<struct<name:string,jdbc:struct<jdbcUri:string>>>,"
    f"graph:struct<vertices:{_LABEL},edges:{_LABEL}>>"
)


def schema_document_skeleton(
    documents: DataFrame, table_files: DataFrame, catalog_databases: dict[str, str], *, doc_instance: str,
    pg_instance: str, label_instance: str, pipeline: tuple[str, str], observed_at: int = 0, label_kind: str = "label",
) -> G.Skeleton:
    """Catalogs, labels and tables declared by graph-schema documents.

    ``documents``: local_id, file_name, pointer, body (JSON text). ``table_files``: table, kind,
    instance, local_id of the file a table was loaded from; those edges are inferred.
    ``pipeline``: instance and id of the pipeline node, of kind ``pipeline``.
    """
    spark = documents.sparkSession
    doc = documents.withColumn("j", F.from_json("body", SCHEMA_DOC))
    at = F.lit(observed_at).cast("long").alias("observed_at")

    def node(df, kind, instance, local, node_kind, ref, name, pointer, fingerprint):
        return df.select(
            F.lit(kind).alias("source_kind"), F.lit(instance).alias("source_instance"), local.alias("local_id"),
            F.lit(node_kind).alias("node_kind"), ref.alias("native_ref"), name.alias("display_name"), pointer.alias("native_pointer"),
            fingerprint.cast("string").alias("fingerprint"), at, "stage", "ord", F.col("local_id" if "doc" not in df.columns else "doc").alias("within"),
        )

    def cross(df, fk, fi, fl, tk, ti, tl, edge_kind, confidence=G.DECLARED):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return df.select(
            lit(fk).alias("from_kind"), lit(fi).alias("from_instance"), lit(fl).alias("from_local_id"), lit(tk).alias("to_kind"),
            lit(ti).alias("to_instance"), lit(tl).alias("to_local_id"), F.lit(edge_kind).alias("edge_kind"),
            F.lit(confidence).alias("confidence"), at,
        )

    # the first node of an id wins, so later kinds of node rank behind earlier ones
    doc_nodes = node(
        doc.withColumns({"ord": F.lit(0), "stage": F.lit(0)}), "es", doc_instance, c("local_id"), "asset",
        F.concat(F.lit(f"es://{doc_instance}/json/"), c("local_id")), F.coalesce("file_name", "local_id"), c("pointer"),
        F.concat(
            F.lit("catalogs="), F.coalesce(F.size("j.catalogs"), F.lit(0)).cast("string"),
            F.lit(";vertices="), F.coalesce(F.size("j.graph.vertices"), F.lit(0)).cast("string"),
            F.lit(";edges="), F.coalesce(F.size("j.graph.edges"), F.lit(0)).cast("string"),
        ),
    )
    doc_edges = cross(doc, "es", doc_instance, c("local_id"), "pipeline", pipeline[0], pipeline[1], G.DECLARES_SCHEMA)

    cat = doc.select(c("local_id").alias("doc"), F.posexplode("j.catalogs").alias("ord", "k")).where("k.name is not null")
    db = F.coalesce(F.substring_index(F.substring_index("k.jdbc.jdbcUri", "?", 1), "/", -1), F.lower("k.name"))
    cat = cat.withColumn("db", db).withColumn("ns", F.concat(c("db"), F.lit("/public"))).withColumn("stage", F.lit(1))
    cat_nodes = node(
        cat, "pg", pg_instance, c("ns"), "namespace", F.concat(F.lit(f"pg://{pg_instance}/"), c("ns")), c("k.name"),
        F.concat_ws(":", F.lit("pg-catalog"), c("k.name"), c("db"), F.lit("public")), F.lit("catalog"),
    )
    cat_edges = cross(cat, "es", doc_instance, c("doc"), "pg", pg_instance, c("ns"), G.DECLARES_SCHEMA)

    def labels_of(key: str, kind: str, source: Column) -> DataFrame:
        return (
            doc.select(c("local_id").alias("doc"), F.posexplode(f"j.graph.{key}").alias("ord", "l")).where("l.label is not null")
            .select("doc", "ord", F.lit(kind).alias("kind"), c("l.label").alias("label"), source.alias("t"))
            .withColumn("local", F.concat_ws("/", F.lit(label_kind), "kind", "label"))
        )

    labels = labels_of("vertices", "vertex", F.coalesce("l.oneToOne.tableSource", "l.tableSource")).unionByName(
        labels_of("edges", "edge", c("l.tableSource"))
    ).withColumn("stage", F.when(c("kind") == "vertex", 2).otherwise(3))
    label_nodes = node(
        labels, label_kind, label_instance, c("local"), "entity", F.concat(F.lit(f"{label_kind}://"), c("local")), c("label"),
        F.concat_ws(":", F.lit("schema"), "doc", "local"), c("kind"),
    )
    label_edges = cross(labels, "es", doc_instance, c("doc"), label_kind, label_instance, c("local"), G.DECLARES_SCHEMA)

    mapping = F.coalesce(*[F.when(c("t.catalog") == k, F.lit(v)) for k, v in catalog_databases.items()], c("t.catalog"))
    tabled = labels.where("t.catalog is not null and t.schema is not null and t.table is not null").withColumn("db", mapping)
    tabled = tabled.withColumn("ns", F.concat_ws("/", "db", "t.schema")).withColumn("tid", F.concat_ws("/", "db", "t.schema", "t.table"))
    spaces = node(
        tabled.withColumn("stage", F.lit(4)), "pg", pg_instance, c("ns"), "namespace", F.concat(F.lit(f"pg://{pg_instance}/"), c("ns")),
        c("t.schema"), F.concat_ws(":", F.lit("pg-catalog"), "db", "t.schema"), F.lit(None),
    )
    tables = node(
        tabled.withColumn("stage", F.lit(5)), "pg", pg_instance, c("tid"), "collection", F.concat(F.lit(f"pg://{pg_instance}/"), c("tid")),
        c("t.table"), F.concat(F.lit("pg-table:"), c("db"), F.lit(":"), c("t.schema"), F.lit("."), c("t.table")), c("t.catalog"),
    )
    contains = tabled.select("ns", "tid").distinct().select(
        F.lit("pg").alias("source_kind"), F.lit(pg_instance).alias("source_instance"), c("ns").alias("from_local_id"),
        c("tid").alias("to_local_id"), F.lit(G.CONTAINS).alias("edge_kind"), F.lit(G.DECLARED).alias("confidence"), at,
    )
    projected = cross(tabled, "pg", pg_instance, c("tid"), label_kind, label_instance, c("local"), G.PROJECTED_AS)
    loaded = tabled.select("tid", c("t.table").alias("table")).distinct().join(table_files, "table").transform(
        lambda d: cross(d, c("kind"), c("instance"), c("local_id"), "pg", pg_instance, c("tid"), G.LOADED_INTO, G.INFERRED)
    )
    nodes = first_nodes(doc_nodes.unionByName(cat_nodes).unionByName(label_nodes).unionByName(spaces).unionByName(tables))
    crosses = doc_edges.unionByName(cat_edges).unionByName(label_edges).unionByName(projected).unionByName(loaded).distinct()
    return G.skeleton(spark, nodes, contains, crosses)


def first_nodes(nodes: DataFrame) -> DataFrame:
    """The first node per id, by stage, document and ``ord`` as far as given; ties by content."""
    place = [n for n in ("stage", "within", "ord") if n in nodes.columns]
    names = [n for n in nodes.columns if n not in ("source_kind", "source_instance", "local_id", *place)]
    best = nodes.groupBy("source_kind", "source_instance", "local_id").agg(
        F.min_by(F.struct(*names), F.struct(*place, *names)).alias("_n")
    )
    return best.select("source_kind", "source_instance", "local_id", *[F.col(f"_n.{n}").alias(n) for n in names])


def status_document_skeleton(
    documents: DataFrame, *, doc_instance: str, target: tuple[str, str, str], observed_at: int = 0
) -> G.Skeleton:
    """Runtime status documents (local_id, pointer, body) with an edge to the entity they describe.
    ``target``: kind, instance and local id of that entity."""
    j = lambda p: F.get_json_object("body", p)
    details = F.coalesce(
        F.json_array_length(j("$.GremlinServer.LocalCacheStatusDetail")), F.lit(0)
    )
    exists = F.try_variant_get(F.try_parse_json("body"), "$.Schema.Exists", "variant")
    fingerprint = F.concat(
        F.lit("cache="), F.coalesce(j("$.GremlinServer.LocalCacheStatus"), F.lit("UNKNOWN")),
        F.lit(";schema_exists="), F.when(F.schema_of_variant(exists) == "BOOLEAN", F.to_json(exists)).otherwise(F.lit("unknown")),
        F.lit(";details="), details.cast("string"),
    )
    at = F.lit(observed_at).cast("long").alias("observed_at")
    nodes = documents.select(
        F.lit("es").alias("source_kind"), F.lit(doc_instance).alias("source_instance"), "local_id", F.lit("asset").alias("node_kind"),
        F.concat(F.lit(f"es://{doc_instance}/json/"), c("local_id")).alias("native_ref"), F.lit("runtime status").alias("display_name"),
        c("pointer").alias("native_pointer"), fingerprint.alias("fingerprint"), at,
    )
    crosses = documents.select(
        F.lit("es").alias("from_kind"), F.lit(doc_instance).alias("from_instance"), c("local_id").alias("from_local_id"),
        F.lit(target[0]).alias("to_kind"), F.lit(target[1]).alias("to_instance"), F.lit(target[2]).alias("to_local_id"),
        F.lit(G.HAS_RUNTIME_STATUS).alias("edge_kind"), F.lit(G.OBSERVED).alias("confidence"), at,
    )
    return G.skeleton(documents.sparkSession, nodes, cross_edges=crosses)


def inventory_skeleton(
    inventory: DataFrame, root: str, instance: str, pipeline: tuple[str, str], kind: str = "fs", observed_at: int = 0,
    pointer_scheme: str = "fs-index",
) -> G.Skeleton:
    """Root, groups and assets of a pipeline's input files (group_name, path, display_name, hint),
    contains edges between them and a parsed-to edge from every asset to the pipeline."""
    spark = inventory.sparkSession
    at = F.lit(observed_at).cast("long").alias("observed_at")

    def node(df, local, node_kind, name, fingerprint, ord_):
        return df.select(
            F.lit(kind).alias("source_kind"), F.lit(instance).alias("source_instance"), local.alias("local_id"),
            F.lit(node_kind).alias("node_kind"), F.concat(F.lit(f"{kind}://{instance}"), local).alias("native_ref"), name.alias("display_name"),
            F.concat_ws(":", F.lit(pointer_scheme), F.lit(instance), local).alias("native_pointer"), fingerprint.cast("string").alias("fingerprint"),
            at, F.lit(ord_).alias("ord"),
        )

    group_id = F.concat_ws("/", F.lit(root), c("group_name"))
    roots = node(inventory.select(F.lit(root).alias("r")).distinct(), c("r"), "root", F.lit(root), F.lit(None), 0)
    groups = node(inventory.select("group_name").distinct(), group_id, "namespace", c("group_name"), F.lit(None), 1)
    assets = node(inventory, c("path"), "asset", c("display_name"), c("hint"), 2)
    pipes = inventory.select(F.lit(pipeline[1]).alias("p")).distinct().select(
        F.lit("pipeline").alias("source_kind"), F.lit(pipeline[0]).alias("source_instance"), c("p").alias("local_id"), F.lit("root").alias("node_kind"),
        F.concat(F.lit("pipeline://"), c("p")).alias("native_ref"), F.concat(c("p"), F.lit(" pipeline")).alias("display_name"),
        F.concat(F.lit("pipeline:"), c("p")).alias("native_pointer"), F.lit(None).cast("string").alias("fingerprint"), at, F.lit(0).alias("ord"),
    )
    edge = lambda df, a, b: df.select(
        F.lit(kind).alias("source_kind"), F.lit(instance).alias("source_instance"), a.alias("from_local_id"), b.alias("to_local_id"),
        F.lit(G.CONTAINS).alias("edge_kind"), F.lit(G.OBSERVED).alias("confidence"), at,
    )
    edges = edge(inventory.select("group_name").distinct(), F.lit(root), group_id).unionByName(edge(inventory, group_id, c("path")))
    parsed = inventory.select(
        F.lit(kind).alias("from_kind"), F.lit(instance).alias("from_instance"), c("path").alias("from_local_id"), F.lit("pipeline").alias("to_kind"),
        F.lit(pipeline[0]).alias("to_instance"), F.lit(pipeline[1]).alias("to_local_id"), F.lit(G.PARSED_TO).alias("edge_kind"),
        F.lit(G.DECLARED).alias("confidence"), at,
    )
    nodes = first_nodes(roots.unionByName(groups).unionByName(assets).unionByName(pipes))
    return G.skeleton(spark, nodes, edges, parsed.distinct())
