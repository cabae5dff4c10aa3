"""The provenance graph: nodes, edges and evidence of all sources under one global id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import ids
from arborlake.schemas import _schema
from arborlake.skew import SALTS, lookup_join
from arborlake.storage import materialize

# The place of a row in what was put together: the skeleton it came with, then its place in that.
RANK = ("part", "ord")
#: Rows that one task of an upsert sorts.
TASK_ROWS = 50_000

SOURCE_NODE = _schema(
    """source_kind string, source_instance string, local_id string, node_kind string, native_ref string,
    display_name string, native_pointer string, fingerprint string, observed_at long, grant_epoch long, ord long"""
)
SOURCE_EDGE = _schema(
    """source_kind string, source_instance string, from_local_id string, to_local_id string, edge_kind string,
    evidence_ref string, confidence string, observed_at long, grant_epoch long, ord long"""
)
CROSS_EDGE = _schema(
    """from_kind string, from_instance string, from_local_id string, to_kind string, to_instance string,
    to_local_id string, edge_kind string, evidence_ref string, confidence string, observed_at long, grant_epoch long,
    ord long"""
)
ANCHOR = _schema(
    """source_kind string, source_instance string, native_ref string, native_pointer string, native_version string,
    cache_pointer string, grant_epoch long"""
)
EVIDENCE = _schema(
    """evidence_id string, anchor anchor, observed_by string, observation_kind string, observed_at long,
    watermark string, adapter_version string, confidence string, ord long""",
    anchor=ANCHOR,
)
_REFS = T.ArrayType(T.StringType())
NODE = T.StructType([T.StructField("gid", T.StringType()), *[f for f in SOURCE_NODE.fields if f.name not in RANK],
                     T.StructField("evidence_refs", _REFS)])
EDGE = T.StructType([
    *_schema("edge_id string, source_gid string, target_gid string, edge_kind string, confidence string, "
             "observed_at long, grant_epoch long").fields,
    T.StructField("evidence_refs", _REFS),
])

# Fixed values of the graph model.
CONTAINS, HAS_FIELD, PARSED_TO, LOADED_INTO = "contains", "has-field", "parsed-to", "loaded-into"
PROJECTED_AS, DECLARES_SCHEMA, HAS_RUNTIME_STATUS = "projected-as", "declares-schema", "has-runtime-status"
OBSERVED, DECLARED, INFERRED = "observed", "declared", "inferred"


@dataclass(frozen=True)
class Labels:
    """Names that derived evidence carries. Give your own to keep names already in use."""

    observers: dict | None = None
    adapter_version: str = "graph-v1"
    graph_name: str = "graph"

    def observer(self, kind: Column) -> Column:
        known = self.observers or {k: f"{k}-adapter" for k in ("fs", "local-fs", "s3", "es", "mysql", "pg")}
        out = F.when(F.lit(False), F.lit(""))
        for k, v in known.items():
            out = out.when(kind == k, F.lit(v))
        return out.otherwise(F.lit("source-adapter"))


@dataclass(frozen=True)
class Skeleton:
    nodes: DataFrame
    edges: DataFrame
    cross_edges: DataFrame
    evidence: DataFrame
    parts: int = 1

    def union(self, other: "Skeleton") -> "Skeleton":
        """The rows of both; those of ``other`` come after all of these."""
        later = F.col("part") + self.parts
        tables = [getattr(self, n).unionByName(getattr(other, n).withColumn("part", later)) for n in ("nodes", "edges", "cross_edges", "evidence")]
        return Skeleton(*tables, parts=self.parts + other.parts)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame


def empty_graph(spark: SparkSession) -> Graph:
    evidence = T.StructType([f for f in EVIDENCE.fields if f.name not in RANK])
    return Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), spark.createDataFrame([], evidence))


def skeleton(
    spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None,
    cross_edges: DataFrame | None = None, evidence: DataFrame | None = None,
) -> Skeleton:
    """Complete a partial skeleton; missing columns become null, a missing order 0."""

    def fit(df, schema):
        if df is None:
            return _placed(spark.createDataFrame([], schema))
        have = set(df.columns)
        return _placed(df.select(*[
            (F.col(f.name) if f.name in have else F.lit(0 if f.name in ("ord", "observed_at") else None))
            .cast(f.dataType).alias(f.name) for f in schema.fields
        ], *sorted(have & {"part"})))

    return Skeleton(fit(nodes, SOURCE_NODE), fit(edges, SOURCE_EDGE), fit(cross_edges, CROSS_EDGE), fit(evidence, EVIDENCE))


def _placed(df: DataFrame) -> DataFrame:
    """A missing place counts as 0."""
    return df.withColumns({n: F.lit(0).cast("long") for n in RANK if n not in df.columns})


def node_rows(nodes: DataFrame) -> DataFrame:
    """Source nodes with their global id and evidence; rows that have them stay as they are."""
    if "gid" in nodes.columns:
        return nodes
    gid = ids.graph_gid("source_kind", "source_instance", "local_id")
    return nodes.withColumn("gid", gid).withColumn(
        "evidence_refs", F.array(F.concat(F.lit("evidence:node:"), ids.stable_escape("gid")))
    )


def _given(ref: str, default: Column) -> Column:
    return F.when(F.trim(F.coalesce(F.col(ref), F.lit(""))) == "", default).otherwise(F.col(ref))


def edge_rows(edges: DataFrame) -> DataFrame:
    if "edge_id" in edges.columns:
        return edges
    src = ids.graph_gid("source_kind", "source_instance", "from_local_id")
    dst = ids.graph_gid("source_kind", "source_instance", "to_local_id")
    default = F.concat(
        F.lit("evidence:edge:"),
        F.concat_ws(":", "source_kind", ids.stable_escape("source_instance"), ids.stable_escape("from_local_id"),
                    ids.stable_escape("to_local_id")),
    )
    return _edge_ids(edges.withColumn("source_gid", src).withColumn("target_gid", dst), default)


def cross_edge_rows(edges: DataFrame) -> DataFrame:
    if "edge_id" in edges.columns:
        return edges
    src = ids.graph_gid("from_kind", "from_instance", "from_local_id")
    dst = ids.graph_gid("to_kind", "to_instance", "to_local_id")
    esc = ids.stable_escape
    default = F.concat(
        F.lit("evidence:cross-edge:"),
        F.concat_ws(":", "from_kind", esc("from_instance"), esc("from_local_id"), "to_kind", esc("to_instance"), esc("to_local_id")),
    )
    return _edge_ids(edges.withColumn("source_gid", src).withColumn("target_gid", dst), default)


def _edge_ids(edges: DataFrame, default: Column) -> DataFrame:
    return edges.withColumn("edge_id", ids.graph_edge_id("source_gid", "edge_kind", "target_gid")).withColumn(
        "evidence_refs", F.array(_given("evidence_ref", default))
    )


def _evidence(df, kind, instance, ref, pointer, version, observer, observation, confidence, labels) -> DataFrame:
    return _placed(df).select(
        F.element_at("evidence_refs", 1).alias("evidence_id"),
        F.struct(
            kind.alias("source_kind"), instance.alias("source_instance"), ref.alias("native_ref"),
            pointer.alias("native_pointer"), version.alias("native_version"),
            F.lit(None).cast("string").alias("cache_pointer"), F.col("grant_epoch"),
        ).alias("anchor"),
        observer.alias("observed_by"),
        F.lit(observation).alias("observation_kind"),
        "observed_at",
        F.lit(None).cast("string").alias("watermark"),
        F.lit(labels.adapter_version).alias("adapter_version"),
        confidence.alias("confidence"),
        *RANK,
    )


def node_evidence(rows: DataFrame, labels: Labels = Labels()) -> DataFrame:
    c = F.col
    return _evidence(rows, c("source_kind"), c("source_instance"), c("native_ref"), c("native_pointer"), c("fingerprint"),
                     labels.observer(c("source_kind")), "snapshot", F.lit(OBSERVED), labels)


def edge_evidence(rows: DataFrame, labels: Labels = Labels()) -> DataFrame:
    c = F.col
    arrow = F.concat(c("from_local_id"), F.lit("->"), c("to_local_id"))
    return _evidence(rows, c("source_kind"), c("source_instance"), F.concat(c("edge_kind"), F.lit(":"), arrow), arrow,
                     F.lit(None).cast("string"), labels.observer(c("source_kind")), "snapshot", c("confidence"), labels)


def cross_evidence(rows: DataFrame, labels: Labels = Labels()) -> DataFrame:
    c = F.col
    arrow = F.concat(F.concat_ws(":", "from_kind", "from_instance", "from_local_id"), F.lit("->"),
                     F.concat_ws(":", "to_kind", "to_instance", "to_local_id"))
    return _evidence(rows, F.lit(labels.graph_name), F.lit("cross-source-lineage"),
                     F.concat(c("edge_kind"), F.lit(":"), arrow), arrow, F.lit(None).cast("string"),
                     F.lit(labels.graph_name), "inferred", c("confidence"), labels)


def _last_per(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The last row per key, by rank and, where two rows have one rank, by content.

    Rows are dealt out before they are sorted, so a task sorts about ``TASK_ROWS`` of them whatever the input's size and
    splits. A key of very many rows is first brought down to one row for each salt. Contents are compared as text, which
    is made while rows are compared and neither sorted nor shuffled.
    """
    rank = ["_stage", *[f"_{n}" for n in RANK]]
    tasks = df.count() // TASK_ROWS + 1

    def best(rows: DataFrame, *by: str) -> DataFrame:
        last = F.max_by(F.struct(*names, *rank), F.struct(*rank, F.to_json(F.struct(*names)).alias("content")))
        return rows.repartition(tasks, *by).groupBy(*by).agg(last.alias("_n")).select("_n.*")

    if tasks > 1:
        df = best(df.withColumn("_salt", F.pmod(F.xxhash64(*names, *rank), F.lit(SALTS))), key, "_salt")
    return best(df, key).select(*names)


def _ranked(df: DataFrame, names: list[str], stage: int, last: bool = True) -> DataFrame:
    """Columns with a rank: stage and place; ``last`` wins or the first."""
    df = _placed(df)
    return df.select(*names, F.lit(stage).alias("_stage"), *[(F.col(n) if last else -F.col(n)).alias(f"_{n}") for n in RANK])


def upsert_nodes(existing: DataFrame, nodes: DataFrame) -> DataFrame:
    """Last row per gid; incoming rows come after stored ones."""
    names = NODE.fieldNames()
    both = _ranked(node_rows(nodes), names, 1).unionByName(_ranked(existing, names, 0))
    return _last_per(both, "gid", names)


def upsert_edges(existing: DataFrame, edges: DataFrame, cross_edges: DataFrame) -> DataFrame:
    """Last row per edge id; cross-source edges come after same-source ones."""
    names = EDGE.fieldNames()
    both = _ranked(existing, names, 0).unionByName(_ranked(edge_rows(edges), names, 1)).unionByName(_ranked(cross_edge_rows(cross_edges), names, 2))
    return _last_per(both, "edge_id", names)


def upsert_evidence(existing: DataFrame, sk: Skeleton, labels: Labels = Labels()) -> DataFrame:
    """Given evidence replaces what is stored, the last one wins. Derived evidence only fills ids
    that nothing else has, the first one wins: nodes before edges before cross-source edges."""
    names = [f.name for f in EVIDENCE.fields if f.name not in RANK]
    both = _ranked(sk.evidence, names, 5).unionByName(_ranked(existing, names, 4))
    derived = [
        (node_evidence(node_rows(sk.nodes), labels), 3),
        (edge_evidence(edge_rows(sk.edges), labels), 2),
        (cross_evidence(cross_edge_rows(sk.cross_edges), labels), 1),
    ]
    for df, stage in derived:
        both = both.unionByName(_ranked(df, names, stage, last=False))
    return _last_per(both, "evidence_id", names)


def dangling_edges(nodes: DataFrame, sk: Skeleton) -> DataFrame:
    """Edges whose source or target is no node.

    The distinct endpoints are checked first; a node with very many edges is one row there.
    """
    names = ["edge_id", "source_gid", "target_gid", "edge_kind"]
    edges = edge_rows(sk.edges).select(*names).unionByName(cross_edge_rows(sk.cross_edges).select(*names))
    # dealt out first, so a task holds a bounded number of them whatever the input's splits
    ends = edges.select(F.explode(F.array("source_gid", "target_gid")).alias("gid"), F.pmod(F.xxhash64("edge_id"), F.lit(SALTS)).alias("_salt"))
    ends = ends.repartition(edges.count() // TASK_ROWS + 1, "gid", "_salt").select("gid").distinct()
    missing = ends.join(nodes.select("gid"), "gid", "left_anti")
    src = missing.select(F.col("gid").alias("source_gid"), F.lit(True).alias("no_source"))
    dst = missing.select(F.col("gid").alias("target_gid"), F.lit(True).alias("no_target"))
    return (
        edges.join(src, "source_gid", "left").join(dst, "target_gid", "left")
        .where("no_source or no_target")
        .select(*names, F.coalesce("no_source", F.lit(False)).alias("no_source"), F.coalesce("no_target", F.lit(False)).alias("no_target"))
    )


class DanglingEdges(ValueError):
    """A batch holds edges without an endpoint; nothing of it was applied."""


def ingest(graph: Graph, sk: Skeleton, labels: Labels = Labels()) -> tuple[Graph, DataFrame]:
    """(graph with the skeleton applied, new ids per table). A bad edge rejects the batch."""
    # ids are computed once; the check, the upserts and the evidence all read them
    sk = Skeleton(
        materialize(node_rows(sk.nodes), "graph-nodes"), materialize(edge_rows(sk.edges), "graph-edges"),
        materialize(cross_edge_rows(sk.cross_edges), "graph-cross-edges"), sk.evidence,
    )
    # every new table is computed once, then checked, counted and handed on
    nodes = materialize(upsert_nodes(graph.nodes, sk.nodes), "graph-upserted-nodes")
    bad = dangling_edges(nodes, sk).orderBy("edge_id").first()
    if bad is not None:
        raise DanglingEdges(f"edge {bad.edge_id} has no {'source' if bad.no_source else 'target'} node")
    edges = materialize(upsert_edges(graph.edges, sk.edges, sk.cross_edges), "graph-upserted-edges")
    evidence = materialize(upsert_evidence(graph.evidence, sk, labels), "graph-upserted-evidence")
    counted = [("nodes", nodes, graph.nodes, "gid"), ("edges", edges, graph.edges, "edge_id"),
               ("evidence", evidence, graph.evidence, "evidence_id")]
    ack = None
    for name, new, old, key in counted:
        row = new.select(key).join(old.select(key), key, "left_anti").agg(F.count("*").alias("upserted"))
        row = row.select(F.lit(name).alias("table"), "upserted")
        ack = row if ack is None else ack.unionByName(row)
    return Graph(nodes, edges, evidence), ack


def list_nodes(graph: Graph, source_kind: str | None = None, node_kind: str | None = None, limit: int | None = None) -> DataFrame:
    df = graph.nodes
    for name, value in (("source_kind", source_kind), ("node_kind", node_kind)):
        df = df if value is None else df.where(F.col(name) == value)
    return _limited(df.orderBy("gid"), limit)


def get_node(graph: Graph, gid: str) -> DataFrame:
    return graph.nodes.where(F.col("gid") == gid)


def list_edges(
    graph: Graph, source_gid: str | None = None, target_gid: str | None = None, edge_kind: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    df = graph.edges
    for name, value in (("source_gid", source_gid), ("target_gid", target_gid), ("edge_kind", edge_kind)):
        df = df if value is None else df.where(F.col(name) == value)
    return _limited(df.orderBy("edge_id"), limit)


def neighbors(graph: Graph, gid: str, direction: str = "both", edge_kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges one hop around a node."""
    out, into = F.col("source_gid") == gid, F.col("target_gid") == gid
    cond = {"outgoing": out, "incoming": into, "both": out | into}[direction]
    df = graph.edges.where(cond)
    return _limited((df if edge_kind is None else df.where(F.col("edge_kind") == edge_kind)).orderBy("edge_id"), limit)


def neighbors_of(graph: Graph, gids: DataFrame, direction: str = "both") -> DataFrame:
    """(gid, edge columns) around every node of a table of gids; a loop edge counts once."""
    ends = {"outgoing": ["source_gid"], "incoming": ["target_gid"], "both": ["source_gid", "target_gid"]}[direction]
    lifted = graph.edges.withColumn("gid", F.explode(F.array_distinct(F.array(*ends))))
    return lookup_join(lifted, gids.select("gid").distinct(), ["gid"], "left_semi", salt_from=["edge_id"])


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def coverage(graph: Graph) -> DataFrame:
    """(dimension, value, count): nodes by source kind and by node kind, and the evidence count."""
    parts = [
        graph.nodes.groupBy(F.col(c).alias("value")).count().select(F.lit(c).alias("dimension"), "value", "count")
        for c in ("source_kind", "node_kind")
    ]
    evidence = graph.evidence.agg(F.count("*").alias("count")).select(F.lit("evidence").alias("dimension"), F.lit("all").alias("value"), "count")
    return parts[0].unionByName(parts[1]).unionByName(evidence)
