"""Search-index documents: pages, polls, rows and field mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.predicates import effective_limit
from arborlake.operators.paging import KeysetPage, keyset_page
from arborlake.storage import materialize

DEFAULT_PAGE, MAX_PAGE = 100, 1_000


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split("."))


def document_rows(hits: DataFrame, timestamp_field: str, kind: str = "snapshot", timestamp_type: str = "string") -> DataFrame:
    """Document events from (index, id, source JSON, routing, seq_no, primary_term). The timestamp
    is a dotted path into the source; only objects are walked. It is read as ``timestamp_type``, and null
    where it is no value of that type."""
    have = set(hits.columns)
    opt = lambda n, t: (F.col(n) if n in have else F.lit(None)).cast(t)
    routing = opt("routing", "string")
    return hits.select(
        F.lit(kind).alias("event_kind"), "index", "id",
        F.get_json_object("source", _json_path(timestamp_field)).try_cast(timestamp_type).alias("timestamp_value"),
        opt("seq_no", "long").alias("seq_no"), opt("primary_term", "long").alias("primary_term"), "source",
        F.when(routing.isNotNull(), F.create_map(F.lit("_routing"), routing))
        .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _projected(value: Column, fields: list[str]) -> Column:
    """JSON text of an object cut to dotted fields, null if it has none of them; members keep their values."""
    below: dict[str, list[str]] = {}
    for field in fields:
        head, _, rest = field.partition(".")
        below.setdefault(head, []).append(rest)
    members = []
    for head, rests in below.items():
        inner = F.variant_get(value, f'$["{head}"]', "variant")
        kept = F.to_json(inner) if "" in rests else _projected(inner, rests)
        members.append(F.concat(F.to_json(F.lit(head).cast("variant")), F.lit(":"), kept))
    listed = F.array_compact(F.array(*members))
    return F.when(F.size(listed) > 0, F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")))


def project_source(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Keep only the named members of the source, in the order of ``fields``; a dotted name keeps a member of a
    nested object. Objects inside arrays are not walked. A source with none of them becomes ``{}``."""
    if not fields:
        return rows
    kept = F.coalesce(_projected(F.try_parse_json("source"), fields), F.lit("{}"))
    return rows.withColumn("source", F.when(F.col("source").isNotNull(), kept))


def doc_snapshot_all(rows: DataFrame, index: str | None = None, condition: Column | None = None, fields: list[str] | None = None) -> DataFrame:
    """All documents, of one index if given."""
    chosen = rows if index is None else rows.where(F.col("index") == index)
    return project_source(chosen if condition is None else chosen.where(condition), fields or [])


def doc_poll_all(
    rows: DataFrame, start=None, timestamp: str = "timestamp_value", index: str | None = None, condition: Column | None = None, fields: list[str] | None = None
) -> DataFrame:
    """All documents from a start time on."""
    chosen = doc_snapshot_all(rows, index, condition, fields)
    return chosen if start is None else chosen.where(F.col(timestamp) >= F.lit(start))


def doc_snapshot(
    rows: DataFrame, timestamp: str = "timestamp_value", condition: Column | None = None, limit: int | None = None, cursor: tuple | None = None,
    index: str | None = None, fields: list[str] | None = None,
) -> KeysetPage:
    """Documents in (timestamp, index, id) order after the cursor, those without a timestamp last."""
    n = effective_limit(limit, DEFAULT_PAGE, MAX_PAGE)
    return keyset_page(doc_snapshot_all(rows, index, condition, fields), [timestamp, "index", "id"], n, cursor)


def doc_poll(
    rows: DataFrame, start=None, timestamp: str = "timestamp_value", tie_breaker: str = "id", condition: Column | None = None,
    limit: int | None = None, cursor: tuple | None = None, index: str | None = None, fields: list[str] | None = None,
) -> KeysetPage:
    """Documents from a start time on that match the condition, strictly after the (timestamp, index, tie breaker) cursor."""
    n = effective_limit(limit, DEFAULT_PAGE, MAX_PAGE)
    return keyset_page(doc_poll_all(rows, start, timestamp, index, condition, fields), [timestamp, "index", tie_breaker], n, cursor)


_CHILDREN = "map<string,string>"


def _entries(json: Column) -> Column:
    """Key and JSON text of every member of an object; anything else gives no rows."""
    return F.map_entries(F.from_json(json, _CHILDREN))


def flatten_mapping(mappings: DataFrame) -> DataFrame:
    """(index, name, field_type) of nested mapping documents (index, mapping JSON).

    Nested ``properties`` and multi ``fields`` become dotted names. Every object with a
    ``properties`` member starts a naming of its own, so nested fields also appear under the
    shorter names seen from there. One pass per nesting level, each
    over the whole table of mappings; ``_id`` and ``_index`` are added; one row per name, a typed
    one before an untyped one.
    """
    # find the objects that hold a properties member, at any depth of wrapping
    level = mappings.select("index", F.col("mapping").alias("j"))
    roots = None
    while True:
        found = level.where(F.get_json_object("j", "$.properties").isNotNull()).select(
            "index", F.lit("").alias("prefix"), F.get_json_object("j", "$.properties").alias("props")
        )
        roots = found if roots is None else roots.unionByName(found)
        inner = level.select("index", F.explode(_entries(F.col("j"))).alias("e")).select("index", F.col("e.value").alias("j"))
        level = materialize(inner.where(F.col("j").startswith("{")), "mapping-objects")
        if level.isEmpty():
            break
    roots = materialize(roots, "mapping-roots")
    out, level = None, roots
    while True:
        named = level.select("index", "prefix", F.explode(_entries(F.col("props"))).alias("e")).select(
            "index",
            F.when(F.col("prefix") == "", F.col("e.key")).otherwise(F.concat_ws(".", "prefix", "e.key")).alias("name"),
            F.col("e.value").alias("d"),
        )
        typed = named.select("index", "name", F.get_json_object("d", "$.type").alias("field_type")).where("field_type is not null")
        out = typed if out is None else out.unionByName(typed)
        nested = named.select(
            "index", F.col("name").alias("prefix"),
            F.explode(F.array(F.get_json_object("d", "$.properties"), F.get_json_object("d", "$.fields"))).alias("props"),
        )
        level = materialize(nested.where("props is not null"), "mapping-level")
        if level.isEmpty():
            break
    builtin = mappings.select("index").distinct().select("index", F.explode(F.array(
        F.struct(F.lit("_id").alias("name"), F.lit("keyword").alias("field_type")),
        F.struct(F.lit("_index").alias("name"), F.lit("keyword").alias("field_type")),
    )).alias("f")).select("index", "f.name", "f.field_type")
    return out.unionByName(builtin).groupBy("index", "name").agg(
        F.min("field_type").alias("field_type")
    )
