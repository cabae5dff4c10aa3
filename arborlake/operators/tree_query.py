"""User queries on trees: listings, pages, statistics envelopes and fresh finds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.functions import paths as P
from arborlake.functions.predicates import check_tree_parameters
from arborlake.operators import heads as H
from arborlake.operators import reliability as R
from arborlake.operators import rollup as U
from arborlake.operators.paging import top_per_group
from arborlake.skew import lookup_join
from arborlake.storage import materialize

NODE = ["path", "size", "modified_time_us", "is_dir"]


def _depth_limit(recursive: bool, max_depth: int | None) -> int | None:
    return max_depth if recursive else 1


def _within(query: str, limit: int | None) -> Column:
    depth = P.relative_depth("path", query)
    return depth.isNotNull() & (F.lit(True) if limit is None else depth <= limit)


def list_nodes(
    state: DataFrame, query: str, as_of_us: int, recursive: bool = True, max_depth: int | None = None
) -> DataFrame:
    """Live nodes at and below the query path with their flags, in groups that know the path;
    groups that do not list the rebased nodes."""
    limit = _depth_limit(recursive, max_depth)
    direct = U.live(state.where(P.is_under("path", query)))
    both = direct
    unknown = U.unknown_groups(state, query)
    if unknown is not None:
        both = direct.unionByName(U.rebased_nodes(unknown(state), query).select(*direct.columns))
    return both.where(_within(query, limit)).select(
        "group_id",
        *NODE,
        P.file_name("path").alias("file_name"),
        "monitoring_attested",
        U.is_suspect(as_of_us).alias("is_suspect"),
        F.col("blind_spot").alias("is_blind_spot"),
        "subtree_changed_at_us",
    )


def children(state: DataFrame, query: str) -> DataFrame:
    """Live rows whose parent is the query path; placeholders are not rows."""
    return U.live(state).where(P.is_under("path", query) & (P.parent_path("path") == query))


def node_set_reliability(nodes: DataFrame, by: str = "group_id") -> DataFrame:
    code = R.reason_code(F.col("monitoring_attested"), F.col("is_suspect"), F.col("is_blind_spot"))
    return nodes.groupBy(by).agg(F.max(code).alias("reason_code")).select(
        by, F.col("reason_code").isNull().alias("reliable"), R.reason_label(F.col("reason_code")).alias("unreliable_reason")
    )


def _root_facts(rows: DataFrame, query: str, as_of_us: int = 0) -> DataFrame:
    """Everything a page head needs from a subtree, in one aggregation."""
    at_root = F.col("path") == query
    alive_root = at_root & U.alive()
    code = R.reason_code(F.col("monitoring_attested"), U.is_suspect(as_of_us), F.col("blind_spot"))
    return rows.groupBy("group_id").agg(
        F.count_if(alive_root).alias("_alive"),
        F.max(F.when(alive_root, F.col("size"))).alias("_size"),
        F.max(F.when(alive_root, F.col("modified_time_us"))).alias("_mtime"),
        F.max(F.when(alive_root, F.col("is_dir"))).alias("_is_dir"),
        F.count_if(U.alive()).alias("_live"),
        F.count_if(U.alive() & (P.parent_path("path") == query)).alias("_kids"),
        F.max(F.when(alive_root, code)).alias("_root"),
        F.max(F.when(alive_root, F.col("subtree_changed_at_us"))).alias("_root_anchor"),
        F.max(F.when(U.alive() & ~F.col("monitoring_attested"), F.lit(0))).alias("_unattested"),
        F.max(F.when(U.alive() & F.col("blind_spot"), F.lit(2))).alias("_blind"),
    )


_FACTS = ["_root", "_root_anchor", "_unattested", "_blind"]


def _root_row(mode: str, query: str, exists: Column, has_children: Column) -> list[Column]:
    return [
        F.col("group_id"), F.lit(mode).alias("mode"), F.lit(query).alias("path"), F.coalesce("_size", F.lit(0)).alias("size"),
        F.coalesce("_mtime", F.lit(0)).alias("modified_time_us"), F.coalesce("_is_dir", F.lit(True)).alias("is_dir"),
        exists.alias("exists"), has_children.alias("has_children"),
    ]


def _roots(state: DataFrame, query: str, unknown, as_of_us: int = 0, stored: DataFrame | None = None) -> DataFrame:
    q = query or P.SLASH
    kids = F.coalesce("_kids", F.lit(0)) > 0
    code = R.reason_code(F.col("monitoring_attested"), U.is_suspect(as_of_us), F.col("blind_spot"))
    if stored is None:
        found = _root_facts(state.where(P.is_under("path", query)), q, as_of_us)
    else:
        found = H.root_facts(stored, state, query, code)
    rows = found.select(
        *_root_row("direct", q, F.col("_live") > 0, F.coalesce("_is_dir", F.lit(True)) & kids), *_FACTS
    )
    if unknown is None:
        return rows
    nodes = _root_facts(U.rebased_nodes(unknown(state), query), q, as_of_us)
    every = unknown((state if stored is None else stored).select("group_id").distinct())
    return rows.unionByName(
        every.join(nodes, "group_id", "left").select(*_root_row("rebased", q, F.col("_live").isNotNull(), kids), *_FACTS)
    )


def page_roots(state: DataFrame, query: str) -> DataFrame:
    """The root row of a page, one per group."""
    return _roots(state, query, U.unknown_groups(state, query)).drop(*_FACTS)


@dataclass(frozen=True)
class TreeResult:
    heads: DataFrame
    entries: DataFrame


def _page(rows: DataFrame, order: Column, limit: int | None, offset: int) -> DataFrame:
    if limit is None:
        return rows.withColumn("position", F.lit(None).cast("int"))
    return top_per_group(rows, ["group_id"], [order], limit, offset)


def tree(
    state: DataFrame,
    groups: DataFrame,
    query: str = P.SLASH,
    *,
    as_of_us: int,
    recursive: bool = True,
    max_depth: int | None = None,
    offset: int = 0,
    limit: int | None = None,
    read_class: str = "materialized",
    only_groups: list[str] | None = None,
    stored: DataFrame | None = None,
) -> TreeResult:
    """Root, entries, reliability and stability of a path per group.

    ``groups`` has (group_id, overflow_pending, coverage_recovered_at_us). Known paths are listed
    in pre-order, rebased ones in byte order. With ``stored`` heads the root, the groups that know the path and the
    children of listed directories come from them, and the subtree is read for its entries alone.
    """
    check_tree_parameters(path=query, max_depth=max_depth, read_class=read_class)
    if only_groups is not None:
        state = state.where(F.col("group_id").isin(only_groups))
        stored = None if stored is None else stored.where(F.col("group_id").isin(only_groups))
    depth_limit = _depth_limit(recursive, max_depth)
    asked_groups = groups if only_groups is None else None
    if stored is None or query in ("", P.SLASH):
        unknown = U.unknown_groups(state, query, asked_groups)
    else:
        unknown = H.unknown_groups(stored, state, query, asked_groups)
    roots = _roots(state, query, unknown, as_of_us, stored)
    evidence = ["monitoring_attested", "blind_spot", "suspect_until_us", "subtree_changed_at_us"]
    q = query or P.SLASH

    below = U.live(state.where(P.is_under("path", query)))
    entry_rows = below.where((F.col("path") != q) & _within(q, depth_limit)).select("group_id", *NODE, *evidence)
    paged = _page(entry_rows, P.preorder_key("path"), limit, offset)
    if stored is None:
        parents = below.select("group_id", P.parent_path("path").alias("path")).where("path is not null")
    else:
        parents = stored.where("children > 0").select("group_id", F.col("dir").alias("path"))
    if limit is not None:
        # the page is small: keep it, and look for children of its own directories only
        paged = materialize(paged, "page")
        parents = lookup_join(parents, paged.where("is_dir").select("group_id", "path"), ["group_id", "path"], "left_semi")
    direct = paged.join(parents.distinct().withColumn("_kids", F.lit(True)), ["group_id", "path"], "left").withColumn(
        "has_children", F.col("is_dir") & F.coalesce("_kids", F.lit(False))
    ).drop("_kids")
    entries = direct
    rebased = None
    if unknown is not None:
        rebased = U.rebased_nodes(unknown(state), query)
        moved = rebased.where((F.col("path") != q) & _within(q, depth_limit)).select("group_id", *NODE, *evidence)
        kids = rebased.select("group_id", P.parent_path("path").alias("path")).where("path is not null").distinct()
        listed = _page(moved, F.col("path"), limit, offset).join(
            kids.withColumn("has_children", F.lit(True)), ["group_id", "path"], "left"
        ).withColumn("has_children", F.coalesce("has_children", F.lit(False)))
        entries = direct.unionByName(listed)

    code = R.reason_code(F.col("monitoring_attested"), U.is_suspect(as_of_us), F.col("blind_spot"))
    page_facts = entries.groupBy("group_id").agg(
        F.max(code).alias("_page"), F.max("subtree_changed_at_us").alias("_page_anchor"), F.count("*").alias("returned_entries")
    )
    asked = groups.select("group_id", "overflow_pending", "coverage_recovered_at_us")
    if only_groups is not None:
        asked = asked.where(F.col("group_id").isin(only_groups))
    # a group without any state answers too, with a root that does not exist
    nothing = {
        "mode": F.lit("direct" if q == P.SLASH else "rebased"), "path": F.lit(q), "size": F.lit(0), "modified_time_us": F.lit(0),
        "is_dir": F.lit(True), "exists": F.lit(False), "has_children": F.lit(False), "overflow_pending": F.lit(False),
    }
    heads = asked.join(roots, "group_id", "left").join(page_facts, "group_id", "left").withColumns(
        {name: F.coalesce(name, value) for name, value in nothing.items()}
    )
    if limit is None:
        anchors = U.quiet_anchor(state, q)
        reason = R.worst(F.col("_page"), F.col("_root"), R.overflow_code(F.col("overflow_pending")))
        heads = heads.join(anchors, "group_id", "left").withColumn("_anchor", F.col("quiet_anchor_us"))
    else:
        # a paged read knows the flags of its page and root, and two facts of the whole subtree
        heads = heads.withColumn("_anchor", F.greatest("_page_anchor", "_root_anchor"))
        reason = R.worst(
            F.col("_page"), F.col("_root"), F.col("_unattested"), F.col("_blind"), R.overflow_code(F.col("overflow_pending"))
        )
    if rebased is not None:
        shown = rebased.where((F.col("path") == q) | _within(q, depth_limit))
        moved_facts = shown.groupBy("group_id").agg(F.max(code).alias("_rebased")).join(
            rebased.groupBy("group_id").agg(F.max("subtree_changed_at_us").alias("_rebased_anchor")), "group_id", "full_outer"
        )
        heads = heads.join(moved_facts, "group_id", "left")
        is_moved = F.col("mode") == "rebased"
        reason = F.when(is_moved, R.worst(F.col("_rebased"), R.overflow_code(F.col("overflow_pending")))).otherwise(reason)
        heads = heads.withColumn("_anchor", F.when(is_moved, F.col("_rebased_anchor")).otherwise(F.col("_anchor")))
    heads = heads.withColumn("reason_code", reason)
    verdict = R.stability(
        F.col("reason_code"), F.col("overflow_pending"), F.col("_anchor"), F.col("coverage_recovered_at_us"),
        F.lit(as_of_us), evaluate=read_class != "fresh",
    )
    heads = heads.select(
        "group_id", "mode", *NODE, "exists", "has_children",
        F.coalesce("returned_entries", F.lit(0)).alias("returned_entries"),
        F.col("reason_code").isNull().alias("reliable"),
        R.reason_label(F.col("reason_code")).alias("unreliable_reason"),
        *[c.alias(n) for n, c in verdict.items()],
    )
    shown_entries = entries.select(
        "group_id", "path", P.relative_depth("path", q).alias("depth"), "size", "modified_time_us", "is_dir",
        "has_children", "position",
    )
    return TreeResult(heads, shown_entries)


def stats(
    state: DataFrame, query: str = P.SLASH, failed: DataFrame | None = None, raw_blind_spots: bool = False, stored: DataFrame | None = None
) -> DataFrame:
    """Statistics per group in an ok/error envelope. The published blind-spot count is always 0;
    ``raw_blind_spots`` shows the real one. ``failed`` has (group_id, message). With ``stored`` heads no subtree is read."""
    counted = U.subtree_stats(state, query) if stored is None else H.subtree_stats(stored, state, query)
    if not raw_blind_spots:
        counted = counted.withColumn("blind_spot_count", F.lit(0).cast("long"))
    if failed is None:
        return counted.withColumn("status", F.lit("ok")).withColumn("message", F.lit(None).cast("string"))
    joined = counted.join(failed.select("group_id", "message"), "group_id", "full_outer")
    bad = F.col("message").isNotNull()
    values = [c for c in counted.columns if c != "group_id"]
    return joined.select(
        "group_id", *[F.when(~bad, F.col(c)).alias(c) for c in values],
        F.when(bad, F.lit("error")).otherwise(F.lit("ok")).alias("status"), "message",
    )


class PartialResultError(RuntimeError):
    """A trusted read met a group that failed or answered in part."""


def require_complete(envelopes: DataFrame) -> DataFrame:
    bad = envelopes.where("status <> 'ok'").orderBy("group_id").first()
    if bad is not None:
        raise PartialResultError(f"group {bad.group_id!r}: {bad.message}")
    return envelopes


def fresh_find(log: DataFrame, query: str = P.SLASH, by: str = "origin_id") -> DataFrame:
    """Winner per origin and rebased path: the greatest modification time; a delete beats an update
    of the same time, otherwise the first to arrive stays. Deleted paths are left out.

    Runs as one partial aggregation, so a path with very many records is reduced before the shuffle.
    """
    rank = F.struct(
        F.col("mtime_us"), (F.col("event_kind") == S.DELETE).cast("int").alias("_d"), (-F.col("seq")).alias("_s")
    )
    node = F.struct("size", "mtime_us", "is_dir", "event_kind", "seq")
    best = (
        log.withColumn("_to", P.rebase("path", query)).where("_to is not null")
        .groupBy(by, F.col("_to").alias("path"))
        .agg(F.max_by(node, rank).alias("n"))
        .where(F.col("n.event_kind") != S.DELETE)
    )
    return best.select(
        by, "path", P.file_name("path").alias("file_name"), F.col("n.size").alias("size"),
        F.col("n.mtime_us").alias("modified_time_us"), F.col("n.is_dir").alias("is_dir"),
        F.lit(True).alias("monitoring_attested"), F.lit(False).alias("is_suspect"), F.lit(False).alias("is_blind_spot"),
    )


def fresh_payload(
    nodes: DataFrame, query: str, by: str = "origin_id", recursive: bool = True, max_depth: int | None = None
) -> TreeResult:
    """Page root and entries of a fresh result; a missing root does not exist, whatever is below."""
    q = query
    at_root = F.col("path") == q
    heads = nodes.groupBy(by).agg(
        F.count_if(at_root).alias("_alive"),
        F.max(F.when(at_root, F.col("size"))).alias("_size"),
        F.max(F.when(at_root, F.col("modified_time_us"))).alias("_mtime"),
        F.max(F.when(at_root, F.col("is_dir"))).alias("_is_dir"),
        F.count_if(P.parent_path("path") == q).alias("_kids"),
        F.count_if(~at_root).alias("_others"),
    ).select(
        by,
        F.lit(q).alias("path"),
        F.coalesce("_size", F.lit(0)).alias("size"),
        F.coalesce("_mtime", F.lit(0)).alias("modified_time_us"),
        F.coalesce("_is_dir", F.lit(True)).alias("is_dir"),
        (F.col("_alive") > 0).alias("exists"),
        F.when(F.col("_alive") > 0, F.col("_kids") > 0).otherwise(F.col("_others") > 0).alias("has_children"),
    )
    kids = nodes.select(by, P.parent_path("path").alias("path")).where("path is not null").distinct().withColumn(
        "has_children", F.lit(True)
    )
    entries = (
        nodes.where(~at_root & _within(q, _depth_limit(recursive, max_depth)))
        .join(kids, [by, "path"], "left")
        .select(
            by, "path", P.relative_depth("path", q).alias("depth"), "size", "modified_time_us", "is_dir",
            F.coalesce("has_children", F.lit(False)).alias("has_children"),
        )
    )
    return TreeResult(heads, entries)


def find_node(state: DataFrame, path: str) -> DataFrame:
    """The live node at an exact path in the first group, by group key, that has one."""
    return U.live(state).where(F.col("path") == path).orderBy("group_id").limit(1)


def merge_responses(responses: DataFrame) -> DataFrame:
    """Union by path of responses numbered ``response_no``; the last one wins."""
    names = [c for c in responses.columns if c not in ("path", "response_no")]
    best = responses.groupBy("path").agg(F.max_by(F.struct(*names), "response_no").alias("n"))
    return best.select("path", *[F.col(f"n.{n}").alias(n) for n in names])


def merge_reliability(responses: DataFrame) -> DataFrame:
    """One row (reliable, unreliable_reason) for responses with a ``reason_code`` each, null where reliable: the
    worst reason of all. Without responses the result is reliable."""
    return responses.agg(F.max("reason_code").alias("reason_code")).select(
        F.col("reason_code").isNull().alias("reliable"), R.reason_label(F.col("reason_code")).alias("unreliable_reason")
    )
