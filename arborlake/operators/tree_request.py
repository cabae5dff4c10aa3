"""One request for a tree: trusted or not, groups ranked and paged, entries paged inside them, one byte budget.

A request is frozen by what it reads, not by a copy of it: state versions never change, so a result is the number of a
version, the ranks of its groups and the request. Any session pages on by the result's id in a signed cursor, and
following the cursors gives every entry once.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions import paths as P
from arborlake.functions.predicates import check_tree_parameters
from arborlake.operators import frozen as Z
from arborlake.operators import heads as H
from arborlake.operators import status as T
from arborlake.operators import tree_query as Q
from arborlake.operators.paging import PageBudgetError, rank_groups
from arborlake.sources.state_store import StateStore
from arborlake.storage import materialize


@dataclass(frozen=True)
class TreeRequest:
    path: str = P.SLASH
    recursive: bool = True
    max_depth: int | None = None
    group_order: str = "group-key"
    group_page_size: int = 50
    entry_page_size: int = 1_000
    limit_bytes: int | None = None
    read_class: str = T.TRUSTED


@dataclass(frozen=True)
class Evidence:
    """What tells whether a materialized read can be trusted (see ``status.trust_gate``)."""

    source: T.SourceStatus
    sink: DataFrame
    schedule: DataFrame


@dataclass(frozen=True)
class TreePage:
    id: str
    state: str  # trust of the observation when the request was opened
    heads: DataFrame  # one row for each group of the page, with rank and metric
    entries: DataFrame  # with rank and position
    cursor: str | None  # of the next page


def open_request(
    store: StateStore, request: TreeRequest, evidence: Evidence, scope: str, secret: bytes, as_of_us: int, ttl_ms: int = 60_000, now_ms: int | None = None
) -> TreePage:
    """The first page. A trusted read that the evidence does not allow raises ``NotReady`` before any row is read."""
    check_tree_parameters(
        path=request.path, group_page_size=request.group_page_size, entry_page_size=request.entry_page_size, group_order=request.group_order,
        read_class=request.read_class, max_depth=request.max_depth,
    )
    version = store.latest()
    if version is None:
        raise T.NotReady("nothing has been stored")
    state, groups, _ = store.read(version)
    trust = T.trust_gate(request.read_class, evidence.source, evidence.sink, evidence.schedule, groups.select("group_id"))
    if request.group_order == "group-key":
        stats = groups.select("group_id")
    else:
        stats = H.subtree_stats(store.heads(version), state, request.path, groups)
    about = {"store": store.folder, "version": version.number, "as_of_us": as_of_us, "trust": trust, "request": asdict(request)}
    frozen = Z.freeze(rank_groups(groups, stats, request.group_order), scope, about, ttl_ms, now_ms)
    return _page(store, frozen, secret, {"id": frozen.id, "groups": 0, "entries": 0, "cut": None})


def next_page(store: StateStore, cursor: str, scope: str, secret: bytes, now_ms: int | None = None) -> TreePage:
    """The page that a cursor stands for. Unknown and expired results, foreign scopes and forged cursors raise."""
    at = Z.positions_of(cursor, secret)
    return _page(store, Z.find(store.spark, at["id"], scope, now_ms), secret, at)


def _page(store: StateStore, frozen: Z.Frozen, secret: bytes, at: dict) -> TreePage:
    request, as_of_us = TreeRequest(**frozen.about["request"]), frozen.about["as_of_us"]
    version = next(v for v in store.versions() if v.number == frozen.about["version"])
    state, groups, _ = store.read(version)
    ranks = Z.rows_of(store.spark, frozen)
    first, last = at["groups"], at["groups"] + request.group_page_size
    # at most a page of groups, and one more
    listed = ranks.where((F.col("rank") > first) & (F.col("rank") <= last + 1)).orderBy("rank").collect()
    shown, more_groups = [r for r in listed if r.rank <= last], any(r.rank > last for r in listed)
    tree = Q.tree(
        state, groups, request.path, as_of_us=as_of_us, recursive=request.recursive, max_depth=request.max_depth, offset=at["entries"],
        limit=request.entry_page_size, read_class=request.read_class, only_groups=[r.group_id for r in shown], stored=store.heads(version),
    )
    ranked = F.broadcast(store.spark.createDataFrame(shown, ranks.schema))
    heads = materialize(tree.heads.join(ranked, "group_id"), "request-heads")
    entries = tree.entries.join(ranked.select("group_id", "rank"), "group_id")
    if at["cut"]:
        entries = entries.where(F.struct("rank", "position") > F.struct(*[F.lit(x).cast("int") for x in at["cut"]]))
    entries, cut = _within_budget(materialize(entries, "request-entries"), request.limit_bytes)
    following = None
    if cut:
        following = at | {"cut": cut}
    elif heads.where(F.col("returned_entries") >= request.entry_page_size).count():
        following = at | {"entries": at["entries"] + request.entry_page_size, "cut": None}
    elif more_groups:
        following = at | {"groups": last, "entries": 0, "cut": None}
    return TreePage(frozen.id, frozen.about["trust"], heads, entries, following and Z.cursor_of(following, secret))


def _within_budget(entries: DataFrame, limit_bytes: int | None) -> tuple[DataFrame, list[int] | None]:
    """The entries, in order of rank and position, whose JSON fits the budget, and the place of the last one if some
    do not. What the groups before a group take is summed once for each group."""
    if limit_bytes is None:
        return entries, None
    sized = entries.withColumn("_bytes", F.octet_length(F.to_json(F.struct(*entries.columns))) + 1)
    totals = sized.groupBy("rank").agg(F.sum("_bytes").alias("_all"))
    before = totals.select("rank", (F.sum("_all").over(W.orderBy("rank")) - F.col("_all")).alias("_before"))
    inside = F.sum("_bytes").over(W.partitionBy("rank").orderBy("position"))
    placed = sized.join(F.broadcast(before), "rank").withColumn("_end", F.col("_before") + inside)
    kept = materialize(placed.where(F.col("_end") <= limit_bytes).select(*entries.columns), "request-kept")
    last = kept.agg(F.max(F.struct("rank", "position")).alias("at"), F.count("*").alias("n")).first()
    if last.n == entries.count():
        return kept, None
    if not last.n:
        raise PageBudgetError(f"no entry fits {limit_bytes} bytes")
    return kept, [last["at"]["rank"], last["at"]["position"]]
