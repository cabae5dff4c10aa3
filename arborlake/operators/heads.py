"""Heads of directories: what reads must know of a subtree, kept as one row for each directory and group.

All facts but the newest file time are sums, so a batch moves them by the rows that it replaced and the rows that
it wrote; the fold hands both on, and no state is read as a whole. A newest file time is looked up again only where
the file that had it went or became older. Reads take one head row, and the row of the path itself, for each group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import paths as P
from arborlake.operators import rollup as U
from arborlake.storage import materialize

BY = ["group_id", "dir"]
#: Rows and tombstones at or below a directory; then live nodes; ``children`` are those directly inside.
SUMS = [
    "known_rows", "tombstones", "total_nodes", "total_files", "total_dirs", "attested_count", "blind_spot_count", "children", "total_size",
]
HEADS = "group_id string, dir string, " + "".join(f"{c} long, " for c in SUMS) + "latest_file_mtime_us long"


def _lifted(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Facts of rows, with a sign, at every directory they count for; rows are summed by parent before ancestors are listed."""
    facts = [*U.counters(U.alive()), F.count("*").alias("known_rows"), F.count_if("is_tombstoned").alias("tombstones")]
    inside = rows.withColumn("_parent", P.parent_path("path")).where("_parent is not null").groupBy("group_id", "_parent").agg(*facts)
    lifted = inside.withColumn("dir", F.explode(P.self_and_ancestors("_parent"))).withColumn(
        "children", F.when(F.col("dir") == F.col("_parent"), F.col("total_nodes")).otherwise(F.lit(0).cast("long"))
    )
    own = rows.where("is_dir").groupBy("group_id", F.col("path").alias("dir")).agg(*facts).withColumn("children", F.lit(0).cast("long"))
    latest = F.col("latest_file_mtime_us")
    return lifted.drop("_parent").unionByName(own).select(
        *BY, *[(F.col(c).cast(U.TOTAL) * sign).alias(c) for c in SUMS],
        F.when(F.lit(sign > 0), latest).alias("_come"), F.when(F.lit(sign < 0), latest).alias("_gone"),
    )


def build(state: DataFrame) -> DataFrame:
    """The heads of a whole state."""
    sums = [F.sum(c).cast("long").alias(c) for c in SUMS]
    return _lifted(state).groupBy(*BY).agg(*sums, F.max("_come").alias("latest_file_mtime_us"))


def refresh(stored: DataFrame, before: DataFrame, after: DataFrame, state: DataFrame) -> DataFrame:
    """The heads of ``state`` from those of the state before it, the rows that were replaced or went and the rows that came."""
    moves = _lifted(before, -1).unionByName(_lifted(after)).groupBy(*BY).agg(
        *[F.sum(c).alias(f"_{c}") for c in SUMS], F.max("_come").alias("_come"), F.max("_gone").alias("_gone")
    )
    both = stored.join(materialize(moves, "heads-moves"), BY, "full")
    sums = [(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast("long").alias(c) for c in SUMS]
    held, come, gone = F.col("latest_file_mtime_us"), F.col("_come"), F.col("_gone")
    lost = gone.isNotNull() & (gone >= held) & (come.isNull() | (come < held))
    moved = materialize(
        both.select(*BY, *sums, F.greatest(held, come).alias("latest_file_mtime_us"), F.coalesce(lost, F.lit(False)).alias("_lost")).where("known_rows > 0"),
        "heads-moved",
    )
    again = moved.where("_lost").select(*BY)
    files = U.live(state).where("not is_dir").groupBy("group_id", P.parent_path("path").alias("dir")).agg(F.max("modified_time_us").alias("_m"))
    found = (
        files.where("dir is not null").withColumn("dir", F.explode(P.self_and_ancestors("dir"))).join(again, BY, "left_semi")
        .groupBy(*BY).agg(F.max("_m").alias("_m"))
    )
    looked_up = moved.where("_lost").drop("_lost", "latest_file_mtime_us").join(found, BY, "left").withColumnRenamed("_m", "latest_file_mtime_us")
    return moved.where("not _lost").drop("_lost").unionByName(looked_up)


def rollup(heads: DataFrame) -> DataFrame:
    """The heads as ``rollup_tree`` has them."""
    return heads.where("total_nodes > 0").select(*BY, *[c for c in U.ROLLUP_COLUMNS if c not in BY])


def own_row(state: DataFrame, query: str) -> DataFrame:
    """The row of a path itself, tombstones too: an equality that the scan can look for."""
    return state.where(F.col("path") == (query or P.SLASH))


def known(heads: DataFrame, state: DataFrame, query: str) -> DataFrame:
    """Groups whose tree has the path, or rows below it; tombstones make a path known."""
    at = heads.where((F.col("dir") == (query or P.SLASH)) & (F.col("known_rows") > 0)).select("group_id")
    return at.unionByName(own_row(state, query).select("group_id")).distinct()


def unknown_groups(heads: DataFrame, state: DataFrame, query: str, groups: DataFrame | None = None) -> Callable[[DataFrame], DataFrame] | None:
    """``rollup.unknown_groups`` from heads. Without ``groups`` those are asked that have a head of the root."""
    every = heads.where(F.col("dir") == P.SLASH) if groups is None else groups
    return U.missing_groups(every.select("group_id").distinct(), known(heads, state, query))


def subtree_stats(heads: DataFrame, state: DataFrame, query: str, groups: DataFrame | None = None) -> DataFrame:
    """``rollup.subtree_stats`` from one head row for each group that knows the path; the others count their rebased nodes."""
    at = query or P.SLASH
    live_dir = U.alive() & F.col("is_dir")
    own = own_row(state, query).select(
        "group_id", live_dir.cast("int").alias("_total_nodes"), live_dir.cast("int").alias("_total_dirs"),
        (live_dir & F.col("monitoring_attested")).cast("int").alias("_attested_count"), (live_dir & F.col("blind_spot")).cast("int").alias("_blind_spot_count"),
        F.when(U.alive() & ~F.col("is_dir"), F.col("modified_time_us")).alias("_file"),
    )
    zero = F.lit(0).cast("long")
    less = lambda c: (F.coalesce(F.col(c), zero) - F.coalesce(F.col(f"_{c}"), zero)).cast("long").alias(c)
    latest, file = F.col("latest_file_mtime_us"), F.col("_file")
    answered = known(heads, state, query).join(heads.where(F.col("dir") == at), "group_id", "left").join(own, "group_id", "left").select(
        "group_id", less("total_nodes"), F.coalesce("total_files", zero).alias("total_files"), less("total_dirs"),
        F.coalesce("total_size", zero).alias("total_size"),
        # a file that is queried and is the newest takes the latest time with it
        F.when(file.isNull() | (latest > file), latest).alias("latest_file_mtime_us"), less("attested_count"), less("blind_spot_count"),
    )
    unknown = None if at == P.SLASH else unknown_groups(heads, state, query, groups)
    if unknown is None:
        return answered
    nothing = unknown((heads if groups is None else groups).select("group_id").distinct())
    return answered.unionByName(U.rebased_stats(nothing, unknown(state), query).select(*answered.columns))


def health_stats(heads: DataFrame, state: DataFrame, as_of_us: int) -> DataFrame:
    """``rollup.health_stats`` from the heads of the roots. Who is suspect depends on the time that is asked for: those
    rows alone are read, by a filter on their time."""
    root = own_row(state, P.SLASH).select("group_id", U.alive().alias("_live"), F.col("is_dir").alias("_dir"), "monitoring_attested", "blind_spot", "is_tombstoned")
    suspects = state.where((F.col("suspect_until_us") > as_of_us) & U.alive()).groupBy("group_id").agg(F.count("*").alias("suspects"))
    zero = F.lit(0).cast("long")
    held = lambda c: F.coalesce(F.col(c), zero)
    counted = F.coalesce(F.col("_live") & F.col("_dir"), F.lit(False))
    apart = F.coalesce(~F.col("_dir"), F.lit(False))  # a root that is no directory has no part in its head
    both = heads.where(F.col("dir") == P.SLASH).join(root, "group_id", "full").join(suspects, "group_id", "left")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return both.select(
        "group_id",
        (held("total_nodes") - one(counted)).alias("live_nodes"),
        (held("tombstones") + one(apart & F.col("is_tombstoned"))).alias("tombstoned_count"),
        (held("attested_count") - one(counted & F.col("monitoring_attested"))).alias("attested_count"),
        held("suspects").alias("suspect_count"),
        (held("blind_spot_count") - one(counted & F.col("blind_spot"))).alias("blind_spot_count"),
        (held("known_rows") + one(apart)).alias("total_nodes"),
    )


def root_facts(heads: DataFrame, state: DataFrame, query: str, code: Column) -> DataFrame:
    """What ``tree_query`` wants to know of the root of a page, for the groups that know the path."""
    at = query or P.SLASH
    own = own_row(state, query).select(
        "group_id", U.alive().cast("int").alias("_alive"), *[
            F.when(U.alive(), c).alias(n) for n, c in (
                ("_size", F.col("size")), ("_mtime", F.col("modified_time_us")), ("_is_dir", F.col("is_dir")), ("_root", code),
                ("_root_anchor", F.col("subtree_changed_at_us")), ("_own_unattested", ~F.col("monitoring_attested")), ("_own_blind", F.col("blind_spot")),
            )
        ],
    )
    zero = F.lit(0).cast("long")
    nodes, attested = F.coalesce("total_nodes", zero), F.coalesce("attested_count", zero)
    return known(heads, state, query).join(heads.where(F.col("dir") == at), "group_id", "left").join(own, "group_id", "left").select(
        "group_id", F.coalesce("_alive", F.lit(0)).alias("_alive"), "_size", "_mtime", "_is_dir",
        F.greatest(nodes, F.coalesce("_alive", F.lit(0)).cast("long")).alias("_live"), F.coalesce("children", zero).alias("_kids"),
        "_root", "_root_anchor",
        F.when((nodes > attested) | F.coalesce("_own_unattested", F.lit(False)), F.lit(0)).alias("_unattested"),
        F.when((F.coalesce("blind_spot_count", zero) > 0) | F.coalesce("_own_blind", F.lit(False)), F.lit(2)).alias("_blind"),
    )
