"""Directory aggregates, subtree statistics and health counters over the state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import paths as P

KEY = ["group_id", "path"]
TOTAL = "decimal(38,0)"  # sums of unsigned sizes may pass the long range on the way


def alive() -> Column:
    return ~F.col("is_tombstoned")


def live(state: DataFrame) -> DataFrame:
    return state.where("not is_tombstoned")


def counters(cond: Column | None = None, attested="monitoring_attested", blind="blind_spot") -> list[Column]:
    """Counters of nodes, of those that a condition holds for."""
    on = F.lit(True) if cond is None else cond
    is_file = on & ~F.col("is_dir")
    return [
        F.count_if(on).alias("total_nodes"),
        F.count_if(is_file).alias("total_files"),
        F.count_if(on & F.col("is_dir")).alias("total_dirs"),
        F.coalesce(F.sum(F.when(is_file, F.col("size").cast(TOTAL))), F.lit(0)).cast("long").alias("total_size"),
        F.max(F.when(is_file, F.col("modified_time_us"))).alias("latest_file_mtime_us"),
        F.count_if(on & F.col(attested)).alias("attested_count"),
        F.count_if(on & F.col(blind)).alias("blind_spot_count"),
    ]


_SUMS = ["total_nodes", "total_files", "total_dirs", "attested_count", "blind_spot_count"]


def rollup_tree(state: DataFrame) -> DataFrame:
    """Counters of self and all live descendants for every directory and placeholder.

    Rows are summed per parent before ancestors are exploded, so the explosion works on
    directories instead of on files.
    """
    rows = live(state)
    per_parent = rows.withColumn("dir", P.parent_path("path")).where("dir is not null").groupBy("group_id", "dir").agg(
        *counters()
    )
    lifted = per_parent.withColumn("dir", F.explode(P.self_and_ancestors("dir")))
    own = rows.where("is_dir").groupBy("group_id", F.col("path").alias("dir")).agg(*counters())
    return lifted.unionByName(own).groupBy("group_id", "dir").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.sum(F.col("total_size").cast(TOTAL)).cast("long").alias("total_size"),
        F.max("latest_file_mtime_us").alias("latest_file_mtime_us"),
    )


ROLLUP_COLUMNS = ["group_id", "dir", *_SUMS, "total_size", "latest_file_mtime_us"]


def changed_rows(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of two states that heads see differently: those of the old state, those of the new one. For versions whose
    batch did not say what it changed."""
    facts = ["is_dir", "size", "modified_time_us", "monitoring_attested", "blind_spot", "is_tombstoned"]
    mark = F.struct(*facts)
    both = before.select(*KEY, mark.alias("_old")).join(after.select(*KEY, mark.alias("_new")), KEY, "full").where(
        ~F.col("_old").eqNullSafe(F.col("_new"))
    )
    side = lambda name: both.where(F.col(name).isNotNull()).select(*KEY, f"{name}.*")
    return side("_old"), side("_new")


MAX_LISTED_GROUPS = 10_000


def unknown_groups(state: DataFrame, query: str, groups: DataFrame | None = None):
    """Restriction of a state to groups whose tree does not have the query path, or None when every
    group has it. Tombstones make a path known.

    Group ids are listed on the driver, which lets Spark prune partitions and lets callers leave
    out the second pass altogether; beyond ``MAX_LISTED_GROUPS`` they stay a table.
    """
    if query in ("", P.SLASH):
        return None
    every = (state if groups is None else groups).select("group_id").distinct()
    return missing_groups(every, state.where(P.is_under("path", query)).select("group_id").distinct())


def missing_groups(every: DataFrame, known: DataFrame):
    """Restriction of a table to the groups of ``every`` that are not ``known``, or None without any."""
    listed = [r[0] for r in every.limit(MAX_LISTED_GROUPS + 1).collect()]
    if len(listed) > MAX_LISTED_GROUPS:
        missing = every.join(known, "group_id", "left_anti")
        return lambda df: df.join(missing, "group_id", "left_semi")
    unknown = sorted(set(listed) - {r[0] for r in known.collect()})
    return (lambda df: df.where(F.col("group_id").isin(unknown))) if unknown else None


def rebased_nodes(state: DataFrame, query: str) -> DataFrame:
    """Live nodes moved to the query path; where two land on one path the later in pre-order wins."""
    moved = live(state).withColumn("_to", P.rebase("path", query)).where("_to is not null")
    names = [c for c in state.columns if c not in KEY]
    best = moved.groupBy("group_id", "_to").agg(
        F.max_by(F.struct(*names), P.preorder_key("path")).alias("_n")
    )
    return best.select("group_id", F.col("_to").alias("path"), *[F.col(f"_n.{n}").alias(n) for n in names])


def subtree_stats(state: DataFrame, query: str) -> DataFrame:
    """Counters below the query path, its own node left out, one row per group.

    A file that is queried and is the newest file takes the latest time with it. Groups that do
    not know the path count the rebased nodes instead, all of them.
    """
    below = state.where(P.is_under("path", query))
    own = F.col("path") == (query or P.SLASH)
    alive_file = alive() & ~F.col("is_dir")
    latest = F.max(F.when(alive_file, F.col("modified_time_us")))
    own_latest = F.max(F.when(alive_file & own, F.col("modified_time_us")))
    facts = counters(alive() & ~own)
    facts[4] = F.when(own_latest.isNull() | (latest != own_latest), latest).alias("latest_file_mtime_us")
    known = below.groupBy("group_id").agg(*facts)
    unknown = unknown_groups(state, query)
    if unknown is None:
        return known
    return known.unionByName(rebased_stats(unknown(state.select("group_id").distinct()), unknown(state), query))


def rebased_stats(groups: DataFrame, state: DataFrame, query: str) -> DataFrame:
    """Counters of the rebased nodes of groups that do not know the path; a group without any answers with zeros."""
    counted = rebased_nodes(state, query).groupBy("group_id").agg(*counters())
    zero = F.lit(0).cast("long")
    return groups.join(counted, "group_id", "left").select(
        "group_id", *[F.coalesce(c, zero).alias(c) if c != "latest_file_mtime_us" else F.col(c) for c in counted.columns[1:]]
    )


def is_suspect(as_of_us: int | Column) -> Column:
    at = as_of_us if isinstance(as_of_us, Column) else F.lit(as_of_us)
    return F.coalesce(at < F.col("suspect_until_us"), F.lit(False))


def health_stats(state: DataFrame, as_of_us: int) -> DataFrame:
    """Live, tombstone, attested, suspect and blind-spot counts; the root node itself only counts
    as suspect or tombstone."""
    counted = alive() & (F.col("path") != P.SLASH)
    return state.groupBy("group_id").agg(
        F.count_if(counted).alias("live_nodes"),
        F.count_if("is_tombstoned").alias("tombstoned_count"),
        F.count_if(counted & F.col("monitoring_attested")).alias("attested_count"),
        F.count_if(alive() & is_suspect(as_of_us)).alias("suspect_count"),
        F.count_if(counted & F.col("blind_spot")).alias("blind_spot_count"),
        F.count("*").alias("total_nodes"),
    )


def fresh_stats(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The same counters over a list of nodes, the root included."""
    return nodes.groupBy(*by).agg(*counters(attested="monitoring_attested", blind="is_blind_spot"))


def live_parents(state: DataFrame) -> DataFrame:
    """(group_id, path) of every path with a live direct child."""
    return (
        live(state).select("group_id", P.parent_path("path").alias("path")).where("path is not null").distinct()
    )


def quiet_anchor(state: DataFrame, query: str) -> DataFrame:
    """Last significant change that counts for ``query``, per group that knows the path.

    The node's own time when it exists, else the newest below it, else the nearest ancestor's.
    """
    at = F.col("subtree_changed_at_us")
    own = F.col("path") == query
    below = P.is_under("path", query)
    # the ancestors are listed here, so that the scan can look for them
    names = [n for n in query.split(P.SLASH) if n]
    above = F.col("path").isin([P.SLASH, *[P.SLASH + P.SLASH.join(names[:i]) for i in range(1, len(names))]])
    rows = state.where(below | (above & at.isNotNull()))
    return (
        rows.groupBy("group_id")
        .agg(
            F.count_if(below).alias("_known"),
            F.count_if(own).alias("_own"),
            F.max(F.when(own, at)).alias("_own_at"),
            F.max(F.when(below & ~own, at)).alias("_below_at"),
            F.max_by(F.when(above & ~below, at), F.when(above & ~below, F.length("path"))).alias("_above_at"),
        )
        .where((F.col("_known") > 0) | F.lit(query == P.SLASH))
        .select(
            "group_id",
            F.when(F.col("_own") > 0, F.col("_own_at"))
            .otherwise(F.coalesce("_below_at", F.lit(None) if query == P.SLASH else F.col("_above_at")))
            .alias("quiet_anchor_us"),
        )
    )


def directory_fingerprints(listing: DataFrame) -> DataFrame:
    """Order-free fingerprint of a directory's children from (group_id, path, is_dir)."""
    h = F.xxhash64(P.file_name("path"), F.col("is_dir"))
    per_dir = (
        listing.select("group_id", P.parent_path("path").alias("dir"), "is_dir", h.alias("_h")).where("dir is not null")
        .groupBy("group_id", "dir")
        .agg(
            F.count("*").alias("entries"),
            F.count_if("is_dir").alias("dirs"),
            F.count_if(~F.col("is_dir")).alias("files"),
            F.bit_xor("_h").alias("_x"),
            F.sum(F.col("_h").cast(TOTAL)).alias("_s"),
        )
    )
    return per_dir.select(
        "group_id", "dir", "entries", "dirs", "files",
        F.xxhash64("entries", "dirs", "files", "_x", F.col("_s").cast("string")).alias("fingerprint"),
    )


def fleet_totals(status: DataFrame) -> DataFrame:
    """Sums over groups and the newest clock."""
    names = ["live_nodes", "tombstoned_count", "attested_count", "suspect_count", "blind_spot_count"]
    return status.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.max("shadow_time_us").alias("shadow_time_us"),
        F.count("*").alias("groups"),
    )


def probe_metric(stats: DataFrame, order: str) -> DataFrame:
    """Ranking metric per group: the largest file count, or the newest file time. Rows whose
    statistics could not be decoded carry nulls and are ignored."""
    value = {"file-count": "total_files", "file-age": "latest_file_mtime_us"}[order]
    return stats.groupBy("group_id").agg(F.coalesce(F.max(value), F.lit(0)).alias("metric"))
