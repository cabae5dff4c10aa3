"""Arbitration: fold a change log into the state table of every group.

A path's fate depends on its own records, on its ancestors (tombstones, purges, the parent's
modification time) and on per-group clock and audit state. Nothing flows upwards. So:

* clock and audit epoch become columns of each record (``ordered.running_max``, control points);
* only paths that are ancestors of other records (*internal* paths, mostly directories) have to be
  folded level by level, each level reading the timelines of the levels above;
* everything else, which is nearly all rows, is folded in one pass whatever its depth;
* rows of the prior state without a record are handled by set operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.functions import paths as P
from arborlake.operators import column_fold as CF
from arborlake.operators import path_fold as PF
from arborlake.operators.ordered import as_of, running_max
from arborlake.skew import BROADCAST_ROWS, is_small, lookup_join
from arborlake.storage import materialize, together

KEY = ["group_id", "path"]
HEAD_SEQ = -1


@dataclass
class FoldResult:
    state: DataFrame
    groups: DataFrame
    outcomes: DataFrame
    purges: DataFrame | None = field(default=None)
    skips: DataFrame | None = field(default=None)  # skip marks that no audit control has cleared yet
    # rows of the prior state that the batch replaced or removed, and the rows it wrote (but for their change stamps)
    changes: tuple[DataFrame, DataFrame] | None = field(default=None)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.STATE)


def initial_groups(primaries: DataFrame) -> DataFrame:
    """One row per group from (group_id, primary_object_ref)."""
    return primaries.select(
        "group_id",
        "primary_object_ref",
        F.lit(0).cast("long").alias("clock_us"),
        F.lit(None).cast("long").alias("active_epoch"),
        F.lit(0).cast("long").alias("completed_epochs"),
        F.lit(None).cast("long").alias("audit_start_us"),
        F.lit(False).alias("overflow_pending"),
        F.lit(None).cast("long").alias("coverage_recovered_at_us"),
        F.lit(False).alias("audited"),
        F.lit(1).cast("long").alias("revision"),
    )


class LogError(ValueError):
    """The log breaks a rule that the result would depend on."""


def check_log(log: DataFrame) -> None:
    """``(group_id, seq)`` must be unique and non-negative."""
    bad = log.groupBy("group_id", "seq").count().where((F.col("count") > 1) | (F.col("seq") < 0))
    row = bad.first()
    if row is not None:
        raise LogError(f"group {row.group_id!r} has {row['count']} rows with seq {row.seq}")


def split_malformed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): a non-empty parent path must be the lexical parent."""
    bad = (F.col("rec_type") == S.DATA) & (F.coalesce("parent_path", F.lit("")) != "") & (
        ~F.col("parent_path").eqNullSafe(P.parent_path("path"))
    )
    return log.where(~F.coalesce(bad, F.lit(False))), log.where(F.coalesce(bad, F.lit(False)))


# ---------------------------------------------------------------- audit control


def control_points(log: DataFrame, groups: DataFrame, small: bool | None = None) -> DataFrame:
    """Primary audit controls with what each one establishes.

    ``epoch`` is the current epoch after the row, ``started_us`` the start of the audit an end
    closes, ``skip_from`` the last point before the row at which skip marks were cleared.
    """
    ctl = log.where(F.col("rec_type").isin(S.EPOCH_START, S.EPOCH_END) & F.col("is_primary")).select(
        "group_id", "seq", "rec_type", "epoch_id", "arrival_us"
    )
    w = W.partitionBy("group_id").orderBy("seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    is_end = F.col("rec_type") == S.EPOCH_END
    clears = F.when(~is_end | (F.col("epoch_id") >= 1), F.col("seq"))
    carried = groups.select("group_id", "completed_epochs", "audit_start_us")
    joined = lookup_join(ctl, carried, ["group_id"], small=small)
    prev = F.lag("rec_type").over(w)
    start_of_prev = (
        F.when(prev == S.EPOCH_START, F.lag("arrival_us").over(w))
        .when(prev.isNull(), F.col("audit_start_us"))
    )
    return joined.select(
        "group_id",
        "seq",
        "rec_type",
        "epoch_id",
        "arrival_us",
        F.when(~is_end, F.col("epoch_id"))
        .otherwise(F.coalesce("completed_epochs", F.lit(0)) + F.sum(is_end.cast("long")).over(upto))
        .alias("epoch"),
        F.when(is_end, F.coalesce(start_of_prev, F.col("arrival_us"))).alias("started_us"),
        F.coalesce(F.max(clears).over(before), F.lit(HEAD_SEQ - 1)).cast("long").alias("skip_from"),
        F.max(clears).over(upto).alias("cleared_at"),
        F.sum(is_end.cast("long")).over(upto).alias("ends_so_far"),
    )


def audit_ends(points: DataFrame) -> DataFrame:
    return points.where(F.col("rec_type") == S.EPOCH_END)


def with_epoch(records: DataFrame, points: DataFrame, small: bool | None = None) -> DataFrame:
    """Attach the epoch that is current at each record; ``_epoch0`` is the one carried in.

    A batch holds a handful of control points per group, so they travel as one short array.
    """
    per_group = points.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("seq").alias("at"), "epoch"))).alias("_points")
    )
    joined = lookup_join(records, per_group, ["group_id"], salt_from=["seq"], small=small)
    last = F.try_element_at(F.filter("_points", lambda p: p["at"] < F.col("seq")), F.lit(-1))
    return joined.withColumn("epoch", F.coalesce(last["epoch"], F.col("_epoch0"), F.lit(0))).drop("_points")


def all_marks(log: DataFrame, carried: DataFrame | None) -> DataFrame:
    marks = log.where((F.col("rec_type") == S.DATA) & F.col("audit_skipped")).select(
        "group_id", F.col("path").alias("dir"), "seq"
    )
    if carried is None:
        return marks
    return marks.unionByName(carried.select("group_id", "dir", F.lit(HEAD_SEQ).cast("long").alias("seq")))


def pending_marks(marks: DataFrame, points: DataFrame, small: bool | None = None) -> DataFrame:
    """Marks after the last clearing control of their group; the next batch starts with them."""
    cleared = points.groupBy("group_id").agg(F.max("cleared_at").alias("_cleared"))
    left = lookup_join(marks, cleared, ["group_id"], salt_from=["dir", "seq"], small=small)
    return left.where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared"))).select("group_id", "dir").distinct()


def skip_marks(marks: DataFrame, points: DataFrame, small: bool | None = None) -> DataFrame:
    """(group_id, dir, end_seq): directories marked skipped for the audit that ends at end_seq."""
    ends = audit_ends(points).where(F.col("epoch_id") >= 1).select(
        "group_id", F.col("seq").alias("end_seq"), "skip_from"
    )
    per_group = ends.groupBy("group_id").agg(F.collect_list(F.struct("end_seq", "skip_from")).alias("_ends"))
    hit = lookup_join(marks, per_group, ["group_id"], "inner", salt_from=["dir", "seq"], small=small).select(
        "group_id", "dir", "seq", F.explode("_ends").alias("e")
    )
    return (
        hit.where((F.col("seq") > F.col("e.skip_from")) & (F.col("seq") < F.col("e.end_seq")))
        .select("group_id", "dir", F.col("e.end_seq").alias("end_seq"))
        .distinct()
    )


def covered_ends(paths: DataFrame, marks: DataFrame) -> DataFrame:
    """Paths equal to or below a marked directory, with the ends they are covered for."""
    exploded = paths.select(*KEY, F.explode(P.self_and_ancestors("path")).alias("dir"))
    return (
        lookup_join(exploded, marks, ["group_id", "dir"], "inner", salt_from=["path"])
        .groupBy(*KEY)
        .agg(F.collect_set("end_seq").alias("covered_ends"))
    )


# ---------------------------------------------------------------- ancestor effects


@dataclass
class Lines:
    """Timelines and purges of the internal paths folded so far, with their row counts."""

    timeline: DataFrame | None = None
    purges: DataFrame | None = None
    n_timeline: int = 0
    n_purges: int = 0
    n_tombs: int = 0

    def add(self, folded: DataFrame) -> None:
        line, cut = _timeline_rows(folded), _purge_rows(folded)
        self.timeline = line if self.timeline is None else self.timeline.unionByName(line)
        self.purges = cut if self.purges is None else self.purges.unionByName(cut)
        for row in folded.where(F.col("out").isin("timeline", "purge")).groupBy("out").agg(
            F.count("*").alias("n"), F.count_if("tomb").alias("tombs")
        ).collect():
            if row.out == "purge":
                self.n_purges += row.n
            else:
                self.n_timeline += row.n
                self.n_tombs += row.tombs


SMALL_EVENTS = 50_000


def _timelines(spark: SparkSession, lines: Lines):
    """All timelines as one broadcast; the caller has checked their row counts."""
    changes = [tuple(r) for r in lines.timeline.select(*KEY, "seq", "known", "tomb", "at_mtime_us").collect()]
    purges = [tuple(r) for r in lines.purges.select(*KEY, "seq").collect()] if lines.n_purges else []
    return spark.sparkContext.broadcast(PF.Timelines(changes, purges))


def _effect_rows(rows: DataFrame, lines: Lines) -> list[DataFrame]:
    """What ancestors do to the given records and heads, as ``fx`` rows for the fold."""
    by = ["group_id", "dir"]
    scan = F.col("op") == PF.SCAN_UPDATE
    found = []

    probes = rows.where(scan & (F.col("claimed_parent_us") > 0)).select(
        "group_id", P.parent_path("path").alias("dir"), "path", "seq", "claimed_parent_us"
    )
    parents = lines.timeline.select("group_id", F.col("path").alias("dir"), "seq", "known", "at_mtime_us")
    seen = as_of(probes, parents, by, "seq", ["known", "at_mtime_us"], "_p")
    found.append(
        seen.where(F.col("_p.known") & (F.col("claimed_parent_us") < F.col("_p.at_mtime_us")))
        .select(*KEY, "seq", F.lit(True).alias("stale_parent"))
    )

    if lines.n_tombs:
        dirs = lines.timeline.where("tomb").select("group_id", F.col("path").alias("dir")).distinct()
        events = lines.timeline.withColumnRenamed("path", "dir").join(dirs, by, "left_semi")
        below = lookup_join(_exploded(rows.where(scan)), dirs, by, "left_semi", ["path", "seq"])
        tombed = as_of(below, events, by, "seq", ["tomb"], "_t")
        found.append(tombed.where("_t.tomb").select(*KEY, "seq", F.lit(True).alias("under_tombstone")))

    if lines.n_purges:
        cuts = lines.purges.withColumnRenamed("path", "dir")
        # heads share seq -1, so they take their first purge by a minimum instead of the as-of join
        first = cuts.groupBy(*by).agg(F.min("seq").alias("next_purge"))
        is_head = F.col("seq") == HEAD_SEQ
        heads = lookup_join(_exploded(rows.where(is_head)), first, by, "inner", ["path"])
        below = lookup_join(_exploded(rows.where(~is_head)), first.drop("next_purge"), by, "left_semi", ["path", "seq"])
        purged = as_of(below, cuts, by, "seq", [], "_n", forward=True)
        found.append(heads.select(*KEY, "seq", "next_purge"))
        found.append(purged.where("_n is not null").select(*KEY, "seq", F.col("_n.at").alias("next_purge")))
    return found


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, "seq", F.explode(P.ancestors("path")).alias("dir"))


# ---------------------------------------------------------------- the fold


def _op_code():
    live = F.col("source") == S.REALTIME
    return (
        F.when(F.col("event_kind") == S.DELETE, F.when(live, PF.LIVE_DELETE).otherwise(PF.SCAN_DELETE))
        .when(~live, PF.SCAN_UPDATE)
        .when(F.col("is_atomic_write"), PF.ATOMIC_UPDATE)
        .otherwise(PF.LIVE_UPDATE)
    )


HOT_ROWS = 4_000_000  # records of one path in a batch from which the path is cut into chunks
CHUNK_ROWS = 1_000_000


def touched_paths(log: DataFrame) -> DataFrame:
    """(group_id, path, n, internal): paths with ``n`` records of the batch, and those that other records lie below."""
    own = log.where(F.col("rec_type") == S.DATA).groupBy(*KEY).agg(F.count("*").alias("n"))
    dirs = (
        own.select("group_id", P.parent_path("path").alias("dir")).where("dir is not null").distinct()
        .select("group_id", F.explode(P.self_and_ancestors("dir")).alias("path")).distinct()
        .select(*KEY, F.lit(0).cast("long").alias("n"), F.lit(True).alias("internal"))
    )
    return own.withColumn("internal", F.lit(False)).unionByName(dirs).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("internal").alias("internal"))


@dataclass
class Shape:
    """What the plan of a batch depends on: one row about its paths."""

    n_dirs: int
    n_hot: int
    depths: list[int]  # of internal paths with records


def _shape(touched: DataFrame) -> Shape:
    depth = F.when(F.col("internal"), P.segment_count("path"))
    row = touched.agg(
        F.count_if("internal").alias("dirs"), F.count_if(F.col("n") > HOT_ROWS).alias("hot"),
        F.sort_array(F.collect_set(F.when(F.col("n") > 0, depth))).alias("depths"),
    ).first()
    return Shape(row.dirs, row.hot, row.depths)


def _fold_level(
    rows: DataFrame, lines: Lines, ends: DataFrame | None, texts, policy: PF.Policy, timeline: bool, label: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``ends`` are the audit ends of the groups, unless they are few: then ``texts`` is a broadcast of them."""
    stream, timelines = _aligned(rows), None
    if lines.n_timeline + lines.n_purges > SMALL_EVENTS:
        for fx in _effect_rows(rows, lines):
            stream = stream.unionByName(_aligned(fx.withColumn("kind", F.lit("fx"))))
    elif lines.n_timeline:
        timelines = _timelines(rows.sparkSession, lines)
    if ends is not None:
        stream = lookup_join(stream, ends, ["group_id"], salt_from=["path"], small=False)

    def ready(df: DataFrame, order: list[str]) -> DataFrame:
        if ends is None:
            df = df.withColumn("ends", F.lit(None).cast("string"))
        extra = ["chunk"] if "chunk" in df.columns else []
        return df.sortWithinPartitions(*order).select(*PF.INPUT_COLUMNS, "prior", *extra)

    order = [*KEY, "seq", "kind"]
    if hot is None:
        cold = stream
    else:
        names = F.broadcast(hot.select(*KEY))
        cold = stream.join(names, KEY, "left_anti")
    folded = ready(cold.repartition(*KEY), order).mapInArrow(CF.folder(policy, timeline, timelines, texts), PF.OUTPUT_DDL)
    out = materialize(folded, label, partition_by="out")
    if hot is None:
        return out
    return out.unionByName(_fold_chunks(stream.join(names, KEY, "left_semi"), hot, ready, policy, timeline, timelines, texts, label))


def _fold_chunks(stream: DataFrame, hot: DataFrame, ready, policy: PF.Policy, timeline: bool, timelines, texts, label: str) -> DataFrame:
    """Fold hot paths in parallel chunks, exactly.

    Every chunk is folded from a guessed entry context; then each chunk whose real entry, the exit
    of the chunk before it, differs from the guess is folded again, until none differs. The first
    chunk of a path is right from the start, so the result is that of one sequential pass; usually
    two or three rounds do, because a chunk's exit rarely depends on its entry.
    """
    spark = stream.sparkSession
    total = sum(r.n for r in hot.collect())
    n = max(2, -(-total // CHUNK_ROWS))
    chunks = materialize(
        stream.repartitionByRange(n, *KEY, "seq").withColumn("chunk", F.spark_partition_id()), f"{label}-chunks", partition_by="chunk"
    )
    listed = sorted(tuple(r) for r in chunks.select(*KEY, "chunk").distinct().collect())
    if not listed:
        return spark.createDataFrame([], PF.OUTPUT_DDL)
    following = {a: b for a, b in zip(listed, listed[1:]) if a[:2] == b[:2]}
    firsts = [c for c in listed if c not in set(following.values())]
    last = frozenset(c for c in listed if c not in following)
    entries: dict[tuple, str | None] = {c: None for c in listed}
    exits: dict[tuple, str] = {}
    results: dict[tuple, int] = {}
    rounds: list[DataFrame] = []
    stale = set(listed)
    while stale:
        wanted = spark.createDataFrame([(*c,) for c in stale], "group_id string, path string, chunk int")
        part = chunks.where(F.col("chunk").isin(sorted({c[2] for c in stale}))).join(F.broadcast(wanted), [*KEY, "chunk"], "left_semi")
        run = PF.chunk_folder(policy, timeline, timelines, texts, {c: entries[c] for c in stale if entries[c] is not None}, last)
        keyed = ready(part.repartition(len(stale), *KEY, "chunk"), [*KEY, "chunk", "seq", "kind"])
        done = materialize(keyed.mapInArrow(run, PF.OUTPUT_DDL), f"{label}-round", partition_by="out")
        rounds.append(done)
        used = dict(entries)
        for r in done.where(F.col("out") == "context").select(*KEY, "chunk", "context").collect():
            exits[(r.group_id, r.path, r.chunk)] = r.context
        for c in stale:
            results[c] = len(rounds) - 1
        stale = set()
        for c in firsts:
            exit_ = exits.get(c)
            while c in following:
                nxt = following[c]
                if used[nxt] != exit_:
                    stale.add(nxt)
                    entries[nxt] = exit_
                    exit_ = PF.predict_exit(exit_, used[nxt], exits[nxt]) if nxt in exits else None
                else:
                    exit_ = exits.get(nxt)
                c = nxt
    valid = spark.createDataFrame([(*c, i) for c, i in results.items()], "group_id string, path string, chunk int, _round int")
    all_rounds = reduce(DataFrame.unionByName, [df.withColumn("_round", F.lit(i)) for i, df in enumerate(rounds)])
    return all_rounds.join(F.broadcast(valid), [*KEY, "chunk", "_round"], "left_semi").drop("_round").select(*rounds[0].columns)


def apply_log(
    state: DataFrame,
    groups: DataFrame,
    log: DataFrame,
    policy: PF.Policy = PF.Policy(),
    skips: DataFrame | None = None,
    label: str = "fold",
) -> FoldResult:
    """Apply one batch of routed log rows, in ``seq`` order, to ``state`` and ``groups``."""
    spark = log.sparkSession

    def controls():
        # a batch has few control rows, so the groups are not worth a check of their size here
        points = materialize(control_points(log, groups, small=False), f"{label}-controls")
        counts = points.agg(F.count("*").alias("all"), F.count_if(F.col("rec_type") == S.EPOCH_END).alias("ends")).first()
        return points, counts

    def paths():
        touched = materialize(touched_paths(log), f"{label}-paths")
        return touched, _shape(touched)

    (points, control_counts), (touched, shape), small_groups, has_state = together(
        controls, paths, lambda: is_small(groups), lambda: not state.isEmpty()
    )
    n_controls, has_ends = control_counts["all"], control_counts["ends"] > 0
    small_controls = n_controls <= BROADCAST_ROWS
    ends = audit_ends(points)

    carried = groups.select(
        "group_id",
        F.col("clock_us").alias("_clock0"),
        F.coalesce("active_epoch", "completed_epochs", F.lit(0)).alias("_epoch0"),
    )
    clocked = running_max(
        lookup_join(log, carried, ["group_id"], salt_from=["seq"], small=small_groups), ["group_id"], "seq",
        "timestamp_us", "clock_us", start="_clock0",
    )
    data = clocked.where(F.col("rec_type") == S.DATA)
    data = with_epoch(data, points, small_controls) if n_controls else data.withColumn("epoch", F.coalesce("_epoch0", F.lit(0)))
    records = (
        data.withColumn("op", _op_code().cast("int"))
        .withColumn("kind", F.lit("rec"))
        .withColumn("audit_skipped", F.coalesce("audit_skipped", F.lit(False)))
        .withColumn("claimed_parent_us", F.when(F.coalesce("parent_path", F.lit("")) != "", F.col("parent_mtime_us")))
        .drop("_clock0", "parent_path", "parent_mtime_us", "_epoch0", "rec_type", "epoch_id", "is_primary", "event_kind", "source", "is_atomic_write")
    )

    dirs = touched.where("internal").select(*KEY, "internal")
    tagged = lookup_join(records, dirs, KEY, salt_from=["seq"], small=shape.n_dirs <= BROADCAST_ROWS).withColumn(
        "internal", F.coalesce("internal", F.lit(False))
    )
    hot = touched.where(F.col("n") > HOT_ROWS).select(*KEY, "n") if shape.n_hot else None

    (heads, untouched, marks), prepared = together(
        lambda: _prior_rows(state, touched, points if has_ends else None, log, skips, has_state, small_controls, label),
        lambda: materialize(tagged, f"{label}-records", partition_by="internal"),
    )

    ends_text = texts = None
    if has_ends:
        item = F.concat_ws(":", F.col("seq").cast("string"), F.col("epoch_id").cast("string"),
                           F.col("started_us").cast("string"), F.col("arrival_us").cast("string"))
        ends_text = ends.groupBy("group_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("t")))), lambda s: s["t"]), ";")
            .alias("ends")
        )
    if has_ends and small_controls:
        # a copy for each worker, not for each row
        texts = spark.sparkContext.broadcast({r.group_id: r.ends for r in ends_text.where("group_id is not null").collect()})
        ends_text = None

    folds: list[DataFrame] = []
    lines = Lines()

    def rows_of(condition) -> DataFrame:
        recs = _aligned(prepared.where(condition))
        return recs if heads is None else recs.unionByName(_aligned(heads.where(condition)))

    internal_rows = rows_of(F.col("internal"))
    depths = set(shape.depths)
    if heads is not None:
        depths.update(r[0] for r in heads.where("internal").select(P.segment_count("path")).distinct().collect())
    for depth in sorted(depths):
        level = internal_rows.where(P.segment_count("path") == depth)
        out = _fold_level(level, lines, ends_text, texts, policy, True, f"{label}-level", hot)
        folds.append(out)
        lines.add(out)
    leaves = rows_of(~F.col("internal"))
    folds.append(_fold_level(leaves, lines, ends_text, texts, policy, False, f"{label}-leaves", hot))

    folded = reduce(DataFrame.unionByName, folds)
    all_purges = _purge_rows(folded)
    written = folded.where(F.col("out") == "state").select(*S.STATE.fieldNames())
    new_state, replaced = written, empty_state(spark)
    if heads is not None:
        replaced = heads.where("prior is not null").select(*KEY, "prior.*")
    if untouched is not None:
        kept, dropped = _carry_untouched(untouched, all_purges, ends if has_ends else None, marks)
        new_state, replaced = new_state.unionByName(kept), replaced.unionByName(dropped)
    outcomes = folded.where(F.col("out") == "outcome").select(
        *KEY, "seq", "origin_id", "arrival_us", "outcome", "significant", "stamps",
        F.col("rec_is_dir").alias("is_dir"), F.col("rec_mtime_us").alias("mtime_us"),
        F.col("rec_ctime_us").alias("ctime_us"),
    )
    stamped, new_groups, still_marked = together(
        lambda: materialize(_stamp(new_state, outcomes), f"{label}-state"),
        lambda: materialize(_next_groups(log, groups, points, outcomes, small_groups), f"{label}-groups"),
        lambda: materialize(pending_marks(all_marks(log, skips), points, small_controls), f"{label}-pending-skips"),
    )
    return FoldResult(stamped, new_groups, outcomes, all_purges, still_marked, (replaced, written))


def _prior_rows(
    state: DataFrame, touched: DataFrame, points: DataFrame | None, log: DataFrame, skips: DataFrame | None, has_state: bool, small_controls: bool, label: str
) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(head rows of the batch's paths, rows of the prior state without a record, skip marks); ``points`` if audits end."""
    spark, heads, untouched, marks = state.sparkSession, None, None, None
    touched = touched.select(*KEY, "internal")
    if has_state:
        split = materialize(
            state.join(touched.withColumn("_touched", F.lit(True)), KEY, "left").withColumn("_touched", F.coalesce("_touched", F.lit(False))),
            f"{label}-prior", partition_by="_touched",
        )
        heads = split.where("_touched").withColumn("_has", F.lit(True))
        untouched = split.where(~F.col("_touched")).select(*S.STATE.fieldNames())
    if points is not None:
        found = materialize(skip_marks(all_marks(log, skips), points, small_controls), f"{label}-skips")
        marks = None if found.isEmpty() else found
    if marks is not None:
        cover = covered_ends(touched, marks).withColumn(
            "covered", F.array_join(F.transform("covered_ends", lambda x: x.cast("string")), ",")
        ).drop("covered_ends")
        cover = cover.join(touched.where("internal"), KEY, "left")
        base = heads if heads is not None else empty_state(spark).withColumn("internal", F.lit(False)).withColumn(
            "_has", F.lit(True)
        )
        heads = base.join(cover.withColumnRenamed("internal", "_internal"), KEY, "full_outer").withColumn(
            "internal", F.coalesce("internal", "_internal", F.lit(False))
        )
    if heads is not None:
        heads = materialize(_head_rows(heads, has_cover=marks is not None), f"{label}-heads", partition_by="internal")
    return heads, untouched, marks


_EMPTY = {
    "seq": "long", "kind": "string", "op": "int", "is_dir": "boolean", "size": "long", "mtime_us": "long",
    "ctime_us": "long", "timestamp_us": "long", "arrival_us": "long", "clock_us": "long", "epoch": "long",
    "origin_id": "string", "covered": "string", "audit_skipped": "boolean", "claimed_parent_us": "long",
    "under_tombstone": "boolean", "stale_parent": "boolean", "next_purge": "long",
}


PRIOR = "struct<" + ",".join(f"{n}:{S.STATE[n].dataType.simpleString()}" for n in PF.STATE_FIELDS) + ">"


def _aligned(rows: DataFrame) -> DataFrame:
    """The columns of the fold's input; a prior state travels as one struct, null on records."""
    have = set(rows.columns)
    fill = {**_EMPTY, "prior": PRIOR}
    return rows.select(*KEY, *[F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fill.items()])


def _head_rows(heads: DataFrame, has_cover: bool) -> DataFrame:
    return heads.select(
        *KEY,
        "internal",
        F.lit(HEAD_SEQ).cast("long").alias("seq"),
        F.lit("head").alias("kind"),
        (F.col("covered") if has_cover else F.lit(None).cast("string")).alias("covered"),
        F.when(F.col("is_dir").isNotNull(), F.struct(*PF.STATE_FIELDS)).alias("prior"),
    )


def _timeline_rows(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("out") == "timeline").select(*KEY, "seq", "known", "tomb", "at_mtime_us")


def _purge_rows(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("out") == "purge").select(*KEY, "seq")


def _below(state: DataFrame, purges: DataFrame) -> DataFrame | None:
    """Keys of the rows of ``state`` that have a purged ancestor, None without a purge."""
    dirs = purges.select("group_id", F.col("path").alias("dir")).distinct()
    if dirs.isEmpty():
        return None
    exploded = state.select(*KEY, F.explode(P.ancestors("path")).alias("dir"))
    return lookup_join(exploded, dirs, ["group_id", "dir"], "left_semi", salt_from=["path"]).select(*KEY).distinct()


def _carry_untouched(state: DataFrame, purges: DataFrame, ends: DataFrame | None, marks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go) of those that no record of the batch touches."""
    kept, dropped, gone = state, state.limit(0), _below(state, purges)
    if gone is not None:
        gone = materialize(gone, "fold-purged")
        kept, dropped = state.join(gone, KEY, "left_anti"), state.join(gone, KEY, "left_semi")
    if ends is None:
        return kept, dropped
    judged = missed_rows(kept, ends, marks)
    names = S.STATE.fieldNames()
    return judged.where("not _gone").select(*names), dropped.unionByName(judged.where("_gone").select(*names))


def missed_rows(state: DataFrame, ends: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Audit ends applied to rows that no record of the batch touches: ``state`` with ``_gone``."""
    per_group = ends.where(F.col("epoch_id") >= 1).groupBy("group_id").agg(
        F.collect_list(F.struct("seq", "epoch_id", "started_us", "arrival_us")).alias("_ends")
    )
    joined = lookup_join(state, per_group, ["group_id"], salt_from=["path"])
    expired = F.exists(
        "_ends", lambda e: F.col("tombstone_expires_at_us").isNull() | (e["arrival_us"] >= F.col("tombstone_expires_at_us"))
    )
    missed = F.filter(
        "_ends",
        lambda e: (F.col("last_seen_epoch") < e["epoch_id"])
        & ~F.coalesce(F.col("last_confirmed_at_us") > e["started_us"], F.lit(False)),
    )
    nothing = F.array().cast("array<long>")
    judged = joined.withColumn("_missed", F.when(~F.col("is_tombstoned"), F.transform(missed, lambda e: e["seq"])))
    gone_tomb = F.col("is_tombstoned") & F.coalesce(expired, F.lit(False))
    at_risk = F.size(F.coalesce("_missed", nothing)) > 0
    if marks is None:
        return judged.withColumn("_gone", gone_tomb | at_risk)
    cover = covered_ends(judged.where(at_risk).select(*KEY), marks)
    uncovered = F.size(F.array_except("_missed", F.coalesce("covered_ends", nothing))) > 0
    return judged.join(cover, KEY, "left").withColumn("_gone", gone_tomb | (at_risk & uncovered))


def change_stamps(outcomes: DataFrame) -> DataFrame:
    """(group_id, path, changed_us): the last stamping change at or below every directory.

    Which ancestors had a node at that time needs no look-up: a node created later stamps itself
    with its own, later, creation.
    """
    last = outcomes.where("stamps").groupBy(*KEY).agg(
        F.max(F.struct("seq", "arrival_us")).alias("last")
    )
    return (
        last.select("group_id", F.explode(P.self_and_ancestors("path")).alias("path"), "last")
        .groupBy(*KEY)
        .agg(F.max("last").alias("last"))
        .select(*KEY, F.col("last.arrival_us").alias("changed_us"))
    )


def _stamp(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    stamped = state.join(change_stamps(outcomes), KEY, "left")
    return stamped.withColumn(
        "subtree_changed_at_us", F.coalesce("changed_us", "subtree_changed_at_us")
    ).select(*S.STATE.fieldNames())


def _next_groups(log: DataFrame, groups: DataFrame, points: DataFrame, outcomes: DataFrame, small_groups: bool | None = None) -> DataFrame:
    clock = log.groupBy("group_id").agg(F.max("timestamp_us").alias("_clock"))
    changes = outcomes.groupBy("group_id").agg(F.sum(F.col("significant").cast("long")).alias("_changes"))
    last = points.groupBy("group_id").agg(
        F.max_by("rec_type", "seq").alias("_last_type"),
        F.max_by("epoch_id", "seq").alias("_last_id"),
        F.max_by("arrival_us", "seq").alias("_last_at"),
        F.max("ends_so_far").alias("_ends"),
    )
    coverage = coverage_changes(log, groups, small_groups)
    g = (
        groups.join(clock, "group_id", "left").join(changes, "group_id", "left").join(last, "group_id", "left")
        .join(coverage, "group_id", "left")
    )
    started = F.col("_last_type") == S.EPOCH_START
    idle = F.col("_last_type") == S.EPOCH_END
    return g.select(
        "group_id",
        "primary_object_ref",
        F.greatest(F.col("clock_us"), F.coalesce("_clock", F.lit(0))).alias("clock_us"),
        F.when(started, F.col("_last_id")).when(idle, F.lit(None)).otherwise(F.col("active_epoch")).alias("active_epoch"),
        (F.col("completed_epochs") + F.coalesce("_ends", F.lit(0))).alias("completed_epochs"),
        F.when(started, F.col("_last_at")).when(idle, F.lit(None)).otherwise(F.col("audit_start_us")).alias("audit_start_us"),
        F.coalesce("_overflow", "overflow_pending").alias("overflow_pending"),
        F.coalesce("_recovered", "coverage_recovered_at_us").alias("coverage_recovered_at_us"),
        (F.col("audited") | (F.coalesce("_ends", F.lit(0)) > 0)).alias("audited"),
        (F.col("revision") + F.coalesce("_changes", F.lit(0)) + F.coalesce("_recoveries", F.lit(0))).alias("revision"),
    )


def coverage_changes(log: DataFrame, groups: DataFrame, small_groups: bool | None = None) -> DataFrame:
    """Overflow flag, last recovery time and number of recoveries per group after the batch.

    Any member's overflow sets the flag; the primary's audit end clears it and, when it was set,
    counts as a recovery.
    """
    is_end = (F.col("rec_type") == S.EPOCH_END) & F.col("is_primary")
    rows = log.where((F.col("rec_type") == S.WATCH_OVERFLOW) | is_end).select(
        "group_id", "seq", "arrival_us", is_end.alias("is_end")
    )
    rows = lookup_join(rows, groups.select("group_id", F.col("overflow_pending").alias("_before")), ["group_id"], small=small_groups)
    w = W.partitionBy("group_id").orderBy("seq")
    prev_end = F.lag("is_end").over(w)
    # the flag before an end: set by a preceding overflow, or carried in when the end comes first
    pending = F.when(prev_end.isNull(), F.col("_before")).otherwise(~prev_end)
    recovered = rows.withColumn("_rec", F.col("is_end") & F.coalesce(pending, F.lit(False)))
    return recovered.groupBy("group_id").agg(
        (~F.max_by("is_end", "seq")).alias("_overflow"),
        F.max_by(F.when(F.col("_rec"), F.col("arrival_us")), F.when(F.col("_rec"), F.col("seq"))).alias("_recovered"),
        F.sum(F.col("_rec").cast("long")).alias("_recoveries"),
    )


# ---------------------------------------------------------------- set forms of single rules


def missing_items(state: DataFrame, epoch: int, audit_start_us: int, skipped: DataFrame) -> DataFrame:
    """Live rows that an audit of ``epoch`` did not see, were not confirmed after it began and
    are not covered by a skipped directory. ``skipped`` has (group_id, path)."""
    if epoch < 1:
        return state.limit(0)
    stale = state.where(
        ~F.col("is_tombstoned")
        & (F.col("last_seen_epoch") < epoch)
        & ~F.coalesce(F.col("last_confirmed_at_us") > audit_start_us, F.lit(False))
    )
    return not_covered(stale, skipped)


def not_covered(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """Rows that neither are nor lie below a skipped directory."""
    dirs = skipped.select("group_id", F.col("path").alias("dir")).distinct()
    exploded = rows.select(*KEY, F.explode(P.self_and_ancestors("path")).alias("dir"))
    covered = lookup_join(exploded, dirs, ["group_id", "dir"], "left_semi", salt_from=["path"]).select(*KEY).distinct()
    return rows.join(covered, KEY, "left_anti")


def reject_below_tombstones(records: DataFrame, state: DataFrame) -> DataFrame:
    """Scan records without a tombstoned ancestor in ``state``; other records pass."""
    dirs = state.where("is_tombstoned").select("group_id", F.col("path").alias("dir"))
    scan = F.col("source") == S.SCAN
    exploded = records.where(scan).select("group_id", "seq", F.explode(P.ancestors("path")).alias("dir"))
    hit = lookup_join(exploded, dirs, ["group_id", "dir"], "left_semi", salt_from=["seq"]).select("group_id", "seq").distinct()
    return records.join(hit, ["group_id", "seq"], "left_anti")


def reject_stale_parents(records: DataFrame, state: DataFrame) -> DataFrame:
    """Drop scan updates of unknown paths whose parent is known to be newer than they claim."""
    known = state.select(*KEY, F.lit(True).alias("_known"))
    parents = state.select("group_id", F.col("path").alias("parent_path"), F.col("modified_time_us").alias("_parent_mtime"))
    joined = lookup_join(records, parents, ["group_id", "parent_path"], "left", salt_from=["seq"])
    joined = lookup_join(joined, known, KEY, "left", salt_from=["seq"])
    stale = (
        (F.col("source") == S.SCAN) & (F.col("event_kind") == S.UPDATE) & F.col("_known").isNull()
        & (F.col("parent_mtime_us") > 0) & (F.col("parent_mtime_us") < F.col("_parent_mtime"))
    )
    return joined.where(~F.coalesce(stale, F.lit(False))).drop("_known", "_parent_mtime")


def write_significant(outcome, audit_skipped, before, after):
    """Whether an outcome changed content: structs ``before`` and ``after`` hold size,
    modified_time_us, is_dir and is_tombstoned."""
    out = F.col(outcome)
    changed = F.lit(False)
    for name in ("size", "modified_time_us", "is_dir", "is_tombstoned"):
        changed = changed | ~F.col(f"{before}.{name}").eqNullSafe(F.col(f"{after}.{name}"))
    return out.isin(S.CREATED, S.DELETED) | ((out == S.MODIFIED) & ~F.col(audit_skipped) & changed)


def collect_tombstones(state: DataFrame, now_us: int) -> DataFrame:
    """Drop tombstones whose time is over or that have none."""
    gone = F.col("is_tombstoned") & (
        F.col("tombstone_expires_at_us").isNull() | (F.col("tombstone_expires_at_us") <= now_us)
    )
    return state.where(~gone)


def visibility_lag(outcomes: DataFrame) -> DataFrame:
    """Milliseconds from a file's own time to its observation, for created and modified files."""
    base = F.when(
        F.col("outcome") == S.CREATED, F.when(F.col("ctime_us") > 0, F.col("ctime_us")).otherwise(F.col("mtime_us"))
    ).when(F.col("outcome") == S.MODIFIED, F.col("mtime_us"))
    return (
        outcomes.where(~F.col("is_dir"))
        .withColumn("_base", base)
        .where(F.col("_base") > 0)
        .select(
            "group_id",
            F.col("origin_id").alias("object_ref"),
            *["path", "seq"],
            F.col("arrival_us").alias("observed_at_us"),
            F.floor(F.greatest(F.col("arrival_us") - F.col("_base"), F.lit(0)) / 1000).cast("long").alias("lag_ms"),
            F.when(F.col("outcome") == S.CREATED, F.lit("create")).otherwise(F.lit("modify")).alias("op"),
        )
    )


def retain_lag(samples: DataFrame, as_of_us: int, days: int = 31, newest: int | None = None, since_us: int | None = None) -> DataFrame:
    """Samples of the retention window; at most the ``newest`` ones where a caller asks for so many."""
    kept = samples.where(F.col("observed_at_us") >= as_of_us - days * 86_400_000_000)
    if newest is not None:
        kept = kept.orderBy(F.col("observed_at_us").desc(), F.col("seq").desc(), "group_id").limit(newest)
    return kept if since_us is None else kept.where(F.col("observed_at_us") >= since_us)


def apply_counters(log: DataFrame) -> DataFrame:
    """Accepted, control and data rows with the last observation time, per origin and group."""
    control = (F.col("rec_type") != S.DATA).cast("long")
    return log.groupBy("origin_id", "group_id").agg(
        F.count("*").alias("accepted"),
        F.sum(control).alias("control"),
        F.sum(1 - control).alias("data"),
        F.max("timestamp_us").alias("last_received_us"),
    )
