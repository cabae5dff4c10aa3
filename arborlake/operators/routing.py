"""Roots, grants and the routing of events to groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import ids
from arborlake.functions.predicates import scope_match
from arborlake.operators.ordered import as_of, number_rows, running_max
from arborlake.skew import lookup_join
from arborlake.storage import materialize

SELECTOR_FIELDS = ["mount_point", "fs_source", "fs_type", "host_ip", "host_ref"]


def match_roots(roots: DataFrame, grants: DataFrame) -> DataFrame:
    """(root_id, grant columns) for every grant that agrees with all given selector fields.

    Roots are told apart by the set of fields they give, at most 31 different ones. A grant is hashed once for each set
    that occurs, on all fields of the set, so that the join itself makes the matches and nothing else. Roots
    without any selector field are refused by ``validate_roots`` and match nothing here.
    """
    bits = {f: 1 << i for i, f in enumerate(SELECTOR_FIELDS)}
    mask = sum((F.when(F.col(f"selector.{f}").isNotNull(), b).otherwise(0) for f, b in bits.items()), F.lit(0)).alias("_mask")
    given = [F.coalesce(F.col(f"selector.{f}"), F.lit("")).alias(f"_{f}") for f in SELECTOR_FIELDS]
    keyed_roots = roots.select(F.col("id").alias("root_id"), "subpath_scope", mask, *given).where("_mask > 0")
    masks = sorted(r[0] for r in keyed_roots.select("_mask").distinct().collect())
    in_mask = lambda b: F.col("_mask").bitwiseAND(F.lit(b)) > 0
    keyed_grants = grants.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in masks]).cast("array<int>")))
    for f, b in bits.items():
        # null where the set has the field and the grant has not: such a grant meets no root
        keyed_grants = keyed_grants.withColumn(f"_{f}", F.when(in_mask(b), F.col(f)).otherwise(F.lit("")))
    key = ["_mask", *[f"_{f}" for f in SELECTOR_FIELDS]]
    return lookup_join(keyed_grants, keyed_roots, key, "inner", salt_from=["object_ref"]).drop(*key)


def monitor_path(mount: Column, subpath: Column) -> Column:
    return F.when(subpath == "/", mount).otherwise(F.concat(F.regexp_replace(mount, "/+$", ""), subpath))


def preview_roots(roots: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched rows with their monitor path, roots that match nothing)."""
    matched = match_roots(roots, grants).select(
        "root_id", "object_ref", "host_ref", monitor_path(F.col("mount_point"), F.col("subpath_scope")).alias("monitor_path")
    )
    unmatched = roots.select(F.col("id").alias("root_id")).join(matched.select("root_id").distinct(), "root_id", "left_anti")
    return matched, unmatched


def validate_roots(roots: DataFrame) -> DataFrame:
    """One row (root_id, error) per broken rule."""
    copies = F.col("_copies")
    empty = F.lit(True)
    for f in SELECTOR_FIELDS:
        empty = empty & F.col(f"selector.{f}").isNull()
    mount = F.col("selector.mount_point")
    rules = F.array(
        F.when(F.trim("id") == "", F.lit("empty id")),
        F.when(copies > 1, F.lit("duplicate id")),
        F.when(empty, F.lit("empty selector")),
        F.when(~mount.startswith("/"), F.lit("relative mount point")),
        F.when(~F.col("subpath_scope").startswith("/"), F.lit("relative subpath scope")),
        F.when(~F.col("watch") & ~F.col("scan"), F.lit("neither watch nor scan")),
    )
    counted = roots.join(roots.groupBy("id").agg(F.count("*").alias("_copies")), "id")
    return counted.select(F.col("id").alias("root_id"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("error"))


def elect_primary(roots: DataFrame, grants: DataFrame, skip_own_id: bool = False) -> DataFrame:
    """(root_id, primary_object_ref): the smallest active member, else the smallest member.

    With ``skip_own_id`` a member named like its root comes last, and a root without members is
    its own primary.
    """
    own = (F.col("object_ref") == F.col("root_id")) if skip_own_id else F.lit(False)
    rank = F.struct(own.cast("int").alias("own"), (~F.col("active")).cast("int").alias("idle"), "object_ref")
    best = match_roots(roots, grants).groupBy("root_id").agg(F.min(rank).alias("best")).select(
        "root_id", F.col("best.object_ref").alias("primary_object_ref")
    )
    if not skip_own_id:
        return best
    return roots.select(F.col("id").alias("root_id")).join(best, "root_id", "left").withColumn(
        "primary_object_ref", F.coalesce("primary_object_ref", "root_id")
    )


def fan_out(roots: DataFrame, grants: DataFrame) -> DataFrame:
    """One row per root and member; a root without members has one row with a null member."""
    members = match_roots(roots, grants).select("root_id", "object_ref", "active").distinct()
    return roots.select(F.col("id").alias("root_id")).join(members, "root_id", "left")


def event_routes(roots: DataFrame, grants: DataFrame, position: str = "id") -> DataFrame:
    """(object_ref, group_id): members go to the last root that matches them, and the id of a root
    routes to itself unless it is a member name."""
    order = roots.select(F.col("id").alias("root_id"), F.col(position).alias("_pos"))
    members = match_roots(roots, grants).select("object_ref", "root_id").join(order, "root_id")
    named = members.select("object_ref", "root_id", F.lit(1).alias("_named"), "_pos")
    own = order.select(F.col("root_id").alias("object_ref"), "root_id", F.lit(0).alias("_named"), "_pos")
    return named.unionByName(own).groupBy("object_ref").agg(
        F.max_by("root_id", F.struct("_named", "_pos")).alias("group_id")
    )


class UnroutedEvents(LookupError):
    """Strict routing met an origin without a group."""


def route_events(log: DataFrame, routes: DataFrame, primaries: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(routed log with group_id and is_primary, quarantine of unmapped rows)."""
    facts = routes.join(primaries.withColumnRenamed("root_id", "group_id"), "group_id", "left").withColumnRenamed(
        "object_ref", "origin_id"
    )
    bare = log.drop("group_id", "is_primary")
    joined = lookup_join(bare, facts, ["origin_id"], "left", salt_from=["seq"]).withColumn(
        "is_primary", F.coalesce(F.col("origin_id") == F.col("primary_object_ref"), F.lit(False))
    ).drop("primary_object_ref")
    lost = joined.where("group_id is null")
    if strict:
        row = lost.first()
        if row is not None:
            raise UnroutedEvents(f"no group for origin {row.origin_id!r}")
    return joined.where("group_id is not null"), lost


def group_keys(rows: DataFrame, members: DataFrame, by: str = "object-ref") -> DataFrame:
    """Key a result row is shown under: its object ref as it is, or its member's mount point when
    that is known. No text is normalised."""
    if by == "object-ref":
        return rows.withColumn("group_key", F.col("object_ref"))
    mounts = members.groupBy("object_ref").agg(F.min("mount_point").alias("_mount"))
    # one object may have most rows: they are spread by what else they hold
    others = [n for n in rows.columns if n != "object_ref"] or None
    return lookup_join(rows, mounts, ["object_ref"], "left", salt_from=others).withColumn(
        "group_key", F.coalesce("_mount", "object_ref")
    ).drop("_mount")


def gate_requests(requests: DataFrame, products: DataFrame, grants: DataFrame, scoped: list[str]) -> DataFrame:
    """Requests with the reason they are denied for, or null.

    ``requests`` has object_ref and one column per name in ``scoped`` (null: no value asked for).
    Products and grants have object_ref, active and ``<name>_scopes``; a grant may also carry a
    default value per name, a product always may. Grant scopes replace product scopes when given.
    """
    p = products.select("object_ref", F.col("active").alias("_p_active"),
                        *[F.col(f"{n}_scopes").alias(f"_p_{n}") for n in scoped],
                        *[F.col(n).alias(f"_pd_{n}") for n in scoped if n in products.columns])
    g = grants.select("object_ref", F.col("active").alias("_g_active"),
                      *[F.col(f"{n}_scopes").alias(f"_g_{n}") for n in scoped],
                      *[F.col(n).alias(f"_gd_{n}") for n in scoped if n in grants.columns])
    joined = lookup_join(lookup_join(requests, p, ["object_ref"], salt_from=scoped), g, ["object_ref"], salt_from=scoped)
    reason = (
        F.when(F.col("_p_active").isNull(), F.lit("unknown endpoint"))
        .when(~F.col("_p_active"), F.lit("inactive endpoint"))
        .when(F.col("_g_active").isNull(), F.lit("missing grant"))
        .when(~F.col("_g_active"), F.lit("inactive grant"))
    )
    out = joined
    for n in scoped:
        defaults = [F.col(f"_{kind}_{n}") for kind in ("gd", "pd") if f"_{kind}_{n}" in joined.columns]
        value = F.coalesce(F.col(n), *defaults)
        scopes = F.when(F.size(f"_g_{n}") > 0, F.col(f"_g_{n}")).otherwise(F.col(f"_p_{n}"))
        reason = reason.when(value.isNotNull() & ~scope_match(value, scopes), F.lit(f"{n} out of scope"))
        out = out.withColumn(f"resolved_{n}", value)
    return out.withColumn("denied_reason", reason).select(
        *requests.columns, *[f"resolved_{n}" for n in scoped], "denied_reason"
    )


_NUMBERED = "^(.+)-([1-9][0-9]{0,17})$"


def normalize_root_ids(rows: DataFrame, raw: str, position: str) -> DataFrame:
    """Give every row a usable unique id: base, base-2, base-3 … in the order of ``position``, a unique number.

    The n-th id of a base can meet one thing only: a base that is spelled like it. The rows of a base take numbers in
    order, and a number is left out if the base spelled so came first. How many rows of a base came before is an as-of
    count, so the numbers left out follow from one pass over the *contested* numbers alone; every row then counts the
    gaps before its own place. The number of jobs does not depend on the ids.
    """
    based = materialize(number_rows(rows.withColumn("_base", ids.root_id_base(raw)), ["_base"], position, "_k"), "root-bases")
    firsts = based.where("_k = 1").select("_base", F.col(position).alias("_first"))
    numbered = firsts.select(
        F.regexp_extract("_base", _NUMBERED, 1).alias("_parent"), F.regexp_extract("_base", _NUMBERED, 2).alias("_digits"),
        F.col("_base").alias("_child"), "_first",
    ).where("_digits <> ''").withColumn("_n", F.col("_digits").cast("long")).where("_n > 1")
    contested = numbered.join(firsts.select(F.col("_base").alias("_parent")), "_parent", "left_semi").select(
        F.col("_parent").alias("_base"), "_child", "_n", F.col("_first").alias(position)
    )
    before = as_of(contested, based.select("_base", position, "_k"), ["_base"], position, ["_k"], "_before")
    marks = before.select(
        F.regexp_replace("_base", "(-[0-9]+)+$", "").alias("stem"), F.size(F.split("_base", "-")).alias("depth"), F.col("_base").alias("base"),
        F.col("_n").alias("n"), F.col("_child").alias("child"), F.coalesce("_before._k", F.lit(0)).cast("long").alias("before"),
    )
    # a base is judged before the bases that are spelled like its ids
    ordered = marks.repartition("stem").sortWithinPartitions("stem", "depth", "base", "n")
    judged = materialize(ordered.mapInArrow(_judge_numbers, "base string, child string, gap long, gaps long"), "root-numbers")
    lost = judged.where("child is not null").select(F.col("child").alias("_base"), F.lit(1).alias("_lost"))
    gaps = judged.where("gap is not null").groupBy(F.col("base").alias("_base"), (F.col("gap") - 1).alias("_k")).agg(F.max("gaps").alias("gaps"))
    placed = as_of(based, gaps, ["_base"], "_k", ["gaps"], "_gap").join(lost, "_base", "left")
    n = F.col("_k") + F.coalesce("_lost", F.lit(0)) + F.coalesce("_gap.gaps", F.lit(0))
    named = placed.withColumn("id", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", n.cast("string"))))
    return named.drop("_base", "_k", "_lost", "_gap")


def _judge_numbers(batches):
    """Contested numbers in order: a number goes to the row of the base whose turn it is, unless the base spelled like the
    id came before that row. Gives ``child`` where that base loses its own name, else the ``gap``: the first row of the
    base that moves on, and the number of gaps so far."""
    stem = base = None
    lost: set[str] = set()  # bases of a stem whose own name is gone
    shift = gaps = 0
    for batch in batches:
        out = []
        for s, b, n, child, before in zip(*(batch.column(c).to_pylist() for c in ("stem", "base", "n", "child", "before"))):
            if s != stem:
                stem, lost, base = s, set(), None
            if b != base:
                base, shift, gaps = b, int(b in lost), 0
            turn = n - gaps - shift
            if turn > before:
                gaps += 1
                out.append((b, None, turn, gaps))
            else:
                lost.add(child)
                out.append((b, child, None, None))
        columns = list(zip(*out)) or [()] * 4
        kinds = pa.string(), pa.string(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["base", "child", "gap", "gaps"])


def accepted_generations(declarations: DataFrame, order: str = "seq", generation: str = "generation") -> DataFrame:
    """Declarations whose generation is newer than all accepted before them."""
    one = declarations.withColumn("_all", F.lit(0))
    fenced = running_max(one, ["_all"], order, generation, "_before", inclusive=False)
    return fenced.where(F.col("_before").isNull() | (F.col(generation) > F.col("_before"))).drop("_before", "_all")


def current_declaration(declarations: DataFrame, order: str = "seq", generation: str = "generation") -> DataFrame:
    """The declaration in force: the first one of the greatest generation."""
    return declarations.orderBy(F.col(generation).desc(), order).limit(1)


def apply_roots(
    state_groups: DataFrame, old_roots: DataFrame, new_roots: DataFrame, grants: DataFrame,
    old_routes: DataFrame, allowed: DataFrame | None = None,
) -> DataFrame:
    """What a new root declaration does to each group: (group_id, fate, primary_object_ref).

    Fates: ``kept``, ``reset`` (selector or subpath changed), ``new``, ``retained`` (set aside with
    its state) and ``dropped``. ``state_groups`` lists groups that hold state, live or set aside;
    filter state partitions by the fates ``kept`` and ``retained``.
    """
    same = F.col("o.subpath_scope") == F.col("n.subpath_scope")
    for f in SELECTOR_FIELDS:
        same = same & F.col(f"o.selector.{f}").eqNullSafe(F.col(f"n.selector.{f}"))
    new = new_roots.alias("n").join(old_roots.alias("o"), F.col("n.id") == F.col("o.id"), "left").select(
        F.col("n.id").alias("group_id"), F.lit(True).alias("declared"),
        (F.col("o.id").isNotNull() & ~same).alias("changed"),
    )
    primaries = elect_primary(new_roots, grants, skip_own_id=True).withColumnRenamed("root_id", "group_id")
    wanted = new if allowed is None else new.join(
        allowed.select("group_id").distinct().withColumn("_ok", F.lit(True)), "group_id", "left"
    )
    in_scope = F.lit(True) if allowed is None else F.coalesce("_ok", F.lit(False))
    scoped_new = new_roots if allowed is None else new_roots.join(
        allowed.select(F.col("group_id").alias("id")).distinct(), "id", "left_semi"
    )
    moved = (
        old_routes.join(event_routes(scoped_new, grants).select("object_ref"), "object_ref", "left_semi")
        .select("group_id").distinct().withColumn("reassigned", F.lit(True))
    )
    held = state_groups.select("group_id").distinct().withColumn("has_state", F.lit(True))
    table = (
        wanted.withColumn("in_scope", in_scope).drop("_ok")
        .join(held, "group_id", "full_outer").join(moved, "group_id", "left").join(primaries, "group_id", "left")
    )
    has_state = F.coalesce("has_state", F.lit(False))
    changed = F.coalesce("changed", F.lit(False))
    declared = F.coalesce("declared", F.lit(False))
    fate = (
        F.when(declared & F.col("in_scope") & changed, F.lit("reset"))
        .when(declared & F.col("in_scope") & has_state, F.lit("kept"))
        .when(declared & F.col("in_scope"), F.lit("new"))
        .when(declared & ~changed & has_state, F.lit("retained"))
        .when(~declared & has_state & ~F.coalesce("reassigned", F.lit(False)), F.lit("retained"))
        .otherwise(F.lit("dropped"))
    )
    return table.select("group_id", fate.alias("fate"), "primary_object_ref")
