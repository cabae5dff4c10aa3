import random
from collections import Counter

import pytest

from arborlake import schemas as S
from arborlake import skew
from arborlake.operators import arbitrate as A
from arborlake.operators import heads as H
from arborlake.operators.path_fold import Policy
from arborlake.storage import materialize

from . import sequential as Q

DIRS = ["/a", "/a/b", "/a/b/c", "/d", "/d/e"]
LEAVES = ["/a/x", "/a/b/y", "/a/b/c/z", "/d/e/w", "/q"]
FIELDS = [f for f in S.STATE.fieldNames() if f not in ("group_id", "path")]


def random_log(rng, n, groups=("g0", "g1"), with_control=True):
    rows, epoch, now = [], 0, 1_000_000
    for seq in range(n):
        g = rng.choice(groups)
        now += rng.randint(0, 400_000)
        row = dict(group_id=g, origin_id=f"h{rng.randint(0, 1)}::{g}", seq=seq, arrival_us=now,
                   timestamp_us=max(0, now - rng.randint(0, 3_000_000)) if rng.random() > 0.05 else 0,
                   rec_type="data", epoch_id=None, path=None, parent_path=None, is_dir=None, size=None, mtime_us=None,
                   ctime_us=None, parent_mtime_us=None, event_kind=None, source=None, is_atomic_write=None,
                   audit_skipped=None)
        roll = rng.random()
        if with_control and roll < 0.08:
            row["rec_type"] = rng.choice(["epoch_start", "epoch_end", "watch_overflow"])
            if row["rec_type"] != "watch_overflow":
                row["epoch_id"] = epoch = rng.choice([epoch, epoch + 1])
        else:
            path = rng.choice(DIRS + LEAVES)
            if rng.random() < 0.25:  # files that are met once
                path = f"{rng.choice(DIRS)}/n{seq}"
            is_dir = (path in DIRS) != (rng.random() < 0.06)
            source = rng.choice(["Scan", "Realtime"])
            named = source == "Scan" and rng.random() < 0.7
            row.update(path=path, is_dir=is_dir, size=rng.randint(0, 3), source=source,
                       mtime_us=max(0, now - rng.choice([0, 1, 500_000, 2_000_000, 40_000_000])),
                       ctime_us=rng.choice([0, now]), event_kind="Delete" if rng.random() < 0.2 else "Update",
                       is_atomic_write=rng.random() < 0.4, audit_skipped=is_dir and rng.random() < 0.2,
                       parent_path=Q.parents(path)[0] if named else "",
                       parent_mtime_us=rng.choice([0, max(0, now - 1_000_000), now]) if named else 0)
        row["is_primary"] = row["origin_id"] == f"h0::{g}"
        rows.append(row)
    return rows


def collect_state(df):
    return {(r.group_id, r.path): tuple(r[f] for f in FIELDS) for r in df.collect()}


POLICY = Policy(tombstone_ttl_us=2_000_000, tolerance_us=600_000, suspect_window_us=1_500_000)


def run(spark, batches, groups=("g0", "g1")):
    state = A.empty_state(spark)
    grp = A.initial_groups(spark.createDataFrame([(g, f"h0::{g}") for g in groups], "group_id string, primary_object_ref string"))
    outcomes, skips, heads = {}, None, H.build(state)
    for rows in batches:
        res = A.apply_log(state, grp, spark.createDataFrame(rows, S.LOG), POLICY, skips)
        heads = materialize(H.refresh(heads, *res.changes, res.state), "test-heads")
        state, grp, skips = res.state, res.groups, res.skips
        outcomes |= {(r.group_id, r.seq): (r.outcome, r.significant) for r in res.outcomes.collect()}
    # what the fold says it changed moves the heads to those of the state
    assert Counter(map(tuple, heads.collect())) == Counter(map(tuple, H.build(state).collect()))
    return collect_state(state), outcomes, {r.group_id: r for r in grp.collect()}


@pytest.mark.parametrize("seed", [1, 2, 4])
def test_random_logs_match_the_sequential_fold(spark, seed, monkeypatch):
    if seed == 2:  # the shuffled form of every lookup
        monkeypatch.setattr(A, "SMALL_EVENTS", 0)
        monkeypatch.setattr(A, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(A, "is_small", lambda df, rows=0: False)
        monkeypatch.setattr(skew, "is_small", lambda df, rows=0: False)
    if seed == 4:  # every path with a few records counts as hot
        monkeypatch.setattr(A, "HOT_ROWS", 25)
        monkeypatch.setattr(A, "CHUNK_ROWS", 12)
    rng = random.Random(seed)
    rows = random_log(rng, 400)
    cut = sorted(rng.sample(range(1, len(rows)), seed % 2))
    batches = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
    for b in batches:
        rng.shuffle(b)
    state, outcomes, groups = run(spark, batches)
    want, want_out, want_groups = Q.fold(rows, {"g0": "h0::g0", "g1": "h0::g1"}, 2_000_000, 600_000, 1_500_000)
    assert outcomes == want_out
    assert state == want
    for g, grp in want_groups.items():
        got = groups[g]
        assert (got.clock_us, got.active_epoch, got.completed_epochs, got.audit_start_us) == (
            grp.clock, grp.active, grp.completed, grp.audit_start)
        assert (got.overflow_pending, got.coverage_recovered_at_us, got.audited, got.revision) == (
            grp.overflow, grp.recovered, grp.audited, grp.revision)
