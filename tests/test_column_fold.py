"""The column-wise fold against the row-wise one, on rows as a task gets them."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from arborlake import schemas as S
from arborlake.operators import column_fold as CF
from arborlake.operators import path_fold as PF

POLICY = PF.Policy(tombstone_ttl_us=40, tolerance_us=6, suspect_window_us=15)
PRIOR = pa.struct([(n, PF._ARROW[S.STATE[n].dataType.simpleString()]) for n in PF.STATE_FIELDS])
TYPES = {
    "group_id": pa.string(), "path": pa.string(), "seq": pa.int64(), "kind": pa.string(), "op": pa.int32(), "is_dir": pa.bool_(),
    "origin_id": pa.string(), "covered": pa.string(), "ends": pa.string(), "audit_skipped": pa.bool_(), "under_tombstone": pa.bool_(),
    "stale_parent": pa.bool_(), "prior": PRIOR,
}
SCHEMA = pa.schema([(n, TYPES.get(n, pa.int64())) for n in [*PF.INPUT_COLUMNS, "prior"]])


def number(rng):
    return rng.choice([0, 1, 5, 9, 14, 20, 33, 47])


def task_rows(rng, effects):
    """Sorted rows of a few groups with all that can reach a path."""
    rows = []
    for group in ("g0", "g1"):
        ends = rng.choice([None, "", ";".join(f"{seq}:{rng.randrange(3)}:{number(rng)}:{number(rng)}" for seq in sorted(rng.sample(range(60), 4)))])
        for path in sorted(rng.sample(["/a", "/a/b", "/a/b/c", "/d", "/e", "/f", "/g/h", "/i", "/j"], 7)):
            blank = dict.fromkeys(SCHEMA.names) | {"group_id": group, "path": path, "ends": ends}
            if rng.random() < 0.6:
                prior = None
                if rng.random() < 0.8:
                    tomb = rng.random() < 0.3
                    prior = dict(zip(PF.STATE_FIELDS, (
                        number(rng), number(rng), number(rng), rng.random() < 0.5, rng.choice([S.SCAN, S.REALTIME]), rng.random() < 0.5, rng.choice([None, number(rng)]),
                        rng.choice([None, number(rng)]), rng.random() < 0.5, tomb, number(rng) if tomb else None, number(rng) if tomb else None,
                        rng.choice([None, number(rng)]), rng.randrange(3), rng.choice([None, 7]))))
                covered = rng.choice([None, ",".join(str(s) for s in rng.sample(range(60), 30))])
                rows.append(blank | {"seq": -1, "kind": "head", "prior": prior, "covered": covered})
            for seq in sorted(rng.sample(range(60), rng.choice([0, 1, 1, 2, 3, 12]))):
                rows.append(blank | {
                    "seq": seq, "kind": "rec", "op": rng.randrange(5), "is_dir": rng.random() < 0.4, "size": rng.randrange(3), "mtime_us": number(rng), "ctime_us": number(rng),
                    "timestamp_us": number(rng), "arrival_us": seq, "clock_us": number(rng), "epoch": rng.randrange(3), "origin_id": "o",
                    "audit_skipped": rng.random() < 0.2, "claimed_parent_us": rng.choice([None, number(rng)]),
                })
    if effects:
        fx = []
        for r in rows:
            for _ in range(rng.choice([0, 0, 1, 2])):
                fx.append(dict.fromkeys(SCHEMA.names) | {k: r[k] for k in ("group_id", "path", "seq", "ends")} | {
                    "kind": "fx", "under_tombstone": rng.choice([None, True]), "stale_parent": rng.choice([None, True]),
                    "next_purge": rng.choice([None, r["seq"] + rng.randrange(1, 30)])})
        rows += fx
    return sorted(rows, key=lambda r: (r["group_id"], r["path"], r["seq"], r["kind"]))


def lines(rng):
    changes = [(g, d, seq, rng.random() < 0.8, rng.random() < 0.3, rng.choice([None, number(rng)])) for g in ("g0", "g1") for d in ("/a", "/a/b", "/g") for seq in rng.sample(range(60), 4)]
    changes = [(g, d, seq, known and m is not None, tomb and known and m is not None, m) for g, d, seq, known, tomb, m in changes]
    return PF.Timelines(changes, [(g, "/a", seq) for g in ("g0", "g1") for seq in sorted(rng.sample(range(60), rng.randrange(3)))])


def result(folder, rows, size):
    table = pa.Table.from_pylist(rows, SCHEMA)
    batches = [b for at in range(0, max(1, len(rows)), size) for b in table.slice(at, size).combine_chunks().to_batches()]
    return Counter(tuple(r.items()) for b in folder(iter(batches)) for r in b.to_pylist())


@pytest.mark.parametrize("seed", range(60))
def test_columns_and_rows_agree(seed):
    rng = random.Random(seed)
    rows = task_rows(rng, effects=seed % 3 == 0)
    timelines = lines(rng) if seed % 3 == 1 else None
    want = result(PF.PathFolder(POLICY, True, timelines), rows, 1000)
    for run_rows, long_path, size in ((1 << 16, 64, 1000), (20, 64, 7), (9, 3, 5), (1, 0, 2), (30, 2, 1)):
        assert result(CF.ColumnFolder(POLICY, True, timelines, run_rows, long_path), rows, size) == want
    untimed = result(PF.PathFolder(POLICY, False, timelines), rows, 13)
    assert result(CF.ColumnFolder(POLICY, False, timelines, 25, 4), rows, 10) == untimed


def test_no_rows():
    assert result(CF.ColumnFolder(POLICY, True), [], 1) == Counter()


def test_few_rows_are_values_at_a_time():
    """A path of many records goes through the row-wise fold in slices, whatever the size of a batch."""
    rng = random.Random(1)
    base = dict.fromkeys(SCHEMA.names) | {"group_id": "g", "path": "/a", "kind": "rec", "is_dir": False, "size": 1, "ctime_us": 1, "clock_us": 9, "epoch": 0, "audit_skipped": False}
    rows = [base | {"seq": i, "op": rng.randrange(5), "mtime_us": number(rng), "timestamp_us": number(rng), "arrival_us": i} for i in range(3 * 4096 + 5)]
    batch = pa.Table.from_pylist(rows, SCHEMA).combine_chunks().to_batches()[0]
    out = list(CF.ColumnFolder(POLICY, False)(iter([batch])))
    assert max(b.num_rows for b in out) <= 4096
    assert sum(b.num_rows for b in out if b.column("out")[0].as_py() == "outcome") == len(rows)


@pytest.mark.parametrize("seed", range(20))
def test_ends_by_group_are_those_of_the_rows(seed):
    """Audit ends that come once for each group, and not with every row."""
    rows = task_rows(random.Random(seed), effects=seed % 2 == 0)
    texts = {r["group_id"]: r["ends"] for r in rows if r["ends"]}
    bare = [r | {"ends": None} for r in rows]
    want = result(PF.PathFolder(POLICY, True), rows, 1000)
    assert result(PF.PathFolder(POLICY, True, ends=texts), bare, 1000) == want
    assert result(CF.ColumnFolder(POLICY, True, None, 20, 3, texts), bare, 7) == want
