"""The per-path step of arbitration, one row at a time, over sorted Arrow batches.

``column_fold`` folds most paths; this form is for paths with many records and states the rules.

Spark hands each task rows sorted by (group, path, seq, kind). A ``head`` row carries the state
that existed before the batch; ``rec`` rows carry records. What a path needs from other paths (an
ancestor's tombstone, the next purge by an ancestor, a newer parent) comes from the timelines of the
levels above: as ``fx`` rows sorted right before the row they belong to, or, when all timelines
together are small, as one broadcast ``Timelines``. The open path is carried across Arrow batches, and a path's
rows stream through one at a time; nothing is collected per path.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from arborlake import schemas as S

# operation codes of a record
SCAN_UPDATE, LIVE_UPDATE, ATOMIC_UPDATE, LIVE_DELETE, SCAN_DELETE = range(5)

STATE_FIELDS = [f.name for f in S.STATE.fields if f.name not in ("group_id", "path")]
(SIZE, MTIME, CTIME, IS_DIR, SOURCE, ATTESTED, CONFIRMED, SUSPECT, BLIND, TOMB, TOMB_EXPIRY, TOMB_AT, LAST_RT,
 SEEN, STAMP) = range(15)

_ARROW = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_STATE_TYPES = [_ARROW[S.STATE[name].dataType.simpleString()] for name in STATE_FIELDS]

OUTPUT_SPEC = (
    [("out", "string"), ("group_id", "string"), ("path", "string"), ("seq", "long"), ("origin_id", "string"),
     ("arrival_us", "long"), ("outcome", "string"), ("significant", "boolean"), ("stamps", "boolean"), ("rec_is_dir", "boolean"),
     ("rec_mtime_us", "long"), ("rec_ctime_us", "long"), ("known", "boolean"), ("tomb", "boolean"),
     ("at_mtime_us", "long"), ("chunk", "int"), ("context", "string")]
    + [(name, S.STATE[name].dataType.simpleString()) for name in STATE_FIELDS]
)
OUTPUT_DDL = ", ".join(f"{n} {t}" for n, t in OUTPUT_SPEC)
_OUT_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in OUTPUT_SPEC])

INPUT_COLUMNS = [
    "group_id", "path", "seq", "kind", "op", "is_dir", "size", "mtime_us", "ctime_us", "timestamp_us", "arrival_us",
    "clock_us", "epoch", "under_tombstone", "stale_parent", "next_purge", "origin_id", "covered", "ends",
    "audit_skipped", "claimed_parent_us",
]


ENDS = INPUT_COLUMNS.index("ends")
#: Rows of a batch that are Python values at a time.
VALUE_ROWS = 4096


@dataclass(frozen=True)
class Policy:
    """Windows of arbitration, in microseconds."""

    tombstone_ttl_us: int = 90_000_000
    tolerance_us: int = 1_000_000
    suspect_window_us: int = 30_000_000


def _fenced(mark: int | None, event_us: int) -> bool:
    """An event is not newer than a mark; a zero on either side disables the fence."""
    return mark is not None and mark > 0 and event_us > 0 and event_us <= mark


def step(state, rec, policy: Policy):
    """One record against one path: (new state, outcome, purges descendants)."""
    (op, is_dir, size, mtime, ctime, event_us, now, clock, epoch, under_tombstone, stale_parent) = rec

    if op >= LIVE_DELETE:
        if op == LIVE_DELETE:
            expiry = now + policy.tombstone_ttl_us
            if state is None:
                fresh = [0, mtime, ctime, is_dir, S.REALTIME, False, None, None, False, True, expiry, event_us,
                         event_us, 0, None]
                return fresh, S.DELETED, False
            state = list(state)
            state[TOMB], state[TOMB_EXPIRY], state[TOMB_AT] = True, expiry, event_us
            state[LAST_RT], state[SUSPECT] = event_us, None
            return state, S.DELETED, bool(is_dir)
        if state is None or state[TOMB] or _fenced(state[LAST_RT], event_us):
            return state, S.IGNORED, False
        if state[MTIME] > mtime or (state[MTIME] == mtime and state[SOURCE] == S.REALTIME):
            return state, S.IGNORED, False
        return None, S.DELETED, False

    scan = op == SCAN_UPDATE
    atomic = op == ATOMIC_UPDATE
    if scan and (under_tombstone or (state is None and stale_parent)):
        return state, S.IGNORED, False

    if state is None:
        hot = (clock - mtime < policy.suspect_window_us) if scan else not atomic
        fresh = [size, mtime, ctime, is_dir, S.SCAN if scan else S.REALTIME, not scan, None if scan else now,
                 now + policy.suspect_window_us if hot else None, scan and epoch >= 1, False, None, None,
                 None if scan else event_us, epoch, None]
        return fresh, S.CREATED, False

    was_tomb = state[TOMB]
    if was_tomb:
        if atomic:
            if _fenced(state[TOMB_AT], event_us):
                return state, S.IGNORED, False
        else:
            newer = mtime > state[MTIME]
            expired = state[TOMB_EXPIRY] is not None and now >= state[TOMB_EXPIRY]
            returns = newer and (expired or mtime - state[MTIME] >= policy.tolerance_us)
            if _fenced(state[TOMB_AT], event_us) or not returns:
                state = list(state)
                state[SEEN] = epoch
                return state, S.IGNORED, False

    state = list(state)
    if scan:
        state[SEEN] = epoch
        if _fenced(state[LAST_RT], event_us):
            return state, S.IGNORED, False
    if state[MTIME] >= mtime and not (atomic and state[SOURCE] == S.SCAN):
        return state, S.IGNORED, False

    changed = state[MTIME] != mtime
    purges = state[IS_DIR] != is_dir and not was_tomb
    if was_tomb:
        state[TOMB], state[TOMB_EXPIRY], state[TOMB_AT] = False, None, None
    state[SIZE], state[MTIME], state[CTIME], state[IS_DIR] = size, mtime, ctime, is_dir
    state[SEEN] = epoch
    if scan:
        state[SOURCE] = S.SCAN
        if changed:
            state[ATTESTED] = False
            if epoch >= 1:
                state[BLIND] = True
            state[SUSPECT] = now + policy.suspect_window_us if clock - mtime < policy.suspect_window_us else None
    else:
        state[SOURCE], state[ATTESTED], state[CONFIRMED] = S.REALTIME, True, now
        state[LAST_RT], state[BLIND] = event_us, False
        state[SUSPECT] = None if atomic else now + policy.suspect_window_us
    return state, S.CREATED if was_tomb else S.MODIFIED, purges


def audit_end(state, end, covered: bool):
    """End of an audit for one path: missing live nodes and expired tombstones go."""
    _, audit_id, started, now = end
    if state is None or audit_id < 1:
        return state
    if state[TOMB]:
        return None if state[TOMB_EXPIRY] is None or now >= state[TOMB_EXPIRY] else state
    confirmed_after_start = state[CONFIRMED] is not None and state[CONFIRMED] > started
    if covered or confirmed_after_start or state[SEEN] >= audit_id:
        return state
    return None


def _significant(before, after, outcome: str, audit_skipped: bool) -> bool:
    if outcome in (S.CREATED, S.DELETED):
        return True
    if outcome != S.MODIFIED or audit_skipped:
        return False
    return any(before[i] != after[i] for i in (SIZE, MTIME, IS_DIR, TOMB))


def parse_ends(text: str | None):
    """``seq:id:start:now`` items of a group's audit ends, in order of seq."""
    if not text:
        return ()
    return tuple(tuple(int(part) for part in item.split(":")) for item in text.split(";"))


class Timelines:
    """Changes of the directories folded so far, looked up per path."""

    def __init__(self, changes, purges):
        """``changes``: (group, dir, seq, known, tomb, mtime); ``purges``: (group, dir, seq)."""
        self.changes, self.purges = {}, {}
        for group, path, seq, known, tomb, mtime in sorted(changes, key=lambda r: (r[0], r[1], r[2])):
            at, what = self.changes.setdefault((group, path), ([], []))
            at.append(seq)
            what.append((known, tomb, mtime))
        for group, path, seq in purges:
            self.purges.setdefault((group, path), []).append(seq)

    @staticmethod
    def _dirs(group: str, path: str) -> list[tuple]:
        dirs, here = [], path
        while here not in ("", "/") and "/" in here:
            here = here[: here.rfind("/")] or "/"
            dirs.append((group, here))
        return dirs

    def above(self, group: str, path: str) -> "Above":
        dirs = self._dirs(group, path)
        lines = [self.changes[d] for d in dirs if d in self.changes]
        purges = sorted(seq for d in dirs for seq in self.purges.get(d, ()))
        return Above(lines, self.changes.get(dirs[0]) if dirs else None, purges)


class Above:
    """What the ancestors of one path do over time."""

    def __init__(self, lines, parent, purges):
        self.lines = [line for line in lines if any(tomb for _, tomb, _ in line[1])]
        self.parent, self.purges = parent, purges

    @staticmethod
    def _before(line, seq):
        i = bisect_left(line[0], seq)
        return line[1][i - 1] if i else (False, False, None)

    def effects(self, seq: int, scan: bool, claimed_parent: int):
        tombed = scan and any(self._before(line, seq)[1] for line in self.lines)
        stale = False
        if scan and claimed_parent > 0 and self.parent is not None:
            known, _, mtime = self._before(self.parent, seq)
            stale = known and claimed_parent < mtime
        i = bisect_right(self.purges, seq)
        return tombed, stale, self.purges[i] if i < len(self.purges) else None


def _values(column: pa.Array) -> list:
    """Python values of a column; numpy is several times faster where nothing is null."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(names) * 4 < len(column) and coded.null_count == 0:
            return [names[i] for i in coded.indices.to_numpy().tolist()]
        return column.to_pylist()
    if column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def batch_of(kind: str, n: int, columns: dict) -> pa.RecordBatch:
    arrays = []
    for field in _OUT_SCHEMA:
        if field.name == "out":
            arrays.append(pa.array([kind]).take(pa.array(np.zeros(n, dtype=np.int32))))
        elif field.name in columns:
            value = columns[field.name]
            arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
        else:
            arrays.append(pa.nulls(n, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_OUT_SCHEMA)


class _Emitter:
    def __init__(self):
        self.states, self.outcomes, self.timeline, self.purges, self.contexts = [], [], [], [], []

    def batches(self, chunked: bool = False) -> Iterator[pa.RecordBatch]:
        tail = ["chunk"] if chunked else []
        yield from self._batch("state", self.states, ["group_id", "path", *STATE_FIELDS, *tail])
        yield from self._batch(
            "outcome", self.outcomes,
            ["group_id", "path", "seq", "origin_id", "arrival_us", "outcome", "significant", "stamps", "rec_is_dir",
             "rec_mtime_us", "rec_ctime_us", *tail],
        )
        yield from self._batch("timeline", self.timeline, ["group_id", "path", "seq", "known", "tomb", "at_mtime_us", *tail])
        yield from self._batch("purge", self.purges, ["group_id", "path", "seq", *tail])
        yield from self._batch("context", self.contexts, ["group_id", "path", "chunk", "context"])
        self.__init__()

    @staticmethod
    def _batch(kind, rows, names):
        if not rows:
            return
        yield batch_of(kind, len(rows), dict(zip(names, zip(*rows))))


class PathFolder:
    """Folds sorted rows; one instance per task."""

    def __init__(self, policy: Policy, with_timeline: bool, timelines: Timelines | None = None, ends: dict[str, str] | None = None):
        self.policy = policy
        self.with_timeline = with_timeline
        self.timelines = timelines
        self.ends = ends
        self.emit = _Emitter()
        self.key = None
        self._ends_text, self._ends = None, ()

    chunked = False

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from self.feed(batch)
        yield from self.finish()

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Fold the rows of a batch; its last path stays open."""
        for at in range(0, batch.num_rows, VALUE_ROWS):
            yield from self._feed(batch.slice(at, VALUE_ROWS))

    def _feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chunks = batch.column("chunk").to_pylist() if self.chunked else None
        cols = {name: _values(batch.column(name)) for name in INPUT_COLUMNS}
        prior = batch.column("prior")
        for i, row in enumerate(zip(*(cols[name] for name in INPUT_COLUMNS))):
            key = (row[0], row[1], chunks[i]) if self.chunked else row[:2]
            if key != self.key:
                if self.key is not None:
                    self._close()
                self._open(key, row[ENDS])
            self._row(row, prior, i)
        yield from self.emit.batches(self.chunked)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            self._close()
            yield from self.emit.batches(self.chunked)

    def _open(self, key, ends) -> None:
        self.key, self.tail = key, key[2:]
        self.state, self.purge_at, self.covered, self.end_at = None, None, frozenset(), 0
        self.seen, self.effects = (False, False, None), None
        self.above = None if self.timelines is None else self.timelines.above(*key[:2])
        if self.ends is not None:
            ends = self.ends.get(key[0])
        if ends != self._ends_text:
            self._ends_text, self._ends = ends, parse_ends(ends)

    def _row(self, row, prior, i) -> None:
        (group, path, seq, kind, op, is_dir, size, mtime, ctime, event_us, now, clock, epoch, under_tombstone,
         stale_parent, next_purge, origin, covered, ends, skipped, claimed_parent) = row
        if kind == "fx":
            tombed, stale, purge = self.effects or (False, False, None)
            if next_purge is not None and (purge is None or next_purge < purge):
                purge = next_purge
            self.effects = (tombed or bool(under_tombstone), stale or bool(stale_parent), purge)
            return
        if self.above is not None:
            self.effects = self.above.effects(seq, op == SCAN_UPDATE, claimed_parent or 0)
        under_tombstone, stale_parent, next_purge = self.effects or (False, False, None)
        self.effects = None
        if kind == "head":
            if prior[i].is_valid:
                self.state = list(prior[i].as_py().values())
            if covered:
                self.covered = frozenset(int(x) for x in covered.split(","))
            self.purge_at = next_purge
            self._mark(seq)
            return
        self._advance(seq)
        before = self.state
        after, outcome, purges = step(
            before, (op, is_dir, size, mtime, ctime, event_us, now, clock, epoch, under_tombstone, stale_parent),
            self.policy,
        )
        self.state = after
        self.purge_at = next_purge
        significant = _significant(before, after, outcome, skipped)
        # a path that is gone after its change stamps neither itself nor its ancestors
        stamps = significant and after is not None
        self.emit.outcomes.append((group, path, seq, origin, now, outcome, significant, stamps, is_dir, mtime, ctime, *self.tail))
        if purges:
            self.emit.purges.append((group, path, seq, *self.tail))
        self._mark(seq)

    def _advance(self, until) -> None:
        """Apply inherited purges and audit ends that lie before ``until`` (None: to the end)."""
        while True:
            end = self._ends[self.end_at] if self.end_at < len(self._ends) else None
            purge = self.purge_at
            if purge is not None and (until is None or purge < until) and (end is None or purge < end[0]):
                self.state, self.purge_at = None, None
                self._mark(purge)
            elif end is not None and (until is None or end[0] < until):
                self.end_at += 1
                self.state = audit_end(self.state, end, end[0] in self.covered)
                self._mark(end[0])
            else:
                return

    def _mark(self, seq) -> None:
        if not self.with_timeline:
            return
        s = self.state
        now = (False, False, None) if s is None else (True, s[TOMB], s[MTIME])
        if now != self.seen:
            self.seen = now
            self.emit.timeline.append((*self.key[:2], seq, *now, *self.tail))

    def _close(self) -> None:
        self._advance(None)
        if self.state is not None:
            self.emit.states.append((*self.key[:2], *self.state, *self.tail))
        self.key = None


class ChunkFolder(PathFolder):
    """Folds one chunk of a hot path from a given entry context and reports the exit context.

    A context is everything one row hands to the next: state, pending purge, number of audit ends
    applied, covered ends and the last timeline entry.
    """

    chunked = True

    def __init__(self, policy, with_timeline, timelines, ends, entries, last_chunks):
        super().__init__(policy, with_timeline, timelines, ends)
        self.entries, self.last_chunks = entries, last_chunks

    def _open(self, key, ends) -> None:
        super()._open(key, ends)
        entry = self.entries.get(key)
        if entry is not None:
            self.state, self.purge_at, self.end_at, covered, seen = json.loads(entry)
            self.covered, self.seen = frozenset(covered), tuple(seen)

    def _close(self) -> None:
        if self.key in self.last_chunks:
            super()._close()
            return
        context = [self.state, self.purge_at, self.end_at, sorted(self.covered), list(self.seen)]
        self.emit.contexts.append((*self.key, json.dumps(context)))
        self.key = None


def chunk_folder(policy: Policy, with_timeline: bool, timelines, ends, entries, last_chunks):
    def run(batches):
        above, texts = (None if x is None else x.value for x in (timelines, ends))
        yield from ChunkFolder(policy, with_timeline, above, texts, entries, last_chunks)(batches)

    return run


def predict_exit(entry: str | None, used: str | None, exit_: str) -> str:
    """Guess of a chunk's exit for another entry; only a guess, the chunk is folded again with it.

    A chunk that left its state as it was (but for the epoch) will most likely do so again.
    """
    if entry is None or used is None:
        return exit_
    new, old, out = json.loads(entry), json.loads(used), json.loads(exit_)
    if new[0] is None or old[0] is None or out[0] is None:
        return exit_
    same = [a for i, a in enumerate(old[0]) if i != SEEN] == [b for i, b in enumerate(out[0]) if i != SEEN]
    if not same:
        return exit_
    state = list(new[0])
    state[SEEN] = out[0][SEEN]
    return json.dumps([state, *out[1:4], new[4]])
