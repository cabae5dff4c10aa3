"""The per-path step of arbitration over whole columns.

The rows of a task come sorted by (group, path, seq, kind). Runs of whole paths are folded together: the first
record of every path at once, then the second one of all paths that have two, and so on, so that a run takes as many
rounds of array work as its longest path has records. Each round first applies the purges and audit ends that lie
before its records. Paths with more than ``LONG_PATH`` records go through ``path_fold``, one row at a time; both
follow the same rules.

Numbers that are null are ``NULL``, flags that are null are -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arborlake import schemas as S
from arborlake.operators import path_fold as PF

#: Rows that are folded together, and the records of a path from which on it is folded by itself.
RUN_ROWS, LONG_PATH = 1 << 16, 64
NULL, NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FLAGS = {PF.IS_DIR, PF.ATTESTED, PF.BLIND, PF.TOMB}
_SOURCES = pa.array([S.SCAN, S.REALTIME])
_IGNORED, _CREATED, _MODIFIED, _DELETED = range(4)
_OUTCOMES = pa.array([S.IGNORED, S.CREATED, S.MODIFIED, S.DELETED])


def numbers(column: pa.Array, null: int = NULL) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def flags(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int8()), -1).to_numpy(zero_copy_only=False)


def _number_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == NULL)


def _flag_array(values: np.ndarray) -> pa.Array:
    return pa.array(values == 1, mask=values == -1)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """The first row of every path."""
    n, group, path = batch.num_rows, batch.column("group_id"), batch.column("path")
    if n < 2:
        return np.zeros(n, np.int64)
    differs = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(group[1:], group[:-1])).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


class ColumnFolder:
    """Folds sorted rows; one instance per task."""

    def __init__(
        self, policy: PF.Policy, with_timeline: bool, timelines: PF.Timelines | None = None, run_rows: int = RUN_ROWS, long_path: int = LONG_PATH,
        ends: dict[str, str] | None = None,
    ):
        self.policy, self.with_timeline, self.timelines, self.ends = policy, with_timeline, timelines, ends
        self.run_rows, self.long_path = run_rows, long_path
        self.rows = PF.PathFolder(policy, with_timeline, timelines, ends)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= self.run_rows:
                rest = yield from self._run(self._joined(held), last=False)
                held = [rest] if rest.num_rows else []
        if held:
            yield from self._run(self._joined(held), last=True)
        yield from self.rows.finish()

    @staticmethod
    def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches()[0] if table.num_rows else held[0]

    def _run(self, batch: pa.RecordBatch, last: bool):
        """Fold all paths of a run but the last one, whose rows may go on; these are handed back."""
        n, starts = batch.num_rows, _starts(batch)
        if not n:
            return batch
        counts = np.diff(np.append(starts, n))
        long = counts > self.long_path
        # the path that the row-wise fold has open
        long[0] |= self.rows.key == (batch.column("group_id")[0].as_py(), batch.column("path")[0].as_py())
        rest = batch.slice(n)
        if not last and not long[-1]:
            rest = batch.slice(starts[-1])
            batch, counts, long = batch.slice(0, starts[-1]), counts[:-1], long[:-1]
        if long.any():
            by_row = pa.array(np.repeat(long, counts))
            yield from self.rows.feed(batch.filter(by_row))
            batch = batch.filter(pc.invert(by_row))
        if batch.num_rows:
            yield from Run(self, batch).fold()
        return rest


class Run:
    """Whole paths in columns: one entry for each record, and one for the state of each path."""

    def __init__(self, folder: ColumnFolder, batch: pa.RecordBatch):
        self.policy, self.with_timeline = folder.policy, folder.with_timeline
        kind = batch.column("kind")
        effect = pc.equal(kind, "fx").to_numpy(zero_copy_only=False)
        real = np.flatnonzero(~effect)
        n = len(real)
        self.tombed, self.stale, self.next_purge = np.zeros(n, bool), np.zeros(n, bool), np.full(n, NEVER)
        if effect.any():
            # the effects on a row lie right before it
            first = np.concatenate([[0], real[:-1] + 1])
            self.tombed = np.maximum.reduceat(flags(batch.column("under_tombstone")), first) == 1
            self.stale = np.maximum.reduceat(flags(batch.column("stale_parent")), first) == 1
            self.next_purge = np.minimum.reduceat(numbers(batch.column("next_purge"), NEVER), first)
            batch = batch.filter(pa.array(~effect))
        self.batch, self.first = batch, _starts(batch)
        self.counts = np.diff(np.append(self.first, n))
        column = batch.column
        self.head = pc.equal(column("kind"), "head").to_numpy(zero_copy_only=False)
        self.op = pc.fill_null(column("op"), -1).to_numpy(zero_copy_only=False)
        self.is_dir, self.skipped = flags(column("is_dir")), flags(column("audit_skipped")) == 1
        self.seq, self.size, self.mtime, self.ctime = (numbers(column(c)) for c in ("seq", "size", "mtime_us", "ctime_us"))
        self.event, self.now, self.clock, self.epoch = (numbers(column(c)) for c in ("timestamp_us", "arrival_us", "clock_us", "epoch"))
        if folder.timelines is not None:
            self._from_timelines(folder.timelines)

        paths = len(self.first)
        self.exists = np.zeros(paths, bool)
        self.state = [np.full(paths, -1, np.int8) if i in FLAGS or i == PF.SOURCE else np.full(paths, NULL) for i in range(len(PF.STATE_FIELDS))]
        self.state[PF.TOMB][:] = 0
        self.purge_at = np.full(paths, NEVER)
        if self.head.any():
            prior = column("prior")
            self.prior_known = pc.is_valid(prior).to_numpy(zero_copy_only=False)
            fields = prior.flatten()
            read = lambda i: _source_codes(fields[i]) if i == PF.SOURCE else flags(fields[i]) if i in FLAGS else numbers(fields[i])
            self.prior = [read(i) for i in range(len(PF.STATE_FIELDS))]
        self._read_ends(folder.ends)
        # the last timeline entry of a path
        self.marked = [np.zeros(paths, bool), np.zeros(paths, np.int8), np.full(paths, NULL)]
        self.marks: list[tuple] = []
        self.outcome, self.significant, self.stamps, self.purges = np.full(n, -1, np.int8), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)

    def _from_timelines(self, lines: PF.Timelines) -> None:
        """What ancestors do to each record, where their timelines are at hand: once for all records of a directory."""
        at = pa.array(self.first)
        keys = zip(self.batch.column("group_id").take(at).to_pylist(), self.batch.column("path").take(at).to_pylist())
        claimed = numbers(self.batch.column("claimed_parent_us"), 0)
        scan = self.op == PF.SCAN_UPDATE
        inside: dict[tuple, tuple[str, list]] = {}
        for (group, path), first, count in zip(keys, self.first.tolist(), self.counts.tolist()):
            inside.setdefault((group, path[: path.rfind("/")] or "/"), (path, []))[1].append((first, count))
        for (group, _), (path, spans) in inside.items():
            above = lines.above(group, path)
            if not (above.lines or above.purges or above.parent):
                continue
            rows = np.concatenate([np.arange(first, first + count) for first, count in spans])
            seq = self.seq[rows]
            for at_seq, what in above.lines:
                tomb = np.array([False, *(t for _, t, _ in what)])
                self.tombed[rows] |= tomb[np.searchsorted(at_seq, seq, "left")] & scan[rows]
            if above.purges:
                self.next_purge[rows] = np.array([*above.purges, NEVER])[np.searchsorted(above.purges, seq, "right")]
            if above.parent:
                at_seq, what = above.parent
                known = np.array([False, *(k for k, _, _ in what)])
                mtime = np.array([0, *(m if m is not None else 0 for _, _, m in what)], np.int64)
                before = np.searchsorted(at_seq, seq, "left")
                self.stale[rows] = scan[rows] & (claimed[rows] > 0) & known[before] & (claimed[rows] < mtime[before])

    def _read_ends(self, ends: dict[str, str] | None) -> None:
        """Audit ends of the groups, one after the other, and the part of them that concerns each path. They are in the
        rows, unless ``ends`` has them by group."""
        at = pa.array(self.first)
        texts = self.batch.column("ends" if ends is None else "group_id").take(at).dictionary_encode()
        code = pc.fill_null(texts.indices, -1).to_numpy(zero_copy_only=False)
        parsed = [PF.parse_ends(t if ends is None else ends.get(t)) for t in texts.dictionary.to_pylist()]
        size = np.array([len(p) for p in parsed] + [0])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.end_at = begin[code].astype(np.int64)
        self.end_stop = self.end_at + size[code]
        flat = np.array([e for p in parsed for e in p] + [(NEVER, 0, 0, 0)], np.int64)
        self.end_seq, self.end_id, self.end_start, self.end_now = flat.T
        covers = self.batch.column("covered").take(at).dictionary_encode()
        self.cover = pc.fill_null(covers.indices, -1).to_numpy(zero_copy_only=False)
        self.covers = [np.array([int(x) for x in t.split(",")] if t else [], np.int64) for t in covers.dictionary.to_pylist()]

    def fold(self) -> Iterator[pa.RecordBatch]:
        order = np.argsort(-self.counts, kind="stable")
        for k in range(int(self.counts.max())):
            active = order[: np.searchsorted(-self.counts[order], -k, "left")]
            rows = self.first[active] + k
            self._advance(active, self.seq[rows])
            head = self.head[rows]
            if head.any():
                self._enter(active[head], rows[head])
            if not head.all():
                self._step(active[~head], rows[~head])
            self.purge_at[active] = self.next_purge[rows]
            self._mark(active, self.seq[rows])
        everything = np.arange(len(self.first))
        self._advance(everything, np.full(len(everything), NEVER))
        yield from self._results()

    def _enter(self, p: np.ndarray, rows: np.ndarray) -> None:
        """The state that a path had before the batch."""
        known = self.prior_known[rows]
        p, rows = p[known], rows[known]
        self.exists[p] = True
        for field, prior in zip(self.state, self.prior):
            field[p] = prior[rows]

    def _advance(self, p: np.ndarray, until: np.ndarray) -> None:
        """Apply inherited purges and audit ends that lie before ``until``."""
        while len(p):
            at = self.end_at[p]
            end = np.where(at < self.end_stop[p], self.end_seq[np.minimum(at, len(self.end_seq) - 1)], NEVER)
            purge = self.purge_at[p]
            due = np.minimum(end, purge) < until
            p, until, at, end, purge = p[due], until[due], at[due], end[due], purge[due]
            cut = purge < end
            if cut.any():
                self.exists[p[cut]] = False
                self.purge_at[p[cut]] = NEVER
                self._mark(p[cut], purge[cut])
            if not cut.all():
                ended, at = p[~cut], at[~cut]
                self.end_at[ended] += 1
                self._audit_end(ended, at)
                self._mark(ended, end[~cut])

    def _audit_end(self, p: np.ndarray, at: np.ndarray) -> None:
        """Missing live nodes and expired tombstones go."""
        s = self.state
        judged = self.exists[p] & (self.end_id[at] >= 1)
        p, at = p[judged], at[judged]
        if not len(p):
            return
        covered = np.zeros(len(p), bool)
        for code in np.unique(self.cover[p]):
            if code >= 0:
                same = self.cover[p] == code
                covered[same] = np.isin(self.end_seq[at[same]], self.covers[code])
        tomb, expiry, confirmed = s[PF.TOMB][p] == 1, s[PF.TOMB_EXPIRY][p], s[PF.CONFIRMED][p]
        over = (expiry == NULL) | (self.end_now[at] >= expiry)
        kept = covered | ((confirmed != NULL) & (confirmed > self.end_start[at])) | (s[PF.SEEN][p] >= self.end_id[at])
        self.exists[p[np.where(tomb, over, ~kept)]] = False

    @staticmethod
    def _fenced(mark: np.ndarray, event: np.ndarray) -> np.ndarray:
        return (mark > 0) & (event > 0) & (event <= mark)

    def _step(self, p: np.ndarray, r: np.ndarray) -> None:
        """One record against each of the paths ``p``; the rules are those of ``path_fold.step``."""
        s, policy = self.state, self.policy
        op, mtime, event, now, epoch = self.op[r], self.mtime[r], self.event[r], self.now[r], self.epoch[r]
        known = self.exists[p].copy()
        tomb, old_mtime = known & (s[PF.TOMB][p] == 1), s[PF.MTIME][p].copy()
        old_size, old_dir, source = s[PF.SIZE][p].copy(), s[PF.IS_DIR][p].copy(), s[PF.SOURCE][p].copy()
        fenced = self._fenced(s[PF.LAST_RT][p], event)
        outcome, purges = np.full(len(p), _IGNORED, np.int8), np.zeros(len(p), bool)

        def put(where: np.ndarray, **values) -> None:
            at = p[where]
            for name, value in values.items():
                s[getattr(PF, name)][at] = value[where] if isinstance(value, np.ndarray) else value

        # deletions
        deleted = op == PF.LIVE_DELETE
        fresh = deleted & ~known
        put(fresh, SIZE=0, MTIME=mtime, CTIME=self.ctime[r], IS_DIR=self.is_dir[r], SOURCE=1, ATTESTED=0, CONFIRMED=NULL, BLIND=0, SEEN=0, STAMP=NULL)
        put(deleted, TOMB=1, TOMB_EXPIRY=now + policy.tombstone_ttl_us, TOMB_AT=event, LAST_RT=event, SUSPECT=NULL)
        purges |= deleted & known & (self.is_dir[r] == 1)
        unseen = (op == PF.SCAN_DELETE) & known & ~tomb & ~fenced & (old_mtime <= mtime) & ~((old_mtime == mtime) & (source == 1))
        outcome[deleted | unseen] = _DELETED

        # updates
        scan, atomic = op == PF.SCAN_UPDATE, op == PF.ATOMIC_UPDATE
        update = op < PF.LIVE_DELETE
        update &= ~(scan & (self.tombed[r] | (~known & self.stale[r])))
        until = now + policy.suspect_window_us
        hot = self.clock[r] - mtime < policy.suspect_window_us
        made = update & ~known
        put(
            made, SIZE=self.size[r], MTIME=mtime, CTIME=self.ctime[r], IS_DIR=self.is_dir[r], SOURCE=(~scan).astype(np.int8), ATTESTED=(~scan).astype(np.int8),
            CONFIRMED=np.where(scan, NULL, now), SUSPECT=np.where(np.where(scan, hot, ~atomic), until, NULL), BLIND=(scan & (epoch >= 1)).astype(np.int8),
            TOMB=0, TOMB_EXPIRY=NULL, TOMB_AT=NULL, LAST_RT=np.where(scan, NULL, event), SEEN=epoch, STAMP=NULL,
        )
        outcome[made] = _CREATED

        update &= known
        expiry = s[PF.TOMB_EXPIRY][p]
        returns = (mtime > old_mtime) & (((expiry != NULL) & (now >= expiry)) | (mtime - old_mtime >= policy.tolerance_us))
        refused = update & tomb & (self._fenced(s[PF.TOMB_AT][p], event) | (~atomic & ~returns))
        put((refused & ~atomic) | (update & ~refused & scan), SEEN=epoch)
        applied = update & ~refused & ~(scan & fenced) & ((old_mtime < mtime) | (atomic & (source == 0)))
        put(applied & tomb, TOMB=0, TOMB_EXPIRY=NULL, TOMB_AT=NULL)
        put(applied, SIZE=self.size[r], MTIME=mtime, CTIME=self.ctime[r], IS_DIR=self.is_dir[r], SEEN=epoch, SOURCE=(~scan).astype(np.int8))
        put(applied & scan, ATTESTED=0, SUSPECT=np.where(hot, until, NULL))
        put(applied & scan & (epoch >= 1), BLIND=1)
        put(applied & ~scan, ATTESTED=1, CONFIRMED=now, LAST_RT=event, BLIND=0, SUSPECT=np.where(atomic, NULL, until))
        outcome[applied] = np.where(tomb[applied], _CREATED, _MODIFIED)
        purges |= applied & ~tomb & (old_dir != self.is_dir[r])

        self.exists[p] = (known | deleted | made) & ~unseen
        different = (old_size != s[PF.SIZE][p]) | (old_mtime != s[PF.MTIME][p]) | (old_dir != s[PF.IS_DIR][p])
        significant = (outcome == _CREATED) | (outcome == _DELETED) | ((outcome == _MODIFIED) & ~self.skipped[r] & different)
        self.outcome[r], self.purges[r], self.significant[r] = outcome, purges, significant
        # a path that is gone after its change stamps neither itself nor its ancestors
        self.stamps[r] = significant & self.exists[p]

    def _mark(self, p: np.ndarray, seq: np.ndarray) -> None:
        """Note paths that are no longer what the last timeline entry says."""
        if not self.with_timeline:
            return
        exists = self.exists[p]
        entry = exists, np.where(exists, self.state[PF.TOMB][p], 0).astype(np.int8), np.where(exists, self.state[PF.MTIME][p], NULL)
        new = np.zeros(len(p), bool)
        for marked, value in zip(self.marked, entry):
            new |= marked[p] != value
        for marked, value in zip(self.marked, entry):
            marked[p] = value
        if new.any():
            self.marks.append((p[new], seq[new], *(value[new] for value in entry)))

    def _results(self) -> Iterator[pa.RecordBatch]:
        column = self.batch.column
        left = np.flatnonzero(self.exists)
        if len(left):
            at = pa.array(self.first[left])
            found = {"group_id": column("group_id").take(at), "path": column("path").take(at)}
            for i, (name, values) in enumerate(zip(PF.STATE_FIELDS, self.state)):
                values = values[left]
                found[name] = _SOURCES.take(pa.array(values)) if i == PF.SOURCE else _flag_array(values) if i in FLAGS else _number_array(values)
            yield PF.batch_of("state", len(left), found)
        rows = np.flatnonzero(~self.head)
        if len(rows):
            at = pa.array(rows)
            yield PF.batch_of("outcome", len(rows), {
                **{name: column(name).take(at) for name in ("group_id", "path", "seq", "origin_id", "arrival_us")},
                "outcome": _OUTCOMES.take(pa.array(self.outcome[rows])), "significant": self.significant[rows], "stamps": self.stamps[rows],
                "rec_is_dir": column("is_dir").take(at), "rec_mtime_us": column("mtime_us").take(at), "rec_ctime_us": column("ctime_us").take(at),
            })
        cut = np.flatnonzero(self.purges)
        if len(cut):
            at = pa.array(cut)
            yield PF.batch_of("purge", len(cut), {name: column(name).take(at) for name in ("group_id", "path", "seq")})
        if self.marks:
            p, seq, known, tomb, mtime = (np.concatenate(x) for x in zip(*self.marks))
            at = pa.array(self.first[p])
            yield PF.batch_of("timeline", len(p), {
                "group_id": column("group_id").take(at), "path": column("path").take(at), "seq": seq, "known": known, "tomb": tomb == 1,
                "at_mtime_us": _number_array(mtime),
            })


def _source_codes(column: pa.Array) -> np.ndarray:
    return pc.equal(pc.fill_null(column, S.SCAN), S.REALTIME).to_numpy(zero_copy_only=False).astype(np.int8)


def folder(policy: PF.Policy, with_timeline: bool, timelines=None, ends=None):
    """The function a task runs; ``timelines`` is a broadcast of ``Timelines``, ``ends`` one of the audit ends' texts by group."""

    def run(batches):
        above, texts = (None if x is None else x.value for x in (timelines, ends))
        yield from ColumnFolder(policy, with_timeline, above, ends=texts)(batches)

    return run
