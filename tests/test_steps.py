"""Arbitration rules one by one, on the step function (no session needed)."""

from arborlake import schemas as S
from arborlake.operators import path_fold as PF
from arborlake.operators.keyed import Drift, Sentinel, Throttle

POLICY = PF.Policy()
SEC = 1_000_000


def rec(op, mtime, ts=0, now=0, clock=0, epoch=0, is_dir=False, size=1, under=False, stale=False):
    return (op, is_dir, size, mtime, mtime, ts, now, clock, epoch, under, stale)


def run(state, *recs):
    out = None
    for r in recs:
        state, out, _ = PF.step(state, r, POLICY)
    return state, out


def test_newer_scan_wins_and_unattests():
    state, _ = run(None, rec(PF.LIVE_UPDATE, 10, ts=5))
    state, out = run(state, rec(PF.SCAN_UPDATE, 20, ts=9, epoch=1, clock=100 * SEC))
    assert out == S.MODIFIED and state[PF.SOURCE] == S.SCAN
    assert not state[PF.ATTESTED] and state[PF.BLIND] and state[PF.SUSPECT] is None


def test_same_time_is_ignored_unless_atomic_over_scan():
    state, _ = run(None, rec(PF.SCAN_UPDATE, 10))
    assert run(state, rec(PF.LIVE_UPDATE, 10))[1] == S.IGNORED
    after, out = run(state, rec(PF.ATOMIC_UPDATE, 5, ts=3))
    assert out == S.MODIFIED and after[PF.MTIME] == 5 and after[PF.ATTESTED]
    assert run(after, rec(PF.ATOMIC_UPDATE, 5, ts=4))[1] == S.IGNORED


def test_scan_not_newer_than_realtime_only_counts_as_seen():
    state, _ = run(None, rec(PF.ATOMIC_UPDATE, 10, ts=50))
    state, out = run(state, rec(PF.SCAN_UPDATE, 99, ts=50, epoch=4))
    assert out == S.IGNORED and state[PF.SEEN] == 4 and state[PF.MTIME] == 10


def test_tombstone_return():
    state, _ = run(None, rec(PF.SCAN_UPDATE, 10 * SEC), rec(PF.LIVE_DELETE, 99, ts=100, now=0))
    assert state[PF.TOMB] and state[PF.MTIME] == 10 * SEC and state[PF.TOMB_EXPIRY] == 90 * SEC
    # inside the tolerance, then beyond it, then inside it but expired
    assert run(state, rec(PF.LIVE_UPDATE, 10 * SEC + 1, ts=101, epoch=7))[1] == S.IGNORED
    assert run(state, rec(PF.LIVE_UPDATE, 11 * SEC, ts=101))[1] == S.CREATED
    assert run(state, rec(PF.LIVE_UPDATE, 10 * SEC + 1, ts=101, now=90 * SEC))[1] == S.CREATED
    # the fence holds for events that are not newer, and zero disables it
    assert run(state, rec(PF.ATOMIC_UPDATE, 1, ts=100))[1] == S.IGNORED
    assert run(state, rec(PF.ATOMIC_UPDATE, 1, ts=0))[1] == S.CREATED


def test_deletes():
    assert run(None, rec(PF.SCAN_DELETE, 10))[1] == S.IGNORED
    state, out = run(None, rec(PF.LIVE_DELETE, 10, ts=3))
    assert out == S.DELETED and state[PF.TOMB] and state[PF.SEEN] == 0
    live, _ = run(None, rec(PF.ATOMIC_UPDATE, 10, ts=3))
    assert run(live, rec(PF.SCAN_DELETE, 10, ts=9))[1] == S.IGNORED  # same time, realtime source
    assert run(live, rec(PF.SCAN_DELETE, 11, ts=9)) == (None, S.DELETED)


def test_type_change_purges_but_not_from_a_tombstone():
    state, _ = run(None, rec(PF.SCAN_UPDATE, 10, is_dir=True))
    assert PF.step(state, rec(PF.SCAN_UPDATE, 20), POLICY)[2]
    tomb, _ = run(state, rec(PF.LIVE_DELETE, 10, is_dir=False))
    assert not PF.step(tomb, rec(PF.ATOMIC_UPDATE, 99, ts=5), POLICY)[2]
    # a directory without a node of its own does not purge what lies below
    assert PF.step(None, rec(PF.LIVE_DELETE, 10, is_dir=True), POLICY)[2] is False


def test_audit_end():
    node, _ = run(None, rec(PF.SCAN_UPDATE, 10, epoch=1))
    end = (5, 2, 100, 200)
    assert PF.audit_end(node, end, covered=False) is None
    assert PF.audit_end(node, end, covered=True) is node
    assert PF.audit_end(node, (5, 0, 100, 200), covered=False) is node
    confirmed, _ = run(None, rec(PF.ATOMIC_UPDATE, 10, now=150))
    assert PF.audit_end(confirmed, end, covered=False) is confirmed


def test_throttle():
    t = Throttle(500)
    assert [t.allows("modify", at) for at in (0, 499, 500)] == [True, False, True]
    t.allows("close_write", 501)
    assert t.allows("modify", 502)


def test_drift_window_and_jump():
    d = Drift(window=20, graduation=5, max_jump_us=1_000_000)
    for i in range(9):
        assert d.push(False, float(i)) == 0
    assert d.push(False, 9.0) == 8_000_000  # element floor(0.999 * 10) - 1 of ten samples
    for _ in range(5):
        d.push(True, 8.0)
    assert d.push(False, 100.0) == d.drift  # scans are ignored after graduation
    for _ in range(30):
        d.push(True, 50.0)
    assert d.drift == 9_000_000  # one step of a second is taken, the jump to 50 is refused


def test_sentinel():
    s = Sentinel()
    sec = 1_000_000
    assert s.signal("overflow", 0, None, None) == [] and s.signal("overflow", sec, None, None) == []
    assert s.signal("overflow", 2 * sec, None, None) == [("rescan", None), ("degraded", "repeated watch overflow")]
    assert s.signal("audit_drift", 3 * sec, 3, None) == []
    assert s.signal("audit_drift", 3 * sec, 0, None) == [("recovered", None)]
    assert s.signal("overflow", 4 * sec, None, None) == [] and s.signal("overflow", 70 * sec, None, None) == []
    assert s.signal("timeout", 0, None, "stat") == [("degraded", "HOST_FS_TIMEOUT: stat")] and s.standing() == "HOST_FS_TIMEOUT"
    assert s.signal("recovered", 0, None, None) == [("recovered", None)] and s.standing() is None
    assert [s.signal("error", 0, None, None) for _ in range(3)][-1] == [("rescan", None), ("degraded", "3 consecutive errors")]
