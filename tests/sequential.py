"""A plain one-record-at-a-time reading of arbitration, the oracle for the distributed fold.

It keeps whole trees in dictionaries and shares no code with the engine.
"""

from __future__ import annotations

import copy

INF = float("inf")


def parents(path):
    out = []
    while path not in ("/", ""):
        cut = path.rfind("/")
        if cut < 0:
            break
        path = "/" if cut == 0 else path[:cut]
        out.append(path)
    return out


class Group:
    def __init__(self, primary, ttl, tolerance, suspect):
        self.primary, self.ttl, self.tolerance, self.suspect = primary, ttl, tolerance, suspect
        self.tree, self.clock, self.active, self.completed = {}, 0, None, 0
        self.audit_start, self.skips = None, set()
        self.overflow, self.recovered, self.audited, self.revision = False, None, False, 1

    def below(self, path):
        head = path.rstrip("/") + "/"
        return [p for p in self.tree if p != path and p.startswith(head)]

    def purge(self, path):
        for p in self.below(path):
            del self.tree[p]

    def apply(self, e):
        self.clock = max(self.clock, e["timestamp_us"])
        kind = e["rec_type"]
        if kind == "watch_overflow":
            self.overflow = True
            return None
        if kind != "data":
            if e["origin_id"] == self.primary:
                self.control(e)
            return None
        if e["audit_skipped"]:
            self.skips.add(e["path"])
        before = copy.deepcopy(self.tree.get(e["path"]))
        outcome = self.update(e) if e["event_kind"] == "Update" else self.delete(e)
        sig = outcome in ("UpsertCreated", "DeleteApplied")
        if outcome == "UpsertModified" and not e["audit_skipped"]:
            after = self.tree[e["path"]]
            sig = any(before[k] != after[k] for k in ("size", "mtime", "is_dir", "tomb"))
        if sig:
            self.revision += 1
            if e["path"] in self.tree:
                for p in [e["path"], *parents(e["path"])]:
                    if p in self.tree:
                        self.tree[p]["stamp"] = e["arrival_us"]
        return outcome, sig

    def control(self, e):
        if e["rec_type"] == "epoch_start":
            self.active, self.audit_start = e["epoch_id"], e["arrival_us"]
            self.skips.clear()
            return
        start = self.audit_start if self.audit_start is not None else e["arrival_us"]
        self.audit_start, self.active = None, None
        self.completed += 1
        if e["epoch_id"] >= 1:
            for p in list(self.tree):
                n = self.tree[p]
                if n["tomb"]:
                    continue
                if p in self.skips or any(a in self.skips for a in parents(p)):
                    continue
                if n["confirmed"] is not None and n["confirmed"] > start:
                    continue
                if n["seen"] < e["epoch_id"]:
                    del self.tree[p]
            for p in list(self.tree):
                n = self.tree[p]
                if n["tomb"] and (n["expiry"] is None or e["arrival_us"] >= n["expiry"]):
                    del self.tree[p]
            self.skips.clear()
        self.audited = True
        if self.overflow:
            self.recovered = e["arrival_us"]
            self.revision += 1
        self.overflow = False

    def epoch(self):
        return self.active if self.active is not None else self.completed

    @staticmethod
    def stale(mark, ts):
        return mark is not None and mark > 0 and ts > 0 and ts <= mark

    def update(self, e):
        path, t, now, ts = e["path"], self.tree, e["arrival_us"], e["timestamp_us"]
        scan, atomic = e["source"] == "Scan", e["is_atomic_write"] and e["source"] == "Realtime"
        if scan and any(a in t and t[a]["tomb"] for a in parents(path)):
            return "Ignored"
        if scan and e["parent_path"] and path not in t and e["parent_path"] in t:
            if 0 < e["parent_mtime_us"] < t[e["parent_path"]]["mtime"]:
                return "Ignored"
        n = t.get(path)
        if n is not None and n["tomb"]:
            if atomic:
                if self.stale(n["tomb_at"], ts):
                    return "Ignored"
            else:
                ok = not self.stale(n["tomb_at"], ts) and e["mtime_us"] > n["mtime"]
                if ok and not (n["expiry"] is not None and now >= n["expiry"]):
                    ok = e["mtime_us"] - n["mtime"] >= self.tolerance
                if not ok:
                    n["seen"] = self.epoch()
                    return "Ignored"
        hot = now + self.suspect if self.clock - e["mtime_us"] < self.suspect else None
        if n is None:
            t[path] = dict(
                size=e["size"], mtime=e["mtime_us"], ctime=e["ctime_us"], is_dir=e["is_dir"], source=e["source"],
                attested=not scan, confirmed=None if scan else now,
                suspect=hot if scan else (None if atomic else now + self.suspect), blind=scan and self.epoch() >= 1,
                tomb=False, expiry=None, tomb_at=None, last_rt=None if scan else ts, seen=self.epoch(), stamp=None,
            )
            return "UpsertCreated"
        if scan:
            n["seen"] = self.epoch()
            if self.stale(n["last_rt"], ts):
                return "Ignored"
        if n["mtime"] >= e["mtime_us"] and not (atomic and n["source"] == "Scan"):
            return "Ignored"
        was = n["tomb"]
        moved = n["mtime"] != e["mtime_us"]
        if n["is_dir"] != e["is_dir"] and not was:
            self.purge(path)
        if was:
            n.update(tomb=False, expiry=None, tomb_at=None)
        n.update(size=e["size"], mtime=e["mtime_us"], ctime=e["ctime_us"], is_dir=e["is_dir"], source=e["source"],
                 seen=self.epoch())
        if scan:
            if moved:
                n["attested"] = False
                n["blind"] = True if self.epoch() >= 1 else n["blind"]
                n["suspect"] = hot
        else:
            n.update(attested=True, confirmed=now, last_rt=ts, blind=False,
                     suspect=None if atomic else now + self.suspect)
        return "UpsertCreated" if was else "UpsertModified"

    def delete(self, e):
        path, t, now, ts = e["path"], self.tree, e["arrival_us"], e["timestamp_us"]
        n = t.get(path)
        if e["source"] == "Realtime":
            if n is None:
                t[path] = dict(size=0, mtime=e["mtime_us"], ctime=e["ctime_us"], is_dir=e["is_dir"],
                               source="Realtime", attested=False, confirmed=None, suspect=None, blind=False, tomb=True,
                               expiry=now + self.ttl, tomb_at=ts, last_rt=ts, seen=0, stamp=None)
            else:
                n.update(tomb=True, expiry=now + self.ttl, tomb_at=ts, last_rt=ts, suspect=None)
                if e["is_dir"]:
                    self.purge(path)
            return "DeleteApplied"
        if n is None or n["tomb"] or self.stale(n["last_rt"], ts):
            return "Ignored"
        if n["mtime"] > e["mtime_us"] or (n["mtime"] == e["mtime_us"] and n["source"] == "Realtime"):
            return "Ignored"
        del t[path]
        return "DeleteApplied"


FIELDS = ["size", "mtime", "ctime", "is_dir", "source", "attested", "confirmed", "suspect", "blind", "tomb", "expiry",
          "tomb_at", "last_rt", "seen", "stamp"]


def fold(rows, primaries, ttl=90_000_000, tolerance=1_000_000, suspect=30_000_000, groups=None):
    groups = groups or {g: Group(p, ttl, tolerance, suspect) for g, p in primaries.items()}
    outcomes = {}
    for e in sorted(rows, key=lambda r: (r["group_id"], r["seq"])):
        res = groups[e["group_id"]].apply(e)
        if res is not None:
            outcomes[(e["group_id"], e["seq"])] = res
    state = {(g, p): tuple(n[f] for f in FIELDS) for g, grp in groups.items() for p, n in grp.tree.items()}
    return state, outcomes, groups
