"""Small state machines per key: modify throttle, drift estimate and root sentinel.

Each is a fold over rows sorted by (key, order). Rows of one key stream through one task with a
state of fixed size, across Arrow batches, and are never collected.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}


def keyed_fold(
    df: DataFrame, keys: list[str], order: str, machine: Callable[[], object], inputs: list[str], schema: T.StructType
) -> DataFrame:
    """Run ``machine().feed(*inputs)`` over each key in order; it yields output rows without keys."""
    out = T.StructType([df.schema[k] for k in keys] + list(schema.fields))
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in out.fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            rows = []
            for values in zip(*(col.to_pylist() for col in batch.columns)):
                key = values[:n]
                if key != current:
                    current, state = key, machine()
                rows.extend((*key, *r) for r in state.feed(*values[n:]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
                )

    return (
        df.select(*keys, *inputs).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, out)
    )


class Throttle:
    """One modify per interval; a closed write lets the next modify through at once."""

    def __init__(self, interval_us: int = 500_000):
        self.interval, self.last = interval_us, None

    def allows(self, kind: str, at: int) -> bool:
        if kind == "modify":
            if self.last is not None and at - self.last < self.interval:
                return False
            self.last = at
        elif kind == "close_write":
            self.last = None
        return True

    def feed(self, seq, kind, at):
        yield seq, self.allows(kind, at)


def throttle_modifies(events: DataFrame, interval_us: int = 500_000) -> DataFrame:
    """(origin_id, path, seq, emitted) from rows of (origin_id, path, seq, kind, arrival_us)."""
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("emitted", T.BooleanType())])
    return keyed_fold(events, ["origin_id", "path"], "seq", lambda: Throttle(interval_us), ["seq", "kind", "arrival_us"], schema)


class Drift:
    """Clock drift of a source from a window of samples; element ⌊0.999·n⌋−1 of the sorted window."""

    def __init__(self, window: int = 10_000, graduation: int = 10_000, max_jump_us: int = 10_000_000):
        self.window, self.graduation, self.max_jump = window, graduation, max_jump_us
        self.recent, self.sorted, self.realtime, self.drift = deque(), [], 0, 0

    def push(self, realtime: bool, sample: float) -> int:
        if realtime:
            self.realtime += 1
        elif self.realtime >= self.graduation:
            return self.drift
        self.recent.append(sample)
        insort(self.sorted, sample)
        if len(self.recent) > self.window:
            del self.sorted[bisect_left(self.sorted, self.recent.popleft())]
        n = len(self.sorted)
        if n >= 10:
            proposed = int(self.sorted[max(int(n * 0.999) - 1, 0)] * 1_000_000.0)
            if self.realtime < self.graduation or abs(proposed - self.drift) <= self.max_jump:
                self.drift = proposed
        return self.drift

    def feed(self, seq, realtime, mtime_us, local_us):
        yield seq, self.push(realtime, mtime_us / 1e6 - local_us / 1e6), self.realtime >= self.graduation


def drift_estimates(samples: DataFrame, window: int = 10_000, graduation: int = 10_000, max_jump_us: int = 10_000_000) -> DataFrame:
    """(origin_id, seq, drift_us, graduated) after every sample (origin_id, seq, realtime, mtime_us, local_us)."""
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("drift_us", T.LongType()),
                           T.StructField("graduated", T.BooleanType())])
    return keyed_fold(samples, ["origin_id"], "seq", lambda: Drift(window, graduation, max_jump_us),
                      ["seq", "realtime", "mtime_us", "local_us"], schema)


class Sentinel:
    """Health of one root: turns signals into rescan, degraded and recovered actions."""

    def __init__(self, overflows: int = 3, window_us: int = 60_000_000, corrections: int = 50, errors: int = 3):
        self.limits = (overflows, window_us, corrections, errors)
        self.overflow_count, self.last_overflow, self.errors, self.drift = 0, None, 0, 0
        self.degraded, self.last_error = False, None

    def _degrade(self, reason):
        if self.degraded:
            return []
        self.degraded = True
        return [("degraded", reason)]

    def signal(self, kind: str, at: int, amount: int | None, detail: str | None):
        overflows, window, corrections, errors = self.limits
        if kind == "overflow":
            if self.last_overflow is not None and at - self.last_overflow > window:
                self.overflow_count = 0
            self.overflow_count, self.last_overflow = self.overflow_count + 1, at
            if self.overflow_count < overflows:
                return []
            self.overflow_count = 0
            return [("rescan", None), *self._degrade("repeated watch overflow")]
        if kind == "init_failed":
            return self._degrade(f"watch init failed: {detail}")
        if kind == "audit_drift":
            self.drift = amount
            if amount >= corrections:
                return self._degrade(f"audit drift: {amount} corrections")
            return self._recover() if amount == 0 else []
        if kind == "error":
            self.errors += 1
            if self.errors < errors or self.degraded:
                return []
            return [("rescan", None), *self._degrade(f"{self.errors} consecutive errors")]
        if kind in ("timeout", "backpressure"):
            self.degraded, self.last_error = True, f"HOST_FS_{kind.upper()}"
            return [("degraded", f"{self.last_error}: {detail}")]
        if kind == "recovered":
            self.errors, self.last_error = 0, None
            return self._recover()
        raise ValueError(f"unknown signal {kind!r}")

    def _recover(self):
        if not self.degraded:
            return []
        self.degraded = False
        return [("recovered", None)]

    def standing(self) -> str | None:
        """Why the root is degraded now, or None."""
        if not self.degraded:
            return None
        if self.last_error:
            return self.last_error
        for name, count in (("overflow", self.overflow_count), ("errors", self.errors), ("drift", self.drift)):
            if count > 0:
                return f"{name}({count})"
        return "degraded"

    def feed(self, seq, kind, at, amount, detail):
        for no, (action, reason) in enumerate(self.signal(kind, at, amount, detail)):
            yield seq, no, action, reason, self.standing()


SENTINEL_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("action_no", T.IntegerType()), T.StructField("action", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("standing", T.StringType()),
])


def sentinel_actions(signals: DataFrame, **limits) -> DataFrame:
    """Actions from (root_key, seq, kind, at_us, amount, detail)."""
    return keyed_fold(signals, ["root_key"], "seq", lambda: Sentinel(**limits),
                      ["seq", "kind", "at_us", "amount", "detail"], SENTINEL_SCHEMA)
