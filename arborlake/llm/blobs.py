"""Arrays on their way through a shuffle: one row per slice instead of one row per element."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def deal(kind: int, slices: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Cut equally long arrays by slice: rows of (kind, slice, n, c0, c1, ...) with packed arrays."""
    order = np.argsort(slices, kind="stable")
    values, first = np.unique(slices[order], return_index=True)
    ends = np.append(first[1:], len(slices))
    packed = [[x.tobytes() for x in np.split(c[order], first[1:])] if len(slices) else [] for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(values), pa.int32()), pa.array(values.astype(np.int32)), pa.array((ends - first).astype(np.int64)), *[pa.array(p, pa.binary()) for p in packed]],
        ["kind", "slice", "n", *[f"c{i}" for i in range(len(columns))]],
    )


def schema(columns: int) -> str:
    return "kind int, slice int, n long, " + ", ".join(f"c{i} binary" for i in range(columns))


class Gathered:
    """The rows of a partition put together again, by (kind, slice)."""

    def __init__(self, batches: Iterator[pa.RecordBatch], dtypes: list[str]):
        self.dtypes, self.held = dtypes, {}
        for batch in batches:
            for kind, part, _, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                self.held.setdefault((kind, part), []).append(packed)

    def keys(self) -> Iterable[tuple[int, int]]:
        return sorted(self.held)

    def take(self, key: tuple[int, int]) -> list[np.ndarray]:
        rows = self.held.pop(key)
        return [np.frombuffer(b"".join(column), dtype) for column, dtype in zip(zip(*rows), self.dtypes)]
