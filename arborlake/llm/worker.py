"""What a Python worker keeps from one task to the next.

Workers outlive stages: what one stage keeps is memory that every later one has to do without. A worker therefore
keeps one value at a time, and stages that need room let go of what others have left.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_KEPT: dict[tuple, Any] = {}


def keep(make: Callable[..., Any], *arguments: Any) -> Any:
    """``make(*arguments)``, made once for as long as the worker is asked for nothing else."""
    key = (make.__module__, make.__qualname__, *arguments)
    if key not in _KEPT:
        forget()
        _KEPT[key] = make(*arguments)
    return _KEPT[key]


def forget() -> None:
    """Give back what earlier tasks have left in this worker."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def cleared(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before which the worker forgets."""

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)

    return started
