"""Memory of Python workers, which Spark keeps from task to task and hands on from one operator to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_FORGET: list[Callable[[], None]] = []


def forgets(forget: Callable[[], None]) -> None:
    """forget empties a cache that a module keeps beyond one call."""
    _FORGET.append(forget)


def give_back() -> None:
    """Caches of all modules go, and free memory goes back to the system; Arrow's pool and malloc() keep it else."""
    for forget in _FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow(): what earlier operators left in the worker goes first, what run remembers goes with the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def tidied_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for applyInArrow(), group by group."""

    def group(found: pa.Table) -> pa.Table:
        try:
            return run(found)
        finally:
            give_back()

    return group
