"""What a Python worker keeps between tasks: the memory of one operator at a time.

Spark gives a worker tasks of all operators in turn, and a worker that kept what each of them had
remembered would hold the sum of all. So an operator that remembers does it here, and the tasks of
others begin by giving that back.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import pyarrow as pa

_held: dict[Hashable, object] = {}


def remembered[T](key: Hashable, make: Callable[[], T]) -> T:
    """make()'s result, the same for all calls with this key until another key or give_back()."""
    if key not in _held:
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Drops what is remembered, and returns memory that is free to the system."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, a function for mapInArrow, in a worker that holds nothing of other operators or of tasks before."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from work(batches)

    return run
