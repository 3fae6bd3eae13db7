"""Python workers: batches of bounded size, and memory given back after a task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa


def small(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, without copying."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Returns this worker's freed memory to the system: an idle worker waits for the tasks of
    later stages in the same process, beside theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library: what it keeps is its own affair.
        return
