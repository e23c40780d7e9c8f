"""Memory of Python workers, which stay alive between tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa

#: Rows of an Arrow batch that are turned into Python objects at once.
ROWS = 500


def trim() -> None:
    """Hands freed memory back to the system (glibc keeps what numpy has freed, Arrow's pool what Arrow has)."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[list[list]]:
    """Columns of Python objects, some rows at a time; at the end of the task freed memory goes back."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            yield [c.to_pylist() for c in part.columns]
        trim()
