"""Arrow columns in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes that are Python objects at a time.
ROWS, BYTES = 2000, 1 << 20


def slices(column: pa.Array, *more: pa.Array) -> Iterator:
    """Slices of a text or binary column (tuples of slices, of several columns) of at most ROWS
    rows and about BYTES bytes of the first, a row at least: a batch has a fixed number of rows,
    so its bytes grow with its texts, and Python objects of all of them are several times that."""
    at = 0
    while at < len(column):
        n = min(ROWS, len(column) - at)
        while n > 1 and column.slice(at, n).nbytes > BYTES:
            n = max(1, n // 2)
        parts = tuple(c.slice(at, n) for c in (column, *more))
        yield parts if more else parts[0]
        at += n
