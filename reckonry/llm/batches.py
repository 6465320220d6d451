"""Whole rows of Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, size: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in order, about ``size`` bytes of ``column`` at a time, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, until - at)
        at = until
