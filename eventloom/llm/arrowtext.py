"""Arrow batches of (id, text) for the functions that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a worker handles at once; a longer text is one slice by itself.
SLICE_BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows again in slices whose texts (column number ``text``) have about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()  # workers live on


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
