"""Arrow batches in small slices, so that a worker holds few texts as Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 500


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows; freed buffers go back to the system at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        batch = None  # noqa: PLW2901 - not held while the next one is read
