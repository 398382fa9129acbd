"""Arrow batches in slices, so that what a task holds of trees and messages does not grow with its batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a slice.
ROWS = 32


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, in order; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
