"""Arrow columns as flat NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8_flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each value starts (one more entry than values); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def binary_column(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Cut a batch so that the strings of `column` in each piece stay near `limit` bytes; one row is never cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    if sizes.sum() <= limit:
        yield batch
        return
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    yield batch.slice(start)
