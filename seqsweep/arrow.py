"""Arrow columns as numpy arrays, and steps over record batches that run in one Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def through(df: DataFrame, step: Step, schema) -> DataFrame:
    """df.mapInArrow(step, schema); after another such step both run in one worker, and rows pass from one to the other there."""
    base, before = getattr(df, "_through", (df, None))
    both = step if before is None else lambda batches: step(before(batches))
    out = base.mapInArrow(both, schema)
    out._through = (base, both)
    return out


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins and the last one ends; a null is empty."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int32)
    return np.frombuffer(data or b"", np.uint8), at


def texts(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of the given sizes that stand end to end in data."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[begin:end] of each row."""
    size = end - begin
    spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
    return texts(data[spot], size)


def portions(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a string column, a row at least."""
    _, at = letters(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(int(np.searchsorted(at, at[a] + most, "right")) - 1, a + 1)
        yield batch.slice(a, b - a)
        a = b


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """The batches, small ones together until they have so many rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
