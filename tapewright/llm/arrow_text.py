"""Texts of Arrow batches cut into blocks and words without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21  # text of a block, but for one longer document


def blocks(batch: pa.RecordBatch, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, whose last column is text, of about block_bytes; whole rows, one at least."""
    sizes = pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + block_bytes, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, in order, and the row of each; null texts have none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten()
    real = pc.not_equal(flat, "")
    rows = pc.list_parent_indices(split).to_numpy()[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), rows.astype(np.int64)


def mapped_bytes(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with every byte replaced by table's; the table must keep texts valid."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    if not len(whole) or data is None:
        return whole
    changed = table[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(whole), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(changed)])


def listed(values: pa.Array, counts: np.ndarray, kind=pa.ListArray) -> pa.Array:
    """Lists of counts consecutive values."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return kind.from_arrays(pa.array(offsets, pa.int32() if kind is pa.ListArray else pa.int64()), values)
