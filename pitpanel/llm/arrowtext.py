"""Whole texts as flat byte arrays inside a task: slices of bounded size, case folding, words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Rows in a slice at most, whatever their texts.
SLICE_ROWS = 1 << 14

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about `limit` bytes of text and SLICE_ROWS rows; a longer text is alone in its slice.

    When the batches end, freed memory goes back to the system, as the worker lives on for other stages.
    """
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group, rows = np.cumsum(size) // limit, np.arange(b.num_rows) // SLICE_ROWS
        cuts = [0, *(np.flatnonzero((np.diff(group) > 0) | (np.diff(rows) > 0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets into them). A null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return d, o - o[0] if len(texts) else np.zeros(1, np.int64)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


def words(texts: pa.Array, table: np.ndarray = LOWER) -> tuple[pa.Array, np.ndarray]:
    """(all words, text number of each), after mapping every byte by `table`; words end at ASCII white space."""
    data, offsets = flat(texts)
    found = pc.ascii_split_whitespace(strings(table[data], offsets))
    w, row = found.flatten(), pc.list_parent_indices(found).to_numpy()
    full = pc.binary_length(w).to_numpy() > 0
    return w.filter(pa.array(full)), row[full].astype(np.int64)


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each text's run in `row`, which is sorted."""
    return np.searchsorted(row, np.arange(n + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
