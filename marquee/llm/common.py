"""What the operators share: texts as numpy buffers, collected columns and names of inner columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.scratch import drop, few, settled, small, table

__all__ = ["CHUNK", "binaries", "buffer", "collected", "drop", "few", "free", "runs", "settled", "small", "table", "tidy"]

CHUNK = 1 << 19  # bytes of text handled at once

pa.set_memory_pool(pa.system_memory_pool())  # workers are kept; what they free is to go back


def tidy() -> None:
    """Gives freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and off[-1] else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of about ``most`` bytes; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def binaries(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column over one buffer."""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.binary())


def collected(df: DataFrame) -> np.ndarray:
    """The one column of a frame of a bounded number of rows, without a Python object a row."""
    col = df.toArrow().column(0).combine_chunks()
    return col.to_numpy(zero_copy_only=False) if len(col) else np.empty(0, np.int64)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as it takes not to clash (Spark's names ignore case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name
