"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

CHUNK_BYTES = 2_000_000


def tidy() -> None:
    """Give memory that a task has freed back to the machine: workers live on, and the next task's need would come on top."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library: nothing to do


def text_chunks(batches, size: int = CHUNK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``size`` characters each from batches of (doc_id, text); null texts are empty.

    A chunk has one row at least, so one long text is a chunk of its own.
    """
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            if ids and held + len(text) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc.as_py())
            texts.append(text)
            held += len(text)
        if ids:
            yield ids, texts


def raw_bytes(column):
    """(bytes of all values as one uint8 array, start offsets) of an Arrow string or binary column without nulls."""
    import numpy as np
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def row_spans(starts, size: int) -> Iterator[tuple[int, int]]:
    """[i, j) spans of rows with about ``size`` bytes each, one row at least."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = i + 1
        while j < n and starts[j + 1] - starts[i] <= size:
            j += 1
        yield i, j
        i = j
