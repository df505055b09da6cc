"""Documents in chunks: rows of some megabytes of texts, compressed, that later joins move whole in place of single texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

CHUNK_BYTES = 4 << 20
#: Chunks that a task may make.
TASK_CHUNKS = 1 << 32


def packed(columns: dict[str, pa.Array]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def chunked(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[int | None], list[str]]]:
    """(chunk, ids, texts) of batches of (id, text): as many rows as make ``size`` bytes; numbers are the task's own."""
    number, ids, texts, held = TaskContext.get().partitionId() * TASK_CHUNKS, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= size:
                yield number, ids, texts
                number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def buckets(hashes: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, low, high) of sorted 64-bit hashes dealt to n ranges."""
    of = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        yield int(of[lo]), int(lo), int(hi)
