"""Buffers: runs of consecutive rows with about `HELD_BYTES` of text, the unit in which a task sums up its documents.

A buffer is named by the number of its first row. Its cut depends only on the rows of the partition, so that two passes
over the same table agree on the buffers. Blobs are arrays compressed column by column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD_BYTES = 24 << 20


def buffers(batches: Iterator[pa.RecordBatch], held_bytes: int = HELD_BYTES) -> Iterator[pa.Table]:
    """Tables of consecutive rows; a row that is longer than `held_bytes` ends its buffer."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.zeros(len(batch), np.int64)
        column = batch.column("text")
        offsets = np.frombuffer(column.cast(pa.large_binary()).buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(batch) else np.zeros(1, np.int64)
        lengths = np.diff(offsets) + 16
        row = 0
        while row < len(batch):
            ends = size + np.cumsum(lengths[row:])
            n = int(np.searchsorted(ends, held_bytes, "left")) + 1
            part = batch.slice(row, min(n, len(batch) - row))
            held.append(part)
            row += len(part)
            if n <= len(ends):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            else:
                size = int(ends[-1])
    if held:
        yield pa.Table.from_batches(held)


def pack(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane without empty planes, compressed."""
    values = np.ascontiguousarray(values).astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    body = np.ascontiguousarray(planes).tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    body = pa.decompress(blob[9:], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    values = np.zeros((n, 8), np.uint8)
    values[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T if n else 0
    return values.view("<u8")[:, 0].astype(np.uint64, copy=False)


def deltas(values: np.ndarray) -> np.ndarray:
    """Differences of integers as unsigned ones, small where the values rise slowly."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    return ((steps << 1) ^ (steps >> 63)).view(np.uint64)


def undeltas(steps: np.ndarray) -> np.ndarray:
    signed = (steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64)
    return np.cumsum(signed)
