"""A table of bits that tells most values of a set from others: what it lets pass is joined exactly afterwards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordhash import scramble

BITS, CHUNKS = 26, 64  # 8 MB at any size; as sets grow it lets more pass, at last everything


def _slots(values: np.ndarray) -> np.ndarray:
    return (scramble(values.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def bit_filter(values: DataFrame) -> np.ndarray:
    """From a table of one long column; built in parts by the tasks and joined by ranges of slots."""
    import zstandard

    width = (1 << BITS) // CHUNKS

    def mark(batches):
        press = zstandard.ZstdCompressor(level=1)
        slots = [np.unique(_slots(b.column(0).to_numpy())) for b in batches if b.num_rows]
        slots = np.unique(np.concatenate(slots)) if slots else np.zeros(0, np.int64)
        ends = np.searchsorted(slots, np.arange(CHUNKS + 1) * width)
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if b > a:
                cells = np.zeros(width, bool)
                cells[slots[a:b] - k * width] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([press.compress(np.packbits(cells).tobytes())], pa.binary())], names=["chunk", "bits"])

    def add(batches):
        press, found = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[k] = found.get(k, np.uint8(0)) | np.frombuffer(press.decompress(c), np.uint8)
        for k, cells in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(cells.tobytes())], pa.binary())], names=["chunk", "bits"])

    kind = "chunk int, bits binary"
    out = np.zeros((CHUNKS, width // 8), np.uint8)
    for k, cells in values.mapInArrow(mark, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).collect():
        out[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(cells), np.uint8)
    return out.reshape(-1)


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set; true for all that are."""
    slots = _slots(values)
    return (table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
