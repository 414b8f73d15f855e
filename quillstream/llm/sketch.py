"""Mergeable count-min summaries of 64-bit items, built in one pass and bounded in size.

Each task adds its items to its own cells and emits them in chunks; chunks of
equal number are added up, and the driver receives the merged cells, whose
number is fixed by the caller.  An estimate is never below the true count (up to
saturation), so a candidate can't be lost; how many false candidates an exact
second pass has to remove depends on the load of the cells.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.llm.textkernel import mix64

#: Cells per emitted chunk, and the greatest count a cell holds.
CHUNK = 1 << 17
FULL = 65535
#: Upper bound on cells in a summary (two bytes each).
MOST_CELLS = 1 << 24


def cells_for(items: int, per_item: float = 1.0, most: int = MOST_CELLS) -> int:
    """A power of two near items * per_item, from one chunk up to `most`."""
    want = max(1, int(items * per_item))
    return int(min(most, max(CHUNK, 1 << (want - 1).bit_length())))


def slots(items: np.ndarray, cells: int, depth: int) -> list[np.ndarray]:
    """The cell of each item in each of `depth` rows of cells // depth cells, a power of two."""
    width = cells // depth
    out = []
    for r in range(depth):
        h = mix64(items ^ np.uint64(0x632BE59BD9B4E019 * (r + 1) & 0xFFFFFFFFFFFFFFFF))
        out.append((h & np.uint64(width - 1)).astype(np.int64) + r * width)
    return out


def _pack(part: np.ndarray) -> bytes:
    """Counts of a chunk, capped, as low bytes and then high bytes, which compress well apart."""
    b = np.minimum(part, FULL).astype("<u2").view(np.uint8)
    return zlib.compress(b[0::2].tobytes() + b[1::2].tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    half = len(b) // 2
    return b[:half].astype(np.uint32) + (b[half:].astype(np.uint32) << 8)


class Summary:
    """Merged cells with point queries."""

    def __init__(self, table: np.ndarray, depth: int):
        self.table, self.depth = table, depth

    def estimate(self, items: np.ndarray) -> np.ndarray:
        at = slots(items, len(self.table), self.depth)
        low = self.table[at[0]]
        for x in at[1:]:
            low = np.minimum(low, self.table[x])
        return low


def summarize(df: DataFrame, items: Callable[[pa.RecordBatch], np.ndarray], cells: int, depth: int = 1) -> Summary:
    """Count the items that `items` makes of each Arrow batch of df."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            found = items(batch)
            for at in slots(found, cells, depth):
                np.add.at(table, at, np.uint32(1))
        for i in range(0, cells, CHUNK):
            part = table[i : i + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([_pack(part)], pa.binary())], ["chunk", "cells"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, dtype=np.uint32)
        for batch in batches:
            for value in batch.column("cells"):
                total += _unpack(value.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_pack(total)], pa.binary())], ["chunk", "cells"])

    schema = "chunk int, cells binary"
    table = np.zeros(cells, dtype=np.uint16)
    for row in df.mapInArrow(per_task, schema).groupBy("chunk").applyInArrow(merge, schema).toLocalIterator():
        table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = _unpack(bytes(row["cells"]))
    return Summary(table, depth)
