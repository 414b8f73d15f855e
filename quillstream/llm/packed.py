"""Packed columns: how millions of small records go through a shuffle at a few bytes each.

A task sorts its records by their key, cuts them by ranges of keys into buckets and
emits one row per bucket: the keys as differences, every column cut into its byte
planes, all compressed.  Whoever gathers a bucket unpacks these into arrays and goes
on in numpy.  A task never holds more than `FLUSH` records, whatever its input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records a task holds before it emits them, and bytes of packed rows in one Arrow batch.
FLUSH = 1 << 21
BATCH_BYTES = 4 << 20
#: Records that a bucket should hold on average, and the fewest and most buckets.
PER_BUCKET, FEWEST, MOST = 1 << 19, 64, 1 << 16

SCHEMA = "bucket int, data binary"


def buckets_for(records: int) -> int:
    """A power of two of buckets for so many records."""
    return int(min(MOST, max(FEWEST, 1 << max(0, (max(1, records) // PER_BUCKET)).bit_length())))


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return width, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length of whole numbers from 0 on, the first ascending."""
    first = columns[0].astype(np.uint64)
    parts = [_planes(np.diff(first, prepend=np.uint64(0))), *(_planes(c) for c in columns[1:])]
    head = np.array([len(first), len(parts), *(w for w, _ in parts)], dtype="<u4").tobytes()
    return head + pa.Codec("zstd", compression_level=1).compress(b"".join(b for _, b in parts), asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(data, "<u4", 2)
    widths = np.frombuffer(data, "<u4", int(k), 8).astype(int)
    size = int(n) * int(widths.sum())
    body = pa.Codec("zstd").decompress(data[8 + 4 * int(k) :], decompressed_size=size, asbytes=True) if size else b""
    out, at = [], 0
    for w in widths:
        x = np.zeros((int(n), 8), dtype=np.uint8)
        x[:, :w] = np.frombuffer(body, np.uint8, int(n) * w, at).reshape(w, int(n)).T
        out.append(x.view("<u8").ravel())
        at += int(n) * w
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def joined(blobs: Iterable[bytes], columns: int) -> list[np.ndarray]:
    """All blobs of a bucket as one set of columns, not sorted."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.uint64) for c in range(columns)]


def blobs_of(batches: Iterable[pa.RecordBatch], column: str = "data") -> list[bytes]:
    return [x.as_py() for b in batches for x in b.column(column)]


def _emit(columns: list[np.ndarray], bits: int, buckets: int, tidy) -> Iterator[pa.RecordBatch]:
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    if tidy is not None:
        columns = tidy(columns)
    cut = np.searchsorted(columns[0], np.arange(buckets, dtype=np.uint64) << np.uint64(bits - (buckets.bit_length() - 1)))
    ends = np.append(cut[1:], len(columns[0]))
    no: list[int] = []
    data: list[bytes] = []
    held = 0
    for b in np.flatnonzero(ends > cut).tolist():
        no.append(b)
        data.append(pack(*(c[cut[b] : ends[b]] for c in columns)))
        held += len(data[-1])
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])
            no, data, held = [], [], 0
    if no:
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def scatter(chunks: Iterable[list[np.ndarray]], bits: int, buckets: int, tidy=None) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, data) of chunks of columns whose first holds keys of `bits` bits; `tidy` may merge the sorted columns."""
    held: list[list[np.ndarray]] = []
    n = 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk[0])
        if n >= FLUSH:
            yield from _emit([np.concatenate(c) for c in zip(*held)], bits, buckets, tidy)
            held, n = [], 0
    if n:
        yield from _emit([np.concatenate(c) for c in zip(*held)], bits, buckets, tidy)


# -- sets of hashes, one row each ---------------------------------------------------------

#: Bits of an element in a stored set, and the bytes its difference takes.
SET_BITS, SET_BYTES = 48, 6


def pack_sets(h: np.ndarray, size: np.ndarray) -> pa.Array:
    """One binary value per set from the sorted elements (SET_BITS bits) of all sets, one after the other."""
    first = np.cumsum(size) - size
    d = np.diff(h, prepend=np.uint64(0))
    have = size > 0
    d[first[have]] = h[first[have]]
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - first[row]
    out = np.zeros(SET_BYTES * len(h), dtype=np.uint8)
    view = d.astype("<u8").view(np.uint8).reshape(len(d), 8)
    for p in range(SET_BYTES):
        out[SET_BYTES * first[row] + p * size[row] + place] = view[:, p]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * SET_BYTES
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def unpack_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, size): the elements of all sets of a column without nulls, ascending within each."""
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.diff(offsets) // SET_BYTES
    n = int(size.sum())
    row = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    place = np.arange(n) - first[row]
    base = (offsets[:-1] if len(offsets) else offsets)[row]
    raw = np.frombuffer(buffers[2], np.uint8) if n else np.zeros(0, np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    for p in range(SET_BYTES):
        out[:, p] = raw[base + p * size[row] + place]
    d = out.view("<u8").ravel()
    total = np.cumsum(d, dtype=np.uint64)
    have = size > 0
    before = np.zeros(len(size), np.uint64)
    before[have] = total[first[have]] - d[first[have]]
    return row, total - before[row], size


# -- bit filters ------------------------------------------------------------------------------


class BitFilter:
    """A set of 64-bit items as bits; never denies an item that was added."""

    def __init__(self, bits: np.ndarray, probes: int = 4):
        self.bits, self.probes = bits, probes

    @staticmethod
    def slot(items: np.ndarray, size: int, probe: int) -> np.ndarray:
        from quillstream.llm.textkernel import mix64

        return mix64(items ^ np.uint64(0x5851F42D4C957F2D * (probe + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(size - 1)

    def has(self, items: np.ndarray) -> np.ndarray:
        out = np.zeros(len(items), dtype=bool)
        at = np.arange(len(items))
        for i in range(self.probes):  # most items that weren't added fall out at the first probe
            s = self.slot(items, len(self.bits) * 8, i)
            m = (self.bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            items, at = items[m], at[m]
        out[at] = True
        return out


def filter_bits(items: int, per_item: int, most: int) -> int:
    """A power of two of bits for so many items, at most `most`."""
    return int(min(most, max(1 << 13, 1 << (max(1, items * per_item) - 1).bit_length())))


#: Bytes of a filter in one row on its way to the driver.
_PIECE = 1 << 16


def build_filter(rows: DataFrame, items, size: int, probes: int = 4) -> BitFilter:
    """The filter of `size` bits (a power of two) over all items that `items` makes of each Arrow batch of rows.

    Every task fills its own bits and emits the pieces that have any; pieces of
    equal number are joined by OR, so that the driver receives size / 8 bytes at most.
    """

    def fill(batches):
        bits = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            found = items(batch)
            for s in (BitFilter.slot(found, size, i) for i in range(probes)):
                np.bitwise_or.at(bits, s >> np.uint64(3), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(bits), _PIECE):
            if bits[i : i + _PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // _PIECE], pa.int32()), pa.array([pa.Codec("zstd").compress(bits[i : i + _PIECE].tobytes(), asbytes=True)], pa.binary())], ["bucket", "data"])

    piece = min(_PIECE, size // 8)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(piece, dtype=np.uint8)
        for data in (x.as_py() for b in batches for x in b.column("data")):
            bits |= np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=piece, asbytes=True), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["bucket", "data"])

    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.mapInArrow(fill, SCHEMA).groupBy("bucket").applyInArrow(merge, SCHEMA).toLocalIterator():
        out[r["bucket"] * piece : (r["bucket"] + 1) * piece] = np.frombuffer(bytes(r["data"]), np.uint8)
    return BitFilter(out, probes)


def total_of(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, sum of a column) of a stored table."""
    r = df.agg(F.count("*").alias("n"), F.sum(column).alias("s")).first()
    return int(r["n"]), int(r["s"] or 0)
