"""Problem 7: passages of held-out test items inside training documents.

Method: every item is cut into all its windows of `run` words (or of its own
length, if it is shorter), and every window of the same length of every
document gets a SimHash over its words, each weighted by its length in
characters.  The 64 bits are indexed in radius + 1 blocks: two fingerprints within
the radius agree in one block at least, so that block lookups find all of them.
Candidates within the radius are verified by the exact weighted similarity of their
word pairs, and for a similarity of one also word by word, in order.

The items are a stated query set.  They are broadcast in blocks of about `block`
items and BLOCK_CHARS characters at most, so that what is broadcast is bounded whatever their number; the documents are
read once per block and never shuffled.

Defined cases: null or wordless texts contain nothing and are contained in
nothing; rows without identifier are left out; an identifier that several rows
share stands for all their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import textkernel as K
from quillstream.llm.near_duplicates import batches_of_text

#: Consecutive words that make a leak; bits by which fingerprints may differ; items, and characters of items, broadcast at once (a window takes about 220 bytes).
RUN = 13
RADIUS = 3
BLOCK, BLOCK_CHARS = 20_000, 2_000_000
#: Words whose fingerprints are made at once, to stay within the cache.
STEP = 8192


def fingerprints(w: K.Words, length: int, lo: int, hi: int, total: np.ndarray) -> np.ndarray:
    """SimHashes of the windows of `length` words that begin at words lo to hi - 1; total: sums from `signed_sums`."""
    d = total[length : length + hi - lo] > total[: hi - lo]
    return np.packbits(d, axis=1).view(np.uint64).ravel()


def signed_sums(w: K.Words, lo: int, hi: int) -> np.ndarray:
    """Running sums of the words' weighted signs, one row before each word from lo to hi."""
    bits = np.unpackbits(w.hash[lo:hi].view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    weight = np.minimum(w.hi[lo:hi] - w.lo[lo:hi], 255).astype(np.int32)
    out = np.zeros((hi - lo + 1, 64), dtype=np.int32)
    signed = bits * np.int8(2) - np.int8(1)
    np.cumsum(signed * weight[:, None], axis=0, out=out[1:])
    return out


@dataclass
class Probe:
    """The item windows of one length: fingerprints, word hashes and weights, and the items of each window."""

    length: int
    marks: np.ndarray
    words: np.ndarray  # windows x length
    weight: np.ndarray  # windows x length
    items: list[np.ndarray]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per block: first row of a value, sorted order, filled values


def _block_of(marks: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """The bits of one block; blocks of 64 // blocks bits, at most 16 of which are used as a table index."""
    width = 64 // blocks
    return ((marks >> np.uint64(block * width)) & np.uint64((1 << min(width, 16)) - 1)).astype(np.int64)


def probes(ids: list[int], texts: list[str | None], run: int = RUN, radius: int = RADIUS) -> list[Probe]:
    """Index of the windows of all items, by window length."""
    code = K.encode(texts, lower=True)
    w = K.words(code)
    n = np.diff(w.first)
    out = []
    for length in sorted({min(run, int(x)) for x in n if x > 0}):
        found: dict[bytes, list[int]] = {}
        rows: dict[bytes, int] = {}
        for i in np.flatnonzero(np.minimum(run, n) == length):
            for at in range(int(w.first[i]), int(w.first[i + 1]) - length + 1):
                key = w.hash[at : at + length].tobytes()
                rows.setdefault(key, at)
                found.setdefault(key, []).append(ids[i])
        at = np.array(list(rows.values()), dtype=np.int64)
        index = at[:, None] + np.arange(length)
        marks = np.array([fingerprints(w, length, a, a + 1, signed_sums(w, a, a + length))[0] for a in at.tolist()], dtype=np.uint64)
        tables = []
        for b in range(radius + 1):
            value = _block_of(marks, b, radius + 1)
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << min(64 // (radius + 1), 16)) + 1))
            tables.append((first, order, np.diff(first) > 0))
        out.append(Probe(length, marks, w.hash[index], np.minimum(w.hi - w.lo, 255)[index], [np.unique(found[k]) for k in rows], tables))
    return out


def pair_similarity(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the word pairs of windows a and b (rows); a pair weighs its characters."""
    if a.shape[1] == 1:
        return (a == b).all(axis=1).astype(float)
    ha, hb = (K.mix64(x[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + x[:, 1:]) for x in (a, b))
    sa, sb = wa[:, :-1] + wa[:, 1:], wb[:, :-1] + wb[:, 1:]
    same = ha[:, :, None] == hb[:, None, :]
    fa = np.ones(ha.shape, dtype=bool)  # first of its kind within the window
    fb = np.ones(hb.shape, dtype=bool)
    for i in range(1, ha.shape[1]):
        fa[:, i] = ~(ha[:, :i] == ha[:, i : i + 1]).any(axis=1)
        fb[:, i] = ~(hb[:, :i] == hb[:, i : i + 1]).any(axis=1)
    common = (sa * (fa & same.any(axis=2))).sum(axis=1)
    union = (sa * fa).sum(axis=1) + (sb * fb).sum(axis=1) - common
    return common / np.maximum(union, 1)


def match(w: K.Words, index: list[Probe], radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Probe]]:
    """(text, first word, window of the probe, similarity, probe) of all verified windows."""
    n = len(w.hash)
    longest = max((p.length for p in index), default=0)
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        total = signed_sums(w, lo, min(n, hi + longest - 1))
        for p in index:
            last = min(hi, n - p.length + 1)
            if last <= lo:
                continue
            ok = w.doc[lo:last] == w.doc[lo + p.length - 1 : last + p.length - 1]
            marks = fingerprints(w, p.length, lo, last, total)
            pairs = []
            for b, (first, order, filled) in enumerate(p.tables):
                value = _block_of(marks, b, radius + 1)
                at = np.flatnonzero(filled[value] & ok)
                if not len(at):
                    continue
                begin, count = first[value[at]], first[value[at] + 1] - first[value[at]]
                i = np.repeat(at, count)
                within = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                j = order[np.repeat(begin, count) + within]
                near = np.bitwise_count(marks[i] ^ p.marks[j]) <= radius
                pairs.append(i[near] * len(p.marks) + j[near])
            if not pairs:
                continue
            i, j = np.divmod(np.unique(np.concatenate(pairs)), len(p.marks))
            if not len(i):
                continue
            rows = (lo + i)[:, None] + np.arange(p.length)
            got = w.hash[rows]
            equal = (got == p.words[j]).all(axis=1)
            if similarity < 1:
                score = np.where(equal, 1.0, pair_similarity(got, p.words[j], np.minimum(w.hi - w.lo, 255)[rows], p.weight[j]))
            else:
                score = equal.astype(float)
            good = score >= similarity
            yield w.doc[lo + i[good]], lo + i[good], j[good], score[good], p


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, radius: int = RADIUS, similarity: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, windows, similarity): documents with the items they contain.

    windows counts the document's windows that match one of the item, and
    similarity is the best of theirs.
    """
    spark = documents.sparkSession
    stated = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n, chars = stated.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-chars // BLOCK_CHARS))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id bigint, item_id bigint, windows bigint, similarity double"
    out = None
    for k in range(blocks):
        part = stated.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)  # a block of the query set; all blocks are run
        rows = part.orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(probes([r[0] for r in rows], [r[1] for r in rows], run, radius))

        def per_task(batches, index=index):
            for batch in batches:
                ids = batch.column("doc_id").to_numpy()
                for at, _, w in batches_of_text(batch):
                    best: dict[tuple[int, int], list[float]] = {}
                    for doc, _, win, score, p in match(w, index.value, radius, similarity):
                        for d, j, s in zip(doc.tolist(), win.tolist(), score.tolist()):
                            for item in p.items[j].tolist():
                                x = best.setdefault((d, item), [0, 0.0])
                                x[0] += 1
                                x[1] = max(x[1], s)
                    if best:
                        keys, values = list(best), list(best.values())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[at + np.array([d for d, _ in keys])], pa.int64()), pa.array([i for _, i in keys], pa.int64()), pa.array([int(v[0]) for v in values], pa.int64()), pa.array([v[1] for v in values], pa.float64())],
                            ["doc_id", "item_id", "windows", "similarity"],
                        )

        found = docs.mapInArrow(per_task, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.max("similarity").alias("similarity"))
