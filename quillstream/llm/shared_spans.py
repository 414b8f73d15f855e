"""Problem 9: stretches of text that stand unchanged in more than one document.

Method: fixed-block anchors.  Each text is cut into non-overlapping blocks of
(least + 1) // 2 characters; any stretch of `least` characters contains one of
them whole.  The hashes of the blocks are kept in a bit filter of bounded
size, every rolling window of every text probes it, and only windows that may be
a block are shuffled to be joined with the blocks.  A hit fixes two
texts and the shift between them; comparing both texts character by character at
that shift extends it to all maximal repeats.

When there are more blocks than the filter can tell apart (MOST_CELLS / LOAD, 45
million), the hashes are cut into slices and the windows probed once per slice; what is broadcast stays bounded.

Defined cases: null texts and texts shorter than `least` share nothing; rows without
identifier are left out, and rows that repeat an identifier and its text count once;
equal texts form one class, which is compared once and, for pairs, expanded afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import textkernel as K
from quillstream.llm.packed import build_filter, filter_bits
from quillstream.runtime import broadcast_if_small, materialize

#: Characters that a stretch must have; characters handled at once within a task.
LEAST = 500
SLICE = 1 << 21
#: Cells (bits) of the filter per block, and its cells at most.
LOAD, MOST_CELLS = 12, 1 << 29
#: Cells at most of the filter of texts with hits.
INVOLVED = 1 << 27


def _slices(batch: pa.RecordBatch):
    """(identifiers, code points) of slices of an Arrow batch with columns doc_id and text."""
    ids = batch.column("doc_id").to_numpy()
    texts = batch.column("text").to_pylist()
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < SLICE):
            total += len(texts[end])
            end += 1
        yield ids[at:end], K.encode(texts[at:end])
        at = end


def _window_hashes(code: K.Batch, size: int) -> np.ndarray:
    """Hash of the window of `size` characters at every position of the batch."""
    prefix = K.prefix_hash(code.cp)
    n = len(code.cp) - size + 1
    _, down = K._power(len(prefix))
    return K.mix64((prefix[size:] - prefix[:n]) * down[:n])


def _places(code: K.Batch) -> tuple[np.ndarray, np.ndarray]:
    """For every position the row of its text and its place within it."""
    length = np.diff(code.start)
    row = np.repeat(np.arange(code.size), length)
    return row, np.arange(len(code.cp)) - code.start[row]


def block_index(docs: DataFrame, size: int) -> DataFrame:
    """(h, doc_id): the non-overlapping blocks of each text, with their place."""

    def per_task(batches):
        for batch in batches:
            for ids, code in _slices(batch):
                if len(code.cp) < size:
                    continue
                h = _window_hashes(code, size)
                count = np.maximum((np.diff(code.start) - 1) // size, 0)
                row = np.repeat(np.arange(code.size), count)
                place = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
                at = code.start[row] + place
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[row]), pa.array(place.astype(np.int32))], ["h", "doc_id", "place"])

    return docs.mapInArrow(per_task, "h bigint, doc_id bigint, place int")


def probing_windows(docs: DataFrame, size: int, summary, part: int = 0, parts: int = 1) -> DataFrame:
    """(h, doc_id, place) of the rolling windows that may be a block, the text's own blocks left out."""

    def per_task(batches):
        for batch in batches:
            for ids, code in _slices(batch):
                if len(code.cp) < size:
                    continue
                h = _window_hashes(code, size)
                row, place = _places(code)
                row, place = row[: len(h)], place[: len(h)]
                inside = (place + size < np.diff(code.start)[row]) & (place % size != 0) if len(row) else np.zeros(0, bool)
                at = np.flatnonzero(inside & (h % np.uint64(parts) == part)) if parts > 1 else np.flatnonzero(inside)
                at = at[summary.value.has(h[at])]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[row[at]]), pa.array(place[at].astype(np.int32))], ["h", "doc_id", "place"])

    return docs.mapInArrow(per_task, "h bigint, doc_id bigint, place int")


def _equal_runs(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of at least `least` equal characters."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], a == b, [False]]).astype(np.int8)))
    lo, length = edge[0::2], edge[1::2] - edge[0::2]
    keep = length >= least
    return lo[keep], length[keep]


def _extend(least: int):
    def per_task(batches):
        for batch in batches:
            a_id, b_id, shift = (batch.column(c).to_numpy() for c in ("a", "b", "shift"))
            ta, tb = batch.column("text_a"), batch.column("text_b")
            rows: list[int] = []
            begin: list[np.ndarray] = []
            length: list[np.ndarray] = []
            for i in range(batch.num_rows):
                x = np.frombuffer(ta[i].as_py().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                y = np.frombuffer(tb[i].as_py().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                d = int(shift[i])
                lo, hi = max(0, -d), min(len(x), len(y) - d)
                if hi - lo < least:
                    continue
                start, size = _equal_runs(x[lo:hi], y[lo + d : hi + d], least)
                rows += [i] * len(start)
                begin.append(start + lo)
                length.append(size)
            if rows:
                r, s, n = np.array(rows), np.concatenate(begin), np.concatenate(length)
                yield pa.RecordBatch.from_arrays([pa.array(a_id[r]), pa.array(b_id[r]), pa.array(s, pa.int64()), pa.array(s + shift[r], pa.int64()), pa.array(n, pa.int64())], ["doc_id_a", "doc_id_b", "start_a", "start_b", "length"])

    return per_task


def _classes(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, first) of long enough texts, first being the smallest identifier with the same text, and one text per class."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"doc_id IS NOT NULL AND text IS NOT NULL AND length(text) >= {least}")
    marked = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")).distinct()
    firsts = marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    members = materialize(marked.join(firsts, ["h1", "h2"]).select("doc_id", "first"), "p9-members")
    spare = materialize(members.where("doc_id <> first").select("doc_id").distinct(), "p9-spare")
    return members, docs.join(broadcast_if_small(spare, 16), "doc_id", "left_anti")


def class_spans(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, first), and all maximal repeats (doc_id_a, doc_id_b, start_a, start_b, length) between classes of different texts."""
    spark = documents.sparkSession
    size = (least + 1) // 2
    members, docs = _classes(documents, least)
    blocks = materialize(block_index(docs, size), "p9-blocks")
    n = blocks.count()
    parts = max(1, -(-n * LOAD // MOST_CELLS))
    hits = None
    for part in range(parts):
        unsigned = F.col("h").cast("decimal(21,0)") + F.when(F.col("h") < 0, F.lit("18446744073709551616")).otherwise("0").cast("decimal(21,0)")
        mine = blocks if parts == 1 else blocks.where(F.pmod(unsigned, F.lit(parts)) == part)
        summary = build_filter(mine.select("h"), lambda b: b.column("h").to_numpy().view(np.uint64), filter_bits(-(-n // parts), LOAD, MOST_CELLS))
        windows = probing_windows(docs, size, spark.sparkContext.broadcast(summary), part, parts)
        x = mine.select("h", F.col("doc_id").alias("a"), F.col("place").alias("pa"))
        # A text's own blocks are in the filter anyway, and meet other texts' blocks without it.
        y = windows.unionByName(mine).select("h", F.col("doc_id").alias("b"), F.col("place").alias("pb"))
        found = x.join(y, "h").where("a < b").select("a", "b", (F.col("pb") - F.col("pa")).alias("shift")).distinct()
        hits = found if hits is None else hits.unionByName(found)
    hits = materialize(hits.distinct(), "p9-hits")
    involved = materialize(hits.select(F.col("a").alias("doc_id")).union(hits.select("b")).distinct(), "p9-involved")
    # A bit filter names the texts with hits, so that the others aren't shuffled, however many there are.
    named = spark.sparkContext.broadcast(build_filter(involved, lambda b: b.column("doc_id").to_numpy().view(np.uint64), filter_bits(involved.count(), LOAD, INVOLVED)))

    def with_hits(batches):
        for batch in batches:
            yield batch.filter(pa.array(named.value.has(batch.column("doc_id").to_numpy().view(np.uint64))))

    texts = materialize(docs.mapInArrow(with_hits, docs.schema).dropDuplicates(["doc_id"]), "p9-texts")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    spans = hits.join(a, "a").join(b, "b").mapInArrow(_extend(least), "doc_id_a bigint, doc_id_b bigint, start_a bigint, start_b bigint, length bigint")
    return members, spans


def sharing_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents that share a stretch of at least `least` characters, copies included."""
    members, spans = class_spans(documents, least)
    linked = spans.select(F.col("doc_id_a").alias("fa"), F.col("doc_id_b").alias("fb")).distinct()
    one = members.select(F.col("doc_id").alias("i"), F.col("first").alias("fa"))
    two = members.select(F.col("doc_id").alias("j"), F.col("first").alias("fb"))
    between = linked.join(one, "fa").join(two, "fb").select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b"))
    within = one.join(two, (F.col("fa") == F.col("fb")) & (F.col("i") < F.col("j"))).select(F.col("i").alias("doc_id_a"), F.col("j").alias("doc_id_b"))
    return between.unionByName(within)


def shared_share(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, first, copies, chars, shared_chars, shared): how much of each text stands elsewhere too.

    first names the class of equal texts; a text with copies is shared as a whole.
    """
    members, spans = class_spans(documents, least)
    sides = spans.select(F.col("doc_id_a").alias("first"), F.col("start_a").alias("lo"), (F.col("start_a") + F.col("length")).alias("hi"))
    sides = sides.union(spans.select("doc_id_b", "start_b", F.col("start_b") + F.col("length"))).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    # One text's stretches are bounded by its length once those inside others are merged; the fold adds up their union.
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))

    def add(acc, x):
        lo = F.greatest(acc["upto"], x["lo"])
        return F.struct((acc["total"] + F.greatest(x["hi"] - lo, F.lit(0))).alias("total"), F.greatest(acc["upto"], x["hi"]).alias("upto"))

    covered = sides.groupBy("first", "lo").agg(F.max("hi").alias("hi")).groupBy("first").agg(F.aggregate(ordered, start, add)["total"].alias("part"))
    copies = members.groupBy("first").agg(F.count("*").alias("copies"))
    length = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("chars")).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    facts = length.join(members, "doc_id", "left").join(copies, "first", "left").join(covered, "first", "left")
    shared = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("part", F.lit(0)))
    return facts.select("doc_id", F.coalesce("first", "doc_id").alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"), "chars", shared.alias("shared_chars"), F.when(F.col("chars") > 0, F.round(shared / F.col("chars"), 6)).alias("shared"))
