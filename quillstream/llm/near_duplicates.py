"""Problem 4: groups of articles whose texts differ just by edits.

Method: a size-aware heavy-light join on shingle sets.  Every text is read once and
becomes a packed set of hashed elements; all else reads these sets.  In how many texts
each element stands is counted exactly by a partitioned aggregation, at every size, and puts the elements of
all sets into one order, rare ones first, so that only a prefix of each set needs to be matched.  Light
sets enumerate the pairs of elements in their prefix and meet on equal pairs; heavy sets
scan inverted lists of single elements and must meet `MEET` times.  The size up to which
a set is light is chosen by comparing the records either way emits.  All candidates
are then verified by their exact overlap.

Why no pair is lost: let two sets of n <= m elements have a similarity of at least
t, hence an overlap of at least o = ceil(t / (1 + t) * (n + m)).  Drop all but the
first n - o + c and m - o + c elements in any common order: at least c <= o common
elements lie in both prefixes (each further one is among the last o - c of one side).

What is broadcast is one bit filter of at most `ORDER_BITS` bits: for thresholds 2 ** k, as many as fit, the
elements that stand in at least so many texts.  Elements below the first threshold
stay in the order of their hashes; where the first threshold is 2, these stand in one text
only, can meet nothing and are left out of a join of a table with itself.

Defined cases: null titles count as empty; rows without id or text are left
out; an article saved again counts once, as its latest row whose payload parses;
texts with fewer words than a shingle have no set and are alike to nothing.
Copies (equal word sequences) form one class, whose sets are compared once.
Elements are told apart by 48 bits of their hash: the chance that an overlap
of two sets of n and m elements is counted too high is n * m / 2 ** 48.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm import packed as P
from quillstream.llm import textkernel as K
from quillstream.llm.common import article_texts
from quillstream.runtime import materialize

#: Consecutive words in an element, and the share of all elements of either text that both must have.
WORDS = 3
SIMILARITY = 0.5
#: Common elements that a pair of heavy sets, and a pair of light sets, must have in their prefixes.
MEET, MEET_LIGHT = 8, 2
#: A number that all numbers up to MEET divide.
WHOLE = math.lcm(*range(1, MEET + 1))
#: Texts handled at once within a task, pairs a task holds at once, and the greatest size of a light set.
SLICE = 512
PAIRS = 1 << 21
LIGHT_MOST = 256
#: Bound on the bits of the broadcast order, bits an element takes in it, and thresholds at most.
ORDER_BITS, PER_ELEMENT, LEVELS = 1 << 27, 8, 6
#: Bound on the bits of the filter of sets that candidates name.
WANTED_BITS = 1 << 27

_ODD = 0x9E3779B97F4A7C15


def need(n, m, t: float):
    """Overlap that sets of n and m elements must have; numpy or plain numbers."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9)


def batches_of_text(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, K.Batch, K.Words]]:
    """Slices of an Arrow batch as (first row, code points, words), small enough for any text length."""
    texts = batch.column(column).to_pylist()
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and end - at < SLICE and (end == at or total + len(texts[end] or "") < 1 << 21):
            total += len(texts[end] or "")
            end += 1
        code = K.encode(texts[at:end], lower=True)
        yield at, code, K.words(code)
        at = end


def class_ids(code: K.Batch, w: K.Words) -> np.ndarray:
    """The class of each text, equal for texts of the same words in the same order."""
    prefix = K.prefix_hash((w.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    high = K.prefix_hash((w.hash >> np.uint64(32)).astype(np.uint32))
    lo, hi = w.first[:-1], w.first[1:]
    return (K.stretch_hash(prefix, lo, hi) ^ K.mix64(K.stretch_hash(high, lo, hi) + np.uint64(1))).view(np.int64)


def class_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, stamp, class_id, size, data): the class of each text and, the first time a task meets the class, its packed set.

    A class may come once per task with its set; what is made of the sets must be distinct by class.
    """

    def per_task(batches):
        seen: set[int] = set()
        for batch in batches:
            for at, code, w in batches_of_text(batch):
                classes = class_ids(code, w)
                fresh = np.zeros(code.size, dtype=bool)
                for i, c in enumerate(classes.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                h, first = K.shingles(w, words)
                e = np.sort((w.doc[first].astype(np.uint64) << np.uint64(P.SET_BITS)) | (h >> np.uint64(64 - P.SET_BITS)))
                e = e[np.diff(e, prepend=~e[:1]) != 0]
                doc = (e >> np.uint64(P.SET_BITS)).astype(np.int64)
                size = np.bincount(doc, minlength=code.size)
                mine = fresh[doc]
                sets = P.pack_sets((e & np.uint64((1 << P.SET_BITS) - 1))[mine], np.where(fresh, size, 0))
                data = pa.array([x if y else None for x, y in zip(sets.to_pylist(), (fresh & (size > 0)).tolist())], pa.binary())
                part = batch.slice(at, code.size)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("stamp"), pa.array(classes), pa.array(size, pa.int32()), data], ["id", "stamp", "class_id", "size", "data"])

    fields = {f.name: f.dataType.simpleString() for f in texts.schema}
    return texts.mapInArrow(per_task, f"id {fields['id']}, stamp {fields['stamp']}, class_id bigint, size int, data binary")


# -- the order of elements -----------------------------------------------------------------------


@dataclass
class Order:
    """Which elements are frequent, and the widths of keys and short class identifiers."""

    key_bits: int
    id_bits: int
    buckets: int
    thresholds: list[int]
    frequent: P.BitFilter
    light: int

    @property
    def drops_single(self) -> bool:
        """Whether elements of level 0 stand in one text only."""
        return self.thresholds[:1] == [2]

    def keys(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(P.SET_BITS - self.key_bits)

    def level(self, h: np.ndarray) -> np.ndarray:
        """How many thresholds each element reaches."""
        out = np.zeros(len(h), dtype=np.uint64)
        at, key = np.arange(len(h)), self.keys(h)
        for k in range(len(self.thresholds)):
            m = self.frequent.has(_tagged(key, k))
            at, key = at[m], key[m]
            out[at] += np.uint64(1)
        return out

    def short(self, classes: np.ndarray) -> np.ndarray:
        return classes.view(np.uint64) >> np.uint64(64 - self.id_bits)

    def short_column(self, name: str) -> Column:
        return F.shiftrightunsigned(F.col(name), 64 - self.id_bits)


def _tagged(key: np.ndarray, level: int) -> np.ndarray:
    return key ^ np.uint64((level + 1) << 50)


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted keys once each, with the sum of the second column."""
    key, n = columns
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    return [key[first], np.add.reduceat(n, first) if len(first) else n]


def _sets_of(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(class_id, row, element, size) of slices of batches of (class_id, data)."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE * 4):
            part = batch.slice(i, SLICE * 4)
            row, h, size = P.unpack_sets(part.column("data"))
            yield part.column("class_id").to_numpy(), row, h, size


def element_order(sets: DataFrame, t: float = SIMILARITY, bits: int | None = None, light: int | None = None, alone: bool = True) -> Order:
    """The order of all elements of stored sets (class_id, size, data), from exact counts of the texts they stand in.

    alone: whether these sets are joined with themselves only, so that elements of one text are left out where they are known.
    """
    bits = bits or ORDER_BITS
    n, total = P.total_of(sets, "size")
    key_bits = min(P.SET_BITS, max(24, total.bit_length() + 9))
    id_bits = min(32, max(16, n.bit_length() + 7))
    buckets = P.buckets_for(total)
    order = Order(key_bits, id_bits, buckets, [], P.BitFilter(np.zeros(1, np.uint8)), 0)

    def items(batches):
        def chunks():
            for _, _, h, _ in _sets_of(batches):
                key = np.sort(order.keys(h))
                yield _merged([key, np.ones(len(key), np.uint64)])

        yield from P.scatter(chunks(), key_bits, buckets, _merged)

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = P.joined(P.blobs_of(batches), 2)
        o = np.argsort(k, kind="stable")
        k, c = _merged([k[o], c[o]])
        bins = np.minimum(np.log2(c.astype(float)), 40).astype(int)
        elements, texts = np.bincount(bins, minlength=41), np.bincount(bins, weights=c.astype(float), minlength=41).astype(np.int64)
        m = c >= 2
        yield pa.RecordBatch.from_arrays([pa.array([P.pack(k[m], c[m])], pa.binary()), pa.array([elements.tolist()], pa.list_(pa.int64())), pa.array([texts.tolist()], pa.list_(pa.int64()))], ["data", "elements", "texts"])

    counted = materialize(sets.select("class_id", "data").mapInArrow(items, P.SCHEMA).groupBy("bucket").applyInArrow(count, "data binary, elements array<bigint>, texts array<bigint>"), "elements")
    sums = counted.agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("elements", "texts") for i in range(41)]).first()
    elements, texts = ([int(sums[f"{c}{i}"] or 0) for i in range(41)] for c in ("elements", "texts"))
    above = [sum(elements[i:]) for i in range(42)]
    low = next((i for i in range(1, 41) if 2 * above[i] * PER_ELEMENT <= bits), 40)
    order.thresholds = [1 << i for i in range(low, 41, 2) if above[i]][:LEVELS]
    held = sum(above[th.bit_length() - 1] for th in order.thresholds)

    def frequent(batch: pa.RecordBatch) -> np.ndarray:
        found = [P.unpack(x.as_py()) for x in batch.column("data")]
        return np.concatenate([np.zeros(0, np.uint64), *(_tagged(k[c >= np.uint64(th)], i) for k, c in found for i, th in enumerate(order.thresholds))])

    if order.thresholds:
        order.frequent = P.build_filter(counted.select("data"), frequent, P.filter_bits(held, PER_ELEMENT, bits))
    order.light = light_boundary(elements, texts, alone and order.drops_single, t) if light is None else light
    return order


def light_boundary(elements: list[int], texts: list[int], drops_single: bool, t: float = SIMILARITY, most: int = LIGHT_MOST) -> int:
    """The greatest size for which enumerating the pairs of a prefix emits no more records than scanning lists.

    elements, texts: how many elements stand in 2 ** i texts or more (but less than the next power), and in how many texts they stand all
    together.  A prefix holds the rarer elements, so that the rarer half of all places tells how
    many of its elements live (stand in two texts) and how many sets a list entry meets.
    """
    left, live, met = sum(texts) / 2, 0.0, 0.0
    half = left
    for n, places in zip(elements, texts):
        take = min(left, places)
        if take <= 0:
            continue
        mean = places / n
        if mean > 1 or not drops_single:
            live += take
            met += take * (mean - 1) / 2
        left -= take
    if not live:
        return 0
    # A prefix of p elements has p * f live ones, p * f * (p * f - 1) / 2 pairs and p * f * (1 + e) list records.
    f, e = live / half, met / live
    p = (2 * (1 + e) + 1) / f
    return int(min(most, max(0.0, (p - MEET_LIGHT) / (1 - t)))) if t < 1 else 0


# -- candidates ---------------------------------------------------------------------------------------


def _entries(classes, row, h, size, order: Order, t: float, drop: bool) -> Iterator[list[np.ndarray]]:
    """Records [key, short class, size, place + 1] of sets: the prefix for inverted lists, and with a place of 0 the pairs of light sets."""
    short = order.short(classes)
    mark = K.mix64(h.copy())
    level = order.level(h)
    o = np.argsort((row.astype(np.uint64) << np.uint64(52)) | (level << np.uint64(48)) | (mark >> np.uint64(16)), kind="stable")
    place = np.arange(len(h)) - (np.cumsum(size) - size)[row]
    h, level, n = h[o], level[o], size[row]
    # The least overlap a set of n can need is with a set of t * n elements.
    rest = n - np.ceil(t * n - 1e-9)
    live = level > 0 if drop else np.ones(len(h), dtype=bool)
    # A set so small that no heavy one can be alike to it needs no list.
    m = live & (place < rest + MEET) & (np.floor(n / t + 1e-9) > order.light)
    yield [order.keys(h[m]), short[row[m]], n[m].astype(np.uint64), place[m].astype(np.uint64) + np.uint64(1)]
    m = live & (n <= order.light) & (place < rest + MEET_LIGHT)
    at, own = row[m], h[m]
    for count in np.unique(q := np.bincount(at, minlength=len(size))):  # all light sets with equally many elements at once
        if count < 1:
            continue
        rows = np.flatnonzero(q == count)
        e = own[np.isin(at, rows)].reshape(len(rows), count)
        a, b = np.triu_indices(count, 1)
        lo, hi = np.minimum(e[:, a], e[:, b]), np.maximum(e[:, a], e[:, b])
        pair = K.mix64(lo * np.uint64(_ODD) + hi) >> np.uint64(64 - order.key_bits)
        who = np.repeat(rows, len(a))
        out, owner = [pair.ravel()], [who]
        one = need(size[rows], np.ceil(t * size[rows]), t) <= 1  # one common element may do
        if one.any():
            out.append((K.mix64(e[one] ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - order.key_bits)).ravel())
            owner.append(np.repeat(rows[one], count))
        key, owner = np.concatenate(out), np.concatenate(owner)
        yield [key, short[owner], size[owner].astype(np.uint64), np.zeros(len(key), np.uint64)]


def packed_entries(sets: DataFrame, order, t: float = SIMILARITY, drop: bool = False) -> DataFrame:
    """(bucket, data): the entries of all sets; order is a broadcast `Order`."""

    def per_task(batches):
        def chunks():
            for found in _sets_of(batches):
                yield from _entries(*found, order.value, t, drop)

        yield from P.scatter(chunks(), order.value.key_bits, order.value.buckets)

    return sets.select("class_id", "data").mapInArrow(per_task, P.SCHEMA)


def _tidy(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Entries in the order of key and size, those that repeat a key and class left out."""
    key, who, size, place = columns
    o = np.lexsort((place > 0, who, size, key))
    columns = [c[o] for c in columns]
    key, who, _, place = columns
    new = np.ones(len(key), dtype=bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(who) != 0) | ((place[1:] > 0) != (place[:-1] > 0))
    return [c[new] for c in columns]


def _meetings(x: list[np.ndarray], y: list[np.ndarray] | None, order: Order, t: float, ascending: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, share) of entries of x with later ones of x, or with those of y; both in the order of `_tidy`.

    A meeting counts for its share of those the pair needs, so that one sum tells.
    ascending: only those with entries of y whose class is greater, for x that are some of the entries of y.
    """
    within = y is None
    y = x if within else y
    if not len(x[0]) or not len(y[0]):
        return
    kinds = np.unique(y[0])
    run_y = np.searchsorted(kinds, y[0])
    run_x = np.minimum(np.searchsorted(kinds, x[0]), len(kinds) - 1)
    there = kinds[run_x] == x[0]
    nx, ny = x[2].astype(np.int64), y[2].astype(np.int64)
    step = int(max(nx.max(), ny.max())) + 2
    place_y = run_y * step + ny
    hi = np.searchsorted(place_y, run_x * step + np.minimum(np.floor(nx / t + 1e-9).astype(np.int64), step - 1), "right")
    lo = np.arange(1, len(nx) + 1) if within else np.searchsorted(place_y, run_x * step + np.ceil(t * nx - 1e-9).astype(np.int64))
    count = np.where(there, np.maximum(hi - lo, 0), 0)
    begin = np.cumsum(count) - count
    cut = np.flatnonzero(np.diff(begin // PAIRS, prepend=-1))
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(count)]):
        c = count[s:e]
        i = np.repeat(np.arange(s, e), c)
        j = np.repeat(lo[s:e], c) + np.arange(len(i)) - np.repeat(begin[s:e] - begin[s], c)
        n, m = nx[i], ny[j]
        overlap = need(n, m, t).astype(np.int64)
        pi, pj = x[3][i].astype(np.int64), y[3][j].astype(np.int64)
        meet = np.minimum(MEET, overlap)
        listed = (pi > 0) & (pj > 0) & (np.maximum(n, m) > order.light) & (pi <= n - overlap + meet) & (pj <= m - overlap + meet)
        ok = (listed | ((pi == 0) & (pj == 0))) & (x[1][i] < y[1][j] if ascending else x[1][i] != y[1][j])
        i, j, meet, pi = i[ok], j[ok], meet[ok], pi[ok]
        a, b = x[1][i], y[1][j]
        if within:
            a, b = np.minimum(a, b), np.maximum(a, b)
        share = np.where(pi == 0, WHOLE, WHOLE // np.maximum(meet, 1)).astype(np.uint64)
        pair = ((a << np.uint64(order.id_bits)) | b) * np.uint64(_ODD) & np.uint64((1 << 2 * order.id_bits) - 1)
        o = np.argsort(pair)
        yield _merged([pair[o], share[o]])


def _capped(columns: list[np.ndarray]) -> list[np.ndarray]:
    pair, share = _merged(columns)
    return [pair, np.minimum(share, np.uint64(WHOLE))]


def scatter_meetings(chunks, order: Order) -> Iterator[pa.RecordBatch]:
    return P.scatter(chunks, 2 * order.id_bits, order.buckets, _capped)


def gather_pairs(met: DataFrame, order, apart: str | None = None) -> DataFrame:
    """(a, b), short identifiers: the pairs that met often enough, from the (bucket, data) of `scatter_meetings`; for each value of a boolean column `apart`, which is then given too."""

    def per_bucket(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, share = P.joined(P.blobs_of(batches), 2)
        o = np.argsort(pair)
        pair, share = _merged([pair[o], share[o]])
        bits = order.value.id_bits
        mask = np.uint64((1 << 2 * bits) - 1)
        pair = pair[share >= WHOLE] * np.uint64(pow(_ODD, -1, 1 << 64)) & mask
        out = {"a": pa.array((pair >> np.uint64(bits)).view(np.int64)), "b": pa.array((pair & np.uint64((1 << bits) - 1)).view(np.int64))}
        if apart:
            out[apart] = pa.array(np.full(len(pair), key[1].as_py(), bool))
        yield pa.RecordBatch.from_pydict(out)

    return met.groupBy("bucket", *([apart] if apart else [])).applyInArrow(per_bucket, "a bigint, b bigint" + (f", {apart} boolean" if apart else ""))


def candidate_pairs(sets: DataFrame, order, t: float = SIMILARITY) -> DataFrame:
    """(a, b), short identifiers of classes that the light and heavy routes propose, within one table of sets."""

    def per_bucket(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _tidy(P.joined(P.blobs_of(batches), 4))
        yield from scatter_meetings(_meetings(x, None, order.value, t), order.value)

    met = packed_entries(sets, order, t, order.value.drops_single).groupBy("bucket").applyInArrow(per_bucket, P.SCHEMA)
    return gather_pairs(met, order)


def full_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, order: Order, within: bool = True) -> DataFrame:
    """(ca, cb): pairs of short identifiers (a, b) as classes of left and right (class_id), which are one table if `within`.

    Classes whose short identifiers are equal are proposed too, since no entries of theirs
    can meet; of two tables that includes the classes that both have.
    """
    x = left.select(F.col("class_id").alias("ca"), order.short_column("class_id").alias("a"))
    y = right.select(F.col("class_id").alias("cb"), order.short_column("class_id").alias("b"))
    same = x.join(y, F.col("a") == F.col("b")).select("ca", "cb")
    return pairs.join(x, "a").join(y, "b").select("ca", "cb").unionByName(same.where("ca < cb") if within else same).distinct()


def named_sets(sets: DataFrame, named: DataFrame) -> DataFrame:
    """(class_id, size, data), once each, of the classes in `named` (class_id), found by a bit filter so that the other sets aren't shuffled."""
    size = P.filter_bits(named.count(), 12, WANTED_BITS)
    wanted = sets.sparkSession.sparkContext.broadcast(P.build_filter(named.select("class_id"), lambda b: b.column("class_id").to_numpy().view(np.uint64), size))

    def per_task(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.has(batch.column("class_id").to_numpy().view(np.uint64))))

    found = sets.select("class_id", "size", "data").mapInArrow(per_task, "class_id bigint, size int, data binary")
    return found.groupBy("class_id").agg(F.any_value("size").alias("size"), F.any_value("data").alias("data"))


def verify_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(a, b, common, similarity) of the pairs (ca, cb) whose sets have at least the similarity t."""

    def overlaps(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE * 4):
                part = batch.slice(i, SLICE * 4)
                (ra, ha, na), (rb, hb, nb) = P.unpack_sets(part.column("da")), P.unpack_sets(part.column("db"))
                e = np.sort((np.concatenate([ra, rb]).astype(np.uint64) << np.uint64(P.SET_BITS)) | np.concatenate([ha, hb]))
                twice = e[1:][e[1:] == e[:-1]] >> np.uint64(P.SET_BITS)
                common = np.bincount(twice.astype(np.int64), minlength=len(na))
                ok = common * (1 + t) >= (na + nb) * t - 1e-9
                yield pa.RecordBatch.from_arrays([part.column("ca").filter(pa.array(ok)), part.column("cb").filter(pa.array(ok)), pa.array(common[ok], pa.int64()), pa.array(common[ok] / np.maximum(na + nb - common, 1)[ok])], ["a", "b", "common", "similarity"])

    x = left.select(F.col("class_id").alias("ca"), F.col("data").alias("da"))
    y = right.select(F.col("class_id").alias("cb"), F.col("data").alias("db"))
    return pairs.join(x, "ca").join(y, "cb").select("ca", "cb", "da", "db").mapInArrow(overlaps, "a bigint, b bigint, common bigint, similarity double")


def text_frame(articles: DataFrame) -> DataFrame:
    """(id, text, stamp) of articles: the title, a line feed and the text."""
    return article_texts(articles).select(F.col("article_id").alias("id"), F.concat("title", F.lit("\n"), "text").alias("text"), "stamp")


def alike_classes(texts: DataFrame, t: float = SIMILARITY, words: int = WORDS, bits: int | None = None, light: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (id, stamp, class_id) and the pairs (a, b, common, similarity) of alike classes of different texts."""
    rows = materialize(class_sets(texts, words), "p4-rows")
    latest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("stamp").desc(), "class_id"))
    members = materialize(rows.select("id", "stamp", "class_id", "size").withColumn("_n", latest).where("_n = 1 AND size > 0").select("id", "stamp", "class_id"), "p4-members")
    sets = rows.where("data IS NOT NULL").select("class_id", "size", "data")
    order = element_order(sets, t, bits, light)
    shared = texts.sparkSession.sparkContext.broadcast(order)
    short = materialize(candidate_pairs(sets, shared, t), "p4-candidates")
    classes = materialize(members.select("class_id").distinct(), "p4-classes")
    pairs = materialize(full_pairs(short, classes, classes, order), "p4-pairs")
    ends = pairs.select(F.col("ca").alias("class_id")).union(pairs.select("cb"))
    found = materialize(named_sets(sets, ends), "p4-sets")
    return members, verify_pairs(pairs, found, found, t)


def alike_pairs(articles: DataFrame, t: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(article_id_a, article_id_b), smaller first: all pairs of alike articles, copies included."""
    members, pairs = alike_classes(text_frame(articles), t, words)
    ids = members.select("id", "class_id")
    one = ids.select(F.col("id").alias("i"), F.col("class_id").alias("a"))
    two = ids.select(F.col("id").alias("j"), F.col("class_id").alias("b"))
    between = pairs.select("a", "b").join(one, "a").join(two, "b").select(F.least("i", "j").alias("article_id_a"), F.greatest("i", "j").alias("article_id_b"))
    within = one.join(two, (F.col("a") == F.col("b")) & (F.col("i") < F.col("j"))).select(F.col("i").alias("article_id_a"), F.col("j").alias("article_id_b"))
    return between.unionByName(within)


def alike_groups(articles: DataFrame, t: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(article_id, class_id, copies, links): each article with its class, the class's size and its alike classes of other texts."""
    members, pairs = alike_classes(text_frame(articles), t, words)
    links = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    copies = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    facts = copies.join(links, "class_id", "left")
    return members.join(facts, "class_id").select(F.col("id").alias("article_id"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
