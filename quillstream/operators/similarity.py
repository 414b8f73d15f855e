"""Reports of one event by sparse TF-IDF cosine, within each edition's candidates.

Every text is read once and becomes a packed row: its distinct terms and how often each
stands in it.  Packed rows meet in units of about `UNIT` rows.  An edition that fits is counted within
its unit; the rows of a larger one are spread over several, whose counts are put together by
(edition, term) first.  Weights never leave their row.  For the pairs, an edition's
rows are cut into blocks and each pair of blocks meets in one task: products of dense columns for frequent terms,
products term by term for rare ones, both in single precision, propose the pairs, whose
cosine is then summed in double precision.  Where the pairs only serve a choice among the rows (`fold_similar`),
a task gives the later partners of each row as one value, so that no pair is a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import content_terms
from quillstream.operators.greedy import greedy_keep
from quillstream.runtime import broadcast_if_small, materialize

#: Words below which a text is a stub; articles from which a source's own terms are told; their share.
STUB_WORDS = 40
SOURCE_ARTICLES = 3
SOURCE_SHARE = 0.5
THRESHOLD = 0.21
#: Rows of a unit; blocks that a large edition is cut into, and the fewest and most rows of one.
UNIT = 4096
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 8, 1024, 16384
#: Rows and columns of a dense product, products made at once of rare terms, and what single precision may be off.
TILE, COLUMNS, PRODUCTS, SLACK = 2048, 1024, 1 << 21, 1e-4


def term_counts(rows: DataFrame, group: str = "edition_id") -> DataFrame:
    """(group, article_id, source_id, term, tf, n_words) of all rows, stubs included."""
    terms = rows.select(group, "article_id", "source_id", content_terms(F.col("title"), F.col("text")).alias("t")).withColumn("n_words", F.size("t"))
    return terms.select(group, "article_id", "source_id", "n_words", F.explode("t").alias("term")).groupBy(group, "article_id", "source_id", "n_words", "term").agg(F.count("*").alias("tf"))


def source_terms(counts: DataFrame, rows: DataFrame, group: str = "edition_id") -> DataFrame:
    """(group, source_id, term, seen, articles): terms in at least half of a source's articles."""
    n = rows.groupBy(group, "source_id").agg(F.count("*").alias("articles")).where(F.col("articles") >= SOURCE_ARTICLES)
    seen = counts.groupBy(group, "source_id", "term").agg(F.count("*").alias("seen"))
    return seen.join(n, [group, "source_id"]).where(F.col("seen") >= F.col("articles") * SOURCE_SHARE)


# -- packed rows -----------------------------------------------------------------------


def packed_terms(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, n_words, terms, tf): the distinct terms of each row, parted by blanks, and as 32-bit numbers how often each stands in it."""
    given = rows.select(*keep, content_terms(F.col("title"), F.col("text")).alias("t"))
    plain = [n for n in given.columns if n != "t"]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            words = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            names = coded.dictionary
            row = np.repeat(np.arange(batch.num_rows), words)
            key, tf = np.unique(row * max(1, len(names)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            size = np.bincount(key // max(1, len(names)), minlength=batch.num_rows)
            terms = pc.binary_join(_lists(names.take(pa.array(key % max(1, len(names)))), size), " ")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in plain), pa.array(words, pa.int32()), terms, _numbers(tf, size, np.int32)], [*plain, "n_words", "terms", "tf"])

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(per_task, ", ".join([*(f"{n} {kinds[n]}" for n in plain), "n_words int", "terms string", "tf binary"]))


def term_rows(rows: DataFrame, keep: tuple[str, ...] = (), group: str = "edition_id") -> DataFrame:
    """(group, article_id, source_id, *keep, n_words, terms, tf), stored: `packed_terms` of rows with title and text, or, where they have terms, the rows as they are."""
    plain = (group, "article_id", "source_id", *keep)
    return materialize(rows.select(*plain, "n_words", "terms", "tf") if "terms" in rows.columns else packed_terms(rows, plain), "terms", "zstd")


def _lists(values: pa.Array, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values)


def _numbers(x: np.ndarray, size: np.ndarray, kind: type) -> pa.Array:
    """The numbers of each row as one binary value."""
    x = np.ascontiguousarray(x, dtype=kind)
    offsets = np.concatenate([[0], np.cumsum(size)]) * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _unpacked(table: pa.Table, numbers: str, kind: type) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, code, terms by code, number) of all terms of packed rows that have any."""
    found = pc.split_pattern(_whole(table.column("terms")), " ")
    size = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = found.flatten().dictionary_encode()
    x = np.frombuffer(b"".join(_whole(table.column(numbers)).to_pylist()), kind)
    return np.repeat(np.arange(len(size)), size), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, x


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, -1 for null, and the values."""
    coded = _whole(column).dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


# -- weights -----------------------------------------------------------------------------


def _unit(group: str, n: int, ident: str) -> Column:
    """The unit of a row: small editions share n of them, a large one has `_shards` of its own."""
    own = F.xxhash64(group, F.pmod(F.xxhash64(ident), F.col("_shards")))
    return F.when(F.col("_shards").isNull(), F.pmod(F.xxhash64(group), F.lit(n))).otherwise(own)


def packed_profiles(stored: DataFrame, may: Column | None = None, group: str = "edition_id", unit: int | None = None, ident: str = "article_id") -> DataFrame:
    """(group, ident, terms, df, weight): L2-normalised weights (64-bit floats) and the rows each term stands in (64-bit numbers), of the rows of `term_rows` that `may` holds for.

    Statistics are those of all rows; stubs have no profile.
    """
    unit = unit or UNIT
    rows = stored.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), ident, "source_id", "n_words", "terms", "tf", F.coalesce(F.lit(True) if may is None else may, F.lit(False)).alias("may"))
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("total")), "edition-sizes")
    every = int(sizes.agg(F.sum("total")).first()[0] or 0)
    large = sizes.where(F.col("total") > unit).select("g", F.ceil(F.col("total") / unit).alias("_shards"), "total")
    placed = rows.join(broadcast_if_small(large), "g", "left").withColumn("unit", _unit("g", max(1, -(-every // unit)), ident))
    spread = placed.where("_shards IS NOT NULL AND terms <> ''")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        row, code, names, _ = _unpacked(table, "tf", np.int32)
        (g, gs), (s, ss) = _codes(table.column("g")), _codes(table.column("source_id"))
        one = (g * (len(ss) + 1) + s + 1)[row] * len(names) + code
        one, seen = np.unique(one, return_counts=True)
        gs_at, s_at = np.divmod(one // len(names), len(ss) + 1)
        source = ss.take(pa.array(s_at - 1, mask=s_at == 0)) if len(ss) else pa.nulls(len(one), pa.string())
        return pa.table({"unit": pa.array(np.full(len(one), key[0].as_py())), "g": gs.take(pa.array(gs_at)), "source_id": source, "term": names.take(pa.array(one % len(names))), "seen": pa.array(seen)})

    counted = spread.select("unit", "g", "source_id", "terms", "tf").groupBy("unit").applyInArrow(count, "unit bigint, g string, source_id string, term string, seen bigint")
    articles = rows.join(broadcast_if_small(large.select("g")), "g", "left_semi").groupBy("g", "source_id").agg(F.count("*").alias("articles")).where(F.col("source_id").isNotNull() & (F.col("articles") >= SOURCE_ARTICLES))
    term, own = Window.partitionBy("g", "term"), Window.partitionBy("g", "term", "source_id")
    summed = counted.withColumn("df", F.sum("seen").over(term)).withColumn("n", F.sum("seen").over(own))
    own_terms = F.coalesce(F.col("n") >= F.col("articles") * SOURCE_SHARE, F.lit(False)).alias("own")
    told = summed.join(broadcast_if_small(materialize(articles, "edition-sources")), ["g", "source_id"], "left").select("unit", "g", "source_id", "term", "df", own_terms)

    def weigh(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        (g, gs), (s, ss) = _codes(table.column("g")), _codes(table.column("source_id"))
        total = np.bincount(g, minlength=len(gs))
        given = table.column("total").to_numpy()
        total = np.where(np.isnan(given), total[g], given)
        by_source = g * (len(ss) + 1) + s + 1
        articles = np.bincount(by_source)[by_source]
        full = np.flatnonzero(pc.not_equal(_whole(table.column("terms")), "").to_numpy(zero_copy_only=False))
        row, code, names, tf = _unpacked(table.take(pa.array(full)), "tf", np.int32)
        row, v = full[row], max(1, len(names))
        _, at, df = np.unique(g[row] * v + code, return_inverse=True, return_counts=True)
        df = df[at]
        pairs, at, seen = np.unique(by_source[row] * v + code, return_inverse=True, return_counts=True)
        chrome = (s[row] >= 0) & (articles[row] >= SOURCE_ARTICLES) & (seen[at] >= articles[row] * SOURCE_SHARE)
        if told.num_rows:  # of a large edition, the counts of all its units
            tg = pc.index_in(_whole(told.column("g")), value_set=gs).to_numpy(zero_copy_only=False).astype(np.int64)
            ts = pc.index_in(_whole(told.column("source_id")), value_set=ss).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(ss) else np.full(len(tg), -1)
            tt = pc.index_in(_whole(told.column("term")), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.searchsorted(pairs, (tg * (len(ss) + 1) + ts + 1) * v + tt)
            all_df, all_own, there = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
            all_df[place], all_own[place], there[place] = told.column("df").to_numpy(), told.column("own").to_numpy(), True
            df, chrome = np.where(there[at], all_df[at], df), np.where(there[at], all_own[at], chrome)
        long = table.column("n_words").to_numpy() >= STUB_WORDS
        ok = ~chrome & (long & table.column("may").to_numpy())[row]
        row, code, df, tf = row[ok], code[ok], df[ok], tf[ok]
        raw = (1 + np.log(tf)) * (np.log((total[row] + 1) / (df + 1)) + 1)
        weight = raw / np.sqrt(np.bincount(row, raw * raw, minlength=table.num_rows))[row]
        size = np.bincount(row, minlength=table.num_rows)
        have = np.flatnonzero(size)
        size = size[have]
        out = table.take(pa.array(have))
        terms = pc.binary_join(_lists(names.take(pa.array(code)), size), " ")
        return pa.table({"g": out.column("g"), ident: out.column(ident), "terms": terms, "df": _numbers(df, size, np.int64), "weight": _numbers(weight, size, np.float64)})

    mine = placed.select("unit", "g", ident, "source_id", "n_words", "terms", "tf", "may", F.col("total").cast("double").alias("total"))
    weighed = mine.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(weigh, f"g string, {ident} {dict(stored.dtypes)[ident]}, terms string, df binary, weight binary")
    return weighed.withColumnRenamed("g", group)


def similarity_profiles(rows: DataFrame, group: str = "edition_id") -> DataFrame:
    """(group, article_id, term, df, weight): L2-normalised weights; statistics over all rows, no profile for stubs."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            row, code, names, df = _unpacked(table, "df", np.int64)
            weight = np.frombuffer(b"".join(batch.column("weight").to_pylist()), np.float64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(group).take(at), batch.column("article_id").take(at), names.take(pa.array(code)), pa.array(df), pa.array(weight)], [group, "article_id", "term", "df", "weight"])

    return packed_profiles(term_rows(rows, (), group), group=group).mapInArrow(expand, f"{group} string, article_id string, term string, df bigint, weight double")


# -- pairs ---------------------------------------------------------------------------------


def _products(x: tuple, y: tuple, nx: int, ny: int, v: int) -> np.ndarray:
    """Cosines of nx rows with ny rows in single precision, from their (row, code, weight)."""
    acc = np.zeros((nx, ny), np.float32)
    cx, cy = np.bincount(x[1], minlength=v), np.bincount(y[1], minlength=v)
    met = cx * cy
    dense = np.flatnonzero((met > 0) & (met * 1024 >= nx * ny))
    column = np.full(v, -1)
    column[dense] = np.arange(len(dense))
    for lo in range(0, len(dense), COLUMNS):
        sides = []
        for (row, code, weight), n in ((x, nx), (y, ny)):
            c = column[code]
            m = (c >= lo) & (c < lo + COLUMNS)
            d = np.zeros((n, min(COLUMNS, len(dense) - lo)), np.float32)
            d[row[m], c[m] - lo] = weight[m]
            sides.append(d)
        acc += sides[0] @ sides[1].T
    rare = (met > 0) & (column < 0)
    (rx, kx, wx), (ry, ky, wy) = ((r[m], c[m], w[m]) for r, c, w in (x, y) for m in (rare[c],))
    if not len(kx):
        return acc
    o = np.argsort(ky, kind="stable")
    ry, ky, wy = ry[o], ky[o], wy[o]
    lo, count = np.searchsorted(ky, kx), cy[kx]
    ends = np.cumsum(count)
    cut = np.flatnonzero(np.diff((ends - count) // PRODUCTS, prepend=-1)).tolist()
    flat = acc.reshape(-1)
    for s, e in zip(cut, [*cut[1:], len(kx)]):
        i = np.repeat(np.arange(s, e), count[s:e])
        j = lo[i] + np.arange(len(i)) - np.repeat(ends[s:e] - count[s:e] - (ends[s] - count[s]), count[s:e])
        np.add.at(flat, rx[i] * ny + ry[j], (wx[i] * wy[j]).astype(np.float32))
    return acc


def _alike(row: np.ndarray, code: np.ndarray, weight: np.ndarray, v: int, left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the rows in left with those in right, or with later ones of left, that about reach the threshold; entries in the order of (row, code)."""
    key = row * v + code
    begin = np.searchsorted(row, np.arange((row[-1] if len(row) else 0) + 2))

    def entries(rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        size = begin[rows + 1] - begin[rows]
        own = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(own)) + np.repeat(begin[rows] - (np.cumsum(size) - size), size)
        return at, (own, code[at], weight[at])

    within = right is None
    other = left if within else right
    for p in range(0, len(left), TILE):
        mine = left[p : p + TILE]
        x = entries(mine)[1]
        for q in range(p if within else 0, len(other), TILE):
            theirs = other[q : q + TILE]
            acc = _products(x, entries(theirs)[1], len(mine), len(theirs), v)
            i, j = np.nonzero(acc >= threshold - SLACK)
            if within and p == q:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 4096):
                a, b = mine[i[s : s + 4096]], theirs[j[s : s + 4096]]
                _, (own, c, w) = entries(a)
                wanted = b[own] * v + c
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                hit = key[at] == wanted
                cosine = np.bincount(own[hit], w[hit] * weight[at[hit]], minlength=len(a))
                m = np.bincount(own[hit], minlength=len(a)) > 0
                yield a[m], b[m], cosine[m]


def _meetings(profiles: DataFrame, group: str, ident: str, block: int | None) -> DataFrame:
    """(task, g, ident, terms, weight, own, i, j): every row of packed profiles once for each pair of blocks that its own meets in."""
    least = block or LEAST_BLOCK
    mine = materialize(profiles.where(F.col(group).isNotNull() & F.col(ident).isNotNull()).select(F.col(group).alias("g"), ident, "terms", "weight"), "profiles", "zstd")
    sizes = materialize(mine.groupBy("g").agg(F.count("*").alias("n")), "profile-sizes")
    every = int(sizes.agg(F.sum("n")).first()[0] or 0)
    per_block = F.least(F.greatest(F.ceil(F.col("n") / BLOCKS), F.lit(least)), F.lit(max(least, MOST_BLOCK)))
    large = sizes.where(F.col("n") > 2 * least).select("g", F.ceil(F.col("n") / per_block).cast("int").alias("_blocks"))
    placed = mine.join(broadcast_if_small(large), "g", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    task = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("g"), F.lit(max(1, -(-every // least))))).otherwise(F.xxhash64("g", "i", "j"))
    return spread.select(task.alias("task"), "g", ident, "terms", "weight", "own", "i", "j")


def _met(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, cosine) of the rows of one task's meetings that about reach the threshold."""
    row, code, names, weight = _unpacked(table, "weight", np.float64)
    v = max(1, len(names))
    o = np.argsort(row * v + code, kind="stable")
    row, code, weight = row[o], code[o], weight[o]
    g = _codes(table.column("g"))[0]
    own, i, j = (table.column(c).to_numpy().astype(np.int64) for c in ("own", "i", "j"))
    a, b, cosine = [], [], []
    order = np.lexsort((own, j, i, g))
    cut = np.flatnonzero((np.diff(g[order], prepend=-1) != 0) | (np.diff(i[order], prepend=-1) != 0) | (np.diff(j[order], prepend=-1) != 0)).tolist()
    for s, e in zip(cut, [*cut[1:], len(order)]):
        rows = np.sort(order[s:e])
        first, last = i[rows[0]], j[rows[0]]
        # Few rows of many: their own terms are numbered anew, so that work goes by their number.
        lo = np.concatenate([np.arange(x, y) for x, y in zip(np.searchsorted(row, rows), np.searchsorted(row, rows + 1))])
        terms, c = np.unique(code[lo], return_inverse=True)
        r = np.searchsorted(rows, row[lo])
        left, right = (np.flatnonzero(own[rows] == k) for k in (first, last))
        for x, y, z in _alike(r, c, weight[lo], max(1, len(terms)), left, None if first == last else right, threshold):
            a.append(rows[x])
            b.append(rows[y])
            cosine.append(z)
    a, b = (np.concatenate([np.zeros(0, np.int64), *k]) for k in (a, b))
    return a, b, np.concatenate([np.zeros(0), *cosine])


def packed_pairs(profiles: DataFrame, threshold: float = THRESHOLD, group: str = "edition_id", block: int | None = None) -> DataFrame:
    """(group, a, b, cosine), a < b, of all rows of one edition in packed profiles (group, article_id, terms, weight) whose cosine reaches the threshold."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        a, b, cosine = _met(table, threshold)
        a, b, ids = pa.array(a), pa.array(b), _whole(table.column("article_id"))
        of = _whole(table.column("g")).take(a)
        a, b = ids.take(a), ids.take(b)
        later = pc.less(a, b)
        return pa.table({"g": of, "a": pc.if_else(later, a, b), "b": pc.if_else(later, b, a), "cosine": pa.array(cosine)})

    met = _meetings(profiles, group, "article_id", block).groupBy("task").applyInArrow(meet, "g string, a string, b string, cosine double")
    return met.where(F.round("cosine", 9) >= threshold).select(F.col("g").alias(group), "a", "b", F.round("cosine", 6).alias("cosine"))


def _rounded_least(threshold: float) -> float:
    """The least number that reaches the threshold once it is rounded to 9 places, half up."""
    return float(Decimal(repr(threshold)).quantize(Decimal("1e-9"), ROUND_CEILING) - Decimal("5e-10"))


def packed_links(profiles: DataFrame, number: str, threshold: float = THRESHOLD, group: str = "edition_id", block: int | None = None) -> DataFrame:
    """(g, lo, his): the pairs of `packed_pairs` by the rows' numbers, those with a larger number than lo as 64-bit numbers of one value; a row for each lo and task that has any."""
    least = _rounded_least(threshold)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        a, b, cosine = _met(table, threshold)
        m = cosine >= least
        a, b, n = a[m], b[m], table.column(number).to_numpy()
        lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        o = np.lexsort((hi, lo))
        first = np.flatnonzero(np.diff(lo[o], prepend=-1))
        size = np.diff(first, append=len(o))
        return pa.table({"g": _whole(table.column("g")).take(pa.array(a[o][first])), "lo": pa.array(lo[o][first]), "his": _numbers(hi[o], size, np.int64)})

    return _meetings(profiles, group, number, block).groupBy("task").applyInArrow(meet, "g string, lo bigint, his binary")


def similar_among(stored: DataFrame, may: Column, threshold: float = THRESHOLD, group: str = "edition_id") -> DataFrame:
    """(group, a, b, cosine), a < b, of the rows of `term_rows` that `may` holds for and whose cosine reaches the threshold; the statistics behind their weights are those of all rows."""
    return packed_pairs(packed_profiles(stored, may, group), threshold, group)


def similar_pairs(profiles: DataFrame, eligible: DataFrame, threshold: float = THRESHOLD, group: str = "edition_id") -> DataFrame:
    """`similar_among` for profiles with a row per term (group, article_id, term, weight) and the eligible articles."""
    mine = profiles.join(eligible.select(group, "article_id").distinct(), [group, "article_id"], "left_semi")
    lists = mine.groupBy(group, "article_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            size = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
            term, weight = t.flatten().flatten()
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("article_id"), pc.binary_join(_lists(term, size), " "), _numbers(weight.to_numpy(zero_copy_only=False), size, np.float64)], [group, "article_id", "terms", "weight"])

    return packed_pairs(lists.mapInArrow(pack, f"{group} string, article_id string, terms string, weight binary"), threshold, group)


def fold_similar(stored: DataFrame, of: Column, may: Column, number: str, threshold: float = THRESHOLD, group: str = "edition_id") -> DataFrame:
    """`collapse_similar` of the rows of `term_rows` that `of` holds for; those that also `may` holds for are folded.

    number: the rows' order, no number below 0 and none twice, whatever the group.  A group's links go through one task in this order, a batch
    at a time, which holds a byte for each number; the first kept row that meets another one is what that is folded into.
    """
    links = materialize(packed_links(packed_profiles(stored, of & may, group, ident=number), number, threshold, group), "links", "zstd")
    last = int(stored.agg(F.max(number)).first()[0] or 0)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = np.zeros(last + 1, bool)
        for batch in batches:
            gone, into = [], []
            for lo, his in zip(batch.column("lo").to_pylist(), batch.column("his")):
                if not lost[lo]:
                    hi = np.frombuffer(his.as_buffer(), np.int64)
                    hi = hi[~lost[hi]]
                    lost[hi] = True
                    gone.append(hi)
                    into.append(np.full(len(hi), lo))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (gone, into)], [number, "into"])

    lost = materialize(links.repartition("g").sortWithinPartitions("g", "lo").mapInArrow(choose, f"{number} bigint, into bigint"), "folded-rows")
    names = stored.select(F.col(number).alias("into"), F.col("article_id").alias("survivor"))
    into = lost.join(names, "into").select(number, "survivor")
    return stored.where(of).join(into, number, "left").select(group, "article_id", F.col("survivor").isNull().alias("kept"), "survivor")


def collapse_similar(rows: DataFrame, pairs: DataFrame, rank: Column, group: str = "edition_id") -> DataFrame:
    """(group, article_id, kept, survivor): each article not kept is folded into the first kept one it is similar to."""
    ident = F.concat_ws("\x1f", group, "article_id")
    nodes = materialize(rows.select(group, "article_id", ident.alias("id"), rank.alias("rank")), "collapse-nodes")
    named = pairs.select(F.concat_ws("\x1f", group, "a").alias("a"), F.concat_ws("\x1f", group, "b").alias("b"))
    named = materialize(named, "collapse-pairs")
    kept = materialize(greedy_keep(nodes.select("id", "rank"), nodes.select("id", F.lit(None).cast("string").alias("key")), named), "collapse-kept")
    owner = kept.where("kept").join(nodes, "id").select(F.col("id").alias("o"), "rank", F.col("article_id").alias("survivor"))
    both = named.select("a", "b").union(named.select("b", "a"))
    lost = kept.where("NOT kept").select("id").join(both, F.col("id") == F.col("a")).join(owner, F.col("b") == F.col("o"))
    into = lost.groupBy("id").agg(F.min_by("survivor", F.struct("rank", "survivor")).alias("survivor"))
    return nodes.join(kept, "id").join(into, "id", "left").select(group, "article_id", "kept", "survivor")
