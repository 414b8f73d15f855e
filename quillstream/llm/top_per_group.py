"""Problem 6: the best N items of every group, ties always settled alike.

Method: secondary sort.  Repeated rows of an item are settled first, which
also spreads every group over partitions by its items; each partition is sorted by
group, score and identifier, and a stream over its Arrow batches emits the
first N rows per group without holding a group.  What is left (N rows per group and
partition at most) is partitioned by group, sorted and streamed once more.

Defined cases: a group with a null part has no rows; of several rows of an item
in a group only the latest counts (ties: the higher score, then the earlier
publication), and it doesn't enter if its score is null; a null publication
time comes last among equal scores; rows without item identifier are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(n: int, group: list[str]):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
            new = np.ones(rows, dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            new[0] = last is None or any(c[0] != x for c, x in zip(cols, last))
            starts = np.flatnonzero(new)
            begin = np.zeros(rows, dtype=np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            rank = np.arange(rows) - begin
            if not new[0]:
                rank[: starts[0] if len(starts) else rows] += seen
            last, seen = [c[-1] for c in cols], int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return stream


def top_n(items: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in the given total order; items may be spread in any way."""
    schema = items.schema
    stream = _first_n(n, group)
    part = items.sortWithinPartitions(*group, *order).mapInArrow(stream, schema)
    return part.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(stream, schema)


def best_articles(ranked: DataFrame, n: int = 3) -> DataFrame:
    """(edition_id, category, article_id, final_score, published_at): the n best of each edition and category."""
    rows = ranked.select("edition_id", F.lower(F.regexp_replace("category", r"^\s+|\s+$", "")).alias("category"), "article_id", "final_score", "published_at", "ranked_at").dropna(subset=["edition_id", "category", "article_id"])
    recency = F.struct("ranked_at", "final_score", -F.unix_micros(F.col("published_at").cast("timestamp")))
    latest = rows.groupBy("edition_id", "category", "article_id").agg(F.max_by(F.struct("final_score", "published_at"), recency).alias("r"))
    items = latest.select("edition_id", "category", "article_id", "r.final_score", "r.published_at").where("final_score IS NOT NULL")
    return top_n(items, ["edition_id", "category"], [F.col("final_score").desc(), F.col("published_at").asc_nulls_last(), F.col("article_id")], n)
