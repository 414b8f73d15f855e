"""Problem 1: lines that one source repeats across its articles, and the articles without them.

Method: one mergeable count-min summary over (source, line) finds the lines
that may stand in `least` articles of a source and loses none; exact counts over
these candidates confirm them; confirmed lines are removed by a join with the
confirmed set, broadcast if it was counted to be small.

Defined cases: a line counts by its letters alone, in lower case, and a line
without a letter never counts; a null source_id is no source, so nothing repeats
in it; rows without article_id or text are left out; an article saved again
counts once, as its latest row whose payload parses; a line that an article
repeats counts once for it, but is a case wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import article_texts, latest_only
from quillstream.llm.sketch import cells_for, summarize
from quillstream.runtime import broadcast_if_small, materialize

#: Distinct articles of a source in which a line has to stand.
LEAST = 8


def line_letters(line: Column) -> Column:
    """The letters of a line in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _line_keys(texts: DataFrame) -> DataFrame:
    """Per text the array of (line_no, key): key is a hash of source and letters, 0 where there is no letter."""
    letters = F.transform(F.split("text", "\n"), line_letters)
    keys = F.transform(letters, lambda x: F.when(x != "", F.xxhash64(F.col("source_id"), x)).otherwise(F.lit(0).cast("long")))
    return texts.where("source_id IS NOT NULL").select("article_id", "source_id", "stamp", keys.alias("keys"))


def repeated_lines(articles: DataFrame, least: int = LEAST) -> DataFrame:
    """(article_id, line_no, source_id, articles): lines found in at least `least` articles of the source."""
    spark = articles.sparkSession
    keyed = _line_keys(article_texts(articles))
    # About ten lines an article; the number only sets the load of the cells.
    cells = cells_for(10 * articles.count())
    distinct = keyed.select(F.array_distinct(F.filter("keys", lambda k: k != 0)).alias("keys"))

    def items(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    summary = spark.sparkContext.broadcast(summarize(distinct, items, cells, depth=2))

    def candidates(batches):
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            row = np.repeat(np.arange(len(keys)), np.diff(offsets))
            no = np.arange(len(flat)) - offsets[row] + 1
            hit = (flat != 0) & (summary.value.estimate(flat.view(np.uint64)) >= least)
            # An article without a candidate still says which of its rows is the latest.
            bare = np.setdiff1d(np.arange(len(keys)), row[hit])
            take = pa.array(np.concatenate([row[hit], bare]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(take) for c in ("article_id", "source_id", "stamp")),
                    pa.array(np.concatenate([no[hit], np.zeros(len(bare), np.int64)]), pa.int32()),
                    pa.array(np.concatenate([flat[hit], np.zeros(len(bare), np.int64)]), pa.int64()),
                ],
                ["article_id", "source_id", "stamp", "line_no", "key"],
            )

    found = keyed.mapInArrow(candidates, "article_id string, source_id string, stamp struct<at: bigint, h: bigint>, line_no int, key bigint")
    lines = materialize(latest_only(found).where("line_no > 0").select("article_id", "source_id", "line_no", "key").distinct(), "p1-candidates")
    # The distinct step spreads the articles of a frequent line; what is counted per line is then summed up in part before it is shuffled.
    counts = lines.select("key", "article_id").distinct().groupBy("key").agg(F.count("*").alias("articles")).where(F.col("articles") >= least)
    confirmed = materialize(counts, "p1-confirmed")
    return lines.join(broadcast_if_small(confirmed, 16), "key").select("article_id", "line_no", "source_id", "articles")


def without_repeated_lines(articles: DataFrame, least: int = LEAST) -> DataFrame:
    """(article_id, source_id, title, clean_text, removed): each article once, without its source's repeated lines."""
    dropped = repeated_lines(articles, least).groupBy("article_id").agg(F.collect_set("line_no").alias("drop"))
    texts = latest_only(article_texts(articles)).dropDuplicates(["article_id"])
    joined = texts.join(dropped, "article_id", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("drop"), i + 1))
    return joined.select("article_id", "source_id", "title", F.array_join(kept, "\n").alias("clean_text"), F.size("drop").alias("removed"))
