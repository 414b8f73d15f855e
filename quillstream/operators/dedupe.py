"""Duplicates among articles: greedy over URL, content and title keys; best per event; who absorbed whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.greedy import greedy_keep
from quillstream.runtime import materialize

#: Reasons in the order in which they are named.
REASONS = ("url", "content", "title")


def conflict_keys(articles: DataFrame) -> DataFrame:
    """(id, kind, key) from columns article_id, url_key, content_hash, title_key; null and empty keys conflict with nothing."""
    cols = {"url": "url_key", "content": "content_hash", "title": "title_key"}
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(cols[name]).alias("key")) for i, name in enumerate(REASONS)])
    return articles.select(F.col("article_id").alias("id"), F.explode(each).alias("k")).select("id", "k.kind", "k.key").where("key IS NOT NULL AND key <> ''")


def deduplicate(articles: DataFrame, rank: Column) -> DataFrame:
    """(article_id, kept, reason, survivor): the greedy choice in the order of rank, ties by identifier.

    Of the kept rows that share a key with a dropped one, the reason names the first
    kind that matches, and survivor the row that owns this key.
    """
    nodes = materialize(articles.select(F.col("article_id").alias("id"), rank.alias("rank")), "dedupe-nodes")
    keys = materialize(conflict_keys(articles), "dedupe-keys")
    kept = materialize(greedy_keep(nodes, keys.select("id", F.concat_ws(":", "kind", "key").alias("key"))), "dedupe-kept")
    ranked = keys.join(nodes, "id")
    owners = ranked.join(kept.where("kept").select("id"), "id").select("kind", "key", F.col("rank").alias("o_rank"), F.col("id").alias("survivor"))
    # A row kept later may share another key with a dropped one, but didn't drop it.
    earlier = F.struct("o_rank", F.col("survivor").alias("o_id")) < F.struct(F.col("rank").alias("o_rank"), F.col("id").alias("o_id"))
    lost = ranked.join(kept.where("NOT kept").select("id"), "id", "left_semi").join(owners, ["kind", "key"]).where(earlier)
    # A key has one owner at most, since two kept rows never share one.
    why = lost.groupBy("id").agg(F.min(F.struct("kind", "survivor")).alias("w"))
    names = F.array(*[F.lit(r) for r in REASONS])
    return kept.join(why, "id", "left").select(F.col("id").alias("article_id"), "kept", F.when(~F.col("kept"), F.get(names, F.col("w.kind"))).alias("reason"), F.when(~F.col("kept"), F.col("w.survivor")).alias("survivor"))


def best_per_event(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with `kept`: the first of each event key in the order; rows without key are all kept.

    Rows are numbered in range partitions of (key, order), so that an event of any size is sorted in
    parallel: a row is the first of its key if the row before it in its partition has another key, and no earlier partition ends with its own.
    """
    named = rows.where(F.col(key).isNotNull())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key), *order]
    sorted_ = materialize(named.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "best")
    within = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    heads = sorted_.groupBy(F.col(key)).agg(F.min("_part").alias("_first"))
    first = sorted_.withColumn("_n", within).join(heads, key).withColumn("kept", (F.col("_n") == 1) & (F.col("_part") == F.col("_first"))).drop("_n", "_part", "_first")
    return first.unionByName(rows.where(F.col(key).isNull()).withColumn("kept", F.lit(True)))
