"""Candidate pools: stratified round robin, batches, recall of stored articles, cross-edition suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(articles: DataFrame, priorities: DataFrame) -> DataFrame:
    """articles with depth: newest first within a source; all sources' first come before any second.

    priorities: (source_id, priority); an unlisted source counts as 0.  Sort by
    `round_robin_order()` for the order itself.  Rows are numbered over all sources by
    range partitions, and a source's rows then from its first number, so that no source is one task's.
    """
    order = [F.col("source_id").asc_nulls_first(), F.col("published_at").desc_nulls_last(), F.col("article_id")]
    numbered = positions(articles, order, "_all")
    first = numbered.groupBy("source_id").agg((F.min("_all") - 1).alias("_before")).withColumnRenamed("source_id", "_source")
    ranked = numbered.join(first, F.col("source_id").eqNullSafe(F.col("_source"))).withColumn("depth", (F.col("_all") - F.col("_before")).cast("int")).drop("_all", "_before", "_source")
    return ranked.join(priorities, "source_id", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))


def round_robin_order() -> list[Column]:
    return [F.col("depth"), F.col("priority").desc(), F.col("source_id"), F.col("article_id")]


def batch_number(position: Column, size: int) -> Column:
    """0-based batch of a 1-based position; size 0 puts all into one batch."""
    return F.lit(0) if size <= 0 else F.floor((position - 1) / size)


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number all rows in a total order without a single-task window: range-partitioned counts, then offsets."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from quillstream.runtime import materialize

    sorted_ = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "positions")
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition: the window over them is bounded by their number.
    offsets = counts.withColumn("_skip", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_skip")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_.withColumn("_at", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_skip") + F.col("_at")).drop("_part", "_skip", "_at")


def split_reserved(articles: DataFrame, reserved_source: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows of the reserved source, and the rest."""
    mark = F.lit(False) if reserved_source is None else F.coalesce(F.col("source_id") == reserved_source, F.lit(False))
    return articles.where(mark), articles.where(~mark)


def merge_stored(fresh: DataFrame, stored: DataFrame, key: str = "article_id") -> DataFrame:
    """Fresh rows and the stored rows that aren't among them."""
    return fresh.unionByName(stored.join(fresh.select(key).distinct(), key, "left_anti"))


def printed_items(items: DataFrame, articles: DataFrame, editions: DataFrame, excluded: str | None = None) -> DataFrame:
    """(article_id, content_hash, issue, generated_at, edition_id, position) of printed items, those of the issue `excluded` left out.

    items: (edition_id, article_id, position); editions: (edition_id, issue_label, generated_at); an edition without label goes by its identifier.
    """
    e = editions.select("edition_id", "issue_label", "generated_at")
    rows = items.join(articles.select("article_id", "content_hash"), "article_id", "left").join(e, "edition_id", "left").withColumn("issue", F.coalesce("issue_label", "edition_id"))
    return (rows if excluded is None else rows.where(F.col("issue") != excluded)).select("article_id", "content_hash", "issue", "generated_at", "edition_id", "position")


def reserved_first(articles: DataFrame, reserved_source: str | None, order: list[Column], size: int) -> DataFrame:
    """articles with `batch`: 0 for the reserved source's rows, then 1, 2, ... in the order for the rest."""
    reserved, rest = split_reserved(articles, reserved_source)
    numbered = positions(rest, order, "_place").withColumn("batch", (batch_number(F.col("_place"), size) + 1).cast("int")).drop("_place")
    return reserved.withColumn("batch", F.lit(0)).unionByName(numbered)


def known_issues(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Issues (issue, started) of the store and the one being printed; a label that both have counts as stored."""
    return stored.select("issue", "started").unionByName(current.select("issue", "started").join(stored.select("issue"), "issue", "left_anti"))


def published_keys(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(article_id, issue) and (content_hash, issue): where each was first printed.

    items: (article_id, content_hash, issue, generated_at, edition_id, position).
    """
    first = F.struct(F.col("generated_at").isNotNull(), "generated_at", "edition_id", "position")

    def by(key: str) -> DataFrame:
        return items.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("issue", first).alias("issue"))

    return by("article_id"), by("content_hash")


def suppress_published(articles: DataFrame, by_id: DataFrame, by_hash: DataFrame) -> DataFrame:
    """articles with `printed_in`: the issue that printed the identifier, else the content; null if none did."""
    a = by_id.select("article_id", F.col("issue").alias("_i"))
    b = by_hash.select("content_hash", F.col("issue").alias("_h"))
    return articles.join(a, "article_id", "left").join(b, "content_hash", "left").withColumn("printed_in", F.coalesce("_i", "_h")).drop("_i", "_h")


def cache_split(articles: DataFrame, assessments: DataFrame, model: str, prompt: str, schema: str) -> DataFrame:
    """articles with `hit`: whether an assessment of their content by this model, prompt and schema is stored."""
    known = assessments.where((F.col("model") == model) & (F.col("prompt_version") == prompt) & (F.col("schema_version") == schema)).select("content_hash").distinct()
    return articles.join(known.withColumn("hit", F.lit(True)), "content_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def issue_neighbours(issues: DataFrame) -> DataFrame:
    """issues (issue, started) with the previous and next issue; one row per issue, few by nature."""
    w = Window.orderBy("started", "issue")
    return issues.select("issue", "started", F.lag("issue").over(w).alias("previous"), F.lead("issue").over(w).alias("next"))
