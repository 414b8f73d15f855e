"""Reading texts out of stored payloads, and settling rows that were saved again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BAD = "_unparsed"


def payload_text(payload: Column) -> Column:
    """clean_text of a JSON payload; null where the payload is null, cut off or has none."""
    parsed = F.from_json(payload, f"clean_text string, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return F.when(parsed[_BAD].isNull(), parsed["clean_text"])


def article_texts(articles: DataFrame) -> DataFrame:
    """(article_id, source_id, title, text, stamp): one row per stored row that has an id and a text.

    stamp orders the rows saved under one id: the latest retrieval, ties by a
    hash of the payload.  Only these columns are read, whatever else the table
    holds.  Use `latest_only` on whatever is derived, so that the texts
    themselves need no shuffle.
    """
    stamp = F.struct(F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"), F.xxhash64("payload").alias("h"))
    return (
        articles.select("article_id", "source_id", F.coalesce("title", F.lit("")).alias("title"), "retrieved_at", "payload")
        .where("article_id IS NOT NULL AND payload IS NOT NULL")
        .select("article_id", "source_id", "title", payload_text(F.col("payload")).alias("text"), stamp.alias("stamp"))
        .where("text IS NOT NULL")
    )


def latest_only(df: DataFrame, key: str = "article_id", stamp: str = "stamp") -> DataFrame:
    """Rows whose stamp is the greatest of their key; a narrow shuffle by key."""
    top = F.max(stamp).over(Window.partitionBy(key))
    return df.withColumn("_top", top).where(F.col(stamp) == F.col("_top")).drop("_top")
