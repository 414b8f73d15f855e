"""Scores from ratings, their order and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of each rating in a score of at most 100 (priority adds up to 10).
WEIGHTS = {"topic_relevance": 6, "business_impact": 5, "novelty": 4, "actionability": 3}
CATEGORIES = ("youtube_platform", "youtube_monetization", "kids_content", "ai_video", "ai_models", "ai_business", "other")


def score(priority: Column | str = "priority") -> Column:
    """Weighted ratings plus the source's priority."""
    total = F.col(priority) if isinstance(priority, str) else priority
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.col(name)
    return total.cast("int")


def score_components(priority: str = "priority") -> Column:
    """The score's parts as a struct."""
    return F.struct(*[(F.lit(w) * F.col(n)).cast("int").alias(n) for n, w in WEIGHTS.items()], F.col(priority).cast("int").alias("priority"))


def stored_assessments(assessments: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Assessments with their article and source; rows without partner are left out."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "priority")
    return assessments.join(articles, "article_id").join(s, "source_id")


def rank_order(score_col: str = "final_score", published: str = "published_at", key: str = "article_id") -> list[Column]:
    """Best first, then oldest, then by identifier: a total order."""
    return [F.col(score_col).desc_nulls_last(), F.col(published).asc_nulls_last(), F.col(key).asc()]


def distribution(scored: DataFrame, threshold: int, by: list[str] | None = None, column: str = "final_score") -> DataFrame:
    """Count, extremes, nearest-rank median and 90th percentile, and how many reach the threshold; per group or over all."""
    s = F.col(column)
    rank = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").cast("int").alias(n) for q, n in ((0.5, "median"), (0.9, "p90"))]
    aggs = [F.count(s).alias("n"), F.min(s).alias("lowest"), *rank, F.max(s).alias("highest"), F.count_if(s >= threshold).alias("passing"), F.round(F.count_if(s >= threshold) / F.count(s), 6).alias("pass_rate")]
    return (scored.groupBy(*by) if by else scored.groupBy()).agg(*aggs)


def histogram(scored: DataFrame, bands: int = 10, top: int = 100, column: str = "final_score") -> DataFrame:
    """(band, low, n) of equal bands, the last closed at the top; empty bands are there too."""
    width = top // bands
    found = scored.where(F.col(column).isNotNull()).groupBy(F.least(F.floor(F.col(column) / width), F.lit(bands - 1)).alias("band")).agg(F.count("*").alias("n"))
    every = scored.sparkSession.range(bands).select(F.col("id").alias("band"))
    return every.join(found, "band", "left").select("band", (F.col("band") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))
