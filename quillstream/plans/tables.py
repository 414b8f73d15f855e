"""Frames over the stored tables: the current row of each key, and typed payload fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSESSMENT = (
    "assessment struct<category: string, topic_relevance: int, business_impact: int, novelty: int, actionability: int, confidence: double, "
    "summary: string, why_it_matters: string, key_facts: array<string>, event_subject: string, event_action: string, event_object: string, event_date: string>"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def saved_articles(spark: SparkSession, sf: str, text: bool = False) -> DataFrame:
    """Every row of every article; with the text (null if the payload doesn't parse) only on demand."""
    rows = table(spark, sf, "articles").where("article_id IS NOT NULL")
    if text:
        parsed = F.from_json("payload", "clean_text string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        rows = rows.withColumn("text", F.when(parsed["_bad"].isNull(), parsed["clean_text"]))
    return rows


def latest_articles(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(article_id, *cols) of the latest row of each article."""
    latest = F.max_by(F.struct(*cols), F.struct("retrieved_at", "content_hash"))
    return rows.groupBy("article_id").agg(latest.alias("r")).select("article_id", "r.*")


def articles(spark: SparkSession, sf: str, text: bool = False) -> DataFrame:
    """The latest row of each article; with the text (null if the payload doesn't parse) only on demand."""
    cols = ["source_id", "canonical_url", "title", "published_at", "content_hash", "retrieved_at", "first_seen_at"]
    return latest_articles(saved_articles(spark, sf, text), [*cols, "text"] if text else cols)


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of each cache key, with the fields of its payload."""
    cols = ["article_id", "content_hash", "model", "prompt_version", "schema_version", "created_at", "payload"]
    rows = table(spark, sf, "assessments").where("cache_key IS NOT NULL")
    latest = rows.groupBy("cache_key").agg(F.max_by(F.struct(*cols), F.struct("created_at", "payload")).alias("r")).select("cache_key", "r.*")
    return latest.withColumn("a", F.from_json("payload", ASSESSMENT)["assessment"]).select("cache_key", *cols[:-1], "a.*")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of each article of an edition, with the category in one spelling."""
    cols = ["source_id", "source_name", "source_priority", "category", "final_score", "published_at"]
    rows = table(spark, sf, "ranked_articles").where("edition_id IS NOT NULL AND article_id IS NOT NULL").withColumn("category", F.lower(F.trim("category")))
    order = F.struct("ranked_at", "final_score", "category")
    return rows.groupBy("edition_id", "article_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("edition_id", "article_id", "r.*")


SQL_ARTICLES = """art AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY retrieved_at DESC NULLS LAST, content_hash DESC NULLS LAST) n FROM articles WHERE article_id IS NOT NULL) WHERE n = 1),
txt AS (SELECT *, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.clean_text') END AS text FROM art)"""
SQL_ASSESSMENTS = """ass AS (SELECT cache_key, article_id, content_hash, model, prompt_version, schema_version, created_at, payload,
 json_extract_string(payload, '$.assessment.category') AS category,
 CAST(json_extract_string(payload, '$.assessment.topic_relevance') AS INT) AS topic_relevance, CAST(json_extract_string(payload, '$.assessment.business_impact') AS INT) AS business_impact,
 CAST(json_extract_string(payload, '$.assessment.novelty') AS INT) AS novelty, CAST(json_extract_string(payload, '$.assessment.actionability') AS INT) AS actionability,
 json_extract_string(payload, '$.assessment.summary') AS summary, json_extract_string(payload, '$.assessment.event_subject') AS event_subject, json_extract_string(payload, '$.assessment.event_object') AS event_object
 FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST, payload DESC NULLS LAST) n FROM assessments WHERE cache_key IS NOT NULL) WHERE n = 1)"""
SQL_SCORED = """scored AS (SELECT a.cache_key, a.article_id, a.prompt_version, a.category, a.topic_relevance, a.business_impact, a.novelty, a.actionability, r.source_id, s.priority, r.published_at, r.title,
 a.event_subject, a.event_object, 6*a.topic_relevance + 5*a.business_impact + 4*a.novelty + 3*a.actionability + s.priority AS final_score
 FROM ass a JOIN art r ON a.article_id = r.article_id JOIN sources s ON r.source_id = s.id)"""
SQL_RANKED = """rk AS (SELECT edition_id, article_id, source_id, source_priority, category, final_score, published_at FROM (SELECT * REPLACE (lower(trim(category)) AS category), row_number() OVER (PARTITION BY edition_id, article_id
 ORDER BY ranked_at DESC NULLS LAST, final_score DESC NULLS LAST, lower(trim(category)) DESC NULLS LAST) n FROM ranked_articles WHERE edition_id IS NOT NULL AND article_id IS NOT NULL) WHERE n = 1)"""
