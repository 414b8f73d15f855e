"""Ingest of all sources at once: failures of single articles and whole sources are rows, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import transfer
from quillstream.functions.text import registrable_host
from quillstream.functions.urls import canonicalize_url, dedupe_key


def limit_per_source(found: DataFrame, limits: DataFrame) -> DataFrame:
    """found (source_id, position, ...) cut at each source's own limit (source_id, max_items); null or no limit cuts nothing.

    The limit is the feature.  position is the row's place within its source as the scan gave it, so that nothing is sorted here.
    """
    most = limits.select("source_id", "max_items")
    kept = found.join(most, "source_id", "left").where(F.col("max_items").isNull() | (F.col("position") <= F.col("max_items")))
    return kept.drop("max_items")


def split_outcome(rows: DataFrame, problem: str = "problem") -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and the quarantine."""
    return rows.where(F.col(problem).isNull()).drop(problem), rows.where(F.col(problem).isNotNull())


def source_outcomes(sources: DataFrame, rows: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(source_id, found, ingested, failed, status): one row per enabled source, whatever became of it.

    rows: (source_id, problem), one per article found.  failures: (source_id, error) of sources that
    could not be read at all.  status is failed, empty, partial or ok.
    """
    n = rows.groupBy("source_id").agg(F.count("*").alias("found"), F.count_if(F.col("problem").isNull()).alias("ingested"))
    base = sources.where("enabled").select(F.col("id").alias("source_id")).join(n, "source_id", "left").select("source_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("ingested", F.lit(0)).alias("ingested"))
    if failures is not None:
        base = base.join(failures.groupBy("source_id").agg(F.min("error").alias("error")), "source_id", "left")
    else:
        base = base.withColumn("error", F.lit(None).cast("string"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("found") == 0, "empty").when(F.col("ingested") < F.col("found"), "partial").otherwise("ok")
    return base.select("source_id", "found", "ingested", (F.col("found") - F.col("ingested")).alias("failed"), status.alias("status"))


def submitted_url_problem(url: Column, blocked: tuple[str, ...] = (), addresses: Column | None = None) -> Column:
    """Why a proposed URL isn't accepted, or null: not public, not https, a blocked host, a non-public address."""
    canonical = canonicalize_url(url)
    address = transfer.private_host_reason(canonical, addresses) if addresses is not None else F.lit(None).cast("string")
    return F.when(canonical.isNull(), "not a public url").when(~canonical.startswith("https://"), "not https").when(transfer.blocked_host(canonical, blocked), "blocked host").otherwise(address)


def match_by_url(proposed: DataFrame, articles: DataFrame) -> DataFrame:
    """proposed (url, ...) with the article whose origin or canonical URL it is; of several the last by retrieval, then by identifier."""
    ends = F.explode(F.array_distinct(F.array(dedupe_key(F.col("origin_url")), dedupe_key(F.col("canonical_url")))))
    by_url = articles.select("article_id", "retrieved_at", ends.alias("_key")).where("_key IS NOT NULL")
    last = by_url.groupBy("_key").agg(F.max_by("article_id", F.struct("retrieved_at", "article_id")).alias("article_id"))
    return proposed.withColumn("_key", dedupe_key(F.col("url"))).join(last, "_key", "left").drop("_key")


def follow_links(pages: DataFrame, links: DataFrame, linked: DataFrame, least: int) -> DataFrame:
    """pages (url, text) with `linked_url` and `linked_text`: of the links of a page with less text than `least`, the first whose page has enough.

    links: (url, position, link).  linked: (link, text).
    """
    enough = links.join(linked.where(F.length("text") >= least), "link").groupBy("url").agg(F.min_by(F.struct("link", "text"), F.struct("position", "link")).alias("l"))
    joined = pages.join(enough, "url", "left")
    thin = F.coalesce(F.length("text") < least, F.lit(True))
    return joined.withColumns({"linked_url": F.when(thin, F.col("l.link")), "linked_text": F.when(thin, F.col("l.text"))}).drop("l")


def oldest_first(rows: DataFrame, status: str, most: int) -> DataFrame:
    """The `most` oldest rows of a status by submitted_at, then submission_id: a queue's head."""
    return rows.where(F.col("status") == status).orderBy(F.col("submitted_at").asc_nulls_last(), "submission_id").limit(most)


def site_of(url: Column) -> Column:
    """The site a URL belongs to."""
    return registrable_host(transfer.host_of(url))


def traceability(items: DataFrame, editions: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(edition_id, article_id, broken): printed items whose chain edition, article, source has a gap, and where; empty for a sound store."""
    e = editions.select("edition_id").distinct().withColumn("_e", F.lit(True))
    a = articles.select("article_id", "source_id").dropDuplicates(["article_id"]).withColumn("_a", F.lit(True))
    s = sources.select(F.col("id").alias("source_id")).distinct().withColumn("_s", F.lit(True))
    chain = items.select("edition_id", "article_id").distinct().join(e, "edition_id", "left").join(a, "article_id", "left").join(s, "source_id", "left")
    broken = F.when(F.col("_e").isNull(), "edition").when(F.col("_a").isNull(), "article").when(F.col("_s").isNull(), "source")
    return chain.select("edition_id", "article_id", broken.alias("broken")).where("broken IS NOT NULL")


def latest_runs(runs: DataFrame, most: int, started: str = "started_at", key: str = "run_id") -> DataFrame:
    """The `most` latest runs, newest first, ties by identifier: a top-k report."""
    return runs.orderBy(F.col(started).desc_nulls_last(), F.col(key).desc()).limit(most)
