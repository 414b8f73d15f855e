"""A seated line-up as one nested record per edition, its link check, and its text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import markdown_escape

ITEM = ("article_id", "title", "source_name", "canonical_url", "published_at", "summary", "final_score")


def build_editions(items: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(edition_id, lead, sections) from seated rows: edition_id, category, position and the columns of ITEM.

    Sections come in the given order of categories, the others after them by name;
    the lead is the best by score, then the oldest, then by identifier.  An edition has
    as many rows as its policy seats.
    """
    item = F.struct("position", *ITEM)
    best = F.struct(-F.col("final_score"), F.unix_micros(F.col("published_at").cast("timestamp")), "article_id")
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category")), F.lit(0)) if order else F.lit(0)
    rank = F.when(place == 0, F.lit(len(order) + 1)).otherwise(place)
    sections = items.groupBy("edition_id", "category").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("rank", rank)
    whole = sections.groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "items"))).alias("s"))
    whole = whole.select("edition_id", F.transform("s", lambda x: F.struct(x["category"].alias("category"), x["items"].alias("items"))).alias("sections"))
    lead = items.groupBy("edition_id").agg(F.min_by(item, best).alias("lead"))
    return lead.join(whole, "edition_id")


def edition_json(editions: DataFrame) -> DataFrame:
    """(edition_id, json)."""
    return editions.select("edition_id", F.to_json(F.struct("edition_id", "lead", "sections")).alias("json"))


def edition_markdown(editions: DataFrame) -> DataFrame:
    """(edition_id, markdown)."""
    line = lambda i: F.concat(F.lit("- ["), markdown_escape(i["title"]), F.lit("]("), i["canonical_url"], F.lit(") — "), markdown_escape(i["source_name"]))
    part = F.transform("sections", lambda s: F.concat(F.lit("## "), s["category"], F.lit("\n\n"), F.array_join(F.transform(s["items"], line), "\n")))
    return editions.select("edition_id", F.concat(F.lit("# "), F.col("edition_id"), F.lit("\n\n"), F.array_join(part, "\n\n"), F.lit("\n")).alias("markdown"))


def broken_links(items: DataFrame, ingested: DataFrame) -> DataFrame:
    """(edition_id, article_id, problem): items whose link wasn't ingested, or whose prose holds a link; empty for a sound edition."""
    unknown = items.join(ingested.select("canonical_url").distinct(), "canonical_url", "left_anti").select("edition_id", "article_id", F.lit("unknown link").alias("problem"))
    prose = items.where(F.coalesce(F.col("summary").rlike(r"(?i)https?://|www\."), F.lit(False))).select("edition_id", "article_id", F.lit("link in prose").alias("problem"))
    return unknown.unionByName(prose)
