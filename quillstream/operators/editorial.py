"""Assessments and edited texts that come from outside: bounds, quarantine, and which of them may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import clean_editorial_text, trimmed_facts

RATINGS = ("topic_relevance", "business_impact", "novelty", "actionability")
#: Characters of an edited headline and of a reason why it matters.
HEADLINE, WHY = 140, 400


def rubric_problem() -> Column:
    """Why an assessment breaks the rubric, by the first bound it breaks; null if it keeps them. A missing value breaks its bound."""
    why = F.when(F.lit(False), F.lit(""))
    for name in RATINGS:
        why = why.when(~F.coalesce(F.col(name).between(0, 5), F.lit(False)), name)
    why = why.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    for name in ("summary", "why_it_matters"):
        why = why.when(F.coalesce(F.trim(name), F.lit("")) == "", name)
    return why


def quarantine(assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assessments within the rubric, with texts trimmed, and those set aside with their `problem`."""
    judged = assessments.withColumn("problem", rubric_problem())
    blank = {c: F.when(F.trim(c) != "", F.trim(c)) for c in ("event_subject", "event_action", "event_object", "event_date")}
    good = judged.where("problem IS NULL").drop("problem").withColumns({"summary": F.trim("summary"), "why_it_matters": F.trim("why_it_matters"), "key_facts": trimmed_facts(F.col("key_facts")), **blank})
    return good, judged.where("problem IS NOT NULL")


def usable_polish(edited: DataFrame, items: DataFrame, by: str = "edition_id") -> DataFrame:
    """(by, article_id, headline, why_it_matters): the first edited text of each printed row, as far as it is clean.

    edited: (by, position, article_id, headline, why_it_matters).  Texts for rows that aren't printed and
    repeats are left out, as are texts of which neither part is clean; a part that isn't clean is null.
    """
    known = edited.join(items.select(by, "article_id").distinct(), [by, "article_id"], "left_semi")
    first = known.groupBy(by, "article_id").agg(F.min_by(F.struct("headline", "why_it_matters"), F.struct("position", "headline", "why_it_matters")).alias("f"))
    clean = first.select(by, "article_id", clean_editorial_text(F.col("f.headline"), HEADLINE).alias("headline"), clean_editorial_text(F.col("f.why_it_matters"), WHY).alias("why_it_matters"))
    return clean.where("headline IS NOT NULL OR why_it_matters IS NOT NULL")


def polish(items: DataFrame, usable: DataFrame, by: str = "edition_id") -> DataFrame:
    """items with the title and why_it_matters of usable texts where there are any."""
    texts = usable.select(by, "article_id", F.col("headline").alias("_h"), F.col("why_it_matters").alias("_w"))
    joined = items.join(texts, [by, "article_id"], "left")
    return joined.withColumns({"title": F.coalesce("_h", "title"), "why_it_matters": F.coalesce("_w", "why_it_matters")}).drop("_h", "_w")


def all_items(editions: DataFrame) -> DataFrame:
    """(edition_id, place, *item): the lead and the items of all sections, each article once, where it comes first."""
    flat = F.concat(F.array("lead"), F.flatten(F.transform("sections", lambda s: s["items"])))
    rows = editions.select("edition_id", F.posexplode(flat).alias("_at", "item"))
    first = F.row_number().over(Window.partitionBy("edition_id", "item.article_id").orderBy("_at"))
    return rows.withColumn("_n", first).where("_n = 1").select("edition_id", F.row_number().over(Window.partitionBy("edition_id").orderBy("_at")).alias("place"), "item.*")
