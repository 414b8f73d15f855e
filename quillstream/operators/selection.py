"""An edition's line-up as a whole: suppression, both collapses, seating, and what each step set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators import similarity
from quillstream.operators.dedupe import best_per_event
from quillstream.operators.scoring import rank_order
from quillstream.operators.seating import Policy, seat_editions
from quillstream.runtime import broadcast_if_small, materialize


def collapse_order(preferred: str | None = None) -> list[Column]:
    """Ranking order with one source's rows before all others."""
    first = [] if preferred is None else [F.coalesce(F.col("source_id") == preferred, F.lit(False)).desc()]
    return [*first, *rank_order()]


def _collapse_rank(preferred: str | None) -> Column:
    """The same order as one sortable value."""
    back = F.lit(0) if preferred is None else F.when(F.coalesce(F.col("source_id") == preferred, F.lit(False)), 0).otherwise(1)
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    return F.struct(back.alias("back"), (-F.coalesce("final_score", F.lit(-1))).alias("s"), at.isNull().alias("undated"), at.alias("t"), "article_id")


def select_lineups(candidates: DataFrame, policy: Policy, threshold: float | None = similarity.THRESHOLD) -> DataFrame:
    """(edition_id, article_id, outcome, position, steps, detail): what became of every candidate.

    candidates: edition_id, article_id (unique within), source_id, category, final_score,
    published_at, and as far as there are any: printed_in (the issue that printed it before), event_key,
    subject, title and text.  In this order: what an issue has printed is set aside; of the rows of an event key the
    first stays; reports of one event by similarity are folded (statistics over all that is left, only rows that
    may be printed are folded; no threshold leaves this out); the rest is seated.  The policy's reserved source
    comes first in both collapses while it has slots.  detail names the issue, the row an
    event was folded into, or the seat that a floor gave the row's place to.
    """
    have = set(candidates.columns)
    for name in ("printed_in", "event_key", "title", "text"):
        if name not in have:
            candidates = candidates.withColumn(name, F.lit(None).cast("string"))
    preferred = None if policy.reserved_slots == 0 else policy.reserved_source
    facts = ("category", "final_score", "published_at", *(["subject"] if "subject" in have else []), "printed_in", "event_key")
    if threshold is None:
        rows = materialize(candidates.select("edition_id", "article_id", "source_id", *facts), "candidates")
    else:
        # Texts are read here only; what goes on is a packed row of terms each, apart from the facts that the steps sort and join.
        told = similarity.term_rows(candidates.withColumn("_told", F.col("text").isNotNull()), (*facts, "_told"))
        rows = told.select("edition_id", "article_id", "source_id", *facts)
    out = [rows.where("printed_in IS NOT NULL").select("edition_id", "article_id", F.lit("already_published").alias("outcome"), F.col("printed_in").alias("detail"))]
    fresh = rows.where("printed_in IS NULL")
    keyed = fresh.withColumn("_event", F.when(F.col("event_key").isNotNull(), F.concat_ws("\x1f", "edition_id", "event_key")))
    judged = materialize(best_per_event(keyed, "_event", collapse_order(preferred)).drop("_event"), "events")
    out.append(judged.where("NOT kept").select("edition_id", "article_id", F.lit("duplicate_event").alias("outcome"), F.lit(None).cast("string").alias("detail")))
    left = judged.where("kept").drop("kept")
    if threshold is not None:
        may = F.col("final_score") >= policy.min_score
        if preferred is not None:
            may = may | F.coalesce(F.col("source_id") == preferred, F.lit(False))
        before = broadcast_if_small(materialize(rows.where("printed_in IS NOT NULL").unionByName(judged.where("NOT kept").drop("kept")).select("edition_id", "article_id"), "set-aside"))
        stored = materialize(told.where("_told").join(before, ["edition_id", "article_id"], "left_anti"), "candidate-terms", "zstd")
        pairs = similarity.similar_among(stored, may, threshold)
        folded = materialize(similarity.collapse_similar(left.select("edition_id", "article_id", "source_id", "final_score", "published_at"), pairs, _collapse_rank(preferred)), "folded")
        gone = folded.where("NOT kept")
        out.append(gone.select("edition_id", "article_id", F.lit("similar_event").alias("outcome"), F.col("survivor").alias("detail")))
        left = left.join(gone.select("edition_id", "article_id"), ["edition_id", "article_id"], "left_anti")
    seated = seat_editions(left.drop("printed_in", "event_key"), policy)
    cost = F.when(F.col("detail").isNotNull(), "coverage_floor").otherwise(F.col("outcome"))
    seated = seated.select("edition_id", "article_id", cost.alias("outcome"), "position", "steps", "detail")
    for part in out:
        seated = seated.unionByName(part.withColumn("position", F.lit(None).cast("int")).withColumn("steps", F.lit(0)))
    return seated


def lineup_summary(candidates: DataFrame, lineups: DataFrame, policy: Policy) -> DataFrame:
    """(edition_id, candidates, above_threshold, selected, reserved, items_short, full, steps): one row per edition.

    above_threshold counts the rows that reached seating, whatever came of them, with a score that may be printed and a category that isn't excluded.
    """
    scored = candidates.select("edition_id", "article_id", "category", "final_score")
    every = scored.join(lineups.select("edition_id", "article_id", "outcome", "position", "steps"), ["edition_id", "article_id"], "left")
    open_ = ~F.coalesce("category", F.lit("")).isin(*policy.excluded, "") & ~F.coalesce("outcome", F.lit("")).isin("already_published", "duplicate_event", "similar_event")
    printed = F.count("position")
    return every.groupBy("edition_id").agg(
        F.count("*").alias("candidates"), F.count_if(open_ & (F.col("final_score") >= policy.min_score)).alias("above_threshold"), printed.alias("selected"), F.count_if(F.col("outcome") == "reserved").alias("reserved"),
        F.greatest(F.lit(policy.min_items) - printed, F.lit(0)).alias("items_short"), (printed >= policy.max_items).alias("full"), F.coalesce(F.max("steps"), F.lit(0)).alias("steps"),
    )


def drop_unsupported(lineups: DataFrame, violations: DataFrame) -> DataFrame:
    """Line-ups in which a printed row with violations (edition_id, article_id, field, token) has given up its place; those after it move up.

    Its outcome becomes unsupported_entity and its detail names what was said where.
    """
    found = violations.groupBy("edition_id", "article_id").agg(F.array_sort(F.collect_set(F.struct("field", "token"))).alias("v"))
    said = F.array_join(F.transform("v", lambda x: F.concat(x["field"], F.lit(" says '"), x["token"], F.lit("'"))), "; ")
    marked = lineups.join(found.select("edition_id", "article_id", said.alias("_said")), ["edition_id", "article_id"], "left")
    out = F.col("_said").isNotNull() & F.col("position").isNotNull()
    # An edition has as many places as its policy seats, so that this window is bounded.
    gone = marked.where(out).groupBy("edition_id").agg(F.collect_list("position").alias("_gone"))
    left = marked.join(gone, "edition_id", "left")
    up = F.col("position") - F.coalesce(F.size(F.filter("_gone", lambda p: p < F.col("position"))), F.lit(0))
    return left.select(
        "edition_id", "article_id", F.when(out, "unsupported_entity").otherwise(F.col("outcome")).alias("outcome"), F.when(~out, up).cast("int").alias("position"), "steps", F.when(out, F.col("_said")).otherwise(F.col("detail")).alias("detail")
    )
