"""Seating an edition's line-up: reserved slots, coverage floors, caps, and caps relaxed step by step.

Caps interact, so that seats are given one after the other in rank order; but in a
cell of equal category, source and subject only the first few rows can ever be seated.
The rest is set aside before rows are brought together, which bounds what one
edition's fold sees, and gets its reason from the finished line-up afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.scoring import rank_order


@dataclass(frozen=True)
class Policy:
    """Line-up rules; a category without limit has max_items, null caps don't bind."""

    max_items: int = 8
    min_items: int = 0
    min_score: int = 70
    section_limits: dict[str, int] = field(default_factory=dict)
    max_per_source: int | None = None
    max_per_subject: int | None = 2
    excluded: tuple[str, ...] = ("other",)
    floors: tuple[tuple[str, tuple[str, ...], int], ...] = ()
    reserved_source: str | None = None
    reserved_slots: int | None = None

    def __post_init__(self) -> None:
        if self.max_items < 1 or not 0 <= self.min_items <= self.max_items:
            raise ValueError("min_items must be between 0 and max_items")
        for name, categories, least in self.floors:
            if least > self.max_items or set(categories) & set(self.excluded):
                raise ValueError(f"floor {name} can't be met")

    def relaxed(self, step: int) -> Policy:
        """All caps raised by step, to max_items at most."""
        up = lambda cap: None if cap is None else min(cap + step, self.max_items)
        return replace(self, section_limits={k: up(v) for k, v in self.section_limits.items()}, max_per_source=up(self.max_per_source), max_per_subject=up(self.max_per_subject))

    def limit(self, category: str) -> int:
        return self.section_limits.get(category, self.max_items)


class _Seats:
    """Seated rows and the counts their caps are about."""

    def __init__(self, policy: Policy):
        self.policy, self.rows = policy, {}
        self.counts: dict[tuple[str, str], int] = {}

    def breach(self, row) -> str | None:
        p = self.policy
        for reason, value, cap in (("category_limit", row.category, p.limit(row.category)), ("source_limit", row.source_id, p.max_per_source), ("subject_limit", row.subject, p.max_per_subject)):
            if cap is not None and value and self.counts.get((reason, value), 0) >= cap:
                return reason
        return None

    def add(self, row, how: str) -> None:
        self.rows[row.article_id] = how
        for reason, value in (("category_limit", row.category), ("source_limit", row.source_id), ("subject_limit", row.subject)):
            if value:
                self.counts[reason, value] = self.counts.get((reason, value), 0) + 1

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.policy.max_items


def seat(rows: list, policy: Policy) -> tuple[dict[str, str], dict[str, str], int]:
    """(seated id -> how, refused id -> reason, relaxation steps) for rows in rank order."""
    step = 0
    while True:
        p = policy.relaxed(step)
        seats, refused = _Seats(p), {}
        slots = p.max_items if p.reserved_slots is None else min(p.reserved_slots, p.max_items)
        if p.reserved_source is not None:
            for row in [r for r in rows if r.source_id == p.reserved_source and r.category not in p.excluded][:slots]:
                seats.add(row, "reserved")
        for name, categories, least in p.floors:
            have = sum(1 for r in rows if r.article_id in seats.rows and r.category in categories)
            for row in rows:
                if have >= least or seats.full:
                    break
                if row.category in categories and row.article_id not in seats.rows and row.final_score >= p.min_score and seats.breach(row) is None:
                    seats.add(row, f"floor:{name}")
                    have += 1
        for row in rows:
            if row.category in p.excluded:
                refused[row.article_id] = "excluded_category"
            elif row.article_id in seats.rows:
                continue
            elif row.final_score < p.min_score:
                refused[row.article_id] = "below_threshold"
            elif seats.full:
                refused[row.article_id] = "max_items"
            elif (reason := seats.breach(row)) is not None:
                refused[row.article_id] = reason
            else:
                seats.add(row, "earned")
        rationed = any(r.endswith("_limit") or r == "max_items" for r in refused.values())
        if len(seats.rows) >= p.min_items or not rationed or p == policy.relaxed(step + 1):
            return seats.rows, refused, step
        step += 1


def displaced(rows: list, policy: Policy, seated: dict[str, str], step: int) -> dict[str, str]:
    """Rows that the same caps would have seated without floors, each with the floor seat that took its place.

    Both are in rank order and paired by it; more displaced rows than floor seats share the last.
    """
    floors = [r.article_id for r in rows if seated.get(r.article_id, "").startswith("floor:")]
    if not floors:
        return {}
    p = policy.relaxed(step)
    without = _Seats(p)
    for row in rows:
        if seated.get(row.article_id) == "reserved":
            without.add(row, "reserved")
    for row in rows:
        if row.article_id not in without.rows and row.category not in p.excluded and row.final_score >= p.min_score and not without.full and without.breach(row) is None:
            without.add(row, "earned")
    lost = [r.article_id for r in rows if r.article_id in without.rows and r.article_id not in seated]
    return {a: floors[min(i, len(floors) - 1)] for i, a in enumerate(lost)}


def seat_editions(ranked: DataFrame, policy: Policy) -> DataFrame:
    """(edition_id, article_id, outcome, position, steps, detail): outcome is how a row was seated, or why it wasn't.

    detail names, for a row that a floor cost its seat, the row that has it.

    ranked: edition_id, article_id (unique within), source_id, category, final_score,
    published_at and, optionally, subject.  position is the place in print: reserved
    rows first, the rest by rank.  Rows that can't be seated under any relaxation never
    reach the fold.
    """
    subject = F.coalesce("subject", F.lit("")) if "subject" in ranked.columns else F.lit("")
    base = ranked.select("edition_id", "article_id", F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("final_score", F.lit(-1)).alias("final_score"), "published_at", subject.alias("subject"))
    reserved = F.lit(False) if policy.reserved_source is None else F.col("source_id") == policy.reserved_source
    eligible = ~F.col("category").isin(*policy.excluded, "") if policy.excluded else F.col("category") != ""
    open_ = base.where(eligible & ((F.col("final_score") >= policy.min_score) | reserved))
    # At most max_items rows of a cell can be seated; those of other cells that hold up a subject are no more than seats.
    cell = F.row_number().over(Window.partitionBy("edition_id", "category", "source_id", "subject").orderBy(*rank_order()))
    bound = policy.max_items * (1 + (policy.max_per_subject or 0) + policy.max_items)
    pair = F.row_number().over(Window.partitionBy("edition_id", "category", "source_id").orderBy(*rank_order()))
    candidates = open_.withColumn("_c", cell).where(F.col("_c") <= policy.max_items).withColumn("_p", pair).where(F.col("_p") <= bound).drop("_c", "_p")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["final_score", "published_at", "article_id"], ascending=[False, True, True], na_position="last")
        rows = list(frame.itertuples(index=False))
        seated, refused, steps = seat(rows, policy)
        printed = [r for r in rows if seated.get(r.article_id) == "reserved"] + [r for r in rows if r.article_id in seated and seated[r.article_id] != "reserved"]
        place = {r.article_id: i for i, r in enumerate(printed, 1)}
        cost = displaced(rows, policy, seated, steps)
        ids = [r.article_id for r in rows]
        return pd.DataFrame({"edition_id": frame["edition_id"].iloc[0], "article_id": ids, "outcome": [seated.get(i) or refused.get(i) for i in ids], "position": pd.array([place.get(i) for i in ids], dtype="Int32"), "steps": steps, "detail": [cost.get(i) for i in ids]})

    done = candidates.groupBy("edition_id").applyInPandas(fold, "edition_id string, article_id string, outcome string, position int, steps int, detail string")
    # Rows that were set aside: their reason follows from the line-up.  At a row's turn the seats taken are
    # the reserved and floor seats and those earned before it; an edition has max_items seats at most.
    steps = done.groupBy("edition_id").agg(F.max("steps").alias("_steps"))
    rest = base.join(done, ["edition_id", "article_id"], "left").join(steps, "edition_id", "left")
    aside = rest.where(F.col("outcome").isNull() & eligible & (F.col("final_score") >= policy.min_score)).drop("outcome", "position", "steps", "detail")
    place = lambda p: [-F.col(f"{p}final_score"), F.col(f"{p}published_at").isNull(), F.col(f"{p}published_at"), F.col(f"{p}article_id")]
    seats = base.join(done.where("position IS NOT NULL"), ["edition_id", "article_id"])
    seats = seats.select("edition_id", *[F.col(c).alias(f"s_{c}") for c in ("article_id", "source_id", "category", "final_score", "published_at", "subject", "outcome")])
    taken = F.coalesce((F.col("s_outcome") != "earned") | _before(place("s_"), place("")), F.lit(False))
    counts = [F.count_if(taken).alias("_all")] + [F.count_if(taken & (F.col(c) != "") & (F.col(c) == F.col(f"s_{c}"))).alias(f"_{c}") for c in ("category", "source_id", "subject")]
    seen = aside.join(seats, "edition_id", "left").groupBy("edition_id", "article_id", "category", "_steps").agg(*counts)
    up = lambda cap: F.least(F.lit(cap) + F.coalesce("_steps", F.lit(0)), F.lit(policy.max_items))
    limit = F.lit(policy.max_items)
    for name, cap in policy.section_limits.items():
        limit = F.when(F.col("category") == name, up(cap)).otherwise(limit)
    why = F.when(F.col("_all") >= policy.max_items, "max_items").when(F.col("_category") >= limit, "category_limit")
    for column, cap, name in (("_source_id", policy.max_per_source, "source_limit"), ("_subject", policy.max_per_subject, "subject_limit")):
        if cap is not None:
            why = why.when(F.col(column) >= up(cap), name)
    named = seen.select("edition_id", "article_id", why.alias("_why"))
    reason = F.coalesce("outcome", "_why", F.when(~eligible, "excluded_category").otherwise("below_threshold"))
    return rest.join(named, ["edition_id", "article_id"], "left").select("edition_id", "article_id", reason.alias("outcome"), "position", F.coalesce("steps", "_steps", F.lit(0)).alias("steps"), "detail")


def _before(x: list[F.Column], y: list[F.Column]) -> F.Column:
    """Whether x comes before y, compared column by column."""
    out = F.lit(False)
    for a, b in reversed(list(zip(x, y))):
        out = F.coalesce(a < b, F.lit(False)) | (a.eqNullSafe(b) & out)
    return out


def rejection_counts(seated: DataFrame) -> DataFrame:
    """(edition_id, outcome, n)."""
    return seated.groupBy("edition_id", "outcome").agg(F.count("*").alias("n"))


def floor_cost(ranked: DataFrame, policy: Policy) -> DataFrame:
    """(edition_id, article_id): rows the same policy would seat without its floors."""
    with_floors = seat_editions(ranked, policy).where("position IS NOT NULL").select("edition_id", "article_id")
    without = seat_editions(ranked, replace(policy, floors=())).where("position IS NOT NULL").select("edition_id", "article_id")
    return without.join(with_floors, ["edition_id", "article_id"], "left_anti")
