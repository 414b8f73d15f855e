"""Continuous forms: weekly event-time counts with late data, first printing as state, idempotent keyed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.sources.store import Store


def weekly_counts(events: DataFrame, time: str = "published_at", late: str = "2 days", key: str = "source_id") -> DataFrame:
    """Rows per key and half-open week (from Monday, UTC) of a stream or a table; rows later than `late` are dropped in a stream."""
    # Unix time began on a Thursday: weeks from Monday are shifted by four days.
    week = F.window(F.col(time), "7 days", startTime="4 days")
    return events.withWatermark(time, late).groupBy(week.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), key, "n")


def first_printing(items: DataFrame, time: str = "published_at", late: str = "28 days", key: str = "content_hash") -> DataFrame:
    """The first row of each key of a stream, remembered for as long as `late`; see `first_printing_sink` for one that never forgets."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def first_printing_sink(store: Store, table: str, key: list[str], order: str):
    """A foreachBatch function that keeps the first row of each key for ever: what is stored stays, whatever comes later or is replayed.

    Within a batch the row that is least by `order`, then by its other columns, is the first; rows with a null in the key are left out.
    """

    def write(batch: DataFrame, _: int) -> None:
        cols = [c for c in batch.columns if c not in key]
        first = batch.dropna(subset=key).groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order])).alias("r")).select(*key, "r.*")
        store.upsert(table, first, key, tuple(cols))

    return write


def upsert_sink(store: Store, table: str, key: list[str], order: str, keep: tuple[str, ...] = ()):
    """A foreachBatch function that writes the latest row of each key; a batch that is replayed changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        cols = [c for c in batch.columns if c not in key]
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order])).alias("r")).select(*key, "r.*")
        store.upsert(table, latest, key, keep)

    return write
