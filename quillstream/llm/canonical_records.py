"""Problem 5: records that differ in form only, collapsed to one with an exact count of copies.

Method: the records are range-partitioned by (canonical key, identifier) and
sorted outside memory; a scan compares the full keys of adjacent records and
closes a run at each change.  As the identifier takes part in the ranges, a key
that holds a third of all records is spread over partitions; the runs that touch the edge of a
partition (at most two per partition) are put together afterwards.

Defined cases: a record with a null identifier, or in which one of the fields is
null, absent or without letter or digit, is no record of an event; rows stored
twice under one identifier count once, as the latest (ties: greatest hash of
the payload); a payload that doesn't parse has no fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import latest_only
from quillstream.runtime import materialize

FIELDS = ("event_subject", "event_action", "event_object")
_SEPARATOR = "\x1f"


def canonical(value: Column) -> Column:
    """Letters and digits only, in order, in lower case."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def canonical_keys(assessments: DataFrame) -> DataFrame:
    """(id, key): one row per stored record that names an event."""
    schema = f"assessment struct<{','.join(f'{f}: string' for f in FIELDS)}>"
    parsed = F.from_json("payload", schema)["assessment"]
    parts = [canonical(F.col("event")[f]) for f in FIELDS]
    full = F.concat_ws(_SEPARATOR, *parts)
    whole = F.coalesce(*[F.when(F.coalesce(p, F.lit("")) == "", F.lit(False)) for p in parts], F.lit(True))
    stamp = F.struct(F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"), F.xxhash64("payload").alias("h"))
    rows = assessments.where("cache_key IS NOT NULL").select(F.col("cache_key").alias("id"), stamp.alias("stamp"), parsed.alias("event")).select("id", "stamp", F.when(whole, full).alias("key"))
    return latest_only(rows, "id").where("key IS NOT NULL").select("id", "key").distinct()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (id, rep) and runs (rep, copies; id null) of one sorted partition; `edge` marks its first and last run."""
    key = rep = None
    count, index = 0, 0
    names = ["key", "id", "rep", "copies", "edge"]

    def run(edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([None], pa.string()), pa.array([rep], pa.string()), pa.array([count], pa.int64()), pa.array([edge])], names)

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        n = len(keys)
        if not n:
            continue
        new = np.ones(n, dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = key is None or keys[0] != key
        starts = np.flatnonzero(new)
        if len(starts) and key is not None:
            count += int(starts[0])
            yield run(edge=index == 0)
            index += 1
        carried = int(starts[0]) if len(starts) else n
        reps = np.empty(n, dtype=object)
        if carried:
            reps[:carried] = rep
        bounds = np.append(starts, n)
        length = np.diff(bounds)
        if len(starts):
            reps[carried:] = np.repeat(ids[starts], length)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.string()), pa.array(reps, pa.string()), pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, dtype=bool))], names)
        if len(starts) > 1:  # all but the last run of this batch are closed
            first = index == 0
            edges = np.zeros(len(starts) - 1, dtype=bool)
            edges[0] = first
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts[:-1]], pa.string()), pa.nulls(len(starts) - 1, pa.string()), pa.array(ids[starts[:-1]], pa.string()), pa.array(length[:-1].astype(np.int64)), pa.array(edges)], names)
            index += len(starts) - 1
        if len(starts):
            key, rep, count = keys[starts[-1]], ids[starts[-1]], int(length[-1])
        else:
            count += n
    if key is not None:
        yield run(edge=True)


def collapse_records(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, key), strings: records (key, rep, copies) and members (id, rep); rep is the smallest id of its key."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    scanned = materialize(ordered.mapInArrow(_scan, "key string, id string, rep string, copies bigint, edge boolean"), "p5-runs")
    runs = scanned.where("id IS NULL")
    # At most two runs per partition touch an edge: this bounds what is broadcast.
    stitched = materialize(runs.where("edge").groupBy("key").agg(F.min("rep").alias("first"), F.sum("copies").alias("copies")), "p5-edges")
    records = runs.where("NOT edge").select("key", "rep", "copies").unionByName(stitched.select("key", F.col("first").alias("rep"), "copies"))
    members = scanned.where("id IS NOT NULL").join(F.broadcast(stitched.select("key", "first")), "key", "left").select("id", F.coalesce("first", "rep").alias("rep"))
    return records, members


def event_copies(assessments: DataFrame) -> DataFrame:
    """(cache_key_a, cache_key_b): every further record of an event, with the smallest key of the event."""
    _, members = collapse_records(canonical_keys(assessments))
    return members.where("id <> rep").select(F.col("rep").alias("cache_key_a"), F.col("id").alias("cache_key_b"))


def distinct_events(assessments: DataFrame) -> DataFrame:
    """(subject, action, object, cache_key, copies): one row per event in canonical form."""
    records, _ = collapse_records(canonical_keys(assessments))
    part = F.split("key", _SEPARATOR)
    return records.select(part[0].alias("subject"), part[1].alias("action"), part[2].alias("object"), F.col("rep").alias("cache_key"), "copies")
