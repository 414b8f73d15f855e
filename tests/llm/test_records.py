"""Problems 5 and 6."""

import json
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from quillstream.llm import canonical_records, top_per_group

T0 = datetime(2026, 5, 1)
SCHEMA = "cache_key string, created_at timestamp, payload string, id string, key string, rep string"


def _assessments(spark, made):
    return spark.createDataFrame([(k, T0 + timedelta(hours=h) if h is not None else None, json.dumps({"assessment": a}) if isinstance(a, dict) else a, "x", "y", "z") for k, h, a in made], SCHEMA)


def event(s, a="launched", o="Tool"):
    return {"event_subject": s, "event_action": a, "event_object": o}


def test_event_copies(spark):
    made = [("c", 1, event("Acme Inc.")), ("a", 1, event("ACME, inc")), ("b", 1, event("acme-inc")), ("d", 1, event("Acme Ink")), ("e", 1, event(None)), ("f", 1, event("?!")), ("g", 1, {"event_subject": "Acme inc"}), ("h", 1, "{cut"), (None, 1, event("Acme Inc")), ("i", None, None)]
    made += [("d", 2, event("acme INC")), ("a", 0, event("else"))]  # stored again later, and a stale row
    got = sorted(map(tuple, canonical_records.event_copies(_assessments(spark, made)).collect()))
    assert got == [("a", "b"), ("a", "c"), ("a", "d")]
    events = {r["subject"]: (r["cache_key"], r["copies"]) for r in canonical_records.distinct_events(_assessments(spark, made)).collect()}
    assert events == {"acmeinc": ("a", 4)}
    assert canonical_records.event_copies(_assessments(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [1, 400])
def test_a_run_over_many_partitions_has_one_record(spark, hot):
    keyed = [(f"k{i:04}", "hot") for i in range(hot)] + [(f"z{i:04}", f"v{i % 37}") for i in range(300)]
    records, members = canonical_records.collapse_records(spark.createDataFrame(keyed, "id string, key string"))
    want = defaultdict(list)
    for i, k in keyed:
        want[k].append(i)
    assert {r["key"]: (r["rep"], r["copies"]) for r in records.collect()} == {k: (min(v), len(v)) for k, v in want.items()}
    assert {r["id"]: r["rep"] for r in members.collect()} == {i: min(want[k]) for i, k in keyed}
    assert records.count() == len(want)


RANKED = "edition_id string, article_id string, category string, final_score int, published_at timestamp, ranked_at timestamp, r string"


def test_best_articles(spark):
    rows = [("e", "a", " X", 5, T0, T0), ("e", "b", "x ", 5, T0, T0), ("e", "c", "x", 5, T0 - timedelta(1), T0), ("e", "d", "x", 5, None, T0), ("e", "a", "x", 9, T0, T0 - timedelta(1))]
    rows += [("e", "n", "x", None, T0, T0), ("e", "m", "x", 9, T0, T0), ("e", "m", "x", None, T0, T0 + timedelta(1)), ("e", "z", None, 9, T0, T0), (None, "z", "x", 9, T0, T0), ("e", None, "x", 9, T0, T0), ("f", "a", "X", 1, T0, None), ("f", "a", "x", 1, T0, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], RANKED)
    got = {tuple(r)[:3] for r in top_per_group.best_articles(df).collect()}
    assert got == {("e", "x", "c"), ("e", "x", "a"), ("e", "x", "b"), ("f", "x", "a")}
    assert top_per_group.best_articles(df.limit(0)).count() == 0


def test_hot_group_over_many_partitions(spark):
    rows = [("e", f"a{i:05}", "x" if i % 3 else f"c{i % 50}", (i * 7919) % 101, T0 + timedelta(minutes=i % 7), T0) for i in range(6000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], RANKED).repartition(7)
    groups = defaultdict(list)
    for e, a, c, s, p, _ in rows:
        groups[c].append((-s, p, a))
    want = {(c, a) for c, v in groups.items() for _, _, a in sorted(v)[:3]}
    assert {(r["category"], r["article_id"]) for r in top_per_group.best_articles(df).collect()} == want
