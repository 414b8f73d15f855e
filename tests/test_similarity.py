"""Similar reports without a stored or shuffled row per term: results by brute force, and how much is written."""

import math
import os
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream import runtime
from quillstream.operators import similarity


def _rows(seed=5):
    """Three editions, one of them large; families of like texts, stubs, rows without source and a source with a phrase of its own."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for edition, n in (("e1", 70), ("e2", 9), ("e3", 4)):
        base = [[rng.choice(words) for _ in range(60)] for _ in range(max(2, n // 4))]
        for k in range(n):
            text = [w if rng.random() < 0.7 else rng.choice(words) for w in rng.choice(base)]
            text = text[:20] if k % 9 == 8 else text
            source = rng.choice(["s1", "s2", None])
            out.append((edition, f"{edition}-{k:03d}", source, rng.randint(40, 90), "Title", " ".join(text + (["subscribe", "now"] if source == "s1" else []))))
    return out


def _brute(rows, least):
    """{(edition, a, b): cosine} of the rows with a score of `least`."""
    found = {}
    for edition in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == edition]
        tf = {r[1]: Counter((r[4] + " " + r[5]).lower().split()) for r in own}
        df = Counter(t for c in tf.values() for t in c)
        seen, articles = defaultdict(Counter), Counter(r[2] for r in own)
        for r in own:
            seen[r[2]].update(set(tf[r[1]]))
        vectors = {}
        for r in own:
            if sum(tf[r[1]].values()) < similarity.STUB_WORDS or r[3] < least:
                continue
            chrome = {t for t, n in seen[r[2]].items() if articles[r[2]] >= 3 and n >= articles[r[2]] * 0.5} if r[2] else set()
            raw = {t: (1 + math.log(n)) * (math.log((len(own) + 1) / (df[t] + 1)) + 1) for t, n in tf[r[1]].items() if t not in chrome}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            vectors[r[1]] = {t: x / norm for t, x in raw.items()}
        for a in vectors:
            for b in vectors:
                if a < b and (c := sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items())) >= similarity.THRESHOLD:
                    found[edition, a, b] = c
    return found


def _frame(spark, rows):
    return spark.createDataFrame(rows, "edition_id string, article_id string, source_id string, final_score int, title string, text string").repartition(3)


def _written(spark, work):
    """What work() gives, and the rows of the largest table that it stored."""
    app = spark.sparkContext.applicationId
    before = len(runtime._tables.get(app, []))
    got = work()
    return got, max(spark.read.parquet(p).count() for p in runtime._tables[app][before:])


@pytest.mark.parametrize("small", [False, True])
def test_pairs_agree_with_brute_force(spark, monkeypatch, small):
    if small:  # editions over several units, blocks and tiles
        for name, value in {"UNIT": 8, "LEAST_BLOCK": 4, "MOST_BLOCK": 8, "TILE": 3, "COLUMNS": 5, "PRODUCTS": 7}.items():
            monkeypatch.setattr(similarity, name, value)
    rows = _rows()
    stored = similarity.term_rows(_frame(spark, rows), ("final_score",))
    got = {(r["edition_id"], r["a"], r["b"]): r["cosine"] for r in similarity.similar_among(stored, F.col("final_score") >= 62).collect()}
    want = _brute(rows, 62)
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_no_table_has_a_row_per_term(spark):
    rows = _rows()
    df = _frame(spark, rows)
    got, most = _written(spark, lambda: similarity.similar_pairs(similarity.similarity_profiles(df), df.where("final_score >= 62")).collect())
    assert {(r["edition_id"], r["a"], r["b"]) for r in got} == _brute(rows, 62).keys()
    assert most <= len(rows)


def test_collapse_stores_no_row_per_term(spark):
    from quillstream.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got, most = _written(spark, lambda: catalogue.similar_event_collapse(spark, sf).count())
    assert got and most <= spark.read.parquet(f"{sf}/ranked_articles.parquet").count()


def _lines(spark, df):
    """What each line-up step stores beside the terms: the columns of all tables, by name of the table."""
    app = spark.sparkContext.applicationId
    before = len(runtime._tables.get(app, []))
    df()
    return {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: set(spark.read.parquet(p).columns) for p in runtime._tables[app][before:]}


@pytest.mark.parametrize("name", ["select_editions", "lineup_summary"])
def test_lineup_steps_carry_no_texts(spark, name):
    from quillstream.plans import catalogue

    stored = _lines(spark, lambda: getattr(catalogue, name)(spark, "/root/testdata/sf0.001"))
    assert not [name for name, columns in stored.items() if "text" in columns]
    assert {name for name, columns in stored.items() if columns & {"terms", "term"}} <= {"terms", "candidate-terms", "profiles"}


def test_collapse_gives_its_shuffles_back(spark):
    from quillstream.plans import catalogue

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {p for p in found if os.path.basename(p).startswith("shuffle_") and p.endswith(".data")}

    before = files()
    catalogue.similar_event_collapse(spark, "/root/testdata/sf0.001")
    terms = next(p for p in reversed(runtime._tables[spark.sparkContext.applicationId]) if "/terms-" in p).removeprefix("file://")
    most = sum(os.path.getsize(os.path.join(terms, n)) for n in os.listdir(terms) if n.endswith(".parquet")) / 4
    until = time.time() + 10  # files are removed in the background
    while (left := sum(os.path.getsize(p) for p in files() - before if os.path.exists(p))) > most and time.time() < until:
        time.sleep(0.1)
    # All that was shuffled before the last step, texts and profiles included; counts may stay.
    assert left <= most


def _greedy(rows, pairs):
    """{(edition, article): (kept, survivor)} by going through the scored rows in their order; rows: (edition, article, score, time)."""
    met = defaultdict(set)
    for e, a, b in pairs:
        met[e, a].add(b)
        met[e, b].add(a)
    out = {}
    for e, a, _, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[3] is not None, r[3] or 0, r[1])):
        first = [b for b, (kept, _) in ((b, out.get((e, b), (False, None))) for b in out.get(e, []) if b in met[e, a]) if kept]
        out.setdefault(e, []).append(a)
        out[e, a] = (not first, first[0] if first else None)
    return {k: v for k, v in out.items() if isinstance(k, tuple)}


def _tables(spark, folder, rows):
    """articles and ranked_articles of rows of `_rows`, with times; every article is saved twice, first with another text, and one has no text any more."""
    import json
    from datetime import datetime, timedelta, timezone

    at = datetime(2026, 6, 1, tzinfo=timezone.utc)
    saved = [(i, s, t, at + timedelta(days=d), json.dumps({"clean_text": x if d else "an earlier text"})) for _, i, s, _, t, x in rows for d in (0, 1)]
    saved.append((rows[0][1], rows[0][2], rows[0][4], at + timedelta(days=2), '{"clean_text": "cut'))
    spark.createDataFrame(saved, "article_id string, source_id string, title string, retrieved_at timestamp, payload string").selectExpr("*", "'u' canonical_url", "retrieved_at published_at", "'h' content_hash", "retrieved_at first_seen_at").write.parquet(f"{folder}/articles.parquet")
    ranked = [(e, i, s, None if k % 11 == 10 else score - score % 8, None if k % 7 == 6 else at + timedelta(days=k % 3)) for k, (e, i, s, score, _, _) in enumerate(rows)]
    spark.createDataFrame(ranked, "edition_id string, article_id string, source_id string, final_score int, published_at timestamp").selectExpr("*", "'n' source_name", "1 source_priority", "'c' category", "published_at ranked_at").write.parquet(f"{folder}/ranked_articles.parquet")
    return [(e, i, score, t) for e, i, _, score, t in ranked]


@pytest.mark.parametrize("small", [False, True])
def test_collapse_agrees_with_brute_force(spark, monkeypatch, tmp_path, small):
    from quillstream.plans import catalogue

    if small:
        for name, value in {"UNIT": 8, "LEAST_BLOCK": 4, "MOST_BLOCK": 8}.items():
            monkeypatch.setattr(similarity, name, value)
    rows = _rows(7)
    ranked = _tables(spark, tmp_path, rows)
    scored = [(e, i, s, -1 if (score := r[2]) is None else score, t, x) for (e, i, s, _, t, x), r in zip(rows, ranked)][1:]
    want = _greedy(ranked[1:], _brute(scored, 62))
    got = {(r["edition_id"], r["article_id"]): (r["kept"], r["survivor"]) for r in catalogue.similar_event_collapse(spark, str(tmp_path)).collect()}
    assert got == want and 0 < sum(not kept for kept, _ in got.values()) < len(got)


def test_collapse_stores_no_row_per_pair(spark, tmp_path):
    from quillstream.plans import catalogue

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows = [("e", f"a{k:03d}", None, 90, "Title", " ".join(w if rng.random() < 0.8 else rng.choice(words) for w in base)) for k in range(80)]
    _tables(spark, tmp_path, rows)
    got, most = _written(spark, lambda: catalogue.similar_event_collapse(spark, str(tmp_path)).where("NOT kept").count())
    assert got > 60 and most <= len(rows)  # 2,405 pairs


def test_threshold_is_met_as_sql_rounds():
    rounded = lambda x: math.floor(round(x * 1e10) / 10 + 0.5) / 1e9
    for threshold in (0.21, 0.5, 0.123456789):
        least = similarity._rounded_least(threshold)
        assert rounded(least) >= threshold > rounded(least - 2e-10)
