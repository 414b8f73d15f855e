import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstream.functions.text import usable_title_key
from quillstream.operators import dedupe, fidelity, pool, scoring, seating, similarity
from quillstream.operators.greedy import greedy_keep

T0 = datetime(2026, 5, 1)


def brute(nodes, keys, pairs):
    kept, taken, out = set(), set(), {}
    for _, i in sorted((r, i) for i, r in nodes):
        mine = {k for j, k in keys if j == i and k is not None}
        free = not (mine & taken) and not any((a == i and b in kept) or (b == i and a in kept) for a, b in pairs)
        out[i] = free
        if free:
            kept.add(i)
            taken |= mine
    return out


@pytest.mark.parametrize("finish", [0, 200_000])
def test_greedy_choice(spark, finish):
    rnd = random.Random(finish)
    nodes = [(i, rnd.randrange(20)) for i in range(60)]
    keys = [(rnd.randrange(60), rnd.choice(["a", None, *(f"k{j}" for j in range(30))])) for _ in range(90)]
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = greedy_keep(spark.createDataFrame(nodes, "id long, rank int"), spark.createDataFrame(keys, "id long, key string"), spark.createDataFrame(pairs, "a long, b long"), finish)
    assert {r["id"]: r["kept"] for r in got.collect()} == brute(nodes, keys, pairs)


def test_a_dropped_row_holds_nothing_against_later_ones(spark):
    rows = [("1", "u1", "h1", "title number one", 1), ("2", "u2", "h1", "title number two", 2), ("3", "u2", "h3", "title number three", 3), ("4", None, None, None, 4), ("5", "u1", "h1", "title number one", 5)]
    df = spark.createDataFrame(rows, "article_id string, url_key string, content_hash string, title string, r int").withColumn("title_key", usable_title_key(F.col("title")))
    got = {r["article_id"]: (r["kept"], r["reason"], r["survivor"]) for r in dedupe.deduplicate(df.repartition(3), F.col("r")).collect()}
    assert got == {"1": (True, None, None), "2": (False, "content", "1"), "3": (True, None, None), "4": (True, None, None), "5": (False, "url", "1")}


def test_round_robin_and_positions(spark):
    rows = [(f"{s}{i}", s, T0 + timedelta(hours=i)) for s, n in (("x", 3), ("y", 1), ("z", 2)) for i in range(n)]
    got = pool.positions(pool.round_robin(spark.createDataFrame(rows, "article_id string, source_id string, published_at timestamp").repartition(5), spark.createDataFrame([("z", 9)], "source_id string, priority int")), pool.round_robin_order()).collect()
    assert [r["article_id"] for r in sorted(got, key=lambda r: r["position"])] == ["z1", "x2", "y0", "z0", "x1", "x0"]


def test_scores_and_their_distribution(spark):
    rows = [(7, 5, 5, 5, 5), (7, 4, 4, 3, 3), (7, 3, 3, 3, 2), (4, 3, 2, 2, 2), (4, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "priority int, topic_relevance int, business_impact int, novelty int, actionability int").withColumn("final_score", scoring.score())
    d = scoring.distribution(df, 62).first().asDict()
    assert d == {"n": 5, "lowest": 22, "median": 58, "p90": 97, "highest": 97, "passing": 2, "pass_rate": 0.4}
    assert [r["n"] for r in scoring.histogram(df).orderBy("band").collect()] == [0, 0, 1, 0, 1, 1, 0, 1, 0, 1]
    assert scoring.histogram(df.limit(0)).count() == 10


RANKED = "edition_id string, article_id string, source_id string, category string, final_score int, published_at timestamp, subject string"


def test_seating_folds_like_one_pass_over_all_rows(spark):
    rnd = random.Random(7)
    policy = seating.Policy(max_items=6, min_items=4, min_score=50, section_limits={"c0": 1, "c1": 2}, max_per_source=2, max_per_subject=1, floors=(("beat", ("c2",), 2),), reserved_source="s9", reserved_slots=1)
    rows = [(f"e{i % 5}", f"a{i}", f"s{rnd.randrange(10)}", rnd.choice(["c0", "c1", "c2", "c3", "other"]), rnd.randrange(30, 100), T0 + timedelta(hours=rnd.randrange(9)), rnd.choice(["", "p", "q", "r"])) for i in range(300)]
    # A cell with more rows than an edition has seats, so that some are set aside before the fold.
    rows += [("e0", f"b{i}", "s1", "c3", 60 + i, T0, "") for i in range(30)] + [("e1", f"b{i}", "", "c3", 99 - i, None, "") for i in range(30)]
    df = spark.createDataFrame(rows, RANKED)
    got = {(r["edition_id"], r["article_id"]): r["outcome"] for r in seating.seat_editions(df.repartition(6), policy).collect()}
    assert len(got) == len(rows)
    from collections import namedtuple

    Row = namedtuple("Row", RANKED.replace(" string", "").replace(" int", "").replace(" timestamp", "").replace(",", ""))
    for e in {r[0] for r in rows}:
        own = sorted((Row(*r) for r in rows if r[0] == e), key=lambda r: (-r.final_score, r.published_at is None, r.published_at or T0, r.article_id))
        seated, refused, _ = seating.seat(own, policy)
        assert {a: o for (x, a), o in got.items() if x == e and (o in ("earned", "reserved") or o.startswith("floor"))} == seated
        for a, reason in refused.items():
            assert got[e, a] == reason
    with pytest.raises(ValueError):
        seating.Policy(max_items=3, min_items=4)


def test_similar_reports_fold_into_the_best(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 2
    other = " ".join(f"word{i}" for i in range(45))
    rows = [("e", "a", "s1", "Launch", base, 88), ("e", "b", "s2", "Launch again", base + " more", 82), ("e", "c", "s3", "Other", other, 79), ("e", "d", "s4", "stub", "alpha beta", 90), ("f", "b", "s2", "Launch again", base, 82)]
    df = spark.createDataFrame(rows, "edition_id string, article_id string, source_id string, title string, text string, final_score int")
    pairs = similarity.similar_pairs(similarity.similarity_profiles(df), df)
    assert [(r["edition_id"], r["a"], r["b"]) for r in pairs.collect()] == [("e", "a", "b")]
    got = {(r["edition_id"], r["article_id"]): (r["kept"], r["survivor"]) for r in similarity.collapse_similar(df, pairs, F.struct(-F.col("final_score"), "article_id")).collect()}
    assert got["e", "b"] == (False, "a") and sum(k for k, _ in got.values()) == 4


def test_names_the_source_never_mentions(spark):
    def supported(words, token):
        for i in range(len(words)):
            stem = ""
            for w in words[i:]:
                stem += w
                if stem == token or (len(stem) >= len(token) and stem.startswith(token)):
                    return True
                if len(stem) >= len(token) or not token.startswith(stem):
                    break
                if len(stem) >= 3:
                    return True
        return False

    rnd = random.Random(3)
    cases = [(["".join(rnd.choices("ab", k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(0, 6))], "".join(rnd.choices("ab", k=rnd.randrange(1, 6)))) for _ in range(3000)]
    df = spark.createDataFrame(cases, "w array<string>, t string").select(fidelity.supported(F.col("w"), F.col("t")))
    assert [r[0] for r in df.collect()] == [supported(w, t) for w, t in cases]
    prose = spark.createDataFrame([("1", "summary", "YouTube-Shorts and iPhone, GPT-5 but NASA. OpenAI's"), ("2", "summary", "DeepMind")], "article_id string, field string, text string")
    source = spark.createDataFrame([("1", "YouTube Shorts beat GPT-4 as OpenAI said"), ("3", "x")], "article_id string, text string")
    assert sorted(r["token"] for r in fidelity.unsupported_entities(prose, source).collect()) == ["GPT-5", "iPhone"]


def test_every_assessment_is_checked_in_summary_and_key_facts(spark, tmp_path):
    import json

    from quillstream.plans import catalogue

    def said(summary, facts):
        return json.dumps({"assessment": {"summary": summary, "key_facts": facts}})

    made = [("k1", "a", T0, said("GPT-9 is out", None)), ("k2", "a", T0 + timedelta(days=1), said("Fine", ["By OpenNews", "iPhone and iPhone", "GPT-4"])), ("k3", None, T0, said("GPT-9", None))]
    schema = "cache_key string, article_id string, created_at timestamp, payload string, content_hash string, model string, prompt_version string, schema_version string"
    spark.createDataFrame([(*r, None, None, None, None) for r in made], schema).write.parquet(f"{tmp_path}/assessments.parquet")
    article = ("a", "s", "u", "GPT-4", T0, "h", T0, T0, json.dumps({"clean_text": "A phone"}))
    spark.createDataFrame([article], "article_id string, source_id string, canonical_url string, title string, published_at timestamp, content_hash string, retrieved_at timestamp, first_seen_at timestamp, payload string").write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([("s", "OpenNews")], "id string, name string").write.parquet(f"{tmp_path}/sources.parquet")
    got = catalogue.entity_violations(spark, str(tmp_path)).select("cache_key", "article_id", "field", "token").collect()
    assert sorted(tuple(r) for r in got) == [("k1", "a", "summary", "GPT-9"), ("k2", "a", "key_facts", "iPhone")]


def test_suppression_prefers_the_identifier(spark):
    items = spark.createDataFrame([("a", "h", "W2", "W2", "e2", 1), ("a", "h", "W1", "W1", "e1", 5), ("b", None, "W3", None, "e0", 1)], "article_id string, content_hash string, issue string, generated_at string, edition_id string, position int")
    by_id, by_hash = pool.published_keys(items)
    new = spark.createDataFrame([("a", "x"), ("z", "h"), ("b", None), ("q", "q")], "article_id string, content_hash string")
    assert {r["article_id"]: r["printed_in"] for r in pool.suppress_published(new, by_id, by_hash).collect()} == {"a": "W1", "z": "W1", "b": "W3", "q": None}
