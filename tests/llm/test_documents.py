"""Problems 7, 8 and 9, which read documents."""

import random
import re

import numpy as np
import pytest

from quillstream.llm import leaks, mixing, shared_spans
from quillstream.llm import textkernel as K

WORD = re.compile(r"[^\W_]+")
DOC = "doc_id long, text string, source string, h long, place int, item_id long"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else None, 1, 1, 1) for i, t in enumerate(texts)], DOC)


# -- text kernel ---------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    texts = ["Ünïcode_words, 12³ and ½!", None, "", "x", "a\0b", "Straße İstanbul 漢字 don't"]
    w = K.words(K.encode(texts, lower=True))
    counts = np.diff(w.first).tolist()
    assert counts == [len(WORD.findall((t or "").lower())) for t in texts]
    same = K.words(K.encode(["one two", "two ONE"], lower=True)).hash
    assert same[0] == same[3] and same[1] == same[2] and same[0] != same[1]


# -- 7 ------------------------------------------------------------------------------------


def _contained(doc, item, run=13):
    d, i = WORD.findall((doc or "").lower()), WORD.findall((item or "").lower())
    n = min(run, len(i))
    grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
    return any(tuple(d[k : k + n]) in grams for k in range(len(d) - n + 1)) if n else False


def test_leaks_are_those_of_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [" ".join(rnd.choices(vocabulary, k=k)) for k in (3, 5, 12, 13, 14, 20, 40, 40)] + ["", None, "?!", "v1"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 120))) for _ in range(60)] + [None, "", "x" * 100_000, "v1 " * 9000]
    for i in items[:8]:
        w = i.split()
        for cut in (w, w[:13], w[-13:], w[1:13], w[:6] + ["zz"] + w[6:]):
            texts.append(("Intro: " + ", ".join(rnd.choices(vocabulary, k=20)) + " — " + "\n> ".join(cut).upper() + "."))
    it = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "v1")], "item_id long, text string")
    df = docs(spark, texts)
    want = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if _contained(t, q)}
    assert len(want) > 60
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it, block=3).collect()} == want
    assert leaks.leaked_items(df.limit(0), it).count() == 0 and leaks.leaked_items(df, it.limit(0)).count() == 0


def test_block_lookups_find_all_within_the_radius():
    rnd = np.random.default_rng(1)
    texts = [" ".join(f"q{x}" for x in rnd.integers(0, 9, 13)) for _ in range(300)]
    index = leaks.probes(list(range(300)), texts)
    w = K.words(K.encode(texts, lower=True))
    (p,) = index
    got = {(int(d), int(j)) for doc, _, win, score, _ in leaks.match(w, index, 3, 0.0) for d, j in zip(doc, win)}
    mine = np.array([leaks.fingerprints(w, 13, a, a + 1, leaks.signed_sums(w, a, a + 13))[0] for a in w.first[:-1]], dtype=np.uint64)
    want = {(i, j) for i in range(300) for j in range(len(p.marks)) if np.bitwise_count(mine[i] ^ p.marks[j]) <= 3}
    assert got == want and len(got) > 300


# -- 8 -----------------------------------------------------------------------------------


TARGET = "source string, target_share double, max_repeats int, tokens long"


def test_shares_are_reached_within_the_caps(spark):
    rnd = random.Random(2)
    texts, sources = [], []
    for s, n in (("big", 400), ("mid", 150), ("small", 30), ("none", 40), (None, 5)):
        for _ in range(n):
            texts.append(rnd.choice([None, "", " ".join(rnd.choices(["alpha", "beta", "gamma"], k=rnd.randrange(1, 90)))] + ["word " * rnd.randrange(5, 60)] * 9))
            sources.append(s)
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("mid", 0.2, 2, 0), ("small", 0.2, 4, 0), ("missing", 0.1, 3, 0), (None, 0.3, 1, 0), ("none", None, 2, 0), ("bad", 0.1, 0, 0)], TARGET)
    copies, report = mixing.mix(docs(spark, texts, sources), targets)
    shares = {r["source"]: r for r in report.collect()}
    assert set(shares) == {"big", "mid", "small", "missing"}
    for s, want in (("big", 5 / 9), ("mid", 2 / 9), ("small", 2 / 9), ("missing", 0)):
        assert shares[s]["actual_share"] == pytest.approx(want, abs=0.005)
    rows = copies.collect()
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(0 <= r["copies"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert shares["small"]["copies"] == 4 * sum(1 for r in rows if r["source"] == "small" and r["tokens"])
    assert sum(r["copies"] * r["tokens"] for r in rows) == sum(x["used_tokens"] for x in shares.values())


def test_rates_are_an_exponential_tilt(spark):
    texts = ["word " * (1 + i % 50) for i in range(300)]
    targets = spark.createDataFrame([("s", 1.0, 3, 0)], TARGET)
    copies, report = mixing.mix(docs(spark, texts, ["s"] * 300), targets, total_tokens=12_000)
    rows = [r for r in copies.collect() if 0 < r["rate"] < 3]
    slope = {round(np.log(r["rate"]) / r["tokens"], 6) for r in rows if r["tokens"] > 5}
    assert len(slope) == 1
    assert report.first()["used_tokens"] == pytest.approx(12_000, rel=0.01)


def test_mixing_nothing(spark):
    targets = spark.createDataFrame([("s", 1.0, 3, 0)], TARGET)
    copies, report = mixing.mix(docs(spark, []), targets)
    assert copies.count() == 0 and [r["used_tokens"] for r in report.collect()] == [0]
    assert mixing.mixing_report(docs(spark, ["a"], ["s"]), targets.limit(0)).count() == 0


# -- 9 ------------------------------------------------------------------------------------------


def _share(x, y, n):
    seen = {x[i : i + n] for i in range(len(x) - n + 1)}
    return any(y[i : i + n] in seen for i in range(len(y) - n + 1))


def _texts(n=40, least=60):
    rnd = random.Random(8)
    letters = "abcde \né漢"
    out = ["".join(rnd.choices(letters, k=rnd.randrange(0, 400))) for _ in range(n)]
    for i in range(n):
        src = rnd.choice(out)
        if len(src) > least + 20:
            at = rnd.randrange(len(src) - least - 5)
            cut = src[at : at + least + rnd.randrange(-3, 5)]
            out.append("".join(rnd.choices(letters, k=rnd.randrange(50))) + cut + "".join(rnd.choices(letters, k=rnd.randrange(50))))
    return [*out, out[1], out[1], "z" * 900, "z" * 700, "", None, "0123456789" * 50]


@pytest.mark.parametrize("least", [60, 61])
def test_sharing_pairs_are_those_of_brute_force(spark, least):
    texts = _texts(least=60)
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and x and y and _share(x, y, least)}
    got = [tuple(r) for r in shared_spans.sharing_pairs(docs(spark, texts), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_slices_of_the_summary_change_nothing(spark, monkeypatch):
    df = docs(spark, _texts())
    want = sorted(map(tuple, shared_spans.sharing_pairs(df, 60).collect()))
    monkeypatch.setattr(shared_spans, "MOST_CELLS", 1000)
    assert sorted(map(tuple, shared_spans.sharing_pairs(df, 60).collect())) == want


def test_shared_share(spark):
    a, b = "".join(random.Random(1).choices("abcdefgh", k=300)), "".join(random.Random(2).choices("abcdefgh", k=300))
    texts = [a, a[:100] + b[:200], b, b, "short", None, a[50:150] + "#" + a[60:160]]
    got = {r["doc_id"]: r for r in shared_spans.shared_share(docs(spark, texts), 80).collect()}
    assert got[0]["shared_chars"] == 160 and got[1]["shared"] == 1.0 and got[2]["copies"] == 2 and got[2]["shared"] == 1.0
    assert got[4]["shared_chars"] == 0 and got[5]["chars"] is None and got[6]["shared_chars"] == 200
    assert shared_spans.sharing_pairs(docs(spark, []), 80).count() == 0
