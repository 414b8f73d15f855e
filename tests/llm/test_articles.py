"""Problems 1 to 4, which read articles."""

import random
import re
import time
import zlib

import numpy as np

from quillstream import runtime
from quillstream.llm import history, near_duplicates, packed, page_content, repeated_lines
from tests.llm.conftest import payload

WORD = re.compile(r"[^\W_]+")


def shingles(title, body):
    w = WORD.findall(((title or "") + "\n" + body).lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def alike(a, b):
    return bool(a | b) and 2 * len(a & b) >= len(a | b)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- 1 ------------------------------------------------------------------------------


def test_repeated_lines(articles):
    made = [{"body": f"Share THIS ({i})!\nStory {'abc'[i % 3] * (i + 1)}\n\n—"} for i in range(9)]
    made += [{"body": "share this", "source_id": "other"}, {"body": "share this", "source_id": None}, {"payload": None}, {"payload": '{"clean_text": "share th'}, {"body": None}, {"body": ""}]
    df = articles(made)
    assert rows(repeated_lines.repeated_lines(df).select("article_id", "line_no")) == [(f"a{i:03}", 1) for i in range(9)]
    clean = {r["article_id"]: r["clean_text"] for r in repeated_lines.without_repeated_lines(df).collect()}
    assert clean["a001"] == "Story bb\n\n—" and clean["a009"] == "share this" and clean["a014"] == "" and "a011" not in clean


def test_an_article_saved_again_counts_once(articles):
    made = [{"body": "same line\nsame line"} for _ in range(7)] + [{"article_id": "a000", "body": "same line"}, {"article_id": "a001", "payload": "{cut"}]
    assert repeated_lines.repeated_lines(articles(made)).count() == 0
    found = rows(repeated_lines.repeated_lines(articles([*made, {"body": "SAME line"}])).select("article_id", "line_no"))
    assert ("a000", 1) in found and ("a000", 2) not in found and ("a001", 2) in found


def test_no_articles_at_all(articles):
    none = articles([])
    assert repeated_lines.repeated_lines(none).count() == 0
    assert repeated_lines.without_repeated_lines(none).count() == 0
    assert page_content.furniture_lines(none).count() == 0
    assert near_duplicates.alike_pairs(none).count() == 0


# -- 3 ---------------------------------------------------------------------------------


def test_minimum_cut_is_a_minimum():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        n = int(rnd.integers(1, 9))
        odds = rnd.normal(0, 2, n)
        edges = [(i, j, float(rnd.uniform(0, 1.5))) for i in range(n) for j in range(i + 1, min(n, i + 3))]

        def cost(label):
            return sum(max(-odds[i], 0) if label[i] else max(odds[i], 0) for i in range(n)) + sum(w for i, j, w in edges if label[i] != label[j])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(page_content.minimum_cut(odds, edges)) - best) < 1e-9


def _word(*seed):
    rnd = random.Random(str(seed))
    return "".join(rnd.choices("abdefgiklmnoprstu", k=8))


def _title(i):
    return f"{_word(i).capitalize()} plans a larger {_word(i, 'thing')}"


def _page(i):
    story = [f"The {_word(i, k)} of {_word(i, k, 1)} approved the {_word(i, k, 2)} budget after a long debate about the {_word(i, k, 3)} costs." for k in range(3)]
    return "\n".join(["Home | News | Sport | Contact", "Accept all cookies", f"By Ann {_word(i, 'w')}", story[0], "Advertisement", story[1], "", f"- {_word(i, 'l')}: {i + 3} seats", story[2], "Latest stories", _title(i + 1), "© 2026 Daily. All rights reserved."])


def test_furniture_is_told_from_story(articles):
    made = [{"title": _title(i), "body": _page(i)} for i in range(30)] + [{"title": None, "body": "\n \n"}, {"payload": "x"}]
    labels = {(r["article_id"], r["line_no"]): r["furniture"] for r in page_content.label_lines(articles(made)).collect()}
    want = {1: True, 2: True, 4: False, 5: True, 6: False, 7: None, 8: False, 9: False, 10: True, 11: True, 12: True}
    for i in range(29):
        assert {n: labels.get((f"a{i:03}", n)) for n in want} == want
    assert not any(k[0] == "a030" for k in labels)


def test_long_page_and_saved_again(articles):
    long = "\n".join(f"Line {i} of a very long page that goes on and on without an end in sight." for i in range(3000))
    df = articles([{"title": "Long", "body": long}, {"article_id": "a000", "title": "Long", "body": "Only this line is left of the page after it was edited."}])
    assert rows(page_content.label_lines(df).select("article_id", "line_no")) == [("a000", 1)]


def test_counts_stay_exact_with_many_different_lines(articles):
    # 40,000 different lines: far more keys than a summary sized by the number of pages has cells.
    made = [{"title": _title(i), "body": _page(i)} for i in range(20)]
    made += [{"title": _title((i, "long")), "body": "\n".join(f"The {_word(i, k, 'x')} of {_word(i, k, 'y')} met a {_word(i, k, 'z')} in {_word(i, k, 'u')} to talk {_word(i, k, 'v')}." for k in range(400))} for i in range(100)]
    wrong = page_content.label_lines(articles(made)).where("furniture AND article_id >= 'a020'").count()
    assert wrong == 0


def test_counts_of_lines_are_those_of_brute_force(articles):
    rnd = random.Random(5)
    long = "A long paragraph about the budget that goes on for more than sixty letters without a stop."
    made = [{"title": f"Line {_word(i % 7)}", "source_id": f"s{i % 2}", "body": "\n".join(rnd.choice([long, *(f"line {_word(k)}" for k in range(9)), f"only {_word(i, 'o')}"]) for _ in range(6))} for i in range(20)]
    made += [{**made[3], "article_id": "a003"}, {"article_id": "a004", "title": "x", "source_id": "s0", "body": "alone here"}]
    latest = {r.get("article_id", f"a{i:03}"): r for i, r in enumerate(made)}
    want = {}
    for a, r in latest.items():
        for no, line in enumerate(r["body"].split("\n"), 1):
            holders = [x for x in latest.values() if line in x["body"].split("\n")]
            led = [x for x in holders if any(p == long and q == line for p, q in zip(x["body"].split("\n"), x["body"].split("\n")[1:]))]
            titles = {x["title"].lower() for x in latest.values()} - {r["title"].lower()}
            want[a, no] = (sum(x["source_id"] == r["source_id"] for x in holders), len(holders), line.lower() in titles, len(led) / len(holders))
    df = articles(made)
    texts = page_content.article_texts(df)
    table = page_content._with_counts(page_content.latest_only(texts), page_content.line_counts(texts)).toArrow()
    got = {}
    for batch in table.combine_chunks().to_batches():
        for r, kept, (_, _, _, own, everywhere, other, _, led, _, _) in page_content._pages(batch):
            for i, k in enumerate(kept):
                got[batch.column("article_id")[r].as_py(), k + 1] = (own[i], everywhere[i], other[i], led[i])
    assert got == want and any(w[2] for w in want.values()) and any(0 < w[3] < 1 for w in want.values())


def test_a_long_notice_of_a_small_source_is_told_by_its_words(articles):
    def talk(i):
        return f"The {_word(i, 5)} of {_word(i, 6)} defended the {_word(i, 7)} plan before the council on Monday, and {_word(i, 8)} officials said that the {_word(i, 9)} works would go on until the {_word(i, 2)} bridge is finished."

    often = "We and our partners store cookies on your device to measure how this site is used, and by going on you consent to our privacy terms, which you may change in your preferences at any time you like."
    once = "Our partners store cookies to measure how you use this site, so please read the privacy terms and change your preferences on your device whenever you like, since going on means that you consent to our use of them."
    made = [{"title": _title(i), "body": f"{_page(i)}\n{talk(i)}\n{often}"} for i in range(30)]
    made += [{"title": _title((i, "few")), "source_id": "few", "body": f"{talk((i, 'a'))}\n{talk((i, 'b'))}\n{once}"} for i in range(2)]
    labels = {(r["article_id"], r["line_no"]): r["furniture"] for r in page_content.label_lines(articles(made)).collect()}
    assert len(once) > 150
    for a in ("a030", "a031"):
        assert [labels[a, n] for n in (1, 2, 3)] == [False, False, True]


def _made_pages(n):
    rnd = random.Random(8)
    out = []
    for i in range(n):
        lines = [line for line in _page(i).split("\n") if line.strip()]
        lines += rnd.sample([_title(i), "12.3.2026", "1) Totals: A | B | 3 %", "…", "ΟΔΟΣ ΣΟΦΟΣ x² 3½", "Cookie cookie privacy Cookie", "(c) Daily", "İstanbul ǅ naïve"], i % 9)
        m = len(lines)
        own, everywhere = (np.array([rnd.choice((1, 2, 5, 9, 30)) for _ in lines]) for _ in range(2))
        other, tail = (np.array([rnd.random() < 0.2 for _ in lines]) for _ in range(2))
        out.append((lines, _title(i), "The Daily", own, everywhere, other, tail, np.array([rnd.random() for _ in lines]), np.array([rnd.random() for _ in lines]), 30))
    return out


def test_pages_read_together_are_read_as_each_alone():
    pages = _made_pages(60)
    weights = np.random.default_rng(4).normal(0, 0.5, len(page_content.DENSE) + page_content.BUCKETS)
    x, tokens, rules = page_content.page_features(pages)
    odds = page_content.line_costs(weights, x, tokens)
    side = page_content.cut_pages(odds, x, [len(p[0]) for p in pages])
    lines = [line for p in pages for line in p[0]]
    assert len(x) == len(rules) == len(odds) == len(lines)
    for i, line in enumerate(lines):
        w = re.findall(r"[^\W\d_]+", line.lower())
        marked = {*w, "^" + w[0], "$" + w[-1]} if w else set()
        assert tokens[1][tokens[0] == i].tolist() == sorted({zlib.crc32(t.encode()) % page_content.BUCKETS for t in marked})
    at = 0
    for page in pages:
        x1, tokens1, rules1 = page_content.page_features([page])
        odds1 = page_content.line_costs(weights, x1, tokens1)
        mine = slice(at, at + len(page[0]))
        assert (x1 == x[mine]).all() and (rules1 == rules[mine]).all() and (odds1 == odds[mine]).all()
        assert (page_content.minimum_cut(odds1, page_content.page_edges(x1)) == side[mine]).all()
        at = mine.stop
    assert 0 < side.sum() < len(side) and {-1, 0, 1} == set(rules.tolist())


def test_a_page_costs_little_more_than_finding_its_words():
    # These pages took 17 times the time of finding their words when each was read line by line, and take 6.
    pages = _made_pages(2000)
    weights = np.ones(len(page_content.DENSE) + page_content.BUCKETS)

    def label():
        for group in page_content._groups(pages):
            x, tokens, _ = page_content.page_features(group, rules_too=False)
            page_content.cut_pages(9 * page_content.line_costs(weights, x, tokens), x, [len(p[0]) for p in group])

    def find():
        for page in pages:
            for line in page[0]:
                WORD.findall(line.lower())

    def least(step):
        out = []
        for _ in range(3):
            begin = time.process_time()
            step()
            out.append(time.process_time() - begin)
        return min(out)

    assert least(label) < 11 * least(find)


# -- 4 -------------------------------------------------------------------------------------


def test_alike_pairs_are_those_of_brute_force(articles, texts):
    bodies = [*texts(120), "", "one two", "one two three", "one two three", "One, two: three", "one two three four", "x " * 500, "y " * 500]
    made = [{"title": ["", None, "T"][i % 3], "body": b} for i, b in enumerate(bodies)] + [{"payload": None}, {"article_id": "a000", "body": bodies[0], "title": ""}]
    sets = {f"a{i:03}": shingles(r["title"], r["body"]) for i, r in enumerate(made[: len(bodies)])}
    want = sorted((a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b]))
    assert len(want) > 50
    assert rows(near_duplicates.alike_pairs(articles(made))) == want


def test_light_and_heavy_routes_agree(articles, texts):
    frame = near_duplicates.text_frame(articles([{"body": b} for b in texts(60, words=12, edits=1, seed=4)]))
    found = [{tuple(r) for r in near_duplicates.alike_classes(frame, light=light)[1].select("a", "b").collect()} for light in (0, 5, 1000)]
    assert found[0] == found[1] == found[2] and found[0]


def test_rows_do_not_depend_on_the_bound_of_the_order(articles, texts):
    frame = near_duplicates.text_frame(articles([{"body": b} for b in texts(90, seed=21)]))
    # 2 ** 13 bits hold far fewer elements than stand in two texts, as a far larger input would have it.
    found = [{tuple(r) for r in near_duplicates.alike_classes(frame, bits=bits)[1].select("a", "b", "common").collect()} for bits in (1 << 13, None)]
    assert found[0] == found[1] and found[0]


def test_packed_columns_and_sets_come_back():
    rnd = np.random.default_rng(2)
    key, value = np.sort(rnd.integers(0, 1 << 40, 999).astype(np.uint64)), rnd.integers(0, 300, 999).astype(np.uint64)
    assert all((a == b).all() for a, b in zip(packed.unpack(packed.pack(key, value)), (key, value)))
    size = np.array([0, 3, 0, 5, 1, 0])
    h = np.concatenate([np.sort(rnd.integers(0, 1 << 48, n).astype(np.uint64)) for n in size])
    row, got, n = packed.unpack_sets(packed.pack_sets(h, size).slice(2, 3))
    assert (got == h[3:]).all() and n.tolist() == [0, 5, 1] and row.tolist() == [1] * 5 + [2]


def test_groups_report_copies_and_links(articles):
    body = " ".join(f"w{i}" for i in range(40))
    got = {r["article_id"]: (r["copies"], r["links"]) for r in near_duplicates.alike_groups(articles([{"body": body}, {"body": body.upper()}, {"body": body + " more"}, {"body": "z " * 9}])).collect()}
    assert got == {"a000": (2, 1), "a001": (2, 1), "a002": (1, 1), "a003": (1, 0)}


# -- 2 -----------------------------------------------------------------------------------------

RECORD = "record_id long, batch_no int, article_id string, canonical_url string, title string, content_hash string, payload string, id string, rank int, key string"


def _records(spark, made):
    return spark.createDataFrame([(r.get("record_id"), r.get("batch_no", 1), r.get("article_id"), r.get("url"), r.get("title"), r.get("hash"), r.get("payload", payload(r["body"]) if "body" in r else None), "clash", 1, "clash") for r in made], RECORD)


def _brute(old, new):
    accepted = [(r.get("article_id"), r.get("hash"), r.get("url"), shingles(r.get("title"), r.get("body") or "")) for r in old]
    held = []
    for r in sorted(new, key=lambda r: (r.get("batch_no", 1), r["record_id"])):
        me = (r.get("article_id"), r.get("hash"), r.get("url"), shingles(r.get("title"), r.get("body") or ""))
        if any((me[0] and me[0] == a[0]) or (me[1] and a[1] and me[1].lower() == a[1].lower()) or (me[2] and me[2] == a[2]) or alike(me[3], a[3]) for a in accepted):
            held.append(r["record_id"])
        else:
            accepted.append(me)
    return sorted(held)


def test_held_records_are_those_of_brute_force(spark, articles, texts):
    bodies = texts(150, seed=9)
    old = [{"article_id": f"a{i:03}", "hash": f"h{i}", "url": f"https://e.example/{i}", "title": "", "body": b} for i, b in enumerate(bodies[:60])]
    new = []
    for i, b in enumerate(bodies[60:]):
        new.append({"record_id": i, "batch_no": 1 + (i * 7) % 4, "article_id": f"b{i % 80}", "hash": [None, f"H{i % 70}", ""][i % 3], "url": [f"https://e.example/n{i % 60}", None][i % 2], "body": b})
    want = _brute(old, new)
    df = _records(spark, [*new, {"record_id": None, "body": "ignored"}])
    got = history.held_records(articles(old), df).where("held").collect()
    assert sorted(r["record_id"] for r in got) == want and 10 < len(want) < 85


def test_batches_in_turn_agree_with_all_at_once(spark, articles, texts, tmp_path):
    bodies = texts(80, seed=12)
    old = articles([{"hash": f"h{i}", "body": b} for i, b in enumerate(bodies[:30])])
    new = [{"record_id": i, "batch_no": i // 20, "article_id": f"n{i}", "body": b} for i, b in enumerate(bodies[30:])]
    once = {r["record_id"]: r["held"] for r in history.held_records(old, _records(spark, new)).collect()}
    store = history.History.create(old, f"file://{tmp_path}/store")
    turns = {}
    for k in range(3):
        again = history.History(spark, store.path)  # as a later run would open it
        turns |= {r["record_id"]: r["held"] for r in again.accept(_records(spark, [r for r in new if r["batch_no"] == k])).collect()}
    assert turns == once and set(once.values()) == {True, False}


def test_a_batch_is_appended_once_and_a_broken_attempt_is_never_read(spark, articles, texts, tmp_path):
    bodies = texts(30, seed=13)
    store = history.History.create(articles([{"body": b} for b in bodies[:5]]), f"file://{tmp_path}/once")
    batch = _records(spark, [{"record_id": 1, "article_id": "n1", "body": "a b c d e f"}])
    broken = batch.selectExpr("record_id AS id", "article_id", "content_hash", "canonical_url")
    store._add_keys(history._identity_keys(broken), store._attempt())  # no commit follows
    assert rows(store.check(batch)) == [(1, False)]
    store.append(batch, "first")
    store.append(_records(spark, [{"record_id": 2, "article_id": "n2", "body": "g h i j k l"}]), "first")
    assert rows(store.check(batch)) == [(1, True)]
    assert rows(store.check(_records(spark, [{"record_id": 3, "article_id": "n2"}]))) == [(3, False)]


def test_records_without_anything_and_empty_tables(spark, articles):
    new = [{"record_id": 1}, {"record_id": 2}, {"record_id": 3, "url": "not a url"}, {"record_id": 4, "url": "not a url", "payload": "{"}]
    assert rows(history.held_records(articles([]), _records(spark, new))) == [(i, False) for i in (1, 2, 3, 4)]
    assert history.held_records(articles([{"body": "a b c d"}]), _records(spark, [])).count() == 0


def test_meetings_in_slices_give_the_same_rows_and_store_pairs_only(spark, articles, texts, monkeypatch):
    bodies = texts(150, seed=9)
    old = [{"article_id": f"a{i:03}", "title": "", "body": b} for i, b in enumerate(bodies[:60])]
    new = [{"record_id": i, "batch_no": 1 + i % 4, "article_id": f"b{i}", "body": b} for i, b in enumerate(bodies[60:])]
    monkeypatch.setattr(history, "LEAST_MET", 1)
    monkeypatch.setattr(history, "PER_ENTRY", 1)
    app = spark.sparkContext.applicationId
    before = len(runtime._tables.get(app, []))
    got = history.held_records(articles(old), _records(spark, new)).where("held").collect()
    assert sorted(r["record_id"] for r in got) == _brute(old, new)
    met = [spark.read.parquet(p) for p in runtime._tables[app][before:] if "/p2-met-" in p]
    # Pairs of two records, from several slices; what met too seldom is nowhere stored.
    assert len(met) > 1 and all(sorted(df.columns) == ["a", "b", "old"] for df in met)
    pairs = [tuple(r) for df in met for r in df.collect()]
    assert len(pairs) == len(set(pairs)) and {True, False} == {p[2] for p in pairs}


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    def files():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    before = files()
    stored = runtime.materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "k")
    until = time.time() + 10  # files are removed in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and stored.count() == 7
