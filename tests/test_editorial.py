import gzip
import zlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillstream.functions import dates, text, transfer
from quillstream.operators import editorial, pool, seating, selection
from quillstream.operators.dedupe import best_per_event
from quillstream.sources import ingest, pages

T0 = datetime(2026, 5, 1)


def ask(spark, values, kind, f):
    """f of each value, as a list."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").repartition(2)
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


# -- functions --------------------------------------------------------------------------


def test_titles_of_social_posts(spark):
    titles = ["Grok (@grok) on X", "@some.one on  Threads", "@grok", "Grok (@grok)", "X on Mars lands", None, "(@a) on X today"]
    assert ask(spark, titles, "string", text.is_account_title) == [True, True, False, False, False, None, False]
    quoted = ['Ann on X: "The real story ..."', "Ann on X: “Zwei Dinge.”", "Plain title", 'Ann on X: "..."', None]
    assert ask(spark, quoted, "string", text.unwrap_social_title) == ["The real story", "Zwei Dinge", "Plain title", 'Ann on X: "..."', None]


def test_headlines_from_prose(spark):
    long = "word " * 60
    prose = ["Short.", "One small step. Then another one that is long enough! And a third.", long, "", None]
    got = ask(spark, prose, "string", text.headline_from_prose)
    assert got[:2] == ["Short.", "One small step. Then another one that is long enough!"] and got[3:] == ["", None]
    assert got[2].endswith("word…") and len(got[2]) <= 121


def test_sites_texts_and_keys(spark):
    assert ask(spark, ["www.Twitter.com", "x.com", "support.x.com", "a.b.co.uk", "localhost", None], "string", text.registrable_host) == ["x.com", "x.com", "x.com", "co.uk", "localhost", None]
    assert ask(spark, ["  a\n b ", "see https://x", "<b>x</b>", "a](b", "1 < 2", "", None, "x" * 9], "string", lambda c: text.clean_editorial_text(c, 8)) == ["a b", None, None, None, "1 < 2", None, None, None]
    assert ask(spark, ["a<b & 'c' \"d\"", None], "string", text.html_escape) == ["a&lt;b &amp; &#x27;c&#x27; &quot;d&quot;", None]
    assert ask(spark, [[" a ", None, "", "b"], [], None], "array<string>", lambda c: text.trimmed_facts(c, 1)) == [["a"], [], None]
    one = spark.createDataFrame([(" A ", "b", "C", None), ("", "b", "c", "d"), (None, "b", "c", "d")], "s string, v string, o string, d string")
    assert [r[0] for r in one.select(text.event_fingerprint(F.col("s"), F.col("v"), F.col("o"), F.col("d"))).collect()] == ["a|b|c|", None, None]
    made = one.limit(1).select(text.with_linked_material(F.lit(" t "), F.lit("u"), F.lit(" x \n\n y ")).alias("m")).first()["m"]
    assert made == "t\n\nMaterial linked from this page (u):\n\nx\ny"


def test_dates_in_print_and_in_scripts(spark):
    moment = datetime(2026, 8, 17, 8, 5)
    assert ask(spark, [moment, None], "timestamp", dates.issue_datetime) == ["17 ago 2026, 08:05 UTC", None]
    assert ask(spark, [datetime(2026, 8, 17)], "timestamp", dates.issue_date_end) == ["16 ago 2026"]
    assert ask(spark, ["2026-W33", "2026-W03", "special", None], "string", dates.issue_week_text) == ["Semana 33", "Semana 3", "special", None]
    assert ask(spark, ["/2026-W34/newsletter.html", "/a/b/newsletter.html", "/../newsletter.html", "/x/other.html", "x/newsletter.html", "/x/newsletter.html\n"], "string", dates.issue_label_in) == ["2026-W34", None, None, None, None, None]
    scripts = ['{"publishedOn": "2026-05-02T10:00:00Z", "publishedOn": "2020-01-01"}', '\\"publishedOn\\":\\"2026-05-03\\"', '{"publishedOn": null} {"publishedOn": "2026-05-02"}', '{"publishedOn": "soon"}', "", None]
    got = ask(spark, scripts, "string", lambda c: dates.embedded_date(c, "publishedOn"))
    assert got == [datetime(2026, 5, 2, 10), datetime(2026, 5, 3), None, None, None, None]
    assert spark.range(1).select(dates.window_days(F.lit(T0), F.lit(T0 + timedelta(hours=36)))).first()[0] == 1.5


def test_payloads_are_decoded_and_bounded(spark):
    body = "aé" * 50
    raw = body.encode()
    squeezed = zlib.compressobj(wbits=-15)
    made = [(raw, None, None), (gzip.compress(raw[:60]) + gzip.compress(raw[60:]), "GZIP", "utf-8"), (zlib.compress(raw), "deflate", ""), (squeezed.compress(raw) + squeezed.flush(), "deflate", None), (raw, "br", None), (b"no", "gzip", None), (gzip.compress(b"x" * 5000), "gzip", None), (b"\xff", "identity", "nonsense"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "i int, b binary, e string, c string")
    got = [tuple(r["x"]) for r in df.select("i", transfer.decode_payload(F.col("b"), F.col("e"), F.col("c"), 1000).alias("x")).orderBy("i").collect()]
    assert [g[0] for g in got] == [body, body, body, body, None, None, None, "�", None]
    assert [g[1] is None for g in got] == [True, True, True, True, False, False, False, True, True]


def test_addresses_that_are_not_fetched(spark):
    made = [("https://10.0.0.1/x", None), ("http://[::1]:80/", None), ("https://8.8.8.8/", None), ("https://a.example/", ["8.8.8.8", "127.0.0.1"]), ("https://a.example/", ["8.8.8.8"]), ("https://a.example/", None), ("nothing", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "i int, u string, a array<string>")
    got = [r["x"] for r in df.select("i", transfer.private_host_reason(F.col("u"), F.col("a")).alias("x")).orderBy("i").collect()]
    assert [g is None for g in got] == [False, False, True, False, True, False, False]
    assert ask(spark, ["https://a.b.example/", "https://xb.example/", "https://B.example"], "string", lambda c: transfer.blocked_host(c, (".b.example", " "))) == [True, False, True]
    problems = ask(spark, ["https://ok.example/", "http://ok.example/", "ftp://x", "https://sub.bad.example/", None], "string", lambda c: ingest.submitted_url_problem(c, ("bad.example",)))
    assert problems == [None, "not https", "not a public url", "blocked host", "not a public url"]


def test_database_urls(spark):
    urls = ["postgresql+psycopg://ann:secret@db:5432/x", "postgres://db/x", "sqlite:///file.db", "sqlite:///", "mysql://x", "plain", None]
    assert ask(spark, urls, "string", transfer.redact_dsn)[:3] == ["postgresql://ann:***@db:5432/x", "postgres://db/x", "sqlite:///file.db"]
    assert ask(spark, urls, "string", transfer.valid_dsn) == ["postgresql://ann:secret@db:5432/x", "postgresql://db/x", "sqlite:///file.db", None, None, None, None]
    assert ask(spark, ["SQLite3://a"], "string", lambda c: transfer.split_dsn(c)["scheme"]) == ["sqlite3"]


# -- assessments and edited texts ------------------------------------------------------------


def test_rubric_and_quarantine(spark):
    base = {"topic_relevance": 5, "business_impact": 0, "novelty": 1, "actionability": 2, "confidence": 0.5, "summary": " s ", "why_it_matters": "w", "key_facts": [" f ", ""], "event_subject": " ", "event_action": "a", "event_object": "o", "event_date": None}
    broken = [("novelty", 6), ("actionability", None), ("confidence", 1.5), ("summary", " "), ("why_it_matters", None)]
    rows = [tuple(base.values())] + [tuple((base | {k: v}).values()) for k, v in broken]
    df = spark.createDataFrame(rows, "topic_relevance int, business_impact int, novelty int, actionability int, confidence double, summary string, why_it_matters string, key_facts array<string>, event_subject string, event_action string, event_object string, event_date string")
    good, bad = editorial.quarantine(df)
    assert [(r["summary"], r["key_facts"], r["event_subject"]) for r in good.collect()] == [("s", ["f"], None)]
    assert sorted(r["problem"] for r in bad.collect()) == sorted(k for k, _ in broken)


def test_polish_is_used_once_and_only_if_clean(spark):
    edited = spark.createDataFrame([("e", 1, "a", "Good", "see https://x"), ("e", 2, "a", "Again", "w"), ("e", 3, "b", "<b>no</b>", ""), ("e", 4, "z", "Unknown", "w")], "edition_id string, position int, article_id string, headline string, why_it_matters string")
    items = spark.createDataFrame([("e", "a", "A", "x"), ("e", "b", "B", "y")], "edition_id string, article_id string, title string, why_it_matters string")
    usable = editorial.usable_polish(edited, items)
    assert [tuple(r) for r in usable.collect()] == [("e", "a", "Good", None)]
    assert sorted((r["article_id"], r["title"], r["why_it_matters"]) for r in editorial.polish(items, usable).collect()) == [("a", "Good", "x"), ("b", "B", "y")]


# -- line-ups ---------------------------------------------------------------------------------------

ROW = "edition_id string, article_id string, source_id string, category string, final_score int, published_at timestamp, printed_in string, event_key string, title string, text string"


def _rows(spark, made):
    return spark.createDataFrame([("e", a, s, c, n, T0, p, k, "", None) for a, s, c, n, p, k in made], ROW)


def test_a_line_up_as_a_whole(spark):
    made = [("a", "s1", "x", 95, "2026-W01", "k1"), ("b", "s2", "x", 90, None, "k1"), ("c", "s3", "x", 85, None, "k1"), ("d", "own", "y", 70, None, "k1"), ("e", "s4", "y", 80, None, None), ("f", "s5", "other", 99, None, None), ("g", "s6", "y", 10, None, None), ("h", "s7", "x", None, None, None)]
    got = {r["article_id"]: (r["outcome"], r["position"], r["detail"]) for r in selection.select_lineups(_rows(spark, made), seating.Policy(max_items=3, min_score=60), None).collect()}
    assert got["a"] == ("already_published", None, "2026-W01") and got["b"] == ("earned", 1, None) and got["c"][0] == got["d"][0] == "duplicate_event"
    assert got["e"] == ("earned", 2, None) and got["f"][0] == "excluded_category" and got["g"][0] == got["h"][0] == "below_threshold" and len(got) == len(made)
    mine = seating.Policy(max_items=3, min_score=60, reserved_source="own")
    first = {r["article_id"]: (r["outcome"], r["position"]) for r in selection.select_lineups(_rows(spark, made), mine, None).collect()}
    assert first["d"] == ("reserved", 1) and first["b"][0] == "duplicate_event" and first["e"] == ("earned", 2)
    summary = selection.lineup_summary(_rows(spark, made), selection.select_lineups(_rows(spark, made), mine, None), mine).first()
    assert (summary["candidates"], summary["above_threshold"], summary["selected"], summary["reserved"], summary["items_short"], summary["full"]) == (8, 2, 2, 1, 0, False)


def test_similar_reports_are_folded_into_the_best(spark):
    story = " ".join(f"word{i}" for i in range(60))
    made = [("e", a, a, "x", n, T0, None, None, "t", t) for a, n, t in (("a", 70, story), ("b", 90, story + " more"), ("c", 80, " ".join(f"else{i}" for i in range(60))), ("d", 10, story))]
    got = {r["article_id"]: (r["outcome"], r["detail"]) for r in selection.select_lineups(spark.createDataFrame(made, ROW), seating.Policy(min_score=60)).collect()}
    assert got == {"a": ("similar_event", "b"), "b": ("earned", None), "c": ("earned", None), "d": ("below_threshold", None)}


def test_floors_name_what_they_cost(spark):
    made = [(f"a{i}", f"s{i}", "x", 90 - i, None, None) for i in range(4)] + [("own1", "t1", "y", 70, None, None), ("own2", "t2", "y", 65, None, None)]
    policy = seating.Policy(max_items=4, min_score=60, floors=(("beat", ("y",), 2),))
    got = {r["article_id"]: (r["outcome"], r["detail"]) for r in selection.select_lineups(_rows(spark, made), policy, None).collect()}
    assert got["a2"] == ("coverage_floor", "own1") and got["a3"] == ("coverage_floor", "own2") and got["own1"][0] == "floor:beat" and got["a0"] == ("earned", None)


def test_unsupported_rows_give_up_their_place(spark):
    lineups = spark.createDataFrame([("e", "a", "earned", 1, 0, None), ("e", "b", "earned", 2, 0, None), ("e", "c", "max_items", None, 0, None)], "edition_id string, article_id string, outcome string, position int, steps int, detail string")
    found = spark.createDataFrame([("e", "a", "summary", "UTube"), ("e", "a", "key_facts", "X9"), ("e", "c", "summary", "Y9")], "edition_id string, article_id string, field string, token string")
    got = {r["article_id"]: (r["outcome"], r["position"], r["detail"]) for r in selection.drop_unsupported(lineups, found).collect()}
    assert got == {"a": ("unsupported_entity", None, "key_facts says 'X9'; summary says 'UTube'"), "b": ("earned", 1, None), "c": ("max_items", None, None)}


def test_best_of_a_hot_event(spark):
    rows = spark.createDataFrame([(f"{i:04}", "hot" if i % 3 else f"k{i}", i) for i in range(600)] + [("none", None, 1)], "article_id string, event_key string, n int").repartition(5)
    kept = {r["article_id"] for r in best_per_event(rows, "event_key", [F.col("n").desc(), F.col("article_id")]).where("kept").collect()}
    assert kept == {"none", "0599" if 599 % 3 else "0598"} | {f"{i:04}" for i in range(0, 600, 3)}
    assert best_per_event(rows.limit(0), "event_key", [F.col("n")]).count() == 0


# -- pools and ingest ----------------------------------------------------------------------------------


def test_printed_items_and_issues(spark):
    items = spark.createDataFrame([("e1", "a", 1), ("e2", "a", 1), ("e3", "b", 2)], "edition_id string, article_id string, position int")
    editions = spark.createDataFrame([("e1", None, 1), ("e2", "W2", 2), ("e3", "W3", 3)], "edition_id string, issue_label string, generated_at int")
    articles = spark.createDataFrame([("a", "h")], "article_id string, content_hash string")
    assert sorted((r["article_id"], r["issue"], r["content_hash"]) for r in pool.printed_items(items, articles, editions, "W3").collect()) == [("a", "W2", "h"), ("a", "e1", "h")]
    both = pool.known_issues(spark.createDataFrame([("W1", 1)], "issue string, started int"), spark.createDataFrame([("W1", 9), ("W2", 2)], "issue string, started int"))
    assert sorted(tuple(r) for r in both.collect()) == [("W1", 1), ("W2", 2)]


def test_ingest_keeps_failures_as_rows(spark):
    sources = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), ("x", True)], "id string, enabled boolean")
    rows = spark.createDataFrame([("a", None), ("a", "no date"), ("b", None), ("d", None)], "source_id string, problem string")
    failures = spark.createDataFrame([("x", "timeout")], "source_id string, error string")
    got = {r["source_id"]: (r["found"], r["ingested"], r["failed"], r["status"]) for r in ingest.source_outcomes(sources, rows, failures).collect()}
    assert got == {"a": (2, 1, 1, "partial"), "b": (1, 1, 0, "ok"), "c": (0, 0, 0, "empty"), "x": (0, 0, 0, "failed")}
    good, bad = ingest.split_outcome(rows)
    assert good.columns == ["source_id"] and good.count() == 3 and bad.count() == 1
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "source_id string, position int")
    assert ingest.limit_per_source(found, spark.createDataFrame([("a", 1), ("b", None)], "source_id string, max_items int")).count() == 2


def test_thin_pages_follow_their_first_useful_link(spark):
    page = spark.createDataFrame([("u", "short"), ("v", "long enough text"), ("w", None)], "url string, text string")
    links = spark.createDataFrame([("u", 1, "l1"), ("u", 2, "l2"), ("v", 1, "l2"), ("w", 1, "l1")], "url string, position int, link string")
    linked = spark.createDataFrame([("l1", "tiny"), ("l2", "a text that is long")], "link string, text string")
    got = {r["url"]: (r["linked_url"], r["linked_text"]) for r in ingest.follow_links(page, links, linked, 10).collect()}
    assert got == {"u": ("l2", "a text that is long"), "v": (None, None), "w": (None, None)}


def test_matches_chains_and_queues(spark):
    articles = spark.createDataFrame([("a1", "https://o.example/1", "https://www.c.example/1/", 1), ("a2", None, "https://c.example/1", 2)], "article_id string, origin_url string, canonical_url string, retrieved_at int")
    proposed = spark.createDataFrame([("https://c.example/1?utm_source=x",), ("https://o.example/1",), ("https://n.example/",)], "url string")
    assert {r["url"][:17]: r["article_id"] for r in ingest.match_by_url(proposed, articles).collect()} == {"https://c.example": "a2", "https://o.example": "a1", "https://n.example": None}
    items = spark.createDataFrame([("e1", "a1"), ("e2", "a1"), ("e1", "a9"), ("e1", "a3")], "edition_id string, article_id string")
    held = spark.createDataFrame([("a1", "s"), ("a3", "gone")], "article_id string, source_id string")
    broken = ingest.traceability(items, items.where("edition_id = 'e1'"), held, spark.createDataFrame([("s",)], "id string"))
    assert sorted(tuple(r) for r in broken.collect()) == [("e1", "a3", "source"), ("e1", "a9", "article"), ("e2", "a1", "edition")]
    queue = spark.createDataFrame([("1", "pending", 3), ("2", "pending", 1), ("3", "used", 0), ("4", "pending", 1)], "submission_id string, status string, submitted_at int")
    assert [r["submission_id"] for r in ingest.oldest_first(queue, "pending", 2).collect()] == ["2", "4"]


def test_a_page_that_names_only_its_account(spark):
    html = '<html><head><meta property="og:title" content="Grok (@grok) on X"><meta name="description" content="A long post about a new model that everyone may use today. More follows."></head><body><article><p>' + "Text of the post that is long enough. " * 8 + '</p></article><script>self.push("{\\"firstPublished\\":\\"2026-05-02T09:00:00Z\\"}")</script></body></html>'
    df = spark.createDataFrame([("s", "https://x.com/1", html, None, None)], "source_id string, url string, html string, title_hint string, published_at_hint timestamp")
    r = pages.extract_articles(df, "firstPublished").first()
    assert r["title"] == "A long post about a new model that everyone may use today." and r["published_at"] == datetime(2026, 5, 2, 9) and r["problem"] is None
