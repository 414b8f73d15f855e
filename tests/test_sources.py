from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillstream.plans import edition
from quillstream.sources import feeds, pages
from quillstream.sources.store import Store
from quillstream.streaming import editions

FEED = """<rss><channel><item><title>In</title><link>https://a.example/1</link><pubDate>Wed, 12 Aug 2026 10:00:00 GMT</pubDate><description>body</description></item>
<item><title>Out</title><link>https://a.example/2</link><pubDate>Wed, 12 Aug 2020 10:00:00 GMT</pubDate></item><item><title>Undated</title><link>https://a.example/3</link></item>
<item><title>Bad</title><link>/4</link></item><item><title>In too</title><link>https://a.example/5</link><pubDate>2026-08-13T00:00:00Z</pubDate></item></channel></rss>"""
PAGE = """<html><head><title>Site</title><meta property="og:title" content="A  headline"><link rel="canonical" href="https://www.a.example/story"><meta name="author" content="Ann">
<script type="application/ld+json">{"@graph": [{"datePublished": "2026-08-12T10:00:00-03:00"}]}</script></head><body><nav><a href="/x">Menu</a></nav>
<article><h1>A headline</h1><p>First paragraph of a story that is long enough to be the body of this page, with <b>bold text<p>Second one after an unclosed tag.<br>Next line.</p>
<div><a href="/a">Link text that goes on and on</a> <a href="/b">and another link that goes on and on</a></div><ul><li>List line</ul></article><footer>All rights reserved</footer></body></html>"""
W = (datetime(2026, 8, 11, tzinfo=timezone.utc), datetime(2026, 8, 19, tzinfo=timezone.utc))


def test_feeds(spark):
    df = spark.createDataFrame([("s", FEED), ("t", "<broken"), ("u", None)], "source_id string, text string")
    got = feeds.discover(feeds.feed_entries(df), *W).orderBy("position").collect()
    assert [r["title"] for r in got] == ["In", "Undated", "In too"] and got[0]["body"] == "body"
    assert feeds.discover(feeds.feed_entries(df), *W, per_source=1).count() == 1


def test_index_pages(spark):
    text = '<ul><li><time datetime="2026-08-12"></time><a href="/1"> One </a></li><li><a href="/2">Two</a><time>2020-01-01</time></li><li><a href="/1">again</a></li><li><a>none</a></li></ul>'
    df = feeds.index_entries(spark.createDataFrame([("s", "https://a.example/i/", text)], "source_id string, url string, text string"))
    assert [(r["link"], r["title"], r["date_text"]) for r in df.orderBy("position").collect()] == [("https://a.example/1", "One", "2026-08-12"), ("https://a.example/2", "Two", "2020-01-01")]


def test_pages(spark):
    rows = [("s", "https://a.example/story?utm_source=x", PAGE, None, None), ("s", "https://b.example/other", PAGE, None, None), ("s", "https://c.example/", "", "Hint", None)]
    df = pages.extract_articles(spark.createDataFrame(rows, "source_id string, url string, html string, title_hint string, published_at_hint timestamp"))
    a, b, c = df.orderBy("origin_url").collect()
    assert a["canonical_url"] == "https://www.a.example/story" and b["canonical_url"] == "https://b.example/other"
    assert (a["title"], a["author"], a["problem"]) == ("A headline", "Ann", None) and a["published_at"] == datetime(2026, 8, 12, 13)
    assert a["clean_text"].split("\n")[0] == "A headline" and "Menu" not in a["clean_text"] and "Link text" not in a["clean_text"] and "rights" not in a["clean_text"] and "List line" in a["clean_text"]
    assert c["problem"] == "no date"
    links = pages.outbound_links(spark.createDataFrame([("https://a.example/", '<a href="https://b.example/x">1</a><a href="/y">2</a><a href="https://c.example/z.png">3</a><a href="https://t.d.example/">4</a>')], "url string, html string"), ("d.example",))
    assert [r["link"] for r in links.collect()] == ["https://b.example/x"]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, first int")
    assert store.read("t") is None and store.upsert("t", rows(("a", 1, 1), ("b", 1, 1)), ["k"]) == 2
    assert store.upsert("t", rows(("b", 2, 2), ("c", 2, 2)), ["k"], keep=("first",)) == 1
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1, 1), ("b", 2, 1), ("c", 2, 2)]
    for bad in (rows(("a", 1, 1), ("a", 2, 1)), rows((None, 1, 1))):
        with pytest.raises(ValueError):
            store.upsert("t", bad, ["k"])
    store.replace_partition("t", rows(("a", 9, 9)), "k", "a")
    assert store.read("t").where("k = 'a'").first()["v"] == 9
    store.prune("t", 1)
    assert len(store.versions("t")) == 1
    with pytest.raises(PermissionError):
        Store(spark, store.path, read_only=True).upsert("t", rows(("a", 1, 1)), ["k"])


def test_streams(spark, tmp_path):
    day = lambda d: datetime(2026, 8, d)
    src = spark.createDataFrame([("s", "h1", day(10), 1), ("s", "h1", day(11), 2), ("s", "h2", day(17), 3), ("t", "h1", day(12), 4)], "source_id string, content_hash string, published_at timestamp, n int")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    weeks = run(editions.weekly_counts(stream), "complete", "weeks")
    assert sorted((r["week"].day, r["source_id"], r["n"]) for r in weeks.collect()) == [(10, "s", 2), (10, "t", 1), (17, "s", 1)]
    assert run(editions.first_printing(stream), "append", "firsts").count() == 2
    store = Store(spark, f"file://{tmp_path}/db")
    for _ in range(2):  # replayed
        stream.writeStream.foreachBatch(editions.upsert_sink(store, "latest", ["source_id"], "published_at")).trigger(availableNow=True).start().awaitTermination()
    assert {r["source_id"]: r["n"] for r in store.read("latest").collect()} == {"s": 3, "t": 4}


def test_a_first_printing_is_never_forgotten(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/firsts")
    sink = editions.first_printing_sink(store, "firsts", ["content_hash"], "published_at")
    schema = "content_hash string, published_at timestamp, issue string"
    sink(spark.createDataFrame([("h", datetime(2026, 8, 3), "W2"), ("h", datetime(2026, 8, 1), "W1"), (None, datetime(2026, 8, 1), "W0")], schema), 0)
    for _ in range(2):  # replayed, a year later
        sink(spark.createDataFrame([("h", datetime(2027, 8, 3), "W9"), ("k", datetime(2027, 8, 3), "W9")], schema), 1)
    assert sorted(tuple(r) for r in store.read("firsts").select("content_hash", "issue").collect()) == [("h", "W1"), ("k", "W9")]


def test_editions(spark):
    rows = [("e", "b", 1, "a1", "T [x]", "S", "https://a.example/1", datetime(2026, 8, 1), "ok", 80), ("e", "a", 2, "a2", "U", "S", "https://a.example/2", datetime(2026, 8, 1), "see https://x.example", 90), ("e", "b", 3, "a3", "V", "S", "https://a.example/9", datetime(2026, 8, 1), None, 90)]
    items = spark.createDataFrame(rows, "edition_id string, category string, position int, article_id string, title string, source_name string, canonical_url string, published_at timestamp, summary string, final_score int")
    built = edition.build_editions(items.repartition(3), ("b",))
    r = built.first()
    assert r["lead"]["article_id"] == "a2" and [s["category"] for s in r["sections"]] == ["b", "a"] and [i["article_id"] for i in r["sections"][0]["items"]] == ["a1", "a3"]
    assert edition.edition_markdown(built).first()["markdown"].startswith("# e\n\n## b\n\n- [T \\[x\\]](https://a.example/1) — S\n")
    assert '"sections"' in edition.edition_json(built).first()["json"]
    known = items.where("position < 3").select(F.col("canonical_url"))
    assert sorted((x["article_id"], x["problem"]) for x in edition.broken_links(items, known).collect()) == [("a2", "link in prose"), ("a3", "unknown link")]
