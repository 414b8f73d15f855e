from datetime import datetime, timezone
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import functions as F

from quillstream.functions import dates, text, urls


def one(spark, values, f, schema="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {schema}").select(f(F.col("v"))).collect()]


def _key(u):
    """The comparison key by the standard library."""
    try:
        p = urlsplit((u or "").strip())
        host = (p.hostname or "").lower()
        if p.scheme.lower() not in ("http", "https") or not host:
            return None
        net = f"[{host}]" if ":" in host else host
        if p.port is not None and p.port != {"http": 80, "https": 443}[p.scheme.lower()]:
            net += f":{p.port}"
        if p.username:
            net = p.username + (f":{p.password}" if p.password else "") + "@" + net
    except ValueError:
        return None
    path, tail = p.path, p.path.rsplit("/", 1)[-1]
    if tail.lower() in urls.INDEX_FILES:
        path = path[: -len(tail)]
    kept = sorted((a, b) for a, b in parse_qsl(p.query, keep_blank_values=True) if a.lower() not in urls.TRACKING_PARAMS and not a.lower().startswith(urls.TRACKING_PREFIXES))
    return urlunsplit((p.scheme.lower(), net.removeprefix("www."), path.rstrip("/"), urlencode(kept), ""))


def test_dedupe_key_agrees_with_the_standard_library(spark):
    cases = ["https://A.example/x?b=2&a=1&utm_source=q#f", "http://a.example:80/x/", "https://user:pw@www.a.example:8443/p/index.html", "https://[::1]:443/z", "ftp://a/b", "https:///x", "", "  https://a.example/É?q=a+b&flag&x=~*%7E%zz&&y=", "https://a.example?trkCampaign=1&at_x=3", "https://www.a.example/INDEX.PHP", "https://a.example:99999/", "https://a.example:/", "https://a.example/a//", "HTTPS://WWW.A.EXAMPLE/News/", "https://a.example/x?q=%C3%A9", "not a url", None, "https://a.example/x?", "https://u@h.example/p;a=1?z=1&Z=2", "//a.example/x", "https://a.example/xindex.html"]
    assert one(spark, cases, urls.dedupe_key) == [_key(c) for c in cases]


def test_same_site(spark):
    rows = [("https://www.a.example/x", "http://a.example/y", True), ("https://a.example", "https://b.example", False), (None, "https://a.example", False), ("x", "x", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(urls.same_site(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_dates_are_never_invented(spark):
    cases = {"2026-08-17T10:00:00-03:00": "2026-08-17 13:00:00", "2026-08-17": "2026-08-17 00:00:00", "2026-08-17 10:00:00 EST": "2026-08-17 10:00:00", "Mon, 17 Aug 2026 10:00:00 GMT": "2026-08-17 10:00:00", "17 Aug 2026 10:00 -0300": "2026-08-17 13:00:00", "2026-08-17T10:00:00.123456Z": "2026-08-17 10:00:00.123456", "2026-08": None, "T10:00": None, "yesterday": None, "": None, "2026-13-45": None, "now": None}
    got = one(spark, list(cases), lambda c: dates.parse_datetime(c).cast("string"))
    assert got == list(cases.values())


def test_windows_are_half_open(spark):
    a, b = dates.rolling_window(datetime(2026, 8, 19, 15, tzinfo=timezone.utc), 7, "America/Argentina/Buenos_Aires", completed_days=True)
    assert (a.isoformat(), b.isoformat()) == ("2026-08-12T00:00:00-03:00", "2026-08-19T00:00:00-03:00")
    assert dates.calendar_window(datetime(2026, 8, 1), datetime(2026, 8, 1))[1].day == 2
    df = spark.createDataFrame([(a,), (b,), (None,)], "t timestamp")
    assert [r[0] for r in df.select(dates.in_window(F.col("t"), a, b)).collect()] == [True, False, False]
    ends = spark.createDataFrame([(datetime(2026, 1, 5),), (datetime(2025, 12, 29),), (datetime(2027, 1, 1),)], "t timestamp")
    assert [r[0] for r in ends.select(dates.issue_label(F.col("t"))).collect()] == ["2026-W01", "2025-W52", "2026-W53"]


def test_texts(spark):
    assert one(spark, ["  Héllo, World_1!! ", "—", None], text.normalize_title) == ["héllo world_1", "", None]
    assert one(spark, ["The Éclair Ltd.", "the", "An A-Team", "Straße"], text.normalize_entity) == ["eclair ltd", "", "a team".removeprefix("a "), "strasse"]
    assert one(spark, [" a\t b \r\n\n c ", ""], text.normalize_text) == ["a b\nc", ""]
    assert one(spark, ["a[b]*|`_\\"], text.markdown_escape) == ["a\\[b\\]\\*\\|\\`\\_\\\\"]
    assert one(spark, ["aaaa\nbbbb\ncccc", "short", "x" * 20], lambda c: text.truncate_text(c, 12)) == ["aaaa\nbbbb", "short", "x" * 12]
