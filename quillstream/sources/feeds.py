"""Candidates from RSS and Atom feeds and from index pages held as text columns."""

from __future__ import annotations

import html.parser
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.dates import in_window, parse_datetime
from quillstream.functions.urls import is_public_url

CANDIDATE = "source_id string, position int, title string, link string, date_text string, body string"
#: Candidates of one source that are kept.
PER_SOURCE = 50
_DATES = ("pubDate", "published", "updated", "date", "created")


def _name(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _entries(text: str) -> Iterator[dict]:
    for item in ET.fromstring(text).iter():
        if _name(item.tag) not in ("item", "entry"):
            continue
        found: dict[str, str] = {}
        for child in item:
            name, value = _name(child.tag), "".join(child.itertext()).strip()
            if name == "link" and not value:
                value = child.get("href", "") if child.get("rel", "alternate") == "alternate" else ""
            if value:
                found.setdefault(name, value)
        yield {"title": found.get("title"), "link": found.get("link"), "date_text": next((found[d] for d in _DATES if d in found), None), "body": found.get("encoded") or found.get("content") or found.get("description") or found.get("summary")}


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of (source_id, text) feeds in reading order; a feed that isn't XML has none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, text in zip(frame["source_id"], frame["text"]):
                try:
                    rows += [{"source_id": source, "position": i} | e for i, e in enumerate(_entries(text or ""), 1)]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["source_id", "position", "title", "link", "date_text", "body"])

    return feeds.select("source_id", "text").mapInPandas(read, CANDIDATE)


class _Cards(html.parser.HTMLParser):
    """Links of an index page, with the text inside and the date of the element around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.open: dict | None = None
        self.time: str | None = None
        self.in_time = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.open = {"link": a["href"], "title": "", "date_text": self.time, "body": None}
        elif tag == "time":
            self.in_time, self.time = True, a.get("datetime")
            if self.cards and self.cards[-1]["date_text"] is None and self.open is None:
                self.cards[-1]["date_text"] = self.time
        elif tag in ("article", "li", "section"):
            self.time = None

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            self.open["title"] = " ".join(self.open["title"].split()) or None
            self.cards.append(self.open)
            self.open = None
        elif tag == "time":
            self.in_time = False

    def handle_data(self, data):
        if self.open is not None:
            self.open["title"] += data
        if self.in_time and not self.time and data.strip():
            self.time = data.strip()
            if self.cards and self.cards[-1]["date_text"] is None:
                self.cards[-1]["date_text"] = self.time


def index_entries(pages: DataFrame) -> DataFrame:
    """Linked cards of (source_id, url, text) index pages in reading order, links made absolute, each once."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, url, text in zip(frame["source_id"], frame["url"], frame["text"]):
                parser = _Cards()
                parser.feed(text or "")
                seen: set[str] = set()
                for c in parser.cards:
                    link = urljoin(url or "", c["link"])
                    if link not in seen:
                        seen.add(link)
                        rows.append({"source_id": source, "position": len(seen)} | c | {"link": link})
            yield pd.DataFrame(rows, columns=["source_id", "position", "title", "link", "date_text", "body"])

    return pages.select("source_id", "url", "text").mapInPandas(read, CANDIDATE)


def discover(entries: DataFrame, start: datetime, end: datetime, per_source: int = PER_SOURCE) -> DataFrame:
    """Entries with a usable link that are undated or inside the window, the first `per_source` of each source."""
    dated = entries.withColumn("published_at_hint", parse_datetime(F.col("date_text")))
    usable = dated.where(is_public_url(F.col("link")) & (F.col("published_at_hint").isNull() | in_window(F.col("published_at_hint"), start, end)))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("position", "link"))
    return usable.withColumn("_n", place).where(F.col("_n") <= per_source).drop("_n")
