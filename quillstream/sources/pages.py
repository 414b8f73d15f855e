"""Articles from HTML pages: title, date, author, canonical link and body, by chains of candidates."""

from __future__ import annotations

import html.parser
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions.dates import SCAN, embedded_date, parse_datetime
from quillstream.functions.transfer import host_of
from quillstream.functions.urls import canonicalize_url, dedupe_key, same_site

# Elements without content, elements that end a line, and those that may hold the body, the best first.
SKIPPED = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg", "button", "select", "header"}
BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "table", "tr", "br", "figure", "figcaption", "td", "th", "body"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "figcaption", "td", "th"}
CONTAINERS = ("article", "main", "body")
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track"}
#: Characters a container must have, part of the largest that it must reach, depth read, and when a block is mostly links.
LEAST_CHARS, LEAST_PART, DEPTH, LINKED_CHARS, LINKED_PART = 120, 0.5, 200, 60, 0.6


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.stack[-1].tag == "p":
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < DEPTH:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def _text(node: Node, linked: bool = False) -> str:
    """All text below a node; only that inside links if linked."""
    out, todo = [], [(node, node.tag == "a")]
    while todo:
        n, inside = todo.pop()
        if isinstance(n, str):
            if inside or not linked:
                out.append(n)
        elif n.tag not in ("script", "style"):
            todo += [(c, inside or (isinstance(c, Node) and c.tag == "a")) for c in reversed(n.children)]
    return " ".join("".join(out).split())


def _lines(node: Node) -> list[str]:
    """The lines of a container's content, without skipped elements and blocks that are mostly links."""
    lines: list[str] = [""]
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            lines[-1] += n
        elif n is None:
            lines.append("")
        elif n.tag not in SKIPPED:
            if n is not node and n.tag in BLOCKS and n.tag not in PROSE:
                whole = len(_text(n))
                if whole >= LINKED_CHARS and len(_text(n, linked=True)) >= LINKED_PART * whole:
                    continue
            block = n.tag in BLOCKS
            todo += ([None] if block else []) + list(reversed(n.children)) + ([None] if block else [])
    clean = (" ".join(x.split()) for x in lines)
    return [x for x in clean if x]


def body_text(root: Node) -> str:
    """The text of the first kind of container that has enough of it, taking the first that isn't much shorter than the largest."""
    for tag in CONTAINERS:
        texts = ["\n".join(_lines(n)) for n in _walk(root) if n.tag == tag][:20]
        most = max(map(len, texts), default=0)
        if most >= LEAST_CHARS or (tag == CONTAINERS[-1] and most):
            return next(t for t in texts if len(t) >= LEAST_PART * most)
    return "\n".join(_lines(root))


def json_ld(root: Node) -> list[dict]:
    """JSON-LD objects of a page, breadth first through lists and graphs; what isn't JSON is skipped."""
    out: list[dict] = []
    for n in _walk(root):
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            try:
                todo = [json.loads("".join(c for c in n.children if isinstance(c, str)))]
            except ValueError:
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo += x
                elif isinstance(x, dict):
                    out.append(x)
                    todo += [x["@graph"]] if "@graph" in x else []
    return out


def page_fields(html_text: str, url: str) -> dict:
    """Candidates for each field of an article, in order of preference."""
    tree = _Tree()
    tree.feed(html_text or "")
    root = tree.root
    meta: dict[str, str] = {}
    first: dict[str, str] = {}
    times, canonical = [], None
    for n in _walk(root):
        if n.tag == "meta":
            meta.setdefault((n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or "").lower(), n.attrs.get("content", "").strip())
        elif n.tag in ("h1", "title"):
            first.setdefault(n.tag, _text(n))
        elif n.tag == "time" and n.attrs.get("datetime"):
            times.append(n.attrs["datetime"])
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and canonical is None:
            canonical = urljoin(url or "", n.attrs.get("href", ""))
    ld = json_ld(root)

    def said(key: str) -> list[str]:
        return [x[key] for x in ld if isinstance(x.get(key), str)]

    names = []
    for x in ld:
        a = x.get("author")
        for y in a if isinstance(a, list) else [a]:
            names += [y["name"]] if isinstance(y, dict) and isinstance(y.get("name"), str) else [y] if isinstance(y, str) else []
    clean = lambda xs: [x for x in xs if x and x.strip()]
    return {
        "titles": clean([meta.get("og:title"), meta.get("twitter:title"), *said("headline"), first.get("h1"), first.get("title")]),
        "dates": clean([*(meta.get(k) for k in ("article:published_time", "og:published_time", "datepublished", "date", "pubdate")), *said("datePublished"), *times]),
        "authors": clean([meta.get("author"), meta.get("article:author"), *names]),
        "canonical": canonical,
        "description": next(iter(clean([meta.get("og:description"), meta.get("description"), meta.get("twitter:description")])), None),
        "scripts": "\n".join(x for x in ("".join(c for c in n.children if isinstance(c, str)) for n in _walk(root) if n.tag == "script") if x)[:SCAN],
        "text": body_text(root),
    }


def extract_articles(pages: DataFrame, date_key: str | None = None) -> DataFrame:
    """Articles from (source_id, url, html, title_hint, published_at_hint), with a `problem` where one can't be made.

    A page's canonical link is trusted only on the page's own site; a date comes from the
    first candidate that reads as one, else from `date_key` in the page's scripts, else from the hint.
    A title that only names an account gives way to the hint or the beginning of the page's description.
    """
    schema = "source_id string, url string, titles array<string>, dates array<string>, authors array<string>, canonical string, description string, scripts string, text string, title_hint string, published_at_hint timestamp"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame([page_fields(h, u) for h, u in zip(frame["html"], frame["url"])], columns=["titles", "dates", "authors", "canonical", "description", "scripts", "text"])
            found.insert(0, "source_id", frame["source_id"].to_numpy())
            found.insert(1, "url", frame["url"].to_numpy())
            found["title_hint"], found["published_at_hint"] = frame["title_hint"].to_numpy(), frame["published_at_hint"].to_numpy()
            yield found

    raw = pages.select("source_id", "url", "html", "title_hint", "published_at_hint").mapInPandas(read, schema)
    own = F.when(same_site(F.col("canonical"), F.col("url")), F.col("canonical")).otherwise(F.col("url"))
    title = F.coalesce(F.get(F.filter("titles", lambda t: ~X.is_account_title(t)), F.lit(0)), F.col("title_hint"), X.headline_from_prose(F.col("description")), F.get("titles", F.lit(0)))
    published = F.coalesce(F.get(F.filter(F.transform("dates", parse_datetime), lambda d: d.isNotNull()), F.lit(0)), F.lit(None) if date_key is None else embedded_date(F.col("scripts"), date_key), F.col("published_at_hint"))
    out = raw.select(
        "source_id", F.col("url").alias("origin_url"), canonicalize_url(own).alias("canonical_url"), X.collapse_whitespace(X.unwrap_social_title(title)).alias("title"), published.alias("published_at"),
        F.get("authors", F.lit(0)).alias("author"), X.normalize_text(F.col("text")).alias("clean_text"),
    )
    problem = (
        F.when(F.col("canonical_url").isNull(), "no usable url").when(F.coalesce(F.col("title"), F.lit("")) == "", "no title").when(F.col("published_at").isNull(), "no date").when(F.col("clean_text") == "", "no text")
    )
    keyed = out.withColumn("article_id", X.article_id(dedupe_key(F.col("canonical_url")))).withColumn("content_hash", X.content_hash(F.col("clean_text")))
    return keyed.withColumn("problem", problem)


def outbound_links(pages: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(url, position, link): links of (url, html) pages to other hosts, first occurrence, media and blocked hosts left out."""
    media = re.compile(r"\.(jpe?g|png|gif|svg|webp|mp[34]|pdf|zip)([?#]|$)", re.I)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, text in zip(frame["url"], frame["html"]):
                tree = _Tree()
                tree.feed(text or "")
                seen: dict[str, int] = {}
                for n in _walk(tree.root):
                    if n.tag == "a" and n.attrs.get("href"):
                        seen.setdefault(urljoin(url or "", n.attrs["href"]), len(seen) + 1)
                rows += [(url, i, link) for link, i in seen.items() if not media.search(link)]
            yield pd.DataFrame(rows, columns=["url", "position", "link"])

    raw = pages.select("url", "html").mapInPandas(read, "url string, position int, link string")
    host = lambda c: X.registrable_host(host_of(c))
    kept = raw.where(canonicalize_url(F.col("link")).isNotNull() & (host(F.col("link")) != host(F.col("url"))))
    return kept.where(~host(F.col("link")).isin(*blocked)) if blocked else kept
