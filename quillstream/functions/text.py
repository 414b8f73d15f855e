"""Text functions as column expressions; a Python function only where no built-in does it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_title(title: Column) -> Column:
    """Comparison key of a title: lower case, runs of anything but letters, digits and _ as one blank."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", " "))


def usable_title_key(title: Column, least: int = 15) -> Column:
    """The title key where it is long enough to tell titles apart, else null."""
    key = normalize_title(title)
    return F.when(F.length(key) >= least, key)


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).casefold()

    return values.map(one)


def normalize_entity(name: Column) -> Column:
    """Comparison key of a name: no accents, folded case, punctuation as blanks, without leading articles."""
    words = F.trim(F.regexp_replace(_fold(name), r"[^\p{L}\p{N}_]+", " "))
    return F.trim(F.regexp_replace(words, r"^((a|an|the)( +|$))+", ""))


def event_key(subject: Column, obj: Column) -> Column:
    """subject|object in normal form; null unless both say something."""
    s, o = normalize_entity(F.coalesce(subject, F.lit(""))), normalize_entity(F.coalesce(obj, F.lit("")))
    return F.when((s != "") & (o != ""), F.concat_ws("|", s, o))


def collapse_whitespace(text: Column) -> Column:
    """All runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """White space collapsed per line, blank lines dropped."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), collapse_whitespace)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def article_id(dedupe_key: Column) -> Column:
    """Identifier from a URL's comparison key."""
    return F.substring(F.sha2(dedupe_key, 256), 1, 16)


def content_terms(title: Column, text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of title and text."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.replace(F.lower(joined), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+"), F.lit(0))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]|`*_])", r"\\$1")


def truncate_text(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last line feed if that leaves more than half."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.locate("\n", F.reverse(head))
    cut = F.when((F.locate("\n", head) > 0) & (at > limit / 2), F.rtrim(F.substring(head, F.lit(1), at))).otherwise(F.rtrim(head))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


# Hosts of one publication under two names, shapes of titles that social sites give posts, lengths of a headline made from prose.
HOST_ALIASES = {"twitter.com": "x.com"}
_ACCOUNT = r"(?iU)^.{0,60}\(@[\w.]{1,30}\)\s+on\s+\S+$"
_HANDLE = r"(?iU)^@[\w.]{1,30}\s+on\s+\S+$"
_QUOTED = r"(?sU)^.{1,60}?\s+on\s+[^:]{1,30}:\s*[\"\u201c\u2018']\s*(.+)$"
_FORBIDDEN = r"(?i)https?://|<[a-z/][^>]*>|\]\("
MIN_HEADLINE, MAX_HEADLINE = 40, 120


def registrable_host(host: Column) -> Column:
    """The site of a host: its last two labels, `www.` aside, in the name its aliases share."""
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    site = F.substring_index(bare, ".", -2)
    for other, name in HOST_ALIASES.items():
        site = F.when(site == other, name).otherwise(site)
    return site


def is_account_title(title: Column) -> Column:
    """Whether a title only names a social account and its platform."""
    t = collapse_whitespace(title)
    return t.rlike(_ACCOUNT) | t.rlike(_HANDLE)


def unwrap_social_title(title: Column) -> Column:
    """The quoted part of `Someone on Platform: "..."`; any other title as it is."""
    body = F.trim(F.regexp_extract(F.trim(title), _QUOTED, 1))
    bare = F.trim(F.regexp_replace(F.regexp_replace(body, "[\u201d\u2019\"']+$", ""), "[ .\u2026]+$", ""))
    return F.when(title.isNotNull(), F.when(bare != "", bare).otherwise(title))


def headline_from_prose(text: Column) -> Column:
    """Whole sentences until MIN_HEADLINE characters, or, beyond MAX_HEADLINE, whole words and an ellipsis."""
    prose = collapse_whitespace(unwrap_social_title(text))
    sentences = F.split(prose, r"(?<=[.!?])\s+")
    taken = F.aggregate(sentences, F.lit(""), lambda acc, x: F.when(F.length(acc) >= MIN_HEADLINE, acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(" "), x)))
    clipped = F.regexp_replace(F.regexp_replace(F.substring(taken, 1, MAX_HEADLINE), r"(?s) [^ ]*$", ""), r"[ ,;:]+$", "")
    return F.when(F.length(prose) <= MIN_HEADLINE, prose).when(F.length(taken) <= MAX_HEADLINE, taken).otherwise(F.concat(clipped, F.lit("\u2026")))


def clean_editorial_text(text: Column, limit: int) -> Column:
    """Prose in one line, or null if it is empty, longer than limit, or holds a link or markup."""
    flat = collapse_whitespace(text)
    return F.when((flat != "") & (F.length(flat) <= limit) & ~flat.rlike(_FORBIDDEN), flat)


def event_fingerprint(subject: Column, action: Column, obj: Column, date: Column) -> Column:
    """subject|action|object|date, trimmed and in lower case; null unless the first three say something."""
    parts = [subject, action, obj]
    said = (subject != "") & (action != "") & (obj != "")
    return F.when(said, F.concat_ws("|", *[F.lower(F.trim(x)) for x in (*parts, F.coalesce(date, F.lit("")))]))


def cache_key(content_hash: Column, prompt: Column, schema: Column, model: Column) -> Column:
    """The identity of an assessment; null if a part is missing."""
    return F.concat(content_hash, F.lit(":"), prompt, F.lit(":"), schema, F.lit(":"), model)


def trimmed_facts(facts: Column, most: int = 8) -> Column:
    """The first facts that say something, trimmed."""
    return F.slice(F.filter(F.transform(facts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, most)


def html_escape(text: Column) -> Column:
    """Text that HTML shows as it is, in content and in attributes."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def with_linked_material(text: Column, url: Column, linked: Column) -> Column:
    """Text with what its page links to, under a label that names the link."""
    label = F.when(url.isNotNull(), F.concat(F.lit("Material linked from this page ("), url, F.lit("):"))).otherwise("Material linked from this page:")
    return F.trim(F.concat(F.trim(text), F.lit("\n\n"), label, F.lit("\n\n"), normalize_text(linked)))


def trim_to_alphanumeric(token: Column) -> Column:
    """A token without anything but letters and digits at its ends."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
