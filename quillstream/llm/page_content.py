"""Problem 3: the main body of a page, without the furniture around and within it.

Method: minimum-cut labelling.  A classifier gives every line a cost of being
story and a cost of being furniture; these are the terminal capacities.  Smoothness
edges join neighbouring lines, and lines one apart, the stronger the more they are
alike in shape (the text keeps no markup, so place and shape stand for the place in
the document's tree).  The maximum flow of each page separates the two.  Capacities of
edges are stated, not fitted: a fit by pseudo-likelihood to the lines that rules label
gives zero, as these are the lines whose own features tell.  Three kinds of lines have
their terminal capacity by definition: the headline and list lines, the story's, and bare dates, the page's.

The classifier is a logistic regression trained here.  No labels come with the data,
so labelling rules name the lines they are sure of on a bounded sample of pages
(`SAMPLE` pages in the order of a hash of their identifiers), and the regression carries
these over to all lines by their words, shape, place, neighbours and repetition.
How often a line stands in the articles of its source and of all sources, and whether it is the
title of an article, is counted exactly over all articles, at every size: each article asks
for the keys of its lines, keys are counted in part before they are shuffled, and a join gives each article the
counts of those that stand elsewhere too.

Defined cases: rows without article_id or text are left out, an article saved
again counts once, as its latest row whose payload parses; a null title
announces nothing; blank lines are never furniture; with no sample every line is story.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.urls import let
from quillstream.llm.common import article_texts, latest_only
from quillstream.llm.repeated_lines import line_letters
from quillstream.llm.textkernel import alnum_table
from quillstream.runtime import materialize

#: Pages the classifier is trained on, and characters that such a page may have (so that the sample is bounded in bytes too); hashed word weights; capacities of edges and their upper bound at terminals.
SAMPLE, SAMPLE_CHARS = 4000, 50_000
BUCKETS = 1 << 13
#: Characters from which a line counts as a paragraph where the places of lines are counted.
PARAGRAPH = 60
#: Different words of furniture from which a line is a notice however seldom it stands in articles, and the most words it may have for each.
SEVERAL, APART = 3, 12
EDGE_LIKE, EDGE_UNLIKE, EDGE_SECOND, MOST = 0.6, 0.15, 0.25, 9.0

_WORD = re.compile(r"[^\W\d_]+")
_SEPARATED = re.compile(r"\s[|•·/›»>]\s")
_SEPARATOR = re.compile(r"[|•·/›»>]")
_STAMP = re.compile(r"^\W*(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4})([T ,]*(at|a las)?\s*\d{1,2}:\d{2}.*)?\W*$", re.I)
_TIME = re.compile(r"\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b")
_BULLET = re.compile(r"^\s*[-–—•*]\s")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)]*\s*$")
_LABELLED = re.compile(r"^\s*(\d+[.)]\s+)?\w+: [A-ZÁÉÍÓÚÑÀÈÇ\"“«]")
_FIGURE = re.compile(r"[|:]\s*[\d.,]+\s*[%€$]?\s*$")
# Words for the parts and functions of any web page in English, Spanish and French, after the kinds of class names that published
# content extractors (Readability, boilerpipe) look for: consent, accounts, sharing, adverts, lists of stories, notices.
FURNITURE = frozenset((
    "cookie", "cookies", "consent", "consentimiento", "consentement", "privacy", "privacidad", "confidentialité", "preferences", "preferencias", "préférences", "gdpr",
    "login", "logout", "signup", "subscribe", "suscríbete", "suscribirse", "abonnez", "newsletter", "newsletters", "boletín", "inbox", "menu", "menú", "sitemap", "sidebar", "footer",
    "share", "comparte", "compartir", "partager", "print", "imprimir", "imprimer", "email", "comments", "comentarios", "commentaires", "facebook", "twitter", "whatsapp",
    "advertisement", "advertising", "publicidad", "publicité", "anuncio", "anuncios", "sponsored", "patrocinado", "sponsorisé", "copyright", "reserved", "reservados", "réservés", "imprint", "legal",
    "related", "relacionado", "relacionados", "relacionadas", "trending", "updated", "actualizado", "redacción", "rédaction",
))
#: A name after a preposition and nothing else: by whom the story is.
_BYLINE = re.compile(r"^\W*(?:\w+ )?(?:by|por|par)(?: (?-i:[A-ZÁÉÍÓÚÑÀÈÇ])[\w’'.-]+){1,4}\W*$", re.I)
#: Share of a source's pages from which a line is the page's, and under which a short line within stories may be a subheading.
OFTEN, SELDOM = 1 / 5, 1 / 6

DENSE = [
    "bias", "own", "own8", "own3", "everywhere", "title", "other_title", "tail_title", "words2", "words5", "words11", "words12",
    "sentence", "bullet", "separated", "rights", "no_letters", "stamp", "time", "capitals", "digits", "labelled", "subject",
    "before", "after", "first", "last", "byline", "often", "often_twice", "share", "prev_other", "next_other", "between", "colon", "furniture_word", "long_rare", "led", "followed", "names_source", "spec", "subject_short",
]
_COL = {name: i for i, name in enumerate(DENSE)}
#: Lines taken through numpy at once; a page is never parted.
TOGETHER = 4096


class _Numbers(dict):
    """Number of each token that was met: its bucket, and for words of FURNITURE, whose numbers all differ, a multiple of BUCKETS more."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        i = self[token] = zlib.crc32(token.encode()) % BUCKETS + BUCKETS * _FURNITURE.get(token, 0)
        return i


_FURNITURE = {word: i for i, word in enumerate(sorted(FURNITURE), 1)}
_numbers = _Numbers()


@functools.lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """True for the code points that `_WORD` takes."""
    return alnum_table() & ~np.fromiter((chr(i).isdecimal() for i in range(0x110000)), dtype=bool, count=0x110000)


@dataclass
class _Words:
    """Words in lower case of all lines, one after another, and their numbers; `first` and `letter_at` have one entry more than lines."""

    words: list[str]
    number: np.ndarray
    first: np.ndarray  # per line: index of its first word
    letters: str  # of all lines
    letter_at: np.ndarray  # per line: index of its first letter
    digits: np.ndarray  # per line: how many of 0 to 9 it has


def _words(lines: list[str]) -> _Words:
    """The words of lines that have no line feed within."""
    cp = np.frombuffer(("\n".join(lines).lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    end = np.flatnonzero(cp == 10)
    inside = _letter_table()[cp]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    words = np.where(inside, cp, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").split()

    def per_line(at: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.searchsorted(at, end)])

    number = np.fromiter(map(_numbers.__getitem__, words), dtype=np.int64, count=len(words))
    digits = np.diff(per_line(np.flatnonzero((cp >= 48) & (cp <= 57))))
    return _Words(words, number, per_line(begins), cp[inside].tobytes().decode("utf-32-le", "surrogatepass"), per_line(np.flatnonzero(inside)), digits)


def _says(line: str, k: int, digits: int) -> tuple:
    """What a line of k words says by itself, wherever it stands, in the order in which `page_features` takes it."""
    shown = line.strip()
    separated = _SEPARATOR.search(line) is not None and len(_SEPARATED.findall(line)) + line.count(" / ") >= 2
    return (
        _SENTENCE_END.search(line[-8:]) is not None, _BULLET.match(line) is not None, separated, "©" in line or shown[:3].lower() == "(c)",
        k <= 4 and _STAMP.match(shown) is not None, k <= 6 and _TIME.search(line) is not None, shown.isupper(), ": " in line and _LABELLED.match(line) is not None,
        k <= 6 and _BYLINE.match(line) is not None, ":" in shown, separated and _FIGURE.search(line) is not None, digits / max(1, len(shown)),
    )


def page_features(pages: list[tuple], rules_too: bool = True):
    """Of all lines of the pages, one after another: dense features (lines x DENSE), hashed words as (line, bucket), and what the labelling rules say (1 furniture, 0 story, -1 nothing).

    A page, of a line at least: (lines, title, source, own, everywhere, other, tail, led, followed, pages).
    own, everywhere: articles of the source, and of all, with the line.  other,
    tail: whether the line, or what follows its first colon, is another article's title.
    led, followed: the share of all its places where a paragraph stands before, or after it.
    pages: articles of the source.
    """
    lines = [line for page in pages for line in page[0]]
    n = len(lines)
    if not n:
        return np.zeros((0, len(DENSE)), np.float32), (np.zeros(0, np.int64),) * 2, np.zeros(0, np.int8)
    w = _words(lines)
    k = np.diff(w.first)
    says = np.fromiter(chain.from_iterable(map(_says, lines, k.tolist(), w.digits.tolist())), dtype=float, count=12 * n).reshape(n, 12)
    sentence, bullet, separated, rights, stamp, timed, capitals, labelled, byline, colon, spec = says[:, :11].T != 0
    digits = says[:, 11]
    # Hashed words, with the first and the last of each line once more as such.
    some = np.flatnonzero(k)
    ends = np.fromiter((_numbers[mark + w.words[i]] for mark, at in (("^", w.first[:-1]), ("$", w.first[1:] - 1)) for i in at[some].tolist()), dtype=np.int64, count=2 * len(some))
    row = np.repeat(np.arange(n), k)
    codes = np.sort(np.concatenate([row, some, some]) * BUCKETS + np.concatenate([w.number, ends]) % BUCKETS)
    tokens = np.divmod(codes[np.diff(codes, prepend=-1) != 0], BUCKETS)
    fixed = w.number >= BUCKETS
    told = np.bincount(np.unique(np.stack([row[fixed], w.number[fixed]]), axis=1)[0], minlength=n)
    rights[row[w.number == _numbers["copyright"]]] = True
    titled: list[tuple[bool, bool, bool]] = []
    first, letter_at = w.first.tolist(), w.letter_at.tolist()
    for page_lines, title, source, *_ in pages:
        title_words = _WORD.findall(title.lower())
        joined = "".join(title_words)
        names = "".join(_WORD.findall(source.lower()))
        subjects = {word for word in title_words if len(word) >= 7}
        for i in range(len(titled), len(titled) + len(page_lines)):
            letters = w.letters[letter_at[i] : letter_at[i + 1]]
            if joined != "" and letters.startswith(joined) and len(letters) <= len(joined) + 30:
                titled.append((True, False, False))
            else:
                titled.append((False, not subjects.isdisjoint(w.words[first[i] : first[i + 1]]), names != "" and names in letters))
    is_title, about, named = np.array(titled, dtype=bool).T
    seen, everywhere, other, tail, led, followed = (np.concatenate([page[i] for page in pages]) for i in range(3, 9))
    other, tail = other.astype(bool), tail.astype(bool)
    size = np.array([len(page[0]) for page in pages], dtype=np.int64)
    start = np.cumsum(size) - size
    at = np.arange(n) - np.repeat(start, size)  # place in the page
    opens, closes = at == 0, at == np.repeat(size, size) - 1
    rare_long = (k >= 9) & (seen < 8) & sentence
    whole = rare_long & ~other & ~labelled
    lo, hi = (np.repeat(f.reduceat(np.where(whole, at, none), start), size) for f, none in ((np.minimum, np.repeat(size, size)), (np.maximum, -1)))
    between = (lo < at) & (at < hi)
    said, notice = told > 0, (told >= SEVERAL) & (k <= APART * told)
    part = np.where(seen >= 3, seen / np.repeat([page[9] for page in pages], size), 0.0)

    def before(v: np.ndarray) -> np.ndarray:
        return np.concatenate([[False], v[:-1]]) & ~opens

    def after(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v[1:], [False]]) & ~closes

    prev_other, next_other = before(other), after(other)
    short = about & (k <= 6) & ~other & ~tail
    x = np.empty((n, len(DENSE)), dtype=np.float32)
    for i, column in enumerate((
        1, np.log1p(seen) / 2, seen >= 8, seen >= 3, np.log1p(everywhere) / 3, is_title, other & ~is_title, tail & ~is_title, k <= 2, (k >= 3) & (k <= 5), (k >= 6) & (k <= 11), k >= 12,
        sentence, bullet, separated, rights, k == 0, stamp, timed, capitals, digits, labelled, about,
        at < lo, at > hi, opens, closes, byline, part >= OFTEN, part >= 2 * OFTEN, part, prev_other, next_other,
        between & (k <= 5), colon, said & (notice | ~(rare_long & (k >= 12) & (seen <= 3))), rare_long & (k >= 12), led, followed, named, spec, short,
    )):
        x[:, i] = column
    if not rules_too:
        return x, tokens, np.zeros(0, dtype=np.int8)
    # Labelling rules, the surest first.
    rules = (
        (is_title, 0),
        (other | tail | stamp | byline | ((seen >= 8) & (part >= OFTEN)), 1),
        (spec | (short & sentence & (seen < 8)), 0),
        (rights | (separated & (k <= 25) & ~sentence), 1),
        (bullet & (seen < 8), 0),
        (named & (seen >= 4), 1),
        ((k <= 4) & ~sentence & ~said & (part < SELDOM) & (everywhere >= 8) & (led > 0.6) & (followed > 0.6) & (digits == 0), 0),
        (said & ((seen >= 4) | (k <= 8) | notice) & ~about, 1),
        ((k >= 6) & ((seen >= 8) | ((everywhere >= 8) & (k <= 14))), 1),
        (about & sentence & (seen < 8), 0),
        (sentence & (k >= 6) & ~labelled & (lo <= at) & (at <= hi) & (seen <= 3) & ~said, 0),
        (labelled & sentence & (prev_other | next_other), 1),
        ((seen >= 8) & ~between & (k >= 1) & (np.minimum(led, followed) < 0.4), 1),
        (between & (k >= 1) & (k <= 4) & ~sentence & ~said & after(rare_long) & (digits == 0), 0),
    )
    return x, tokens, np.select([where for where, _ in rules], [says for _, says in rules], -1).astype(np.int8)


def _groups(pages, lines: int = TOGETHER) -> Iterator[list[tuple]]:
    """Pages, one after another, in lists of about so many lines."""
    group, n = [], 0
    for page in pages:
        group.append(page)
        n += len(page[0])
        if n >= lines:
            yield group
            group, n = [], 0
    if group:
        yield group


def fit(pages: list[tuple], steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on the lines that rules label; pages as in `page_features`."""
    dense, rows, cols, y = [], [], [], []
    at = 0
    for group in _groups(pages):
        x, tokens, rule = page_features(group)
        told = np.flatnonzero(rule >= 0)
        dense.append(x[told])
        y.append(rule[told])
        row, bucket = tokens
        kept = rule[row] >= 0
        rows.append(at + np.searchsorted(told, row[kept]))
        cols.append(bucket[kept])
        at += len(told)
    weights = np.zeros(len(DENSE) + BUCKETS)
    if not at:
        weights[0] = -MOST
        return weights
    d, y = np.concatenate(dense), np.concatenate(y).astype(float)
    r, k = np.concatenate(rows), np.concatenate(cols)
    scale = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=at), 1))
    # Both classes weigh alike.
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        z = np.einsum("ij,j->i", d, weights[: len(DENSE)]) + np.bincount(r, weights[len(DENSE) + k] * scale[r], minlength=at)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.concatenate([np.einsum("ij,i->j", d, error), np.bincount(k, (error * scale)[r], minlength=BUCKETS)]) + decay * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def line_costs(weights: np.ndarray, x: np.ndarray, tokens: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-odds of furniture per line."""
    row, bucket = tokens
    words = np.bincount(row, weights[len(DENSE) + bucket], minlength=len(x))
    return np.einsum("ij,j->i", x.astype(float), weights[: len(DENSE)]) + words / np.sqrt(np.maximum(np.bincount(row, minlength=len(x)), 1))


def minimum_cut(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes are on the furniture side of the minimum cut.

    odds: log-odds of furniture, the terminal capacities; edges: (i, j, capacity).
    Nodes whose terminal outweighs all their edges are fixed first, which leaves
    the cut unchanged; the rest is separated by a maximum flow.
    """
    n = len(odds)
    odds = np.clip(odds, -MOST, MOST).astype(float)
    weight = np.zeros(n)
    for i, j, w in edges:
        weight[i] += w
        weight[j] += w
    fixed = np.abs(odds) > weight
    label = odds > 0
    free = np.flatnonzero(~fixed)
    if not len(free):
        return label
    index = {int(v): k for k, v in enumerate(free)}
    s, t = len(free), len(free) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def add(a: int, b: int, w: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(w)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    pull = odds[free].copy()
    for i, j, w in edges:
        a, b = index.get(i), index.get(j)
        if a is not None and b is not None:
            add(a, b, w, w)
        elif a is not None:
            pull[a] += w if label[j] else -w
        elif b is not None:
            pull[b] += w if label[i] else -w
    for a, p in enumerate(pull):
        if p > 0:
            add(s, a, p, 0.0)
        elif p < 0:
            add(a, t, -p, 0.0)
    while True:  # shortest augmenting paths
        by = [-1] * (t + 1)
        by[s] = -2
        queue = deque([s])
        while queue and by[t] == -1:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and by[to[e]] == -1:
                    by[to[e]] = e
                    queue.append(to[e])
        if by[t] == -1:
            break
        flow, b = np.inf, t
        while b != s:
            flow = min(flow, cap[by[b]])
            b = to[by[b] ^ 1]
        b = t
        while b != s:
            cap[by[b]] -= flow
            cap[by[b] ^ 1] += flow
            b = to[by[b] ^ 1]
    for v, a in index.items():
        label[v] = by[a] != -1
    return label


def _shape(x: np.ndarray) -> np.ndarray:
    """What lines are alike in."""
    return x[:, _COL["words12"]] + 2 * x[:, _COL["sentence"]] + 4 * x[:, _COL["bullet"]]


def page_edges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity) between lines next to each other and one apart."""
    shape = _shape(x).tolist()
    n = len(x)
    out = [(i, i + 1, EDGE_LIKE if shape[i] == shape[i + 1] else EDGE_UNLIKE) for i in range(n - 1)]
    return out + [(i, i + 2, EDGE_SECOND) for i in range(n - 2) if shape[i] == shape[i + 2]]


def cut_pages(odds: np.ndarray, x: np.ndarray, size: list[int]) -> np.ndarray:
    """`minimum_cut` of each of several pages one after another, of `size` lines each; only pages with a line that isn't fixed need a flow."""
    label = np.clip(odds, -MOST, MOST) > 0
    shape, page, weight = _shape(x), np.repeat(np.arange(len(size)), size), np.zeros(len(odds))
    for apart, alike, unlike in ((1, EDGE_LIKE, EDGE_UNLIKE), (2, EDGE_SECOND, 0.0)):
        w = np.where(page[:-apart] != page[apart:], 0.0, np.where(shape[:-apart] == shape[apart:], alike, unlike))
        weight[apart:] += w
        weight[:-apart] += w
    start = np.cumsum(size) - size
    for p in np.unique(page[np.abs(np.clip(odds, -MOST, MOST)) <= weight]).tolist():
        own = slice(start[p], start[p] + size[p])
        label[own] = minimum_cut(odds[own], page_edges(x[own]))
    return label


def _keyed(texts: DataFrame) -> DataFrame:
    """Texts with, per line, the keys that are counted: in its source, in all sources, as a title.  A key of 0 counts nothing."""
    source = F.concat(F.lit("s:"), F.coalesce("source_id", F.lit("")))

    def key(tag: F.Column, letters: F.Column) -> F.Column:
        return F.when(letters != "", F.xxhash64(tag, letters)).otherwise(F.lit(0).cast("long"))

    def of_line(line: F.Column) -> F.Column:
        head = F.when(line.contains("("), line_letters(F.regexp_replace(line, r"\([^()]*\)\s*$", ""))).otherwise(F.lit(None))
        tail = F.when(line.contains(":"), line_letters(F.regexp_replace(F.regexp_replace(line, r"\([^()]*\)\s*$", ""), r"^[^:]*:", ""))).otherwise("")
        solid = F.length(F.trim(line)) >= PARAGRAPH

        def keys(letters: F.Column) -> F.Column:
            return F.struct(
                key(source, letters).alias("own"), key(F.lit("*"), letters).alias("everywhere"), key(F.lit("^"), F.coalesce(head, letters)).alias("head"), key(F.lit("^"), tail).alias("tail"), solid.alias("solid"), line.rlike(r"\S").alias("there"),
            )

        return let(line_letters(line), keys)

    lines = F.split("text", "\n")
    known = ["known"] if "known" in texts.columns else []
    return texts.select("article_id", "stamp", "title", F.coalesce("source_id", F.lit("")).alias("source"), lines.alias("lines"), F.transform(lines, of_line).alias("info"), F.xxhash64(F.lit("^"), line_letters(F.col("title"))).alias("head"), F.xxhash64(F.lit("n"), source).alias("all"), *known)


#: What an article has to do with a key: counts once for it, in a place after or before a paragraph, is titled so; 0 only asks for it.
_COUNTS, _LED, _FOLLOWED, _TITLED = 1, 2, 4, 8


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Row of each line, the fields of `info`, and where each row's lines begin."""
    info = batch.column("info")
    offsets = info.offsets.to_numpy() - info.offsets[0].as_py()
    flat = info.flatten()
    fields = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("own", "everywhere", "head", "tail", "solid", "there")}
    fields |= {name: fields[name].view(np.uint64) for name in ("own", "everywhere", "head", "tail")}
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets)), fields, offsets


def _per_article(rows: np.ndarray, keys: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) with the kinds of all its places together, and the index of each place's among them."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = np.empty(len(r), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    kinds = np.bitwise_or.reduceat(kind[order], np.flatnonzero(new)) if len(r) else kind
    return r[new], k[new], kinds, at


def _places(row: np.ndarray, f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The lines whose places count in all sources, and what each place is."""
    at = np.flatnonzero(f["there"])
    r, solid = row[at], f["solid"][at]
    same = r[1:] == r[:-1]
    kind = np.full(len(at), _COUNTS, dtype=np.int8)
    kind[1:][same & solid[:-1]] |= _LED
    kind[:-1][same & solid[1:]] |= _FOLLOWED
    brief = f["everywhere"][at] != 0
    return at[brief], kind[brief]


def _uses(batches):
    """(key, doc, kind) per article and key, from batches of (doc, info, head, all)."""
    for batch in batches:
        row, f, _ = _columns(batch)
        heads, doc = batch.column("head").to_numpy().view(np.uint64), batch.column("doc").to_numpy()
        own = np.flatnonzero(f["there"] & (f["own"] != 0))
        brief, kind = _places(row, f)
        parts = [(row[own], f["own"][own], np.full(len(own), _COUNTS, np.int8)), (row[brief], f["everywhere"][brief], kind)]
        for name in ("head", "tail"):
            asked = np.flatnonzero((f[name] != 0) & (f[name] != heads[row]))
            parts.append((row[asked], f[name][asked], np.zeros(len(asked), np.int8)))
        parts.append((np.arange(batch.num_rows), heads, np.full(batch.num_rows, _TITLED, np.int8)))
        parts.append((np.arange(batch.num_rows), batch.column("all").to_numpy().view(np.uint64), np.full(batch.num_rows, _COUNTS, np.int8)))
        r, k, kinds, _ = _per_article(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(doc[r]), pa.array(kinds)], ["key", "doc", "kind"])


def line_counts(texts: DataFrame) -> DataFrame:
    """(doc, known): per article, by the hash of its identifier, the keys of its lines that stand in another article too or are a title, with exact counts.

    A key that isn't named there stands in this article alone.  Two identifiers of
    equal hash do no harm, as a key's counts are the same for all articles.
    """
    keyed = _keyed(texts).select("article_id", "stamp", "info", "head", "all")
    latest = latest_only(keyed).dropDuplicates(["article_id"]).select(F.xxhash64("article_id").alias("doc"), "info", "head", "all")
    uses = materialize(latest.mapInArrow(_uses, "key long, doc long, kind byte"), "p3-uses")

    def has(mark: int) -> F.Column:
        return F.col("kind").bitwiseAND(F.lit(mark).cast("byte")) != 0

    counts = uses.where("kind <> 0").groupBy("key").agg(F.count_if(has(_COUNTS)).alias("n"), F.count_if(has(_LED)).alias("led"), F.count_if(has(_FOLLOWED)).alias("followed"), F.bool_or(has(_TITLED)).alias("titled"))
    asked = uses.where(f"kind <> {_TITLED}").select("key", "doc")
    found = asked.join(counts.where("n > 1 OR titled"), "key")
    return materialize(found.groupBy("doc").agg(F.collect_list(F.struct("key", "n", "led", "followed", "titled")).alias("known")), "p3-counts")


def _with_counts(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Keyed texts with the counts of their lines."""
    return _keyed(texts.withColumn("doc", F.xxhash64("article_id")).join(counts, "doc", "left"))


def _pages(batch: pa.RecordBatch):
    """(row, numbers of the non-blank lines, the page as in `page_features`) of each row of a batch."""
    row, f, offsets = _columns(batch)
    head = batch.column("head").to_numpy().view(np.uint64)[row] if len(row) else np.zeros(0, np.uint64)
    flat = batch.column("known").flatten()
    keys, first = np.unique(flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
    counts = {name: flat.field(name).to_numpy(zero_copy_only=False)[first] for name in ("n", "led", "followed", "titled")}

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and where."""
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)), at

    def count(wanted: np.ndarray, name: str, alone: np.ndarray) -> np.ndarray:
        """The count of each key; of one that isn't known, that in its own article."""
        there, at = find(wanted)
        out = alone.astype(np.int64)
        out[there] = counts[name][at[there]]
        return np.where(wanted == 0, 0, out)

    def is_title(wanted: np.ndarray) -> np.ndarray:
        there, at = find(wanted)
        there[there] = counts["titled"][at[there]]
        return there & (wanted != 0) & (wanted != head)

    brief, kind = _places(row, f)
    _, _, kinds, at = _per_article(row[brief], f["everywhere"][brief], kind)
    own_kind = np.zeros(len(row), dtype=np.int8)
    own_kind[brief] = kinds[at]
    one = np.ones(len(row), dtype=np.int64)
    own, everywhere = count(f["own"], "n", one), count(f["everywhere"], "n", one)
    other, tail = is_title(f["head"]), is_title(f["tail"])
    places = np.maximum(everywhere, 1)
    led, followed = (count(f["everywhere"], name, own_kind & mark != 0) / places for name, mark in (("led", _LED), ("followed", _FOLLOWED)))
    pages = count(batch.column("all").to_numpy().view(np.uint64), "n", np.ones(batch.num_rows, dtype=np.int64))
    titles, sources = (batch.column(c).to_pylist() for c in ("title", "source"))
    shown = np.flatnonzero(f["there"])
    lines = batch.column("lines").flatten().to_numpy(zero_copy_only=False)[shown].tolist()
    no = (shown - offsets[row[shown]]).tolist()
    own, everywhere, other, tail, led, followed = (v[shown] for v in (own, everywhere, other, tail, led, followed))
    begin = np.searchsorted(shown, offsets).tolist()
    for r, (a, b) in enumerate(zip(begin, begin[1:])):
        yield r, no[a:b], (lines[a:b], titles[r], sources[r], own[a:b], everywhere[a:b], other[a:b], tail[a:b], led[a:b], followed[a:b], int(pages[r])) if a < b else None


def label_lines(articles: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(article_id, line_no, furniture, odds) of every non-blank line of every article."""
    spark = articles.sparkSession
    counts = line_counts(article_texts(articles))
    # A bounded sample of pages, the same for the same articles in any order.
    sized = article_texts(articles).where(F.length("text") <= SAMPLE_CHARS)
    ids = sized.select("article_id").distinct().orderBy(F.xxhash64("article_id"), "article_id").limit(sample)
    chosen = _with_counts(latest_only(article_texts(articles.join(F.broadcast(ids), "article_id", "left_semi")).where(F.length("text") <= SAMPLE_CHARS)), counts)
    rows = chosen.orderBy("article_id", "stamp").limit(2 * sample).toArrow()
    pages = [p for b in rows.combine_chunks().to_batches() for _, _, p in _pages(b) if p is not None]
    shared = spark.sparkContext.broadcast(fit(pages))

    def per_task(batches):
        w = shared.value
        for batch in batches:
            # A mark for each row, so that the latest row of an article is known even if it has no line.
            none = np.zeros(batch.num_rows)
            row, no, side, odds = [np.arange(batch.num_rows)], [none], [none], [none]
            held = [p for p in _pages(batch) if p[2] is not None]
            done = 0
            for group in _groups(page for _, _, page in held):
                mine = held[done : done + len(group)]
                done += len(group)
                size = [len(kept) for _, kept, _ in mine]
                x, tokens, _ = page_features(group, rules_too=False)
                z = line_costs(w, x, tokens)
                z[x[:, _COL["title"]] > 0] = -MOST  # the headline is the story's by definition, and so are list lines
                listed = (x[:, _COL["bullet"]] > 0) & (x[:, _COL["other_title"]] + x[:, _COL["tail_title"]] == 0)
                z[listed] = np.minimum(z[listed], -2.0)
                z[x[:, _COL["stamp"]] > 0] = MOST  # nothing but a date is a stamp
                row.append(np.repeat([r for r, _, _ in mine], size))
                no.append(np.fromiter(chain.from_iterable(kept for _, kept, _ in mine), dtype=np.int64, count=sum(size)) + 1)
                side.append(cut_pages(z, x, size))
                odds.append(z)
            take = pa.array(np.concatenate(row), pa.int64())
            no, side, odds = np.concatenate(no).astype(np.int32), np.concatenate(side).astype(bool), np.concatenate(odds)
            yield pa.RecordBatch.from_arrays([batch.column("article_id").take(take), batch.column("stamp").take(take), pa.array(no), pa.array(side), pa.array(odds)], ["article_id", "stamp", "line_no", "furniture", "odds"])

    labelled = _with_counts(article_texts(articles), counts).mapInArrow(per_task, "article_id string, stamp struct<at: bigint, h: bigint>, line_no int, furniture boolean, odds double")
    return latest_only(labelled).where("line_no > 0").drop("stamp").dropDuplicates(["article_id", "line_no"])


def furniture_lines(articles: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(article_id, line_no) of the lines that belong to the page and not to the story."""
    return label_lines(articles, sample).where("furniture").select("article_id", "line_no")
