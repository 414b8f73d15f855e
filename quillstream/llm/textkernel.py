"""Vectorised text kernel: words, shingles and rolling hashes over whole Arrow batches.

Every function works on one *batch* of texts that was joined into one array of
code points, so the cost per character is a few numpy passes and never a Python
loop.  Hashes are 64-bit and only ever propose candidates; every operator
checks the words or characters themselves, or accepts the (documented) chance
of a 64-bit collision where equality of hashed shingles is what is counted.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """True for the code points that are letters or digits."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Batch:
    """Code points of all texts, each followed by one zero; `start` has one entry more than texts."""

    cp: np.ndarray
    start: np.ndarray

    @property
    def size(self) -> int:
        return len(self.start) - 1


def encode(texts: list[str | None], lower: bool = False) -> Batch:
    """Join texts (None counts as empty) into one array of code points."""
    texts = [(t.lower() if lower else t) if t else "" for t in texts]
    start = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)), out=start[1:])
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if texts else np.zeros(0, np.uint32)
    return Batch(cp, start)


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the hash of any stretch is the difference of two of them."""
    up, _ = _power(len(cp) + 1)
    out = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(0x1B873593)) * up[: len(cp)], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [lo, hi), equal for equal content wherever it stands."""
    _, down = _power(len(prefix))
    return mix64((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _MIX2)


@dataclass
class Words:
    """Hash of every word, the text it stands in, and where it begins and ends in the batch."""

    hash: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray  # per text: index of its first word; one entry more than texts


def words(batch: Batch) -> Words:
    """Unbroken runs of letters or digits, in the order they stand."""
    inside = np.zeros(len(batch.cp) + 2, dtype=bool)
    inside[1:-1] = alnum_table()[batch.cp]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = edge[0::2], edge[1::2]
    first = np.searchsorted(lo, batch.start)
    doc = np.repeat(np.arange(batch.size), np.diff(first))
    return Words(stretch_hash(prefix_hash(batch.cp), lo, hi), doc, lo, hi, first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words within a text, and the index of each run's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _BASE + w.hash[i : n + i]
    return mix64(h[at]), at


def distinct_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop repeats of a hash within a text; the result is ordered by text, then hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
