"""Vectorised words and word hashes of text batches.

A word is a run of code points other than space and tab..carriage return, after A-Z
are lower-cased. Both steps touch single bytes only, so they work on UTF-8 directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 20240229
#: Texts are worked on in chunks of about so many bytes; one longer text makes a chunk of its own.
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (shift-multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(_SEED))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunks(texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts), each chunk about limit bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = encoded(t)
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def spans_hash(a: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """uint64 hash of the bytes a[start:stop] of each span, the same wherever they stand."""
    up, down = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


class Words:
    """Words of a chunk: doc (index of the text), start and stop (bytes of buf), hash (uint64)."""

    def __init__(self, parts: list[bytes], hashes: bool = True):
        self.n_docs = len(parts)
        self.buf = (b"\n".join(parts) + b"\n").translate(_LOWER)
        a = np.frombuffer(self.buf, np.uint8)
        space = _IS_SPACE[a]
        word = ~space
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.stop = edge[0::2], edge[1::2]
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends)))  # of each text's words
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        if hashes:
            self.hash = spans_hash(a, self.start, self.stop)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.stop[i]]


def shingle_sets(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct shingles of each text, sorted; a text of fewer words has its whole sequence as one."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.concatenate((w.hash, np.zeros(size - 1, np.uint64)))
    n, k = len(w.hash), np.uint64(0x2545F4914F6CDD1D)
    left = np.repeat(w.first[1:], w.count) - np.arange(n)  # words from here to the text's end
    short = np.repeat(np.minimum(w.count, size), w.count)
    s = np.zeros(n, np.uint64)
    for j in range(size):
        s = np.where(j < short, mix(s * k + h[j : j + n] + np.uint64(j + 1)), s)
    keep = left >= short
    doc, s = w.doc[keep], s[keep]
    out_doc, out_hash = [], []
    bounds = np.searchsorted(doc, np.arange(w.n_docs + 1))
    for d in range(w.n_docs):
        if bounds[d] < bounds[d + 1]:
            u = np.unique(s[bounds[d] : bounds[d + 1]])
            out_hash.append(u)
            out_doc.append(np.full(len(u), d))
    return np.concatenate(out_doc), np.concatenate(out_hash)


def tokens(text: str | None) -> list[str]:
    """The same words, plainly; used by tests and the slow ends of operators."""
    import re

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)
