"""Texts cut into pre-tokens where a byte-level vocabulary is cut anyway, with vectorised hashes."""

from __future__ import annotations

import numpy as np

from strandline.llm.words import spans_hash

_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True  # ASCII but white space and control characters
_HEAD = _MARK.copy()
_HEAD[0xC3:0xF5] = True
_HEAD[[0xE1, 0xE2, 0xE3]] = False  # these, and 0xC2, may begin white space beyond ASCII


#: White space, '<' (which added tokens begin with), and bytes that may begin white space beyond ASCII.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Pieces:
    """Pieces of a chunk: start and stop (bytes of buf), hash (uint64), and first, the index of each text's first piece.

    A piece begins with each text, at a space before a character that isn't white space, and
    after a line break between two such characters. An empty text has no piece.
    """

    def __init__(self, parts: list[bytes]):
        self.buf = b"".join(parts)
        a = np.frombuffer(self.buf, np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        cut = np.zeros(len(a) + 1, bool)
        if len(a) > 1:
            cut[:-2] |= (a[:-1] == 0x20) & _HEAD[a[1:]]
        if len(a) > 2:
            cut[2:-1] |= _MARK[a[:-2]] & (a[1:-1] == 0x0A) & _HEAD[a[2:]]
        cut[begins] = True
        cut[len(a)] = False
        self.start = np.flatnonzero(cut)
        self.stop = np.concatenate((self.start[1:], [len(a)])) if len(self.start) else self.start
        self.first = np.searchsorted(self.start, np.concatenate((begins, [len(a)])))
        self.hash = spans_hash(a, self.start, self.stop)

    def piece(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.stop[i]]

    def bare(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stop without a line break at the end, whether nothing odd is left but a space at the start) of the pieces."""
        a = np.frombuffer(self.buf, np.uint8)
        odd = np.concatenate(([0], np.cumsum(_ODD[a])))
        start, stop = self.start[at], self.stop[at]
        stop = stop - (a[stop - 1] == 0x0A)
        space = a[start] == 0x20
        return stop, (stop - start > space) & (odd[stop] - odd[start] == space)
