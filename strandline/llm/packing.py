"""Packing token sequences into windows by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.pieces import Pieces
from strandline.llm.words import chunks
from strandline.session import ensure_workers, stored

WINDOW = 1024
#: About so many documents are packed by one task, at every input size.
BLOCK = 32768
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A piece that keeps its tokens in a line of its own, and so many lines make one text.
LINE, LINES = re.compile(r" ?\S+"), 20
#: A worker's tokenized pieces are forgotten past so many pieces or ids.
MOST_PIECES, MOST_IDS = 1_000_000, 8_000_000


class Tokenized:
    """Token ids of pieces seen before, in one array."""

    def __init__(self, tok):
        self.tok = tok
        line = tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.added = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self):
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and which piece each is
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _put(self, ids) -> int:
        """Where the ids were written."""
        at, self.used = self.used, self.used + len(ids)
        while self.used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[at : self.used] = ids
        return at

    def _learn(self, p: Pieces, at: np.ndarray) -> None:
        """Tokenize new pieces: those without inner white space or added tokens as lines of short texts, others alone.

        A line break that ends such a piece is the line's own.
        """
        stop, inline = p.bare(at)
        begin, end = p.start[at], p.stop[at]
        if self.line is None:
            inline[:] = False
        for i in np.flatnonzero(~inline) if self.line is not None else ():
            x = p.buf[begin[i] : stop[i]].decode("utf-8", "surrogatepass")
            inline[i] = LINE.fullmatch(x) is not None and not any(t in x for t in self.added)
        start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        part = np.flatnonzero(inline)
        if len(part):
            lines = [p.buf[a:b] for a, b in zip(begin[part].tolist(), stop[part].tolist(), strict=True)]
            texts = [(b"\n".join(lines[k : k + LINES]) + b"\n").decode("utf-8", "surrogatepass") for k in range(0, len(lines), LINES)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            breaks = np.flatnonzero(ids == self.line)
            first = np.concatenate(([0], breaks[:-1] + 1))
            start[part] = first + self._put(ids)
            size[part] = breaks - first + (end[part] > stop[part])
        alone = np.flatnonzero(~inline)
        whole = [p.buf[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[alone].tolist(), end[alone].tolist(), strict=True)]
        for i, e in zip(alone, self.tok.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            start[i], size[i] = self._put(e.ids), len(e.ids)
        self.start, self.size = np.concatenate((self.start, start)), np.concatenate((self.size, size))

    def of(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, the same as of the whole text at once."""
        if len(self.known) > MOST_PIECES or self.used > MOST_IDS:
            self.clear()
        p = Pieces(parts)
        kinds, at, back = np.unique(p.hash, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, kinds)
        old = np.minimum(slot, max(len(self.known) - 1, 0))
        seen = self.known[old] == kinds if len(self.known) else np.zeros(len(kinds), bool)
        new = np.flatnonzero(~seen)
        place = self.place[old] if len(self.known) else np.zeros(len(kinds), np.int64)
        if len(new):
            place[new] = len(self.start) + np.arange(len(new))
            self._learn(p, at[new])
            self.known = np.insert(self.known, slot[new], kinds[new])
            self.place = np.insert(self.place, slot[new], place[new])
        place = place[back]
        n = self.size[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[place] - ends[:-1], n)]
        bounds = ends[p.first]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _tokenize(path: str | None, window: int):
    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path or vocabulary_path())
        known = Tokenized(tok)
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, parts in chunks(pdf["text"], 1_000_000):
                counts, crcs = [], []
                for found in known.of(parts):
                    a = np.append(found, np.uint32(0))
                    counts.append(len(a))
                    crcs.append([zlib.crc32(a[i : i + window]) for i in range(0, len(a), window)])
                yield pd.DataFrame({"doc_id": ids[first : first + len(parts)], "n": counts, "crcs": crcs})
    return run


def sum_of_squares(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window number, offset) of each piece in turn, and how many windows were opened.

    count[l] is the number of windows filled to l (0 < l < window). A piece goes where the
    sum of squared counts comes out least; opening a window is the choice l = 0. Ties go to
    the fullest window.
    """
    count = np.zeros(window + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(window)]
    seq, off, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    levels = np.arange(window + 1)
    for i, n in enumerate(lengths):
        n = int(n)
        # going from level l to l + n changes the sum by 1 - 2 count[l] + 1 + 2 count[l + n]; a full window isn't counted
        gain = 2 * count[n:].copy() + 1
        gain[-1] = 0
        cost = gain[: window - n + 1] - 2 * count[: window - n + 1] + 1
        cost[0] = gain[0]
        cost[1:][count[1 : window - n + 1] == 0] = np.iinfo(np.int64).max
        level = int(levels[: len(cost)][::-1][np.argmin(cost[::-1])])
        if level:
            w = bins[level].pop()
            count[level] -= 1
        else:
            w, opened = opened, opened + 1
        seq[i], off[i] = w, level
        if level + n < window:
            bins[level + n].append(w)
            count[level + n] += 1
    return seq, off, opened


def _pack(window: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["h", "n"], kind="stable")
        base, doc, n = int(key[0]) << 36, pdf["doc_id"].to_numpy(), pdf["n"].to_numpy()
        rest = n % window
        part = np.flatnonzero(rest)
        seq, off, opened = sum_of_squares(rest[part], window)
        place = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        place[0][part], place[1][part] = seq, off
        pieces = -(-n // window)
        row = np.repeat(np.arange(len(pdf)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(window, n[row] - k * window)
        full = length == window
        sequence = np.where(full, opened + np.cumsum(full) - 1, place[0][row])
        return pd.DataFrame({
            "doc_id": doc[row], "start": k * window, "length": length, "ids_crc32": np.concatenate(list(pdf["crcs"])).astype(np.int64),
            "doc_tokens": n[row], "sequence_id": base + sequence, "offset": np.where(full, 0, place[1][row])})
    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    Each row of docs (doc_id, text) is tokenized whole, and id 0 ends it (null text: only
    that id). It is cut into whole windows and one shorter rest; rests are packed by the
    sum-of-squares rule in blocks of about `block` documents, in hash order. Windows are
    padded to the window's length after their last piece. Rows with a null doc_id come back
    with null; repeated rows are packed each, ties in a block by length. Other columns are
    ignored whatever their names. Empty input gives no rows. vocabulary: a path
    readable on each worker; by default the public byte-level one.
    """
    ensure_workers(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_tokenize(vocabulary, window), "doc_id string, n long, crcs array<long>"))
    h = F.xxhash64("doc_id", "n")
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("h", h).withColumn("block", F.pmod(F.xxhash64("doc_id", "n", "crcs"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_pack(window), PIECES).withColumn("doc_id", F.col("doc_id").cast(kind))
