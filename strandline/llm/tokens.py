"""Token counts under a unigram model, by dynamic programming shared over a trie.

The pieces are a public vocabulary's. Tokenizers aren't trained here, so piece r (by its id,
the order in which it was merged) has the log-probability -ln(r + 1) - c of a Zipf law. The
distinct pre-tokens of a batch form a trie; forward scores depend on the prefix only, so each
trie node is scored once, and the node where a pre-token ends stores its token count. Texts
are counted as they are: case and white space are kept.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.pieces import Pieces
from strandline.llm.words import Words, chunks
from strandline.session import ensure_workers

#: A byte without a piece costs one token at UNKNOWN. Pre-tokens longer than LONG bytes are scored along, without the trie.
UNKNOWN, LONG = -25.0, 256


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write it by."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str | None = None) -> dict[bytes, float]:
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = _printable()
    out = {}
    for piece, i in vocab.items():
        if all(c in back for c in piece):
            out[bytes(back[c] for c in piece)] = -float(np.log(i + 1.0)) - 2.4
    return out


class Trie:
    """Pre-tokens and their token counts; kept over batches up to `most` nodes, then begun anew."""

    def __init__(self, vocab: dict[bytes, float], most: int = 2_000_000):
        self.vocab, self.most = vocab, most
        self.longest = max(map(len, vocab), default=1)
        self.clear()

    def clear(self):
        self.child: list[dict[int, int]] = [{}]
        self.best = [(0.0, 0)]  # of the prefix: forward score, tokens of the best split
        self.ends: dict[bytes, int] = {}

    def _forward(self, word: bytes, end: int, before) -> tuple[float, int]:
        """(score, -tokens) of the best split of word[:end]; before(a) has that of word[:a]."""
        best = None
        for a in range(max(0, end - self.longest), end):
            s = self.vocab.get(word[a:end])
            if s is None:
                if a < end - 1:
                    continue
                s = UNKNOWN
            score, n = before(a)
            if best is None or (score + s, n - 1) > best:
                best = (score + s, n - 1)
        return best

    def _along(self, word: bytes) -> int:
        """The count of a long pre-token; scores of its last `longest` prefixes are all that is held."""
        held, size = [(0.0, 0)] * (self.longest + 1), self.longest + 1
        for end in range(1, len(word) + 1):
            held[end % size] = self._forward(word, end, lambda a: held[a % size])
        return -held[len(word) % size][1]

    def count(self, word: bytes) -> int:
        """Tokens of the best split; of equal scores the one with fewer tokens."""
        known = self.ends.get(word)
        if known is not None:
            return known
        if len(word) > LONG:
            return self._along(word)
        if len(self.child) > self.most:
            self.clear()
        path, node = [0], 0
        for i, byte in enumerate(word):
            nxt = self.child[node].get(byte)
            if nxt is None:
                best = self._forward(word, i + 1, lambda a: self.best[path[a]])
                nxt = len(self.child)
                self.child[node][byte] = nxt
                self.child.append({})
                self.best.append(best)
            node = nxt
            path.append(node)
        self.ends[word] = -self.best[node][1]
        return self.ends[word]


def _counted(path: str | None):
    def run(batches):
        trie = Trie(pieces(path))
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, parts in chunks(pdf["text"]):
                p = Pieces(parts)
                kinds, at, back = np.unique(p.hash, return_index=True, return_inverse=True)
                words = [p.piece(i) for i in at]
                n = np.zeros(len(kinds), np.int64)
                for j in sorted(range(len(words)), key=words.__getitem__):
                    n[j] = trie.count(words[j])
                sums = np.concatenate(([0], np.cumsum(n[back])))
                w = Words(parts, hashes=False)
                yield pd.DataFrame({"doc_id": ids[first : first + len(parts)], "n_words": w.count, "n_tokens": np.diff(sums[p.first])})
    return run


def count(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs (doc_id, text).

    n_words counts runs of code points other than space and tab..carriage return. n_tokens
    counts the pieces of the whole text's bytes, as it is; pre-tokens are those of
    pieces.Pieces, no vocabulary piece reaching over their ends. Null and empty texts have 0.
    Null ids and repeated rows are counted each; other columns are ignored whatever their
    names. Empty input gives no rows. vocabulary: a path readable on each worker.
    """
    ensure_workers(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_counted(vocabulary), "doc_id string, n_words long, n_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
