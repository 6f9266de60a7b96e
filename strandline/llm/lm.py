"""Language-model scoring with a log-frequency Bloom filter.

Counts of all words and word pairs, those seen once included, are quantised to
q = floor(2 log2 c) and each n-gram is put into the filter with 0..q; its count is read back
by probing q = 0, 1, ... until a probe fails. The filter is blocked: an n-gram's probes stay
in one block, so blocks are built apart from each other and their number follows what is
inserted, without a bound. A filter too large to broadcast is probed where its blocks are: each
chunk of texts sends the hashes of its distinct n-grams there and gets a byte for each.
Single words have P(w) = (q(w) + 1/2) / (sum of all q + (V + 1) / 2), q being the count read
back; pairs P(w | v) = LAMBDA * min(q(v w), q(v)) / q(v) + (1 - LAMBDA) * P(w).
Base scores use exact word counts: the most frequent words are broadcast, up to a bound, and
tokens of all other words are joined.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fetch import fetched
from strandline.llm.sampling import remainder
from strandline.llm.words import Words, chunks, mix
from strandline.session import dropped, ensure_workers, stored

#: A block of BLOCK_BITS bits takes so many insertions on average (17 % of its bits set); up to MOST_BLOCKS (256 MB) the filter is broadcast.
BLOCK_BITS, INSERTIONS_A_BLOCK, MOST_BLOCKS, PROBES = 1 << 15, 1 << 11, 1 << 16, 3
#: Exact counts of so many words, the most frequent ones, are broadcast at most (16 bytes each).
BROADCAST_WORDS, MOST_FLOOR = 1_000_000, 1_000
#: Blocks that are filled together.
BLOCKS_A_CALL = 64
#: N-grams that a task holds before it passes their counts on.
HELD = 2_000_000
#: Tokens of a chunk of texts that asks for counts together, on average.
ASKING = 1_000_000
#: Shares of the chunks that ask one after the other, as what they send takes up disk until it is answered.
TURNS = 4
LAMBDA = 0.6
END = np.uint64(0x51ED270B35B1A9C7)
_LEVELS = 80


def _sequence(w: Words):
    """(text, token hash, hash of the token before, 0 at a text's start), the end token of each text included."""
    doc = np.concatenate((w.doc, np.arange(w.n_docs)))
    order = np.argsort(doc, kind="stable")
    token = np.concatenate((w.hash, np.full(w.n_docs, END)))[order]
    doc = doc[order]
    before = np.concatenate((np.zeros(1, np.uint64), token[:-1]))
    before[np.concatenate(([True], doc[1:] != doc[:-1]))] = 0
    return doc, token, before


def _pair(before, token):
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(token + np.uint64(77)))


def _summed(held):
    """(kind, h, n) of held (kind, h, n) arrays, each n-gram once."""
    for kind in (1, 2):
        h = np.concatenate([x for k, x, _ in held if k == kind] or [np.zeros(0, np.uint64)])
        n = np.concatenate([x for k, _, x in held if k == kind] or [np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        for a in range(0, len(first), 1 << 18):
            at = first[a : a + (1 << 18)]
            end = first[a + (1 << 18)] if a + (1 << 18) < len(first) else len(h)
            yield pd.DataFrame({"kind": np.full(len(at), kind), "h": h[at].view(np.int64), "n": np.add.reduceat(n[:end], at)})


def _grams(batches):
    held, size = [], 0
    for pdf in batches:
        for _, parts in chunks(pdf["text"]):
            _, token, before = _sequence(Words(parts))
            for kind, h in ((1, token), (2, _pair(before, token))):
                k, n = np.unique(h, return_counts=True)
                held.append((kind, k, n))
                size += len(k)
            if size > HELD:
                yield from _summed(held)
                held, size = [], 0
    yield from _summed(held)


def _mixed(h: np.ndarray, q):
    return mix(h * np.uint64(31) + q * np.uint64(0x2545F4914F6CDD1D))


def _slot(x: np.ndarray, i: int):
    """The bit place of probe i within a block."""
    return ((x >> np.uint64(15 * i + 4)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def _slots(h: np.ndarray, q: np.ndarray):
    """(len, PROBES) bit places within a block, from one 64-bit hash."""
    x = _mixed(h, q.astype(np.uint64))
    return np.stack([_slot(x, i) for i in range(PROBES)], axis=1)


def _packed(blocks: int):
    """(call, h, q): the hashes and quantised counts of up to HELD n-grams that go into one call of _fill, as bytes.

    A row a call instead of a row an n-gram moves the eight bytes of a hash and the one of a count, which is mostly 0, and little else.
    """
    def rows(held):
        h, q = (np.concatenate(x) for x in zip(*held, strict=True))
        call = (h % np.uint64(blocks) // np.uint64(BLOCKS_A_CALL)).astype(np.int32)
        order = np.argsort(call, kind="stable")
        h, q, call = h[order], q[order], call[order]
        first = np.flatnonzero(np.concatenate(([True], call[1:] != call[:-1])))
        cuts = np.append(first, len(h)).tolist()
        for a in range(0, len(first), 1 << 10):
            at = range(a, min(a + (1 << 10), len(first)))
            yield pd.DataFrame({"call": call[first[at.start : at.stop]], "h": [h[cuts[i] : cuts[i + 1]].tobytes() for i in at], "q": [q[cuts[i] : cuts[i + 1]].tobytes() for i in at]})

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            if len(pdf):
                held.append((pdf["h"].to_numpy().view(np.uint64), pdf["q"].to_numpy(np.int8)))
                size += len(pdf)
            if size > HELD:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)
    return run


def _fill(blocks: int):
    """The bits of BLOCKS_A_CALL neighbouring blocks, those with insertions, from rows of _packed."""
    def run(key, pdf):
        first = int(key[0]) * BLOCKS_A_CALL
        each = np.frombuffer(b"".join(pdf["h"]), np.uint64)
        q = np.frombuffer(b"".join(pdf["q"]), np.int8).astype(np.int64) + 1
        h = np.repeat(each, q)
        row = np.repeat((each % np.uint64(blocks)).astype(np.int64) - first, q)
        step = np.arange(len(h)) - np.repeat(np.cumsum(q) - q, q)
        bits = np.zeros((BLOCKS_A_CALL, BLOCK_BITS), bool)
        bits[row[:, None], _slots(h, step)] = True
        used = np.unique(row)
        return pd.DataFrame({"block": first + used, "bits": [x.tobytes() for x in np.packbits(bits[used], axis=1)]})
    return run


class Filter:
    """The filter's bits and its reader."""

    def __init__(self, blocks: int, rows, first: int = 0, held: int | None = None):
        """rows have the bits of some of the `held` blocks (all) from the one numbered first on."""
        self.blocks, self.first = blocks, first
        self.bits = np.zeros((blocks if held is None else held, BLOCK_BITS // 8), np.uint8)
        for r in rows:
            self.bits[r.block - first] = np.frombuffer(r.bits, np.uint8)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The quantised count of each hash, 0 if absent."""
        kinds, back = np.unique(h, return_inverse=True)
        return self.distinct(kinds)[back]

    def distinct(self, kinds: np.ndarray) -> np.ndarray:
        """counts() of hashes of which none comes twice."""
        return _of_levels(self.levels(kinds))

    def levels(self, kinds: np.ndarray) -> np.ndarray:
        """The highest q of each hash, -1 if absent; a probe is read only where those before it hit."""
        place = ((kinds % np.uint64(self.blocks)).astype(np.int64) - self.first) * (BLOCK_BITS // 8)
        bits, found, live = self.bits.reshape(-1), np.full(len(kinds), -1), np.arange(len(kinds))
        for q in range(_LEVELS):
            x = _mixed(kinds[live], np.array([q], np.uint64))
            for i in range(PROBES):
                s = _slot(x, i)
                hit = np.flatnonzero(bits[place[live] + (s >> 3)] >> (7 - (s & 7)).astype(np.uint8) & 1)
                live, x = live[hit], x[hit]
            if not len(live):
                break
            found[live] = q
        return found


def _of_levels(q: np.ndarray) -> np.ndarray:
    """The count of each level, 0 below 0."""
    return np.where(q < 0, 0.0, 2.0 ** ((q + 0.5) / 2))


def read_back(n):
    """The count that the filter gives for a count n >= 1."""
    return 2.0 ** ((np.floor(2 * np.log2(n)) + 0.5) / 2)


def _probability(one, prior, two, total: float, kinds: int):
    """total: of the counts as read back."""
    p1 = (one + 0.5) / (total + 0.5 * (kinds + 1))
    two = np.minimum(two, prior)
    return np.where(prior > 0, LAMBDA * two / np.where(prior > 0, prior, 1.0) + (1 - LAMBDA) * p1, p1)


def _scored(bc, table_bc, total: int, kinds: int, total_q: float):
    """Scores by the filter (bc; None: left at 0), base scores of tokens in the table, and the other tokens with their numbers."""
    def run(batches):
        h, c = table_bc.value
        for pdf in batches:
            ids, rows = pdf["doc_id"].to_numpy(), pdf["row"].to_numpy()
            for first, parts in chunks(pdf["text"]):
                doc, token, before = _sequence(Words(parts))
                n, score = len(parts), np.zeros(len(parts))
                words, of = np.unique(token, return_inverse=True)  # a chunk's words are looked up once
                if bc is not None:
                    one = bc.value.distinct(words)[of]
                    prior = np.where(before == 0, 0.0, np.concatenate(([0.0], one[:-1])))
                    p = _probability(one, prior, bc.value.counts(_pair(before, token)), total_q, kinds)
                    score = np.bincount(doc, np.log10(p), n)
                at = np.minimum(np.searchsorted(h, words), max(len(h) - 1, 0))
                there = h[at] == words if len(h) else np.zeros(len(words), bool)
                listed, exact = there[of], np.where(there, c[at] if len(h) else 0, 0)[of]
                base = np.where(listed, np.log10((exact + 0.5) / (total + 0.5 * (kinds + 1))), 0.0)
                rest = np.flatnonzero(~listed)
                rest = rest[np.lexsort((token[rest], doc[rest]))]
                new = np.concatenate(([True], (doc[rest][1:] != doc[rest][:-1]) | (token[rest][1:] != token[rest][:-1]))) if len(rest) else np.zeros(0, bool)
                start = np.flatnonzero(new)
                k, other = np.diff(np.concatenate((start, [len(rest)]))), rest[start]
                cuts = np.searchsorted(doc[other], np.arange(n + 1))
                yield pd.DataFrame({
                    "doc_id": ids[first : first + n], "row": rows[first : first + n], "n_tokens": np.bincount(doc, minlength=n), "score": score,
                    "n_known": np.bincount(doc, listed, n).astype(np.int64), "base_score": np.bincount(doc, base, n),
                    "h": [token[other[a:b]].view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "k": [k[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})
    return run


def _kinds(texts, blocks: int):
    """Hashes of the distinct n-grams of texts, sorted, their order by the call of _fill that has their block, and the calls in it."""
    held = [np.zeros(0, np.uint64)]
    for _, parts in chunks(texts):
        _, token, before = _sequence(Words(parts))
        held += [np.sort(token), _pair(before, token)]
        held[-2] = held[-2][np.concatenate(([True], held[-2][1:] != held[-2][:-1]))]
    kinds = np.sort(np.concatenate(held))
    kinds = kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))] if len(kinds) else kinds
    call = (kinds % np.uint64(blocks) // np.uint64(BLOCKS_A_CALL)).astype(np.uint16 if blocks < BLOCKS_A_CALL << 16 else np.int32)
    order = np.argsort(call, kind="stable")  # of two bytes: sorted by digits
    return kinds, order, call[order].astype(np.int32)


def _places(kinds: np.ndarray):
    """A function of hashes, all among kinds (sorted): where they stand. They are spread evenly, so their first bits nearly tell."""
    bits = max(1, int(len(kinds)).bit_length())
    shift = np.uint64(64 - bits)
    start = np.searchsorted(kinds >> shift, np.arange(1 << bits, dtype=np.uint64))

    def of(h):
        at = start[(h >> shift).astype(np.int64)]
        live = np.flatnonzero(kinds[at] != h)
        while len(live):
            at[live] += 1
            live = live[kinds[at[live]] != h[live]]
        return at
    return of


def _asked(blocks: int):
    """chunk, call, h: the distinct n-grams of a chunk of texts, a row a call, eight bytes an n-gram."""
    def run(key, pdf):
        kinds, order, call = _kinds(pdf["text"], blocks)
        first = np.flatnonzero(np.concatenate(([True], call[1:] != call[:-1])))
        return pd.DataFrame({"chunk": np.full(len(first), key[0], np.int64), "call": call[first], "h": [x.tobytes() for x in np.split(kinds[order], first[1:])]})
    return run


def _answered(blocks: int):
    """chunk, call, q: a level a hash of _asked, a byte each."""
    def run(key, asked, filled):
        first = int(key[0]) * BLOCKS_A_CALL
        bits = Filter(blocks, filled.itertuples(index=False), first, BLOCKS_A_CALL)
        sizes = [len(x) // 8 for x in asked["h"]]
        h = np.frombuffer(b"".join(asked["h"]), np.uint64)
        q = np.concatenate([bits.levels(h[a : a + HELD]) for a in range(0, len(h), HELD)] or [np.zeros(0)]).astype(np.int8)
        return pd.DataFrame({"chunk": asked["chunk"], "call": asked["call"], "q": [x.tobytes() for x in np.split(q, np.cumsum(sizes)[:-1])] if sizes else []})
    return run


def _weighed(blocks: int, total: float, kinds: int):
    """row, score of the texts of a chunk, by the answers to what _asked sends for it."""
    def run(texts, answers):
        if not len(texts):
            return pd.DataFrame({"row": np.zeros(0, np.int64), "score": np.zeros(0)})
        texts = texts.drop_duplicates("row")
        known, order, _ = _kinds(texts["text"], blocks)
        q = np.empty(len(known), np.int8)
        q[order] = np.frombuffer(b"".join(answers.sort_values("call")["q"]), np.int8)
        table, places, score = _of_levels(np.arange(-1, _LEVELS)), _places(known), []
        counts = lambda h: table[q[places(h)].astype(np.int64) + 1]
        for _, parts in chunks(texts["text"]):
            doc, token, before = _sequence(Words(parts))
            one = counts(token)
            prior = np.where(before == 0, 0.0, np.concatenate(([0.0], one[:-1])))
            score.append(np.bincount(doc, np.log10(_probability(one, prior, counts(_pair(before, token)), total, kinds)), len(parts)))
        return pd.DataFrame({"row": texts["row"], "score": np.concatenate(score)})
    return run


def _sent_model(rows: DataFrame, filled: DataFrame, blocks: int, total: float, kinds: int, tokens: int) -> DataFrame:
    """row, score of each distinct row of rows (row, text), of so many tokens; no part of the filter but a call's blocks is held at once.

    What is moved is the texts, twice, eight bytes a distinct n-gram of a chunk, and one byte back.
    """
    dealt = rows.withColumn("chunk", F.expr(f"pmod(row, {max(1, -(-tokens // ASKING))})"))
    there = filled.withColumn("call", F.expr(f"cast(block div {BLOCKS_A_CALL} AS int)"))
    answers = []
    for turn in range(TURNS):
        asked = dealt.where(F.col("chunk") % TURNS == turn).groupBy("chunk").applyInPandas(_asked(blocks), "chunk long, call int, h binary")
        answers.append(stored(asked.groupBy("call").cogroup(there.groupBy("call")).applyInPandas(_answered(blocks), "chunk long, call int, q binary")))
    answers = reduce(DataFrame.unionByName, answers)
    return stored(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_weighed(blocks, total, kinds), "row long, score double"))


def score(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Null texts are empty and have the end token only. Training rows are those whose
    crc32(doc_id as text) mod 5 is not 1; null ids don't train and aren't held out. Repeated
    rows train and come back each. Without training rows N and V are 0 and every token has
    log10(1). Other columns are ignored whatever their names. Empty input gives no rows.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    train = docs.where(remainder("doc_id", 5) != 1).select("text")
    grams = stored(train.mapInPandas(_grams, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")))
    words = stored(grams.where("kind = 1").select("h", "n"))
    level = F.expr(f"least(floor(2 * log2(n) + 1e-9), {_LEVELS - 1})")  # log2 of 8 is not quite 3 there
    sums = words.agg(F.sum("n"), F.count("*"), F.sum(F.pow(F.lit(2.0), (level + 0.5) / 2))).first()
    total, kinds, total_q = int(sums[0] or 0), int(sums[1]), float(sums[2] or 0.0)
    insertions = int(grams.agg(F.sum(level + 1)).first()[0] or 0)
    blocks = max(1, -(-insertions // INSERTIONS_A_BLOCK))
    # only what the filter keeps is moved again: the hash and the quantised count
    placed = grams.select("h", level.cast("tinyint").alias("q")).mapInPandas(_packed(blocks), "call int, h binary, q binary")
    filled = stored(placed.groupBy("call").applyInPandas(_fill(blocks), "block int, bits binary"))
    dropped(grams)
    small = blocks <= most_blocks
    bc = spark.sparkContext.broadcast(Filter(blocks, filled.toLocalIterator())) if small else None
    if small:
        dropped(filled)
    # the least count from which on words fit the broadcast table
    by = {r["c"]: r["w"] for r in words.groupBy(F.least("n", F.lit(MOST_FLOOR)).alias("c")).agg(F.count("*").alias("w")).collect()}
    floor = next((c for c in range(1, MOST_FLOOR + 1) if sum(w for n, w in by.items() if n >= c) <= broadcast_words), None)
    t = fetched(words.where(F.col("n") >= floor if floor else F.lit(False)))
    order = np.argsort(t["h"].view(np.uint64))
    table = spark.sparkContext.broadcast((t["h"].view(np.uint64)[order], t["n"][order]))
    # rows alike in id and text share a key and are alike in all that follows
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    out = stored(keyed.mapInPandas(_scored(bc, table, total, kinds, total_q), "doc_id string, row long, n_tokens long, score double, n_known long, base_score double, h array<long>, k array<long>"))
    if floor != 1:
        rest = words.where(F.col("n") < floor) if floor else words
        asked = out.where(F.size("h") > 0).dropDuplicates(["row"]).select("row", F.explode(F.arrays_zip("h", "k")).alias("x")).select("row", "x.h", "x.k")
        base = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / (total + 0.5 * (kinds + 1)))
        more = asked.join(rest.hint("merge"), "h", "left").groupBy("row").agg(F.sum(F.expr("CASE WHEN n > 0 THEN k ELSE 0 END")).alias("known"), F.sum(F.col("k") * base).alias("more"))
    else:
        # what the table doesn't list was never seen
        base = float(np.log10(0.5 / (total + 0.5 * (kinds + 1))))
        more = None
        out = out.withColumn("base_score", F.col("base_score") + F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x) * base)
    if more is not None:
        out = out.join(more.hint("merge"), "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0)))
    if not small:
        rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
        tokens = int(out.agg(F.sum("n_tokens")).first()[0] or 0)
        out = out.drop("score").join(_sent_model(rows, filled, blocks, total_q, kinds, tokens).hint("merge"), "row")
    held = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), held, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
