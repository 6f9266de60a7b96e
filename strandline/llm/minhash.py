"""Near-duplicate documents: similarity sketches, banding, exact verification, components.

Sketch: in each round every shingle of a set is placed in one bin of the sketch by a
hash and a bin keeps the least value, values of earlier rounds being below those of later
ones; from round `bins` on all shingles go into the one bin of that number. A set is done
when each bin is filled, so each coordinate is a fair sample of the set and the share of
equal coordinates estimates the similarity with Chernoff-like concentration.

Equal sets are folded into one node. Nodes share buckets by band key. First each node is
verified against the most central member of its buckets (the one whose buckets are fullest),
which joins most of a group of edited copies. Buckets that still hold several components are
dealt as pairs of blocks; a block pair is screened by sketches, then verified on full sets,
and gives a spanning set of links, never its list of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.words import Words, chunks, mix, shingle_sets
from strandline.session import dropped, ensure_workers, stored

#: Coordinates of a sketch. The first BANDED of them make bands of BAND: a pair at 0.75 shares no band with odds of (1 - 0.75^4)^32 = 5e-6.
BINS, BANDED, BAND = 256, 128, 4
#: A pair whose sketches agree in a smaller share isn't verified; at a similarity of 0.75 that is 5 standard deviations low.
LEAST_AGREEMENT = 0.615
#: Members of a block, and of a hub's share; bytes of sets, and rows of sketches, that one task's call takes, about.
BLOCK, CALL_BYTES, CALL_ROWS = 512, 8_000_000, 16_384


def sketches(doc: np.ndarray, hashes: np.ndarray, n_docs: int, bins: int = BINS) -> np.ndarray:
    """uint64 array (n_docs, bins); texts without shingles stay at the greatest value."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_docs * bins, full, np.uint64)
    open_docs = np.zeros(n_docs, bool)
    open_docs[doc] = True
    bits = np.uint64(54)  # of a value; the round is above it
    for r in range(2 * bins):
        h = mix(hashes ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = (h % np.uint64(bins)).astype(np.int64) if r < bins else np.full(len(h), r - bins)
        np.minimum.at(out, doc * bins + place, (h >> np.uint64(10)) | (np.uint64(r) << bits))
        open_docs &= (out.reshape(n_docs, bins) == full).any(axis=1)
        keep = open_docs[doc]
        if not keep.any():
            break
        doc, hashes = doc[keep], hashes[keep]
    return out.reshape(n_docs, bins)


def band_keys(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key a band, different bands apart."""
    parts = sketch.reshape(len(sketch), -1, band)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(band):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, j])
    return key


def _fingerprints(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    np.add.at(a, doc, mix(hashes + np.uint64(11)))
    np.add.at(b, doc, mix(hashes + np.uint64(23)))
    return a.view(np.int64), b.view(np.int64)


def _sketch_rows(size: int):
    def run(batches):
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, parts in chunks(pdf["text"]):
                w = Words(parts)
                doc, hashes = shingle_sets(w, size)
                n = np.bincount(doc, minlength=w.n_docs)
                sk = sketches(doc, hashes, w.n_docs)
                keys = band_keys(sk[:, :BANDED]).view(np.int64)
                a, b = _fingerprints(doc, hashes, w.n_docs)
                short = mix(sk).astype(np.uint8)
                yield pd.DataFrame({"doc_id": ids[first : first + w.n_docs], "n_shingles": n.astype(np.int64), "fp_a": a, "fp_b": b,
                                    "bands": list(keys), "sketch": [x.tobytes() for x in short]})
    return run


def _set_rows(size: int):
    def run(batches):
        for pdf in batches:
            for first, parts in chunks(pdf["text"]):
                w = Words(parts)
                doc, hashes = shingle_sets(w, size)
                a, b = _fingerprints(doc, hashes, w.n_docs)
                ends = np.searchsorted(doc, np.arange(w.n_docs + 1))
                yield pd.DataFrame({"fp_a": a, "fp_b": b, "shingles": [hashes[ends[i] : ends[i + 1]].tobytes() for i in range(w.n_docs)]})
    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |A & B| >= percent * |A | B| of two sorted arrays without repeats."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs (rows of x, rows of y) whose sketches agree in LEAST_AGREEMENT of the coordinates or more."""
    least, out = int(np.ceil(LEAST_AGREEMENT * x.shape[1])), np.zeros((len(x), len(y)), bool)
    for i in range(len(x)):
        out[i] = np.count_nonzero(y == x[i], axis=1) >= least
    return out


def _hub_links(percent: int):
    """Of rows (hub, node, sketch, shingles), the hub's own among them: the links (u, v) between a hub and its rows."""
    def run(pdf):
        out = []
        for hub, part in pdf.groupby("hub", sort=False):
            own = part[part["node"] == hub]
            if not len(own):
                continue
            rest = part[part["node"] != hub].drop_duplicates("node")
            x = np.frombuffer(b"".join(rest["sketch"]), np.uint8).reshape(len(rest), BINS)
            ok = _agree(np.frombuffer(own["sketch"].iloc[0], np.uint8)[None, :], x)[0]
            mine = np.frombuffer(own["shingles"].iloc[0], np.uint64)
            out += [(hub, v) for v, s in zip(rest["node"][ok], rest["shingles"][ok], strict=True) if similar(mine, np.frombuffer(s, np.uint64), percent)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _block_pairs(pdf):
    """(first, last, rows of the left side) of each block pair of pdf, sorted by pair and side."""
    pair = pdf.groupby(["bucket", "i", "j"], sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["side"].to_numpy(), pair))
    pdf, pair = pdf.iloc[order], pair[order]
    edges = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
    return pdf, list(zip(edges[:-1], edges[1:], strict=True))


def _candidates(part, x, first, last):
    """Left and right rows of a block pair, and which of their pairs lie in different components and agree."""
    c, side, i, j = (part[k].to_numpy() for k in ("c", "side", "i", "j"))
    cut = last if i[first] == j[first] else first + int(np.searchsorted(side[first:last], 1))
    left, right = np.arange(first, cut), np.arange(first if cut == last else cut, last)
    hit = c[left][:, None] != c[right][None, :]
    if hit.any():
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        hit[np.ix_(rows, cols)] &= _agree(x[left[rows]], x[right[cols]])
    return left, right, hit


def _screened(pdf):
    """The rows of block pairs that are in some pair worth verifying."""
    part, pairs = _block_pairs(pdf)
    x = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), BINS)
    keep = np.zeros(len(part), bool)
    for first, last in pairs:
        left, right, hit = _candidates(part, x, first, last)
        keep[left[hit.any(axis=1)]] = True
        keep[right[hit.any(axis=0)]] = True
    return part.loc[keep, ["bucket", "i", "j", "side", "node", "c"]]


def _block_links(percent: int):
    """Links that join what the block pairs' links join."""
    def run(pdf):
        part, pairs = _block_pairs(pdf)
        x = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), BINS)
        sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        node, c, parent, out, tried = part["node"].to_numpy(), part["c"].to_numpy(), {}, [], set()

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for first, last in pairs:
            left, right, hit = _candidates(part, x, first, last)
            for a, b in zip(*np.nonzero(hit), strict=True):
                u, v = left[a], right[b]
                key = (min(node[u], node[v]), max(node[u], node[v]))
                if key in tried:
                    continue
                tried.add(key)
                ru, rv = root(c[u]), root(c[v])
                if ru != rv and similar(sets[u], sets[v], percent):
                    parent[max(ru, rv)] = min(ru, rv)
                    out.append((node[u], node[v]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _calls(total: int, each: int) -> int:
    return max(1, -(-int(total or 0) // each))


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, ...).

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of
    distinct `size`-word shingles. Null or empty texts have no set and are linked with
    nothing. A row with a null doc_id is linked with nothing, has a null component_id and is
    kept. Repeated rows come back each; rows of one doc_id with unlike texts are separate
    documents with the same id. Other columns of docs are ignored whatever their names.
    Empty input gives no rows.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    docs = docs.select("doc_id", "text")
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        _sketch_rows(size), "doc_id string, n_shingles long, fp_a long, fp_b long, bands array<long>, sketch binary")
    rows = stored(out.withColumn("doc_id", F.col("doc_id").cast("long")))
    # one node a different set; nodes are named by the set's first fingerprint
    sets_of = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = stored(sets_of.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    spread = nodes.select(F.col("fp_a").alias("node"), F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(spread.join(full.hint("merge"), "bucket"))
    central = members.groupBy("node").agg(F.sum("n").alias("pop"))
    members_pop = members.join(central.hint("merge"), "node")
    hubs = members_pop.groupBy("bucket").agg(F.max(F.struct("pop", "node")).alias("hub"))
    tried = members.select("bucket", "node").join(hubs.hint("merge"), "bucket").where("hub.node <> node").groupBy("node").agg(F.max("hub").alias("hub"))
    tried = stored(tried.select("node", F.col("hub.node").alias("hub")))

    asked = members.select(F.col("node").alias("fp_a")).distinct().join(nodes.select("fp_a", "fp_b", F.col("rep").alias("doc_id")).hint("merge"), "fp_a")
    texts = docs.join(asked.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInPandas(_set_rows(size), "fp_a long, fp_b long, shingles binary").join(asked.select("fp_a", "fp_b").hint("merge"), ["fp_a", "fp_b"], "left_semi")
    sets = sets.groupBy("fp_a").agg(F.first("shingles").alias("shingles")).join(nodes.select("fp_a", "sketch").hint("merge"), "fp_a")
    sets = stored(sets.select(F.col("fp_a").alias("node"), "sketch", "shingles"))
    each = int(sets.agg(F.avg(F.length("shingles"))).first()[0] or 0) + BINS

    sizes = tried.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares"))
    mine = tried.join(sizes.hint("merge"), "hub").select("hub", "node", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"))
    own = sizes.select("hub", F.col("hub").alias("node"), F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    asks = stored(mine.unionByName(own))
    calls = _calls(asks.count() * each, CALL_BYTES)
    links = (asks.join(sets.hint("merge"), "node").withColumn("call", F.pmod(F.xxhash64("hub", "share"), F.lit(calls)))
             .groupBy("call").applyInPandas(_hub_links(percent), "u long, v long"))
    links = stored(links)
    found = stored(components(links))

    # buckets that still hold several components, each different one once
    label = found.select("node", F.col("component_id").alias("c"))
    labelled = members.join(label.hint("merge"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    open_ = labelled.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.sum(F.hash("node").cast("long")).alias("x"), F.sum(F.hash("node", F.lit(1)).cast("long")).alias("y"))
    open_ = open_.where("lo < hi").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = labelled.drop("n").join(open_.hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "c")
    dealt = stored(dealt)
    calls = _calls(dealt.count(), CALL_ROWS)
    call = lambda k: F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(k))
    worth = stored(dealt.join(nodes.select(F.col("fp_a").alias("node"), "sketch").hint("merge"), "node").withColumn("call", call(calls))
                   .groupBy("call").applyInPandas(_screened, "bucket long, i int, j int, side int, node long, c long"))
    calls = _calls(worth.count() * each, CALL_BYTES)
    more = stored(worth.join(sets.hint("merge"), "node").withColumn("call", call(calls)).groupBy("call").applyInPandas(_block_links(percent), "u long, v long"))
    if not more.isEmpty():
        found = stored(components(links.unionByName(more)))
    reps = nodes.select(F.col("fp_a").alias("node"), "rep")
    ids = found.join(reps.hint("merge"), "node")
    least = ids.groupBy("component_id").agg(F.min("rep").alias("least"))
    named = ids.join(least.hint("merge"), "component_id").select(F.col("node").alias("fp_a"), "least")
    named = nodes.select("fp_a", "fp_b", "rep").join(named.hint("merge"), "fp_a", "left").select("fp_a", "fp_b", F.coalesce("least", "rep").alias("least"))
    done = rows.select("doc_id", "n_shingles", "fp_a", "fp_b").join(named.hint("merge"), ["fp_a", "fp_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    done = stored(done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    dropped(rows, nodes, members, tried, sets, asks, links, found, dealt, worth, more)
    return done
