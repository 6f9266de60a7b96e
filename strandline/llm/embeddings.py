"""Near-duplicate vectors: sign hashing in several tables, exact cosine, components.

Equal directions aren't special; equal vectors are folded into one representative first.
A bucket (label, table, key) of any size is dealt as pairs of blocks of at most BLOCK rows;
each block pair is one matrix product, and a pair that shares buckets of several tables is
counted in the first of them only. A block pair gives counts and a spanning set of links,
never its list of pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.session import ensure_workers, stored

#: Fewest sign bits of a key; they grow with the vectors so that random ones would share a bucket with about BUCKET others.
BITS, MOST_BITS, BUCKET, SEED, BLOCK = 10, 24, 64, 5, 512
#: So many tables that a pair at the least cosine shares a bucket of none with these odds at most.
MISSED = 1e-5
#: Rows that one comparing call takes, about.
ROWS = 8192


def usable(col: str = "embedding"):
    """Not null, not empty, all components finite, and one of them not zero."""
    return F.expr(f"{col} IS NOT NULL AND size({col}) > 0 AND forall({col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({col}, x -> x <> 0)")


def tables(bits: int, least: float, missed: float = MISSED) -> int:
    """A pair at cosine `least` is in one bucket of a table with odds (1 - acos(least) / pi)^bits."""
    same = (1 - np.arccos(least) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(missed) / np.log1p(-same))))


def _keys(batches, bits_of: int, tables_of: int):
    for pdf in batches:
        if not len(pdf):
            continue
        for dim, part in pdf.groupby(pdf["embedding"].map(len)):
            x = np.array(part["embedding"].tolist(), np.float64).reshape(len(part), dim)
            x /= np.abs(x).max(axis=1, keepdims=True)
            planes = np.random.default_rng(SEED + dim).standard_normal((dim, tables_of * bits_of))
            bits = (x @ planes > 0).reshape(len(part), tables_of, bits_of)
            keys = (bits * (1 << np.arange(bits_of))).sum(axis=2).astype(np.int32)
            yield pd.DataFrame({"rep": part["rep"], "copies": part["copies"], "label": part["label"], "dim": np.full(len(part), dim), "embedding": [v.tobytes() for v in np.array(part["embedding"].tolist(), np.float64)], "keys": list(keys)})


def _spanning(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the links of hit (rows x columns) join, fewer than rows + columns of them."""
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    seen = np.zeros(len(right), bool)
    for i in np.flatnonzero(hit.any(axis=1)):
        cols = np.flatnonzero(hit[i])
        # columns seen before are joined with each other only through some row: try one a component
        fresh = cols[~seen[cols]]
        roots = {root(right[j]): right[j] for j in cols[seen[cols]]} if seen[cols].any() else {}
        for v in [*roots.values(), *right[fresh]]:
            x, y = root(left[i]), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(left[i]), int(v)))
        seen[cols] = True
    return out


def _compare(least: float):
    def run(pdf):
        reps, counts, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def put(u, n, v):
            reps.append(u), counts.append(n), others.append(v)

        for dim, part in pdf.groupby("dim"):
            pair = part.groupby(["label", "t", "key", "i", "j"], sort=False).ngroup().to_numpy()
            order = np.lexsort((part["side"].to_numpy(), pair))
            part, pair = part.iloc[order], pair[order]
            x = np.frombuffer(b"".join(part["embedding"]), np.float64).reshape(len(part), int(dim))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            keys = np.array(part["keys"].tolist())
            rep, copies, side, t, i, j = (part[c].to_numpy() for c in ("rep", "copies", "side", "t", "i", "j"))
            edges = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                same, cut = i[first] == j[first], first + int(np.searchsorted(side[first:last], 1))
                left, right = (slice(first, last),) * 2 if same else (slice(first, cut), slice(cut, last))
                hit = x[left] @ x[right].T >= least
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                for k in range(t[first]):
                    hit &= keys[left, k][:, None] != keys[right, k][None, :]
                put(rep[left], hit @ copies[right], rep[left])
                if not same:
                    put(rep[right], hit.T @ copies[left], rep[right])
                links = np.array(_spanning(hit, rep[left], rep[right]), np.int64).reshape(-1, 2)
                put(links[:, 0], np.zeros(len(links), np.int64), links[:, 1])
        out = pd.DataFrame({"rep": np.concatenate(reps), "n": np.concatenate(counts), "v": np.concatenate(others)})
        return out[(out["n"] > 0) | (out["rep"] != out["v"])]
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors are linked if their labels are equal and not null, their lengths are equal and
    their cosine in double precision is at least `least`. Null, empty or zero vectors, and
    those with null or non-finite components, are linked with nothing, and so are rows with a
    null vec_id. Repeated rows of a vec_id come back each and count as separate vectors in
    n_links. Every bucket is compared whole. Other columns are ignored whatever their names.
    Empty input gives no rows.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))
    linkable = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    ok = rows.where(linkable).withColumn("embedding", F.expr("transform(embedding, x -> x + 0D)"))
    ok = ok.withColumn("fp_a", F.xxhash64("embedding")).withColumn("fp_b", F.hash("embedding"))
    members = stored(ok)
    reps = members.groupBy("label", "fp_a", "fp_b").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    bits = int(np.clip(np.ceil(np.log2(max(members.count(), 1) / BUCKET)), BITS, MOST_BITS))
    keys = partial(_keys, bits_of=bits, tables_of=tables(bits, least))
    keyed = stored(reps.select("rep", "copies", "label", "embedding").mapInPandas(keys, f"rep long, copies long, label {dict(vectors.dtypes)['label']}, dim int, embedding binary, keys array<int>"))
    spread = keyed.select("rep", "label", "dim", F.posexplode("keys").alias("t", "key"))
    sizes = spread.groupBy("label", "dim", "t", "key").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    full = keyed.select("*", F.posexplode("keys").alias("t", "key"))
    dealt = full.join(sizes, ["label", "dim", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    # many small block pairs share a call of about ROWS rows
    calls = -(-int(sizes.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0) // ROWS) or 1
    dealt = dealt.withColumn("call", F.pmod(F.xxhash64("label", "dim", "key", "t", "i", "j"), F.lit(calls)))
    found = stored(dealt.select("call", "label", "dim", "key", "t", "i", "j", "side", "rep", "copies", "embedding", "keys")
                   .groupBy("call").applyInPandas(_compare(least), "rep long, n long, v long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(found.where("rep <> v").select(F.col("rep").alias("u"), "v"))
    known = keyed.select("rep", "copies").join(counts, "rep", "left").join(label.select(F.col("node").alias("rep"), "component_id"), "rep", "left")
    ids = reps.select("label", "fp_a", "fp_b", "rep")
    linked = members.select("vec_id", "label", "fp_a", "fp_b").join(ids, ["label", "fp_a", "fp_b"]).join(known, "rep").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = rows.where(~F.coalesce(linkable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
