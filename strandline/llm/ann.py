"""Approximate nearest neighbours by largest inner product, with learned partitions.

On a bounded sample: a neighbour graph, a balanced partitioning of it (recursive bisection by
the second eigenvector, at the median), and a softmax classifier that learns the parts. Inner
products become angles by one more component: candidates get sqrt(M^2 - |x|^2), M being the
greatest length of all vectors, queries get 0. Every vector is indexed in its likeliest part;
a query goes to as many likeliest parts as the sample needs for the recall asked for, and to
further ones until they hold enough candidates. Parts of any size are dealt in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.embeddings import usable
from strandline.session import ensure_workers, stored

#: Vectors of the sample for each part (least hashes first), neighbours in its graph, and rows of a block.
SAMPLE, NEIGHBOURS, BLOCK, SEED = 128, 10, 4096, 9
#: Parts grow with the vectors, so many to a part, between these bounds; the sample has 6,000 vectors at least.
TO_A_PART, PARTS, MOST_PARTS, LEAST_SAMPLE = 20_000, 16, 128, 6000
#: Recall that the sample must reach; the margin over 0.9 is for vectors outside of it.
RECALL = 0.96


def balanced_parts(x: np.ndarray, k: int, parts: int) -> np.ndarray:
    """Part of each row: recursive bisection of the neighbour graph by its second eigenvector, at the median."""
    n = len(x)
    out = np.zeros(n, np.int64)
    near = np.zeros((n, min(k, n - 1)), np.int64)
    for a in range(0, n, 1000):
        s = x[a : a + 1000] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a : a + 1000] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[a : a + 1000]
    rng = np.random.default_rng(SEED)

    def split(rows: np.ndarray, first: int, count: int):
        if count == 1 or len(rows) < 2:
            out[rows] = first
            return
        local = np.full(n, -1)
        local[rows] = np.arange(len(rows))
        to = local[near[rows]]
        ok = to >= 0
        src, dst = np.repeat(np.arange(len(rows)), ok.sum(axis=1)), to[ok]
        degree = np.bincount(src, minlength=len(rows)) + np.bincount(dst, minlength=len(rows)) + 1.0
        v = rng.standard_normal(len(rows))
        for _ in range(60):  # power steps of the lazy walk, the constant vector removed
            v -= (v * degree).sum() / degree.sum()
            v = 0.5 * v + 0.5 * (v + np.bincount(src, v[dst], len(rows)) + np.bincount(dst, v[src], len(rows))) / degree
            v /= np.abs(v).max() + 1e-300
        order = rows[np.argsort(v, kind="stable")]
        half = len(rows) // 2
        split(order[:half], first, count // 2)
        split(order[half:], first + count // 2, count - count // 2)

    split(np.arange(n), 0, parts)
    return out


def classifier(x: np.ndarray, y: np.ndarray, parts: int, steps: int = 200) -> np.ndarray:
    """Softmax weights (inputs and a constant, parts) by gradient steps with momentum."""
    a = np.column_stack([x, np.ones(len(x))])
    w, m, target = np.zeros((a.shape[1], parts)), 0.0, np.eye(parts)[y]
    for _ in range(steps):
        z = a @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = a.T @ (p / p.sum(axis=1, keepdims=True) - target) / len(a) + 1e-4 * w
        m = 0.9 * m + g
        w -= 2.0 * m
    return w


def augmented(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose angles order candidates as inner products with a query do."""
    if query:
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])


def _ranked(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Parts of each row, likeliest first."""
    return np.argsort(-(np.column_stack([a, np.ones(len(a))]) @ w), axis=1, kind="stable")


def _needed(x: np.ndarray, longest: float, w: np.ndarray, k: int, recall: float) -> int:
    """Parts a query visits so that the sample's own queries reach the recall among its inner products."""
    home = _ranked(augmented(x, longest, False), w)[:, 0]
    q = np.arange(0, len(x), max(1, len(x) // 500))
    rank = np.argsort(_ranked(augmented(x[q], longest, True), w), axis=1)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(q), 0), int)
    depth = np.take_along_axis(rank, home[top], axis=1).ravel()
    return int(np.searchsorted(np.cumsum(np.bincount(depth, minlength=w.shape[1])), recall * len(depth))) + 1 if len(depth) else w.shape[1]


def _best(q: np.ndarray, own: int, m: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best candidates, ties to smaller ids; s: products by blocks, good but for the last digits.

    All that may be among the k are summed anew in one order, so equal vectors have equal scores.
    """
    s[ids == own] = -np.inf
    n = min(k, len(s))
    slack = 1e-9 * (np.abs(q).sum() * (np.abs(m).max() if m.size else 0.0) + 1e-300)
    at = np.flatnonzero((s >= np.partition(s, len(s) - n)[len(s) - n] - slack) & (s > -np.inf)) if n else np.zeros(0, np.int64)
    exact = (m[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vec_id divisible by `every`.

    Nearness is the inner product in double precision, ties go to the smaller vec_id; a query
    is no candidate of its own and gets all candidates, if they are fewer than k. Null, empty
    or zero vectors and those with null or non-finite components take no part, nor do null
    ids; vectors of another length than the query's are no candidates. Repeated rows of a
    vec_id are one vector, the least. Other columns are ignored. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable("x"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("x").alias("x")))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    total, longest = rows.agg(F.count("*"), F.max(length)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    parts = int(np.clip(1 << int(np.ceil(np.log2(max(total / TO_A_PART, 1)))), PARTS, MOST_PARTS))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(LEAST_SAMPLE, SAMPLE * parts)).toPandas()
    dim = int(picked["x"].map(len).mode()[0])
    sample = np.array([v for v in picked["x"] if len(v) == dim])
    parts = max(1, min(parts, len(sample) // 8))
    known = augmented(sample, longest, False)
    w = classifier(known, balanced_parts(known, NEIGHBOURS, parts), parts)
    probes = min(parts, _needed(sample, longest, w, k, recall))

    def routed(batches):
        for pdf in batches:
            if len(pdf):
                same = pdf["x"].map(len).to_numpy() == dim
                home = np.zeros(len(pdf), np.int64)  # other lengths: part 0 as candidate, everywhere as query
                if same.any():
                    home[same] = _ranked(augmented(np.array(pdf["x"][same].tolist()), longest, False), w)[:, 0]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "x": [np.array(v).tobytes() for v in pdf["x"]], "home": home})

    index = stored(rows.mapInPandas(routed, "vec_id long, x binary, home int"))
    held = {r["home"]: r["n"] for r in index.groupBy("home").agg(F.count("*").alias("n")).collect()}  # at most MOST_PARTS rows
    size = np.array([held.get(p, 0) for p in range(parts)])
    blocks = [max(1, -(-int(n) // BLOCK)) for n in size]

    def asked(batches):
        for pdf in batches:
            for dims, part in pdf.groupby(pdf["x"].map(len) // 8):
                order = np.tile(np.arange(parts), (len(part), 1))
                visits = np.full(len(part), parts)
                if dims == dim:
                    order = _ranked(augmented(np.frombuffer(b"".join(part["x"])).reshape(len(part), dim), longest, True), w)
                    visits = np.maximum(probes, 1 + (np.cumsum(size[order], axis=1) <= k).sum(axis=1)).clip(max=parts)
                yield pd.DataFrame({"vec_id": part["vec_id"], "x": part["x"], "home": [o[:v] for o, v in zip(order, visits, strict=True)]})

    each = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("home") + 1)
    candidates = index.select("home", F.pmod(F.xxhash64("vec_id"), each).cast("int").alias("block"), "vec_id", "x", F.lit(0).alias("asks"))
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "x").mapInPandas(asked, "vec_id long, x binary, home array<int>")
    queries = queries.select("vec_id", "x", F.explode("home").alias("home"))
    queries = queries.select("home", F.explode(F.sequence(F.lit(0), each - 1)).alias("block"), "vec_id", "x", F.lit(1).alias("asks"))

    def nearest(pdf):
        out = {"query_id": [], "vec_id": [], "score": []}
        for _, part in pdf.groupby(pdf["x"].map(len)):
            c, q = part[part["asks"] == 0].sort_values("vec_id"), part[part["asks"] == 1]
            if not len(c) or not len(q):
                continue
            ids = c["vec_id"].to_numpy()
            m = np.frombuffer(b"".join(c["x"])).reshape(len(c), -1)
            x, own = np.frombuffer(b"".join(q["x"])).reshape(len(q), -1), q["vec_id"].to_numpy()
            for a in range(0, len(x), 256):
                s = x[a : a + 256] @ m.T
                for i in range(len(s)):
                    v, exact = _best(x[a + i], own[a + i], m, ids, s[i], k)
                    out["query_id"].append(np.full(len(v), own[a + i]))
                    out["vec_id"].append(v)
                    out["score"].append(exact)
        whole = {n: np.concatenate(v) if v else np.zeros(0, float if n == "score" else np.int64) for n, v in out.items()}
        return pd.DataFrame(whole)

    found = candidates.unionByName(queries).groupBy("home", "block").applyInPandas(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
