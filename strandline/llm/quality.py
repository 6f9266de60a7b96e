"""Quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

Normal equations are summed within partitions (a fixed-size matrix each), then over them;
calibration pools adjacent violators over a histogram of fixed size. All labelled rows count:
of each FOLD, one calibrates and the others fit the ridge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.sampling import remainder, training_labels
from strandline.llm.words import Words, chunks
from strandline.session import ensure_workers, stored

FEATURES, WIDTH, RIDGE, CELLS, SEED, FOLD = 256, 3.0, 1.0, 1000, 11, 4
STATS = ("length", "word_length", "upper", "digit", "symbol", "high", "distinct", "top", "lines", "stops", "shouts", "caps")
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~!"))
_ROWS = ", ".join(f"{s} double" for s in STATS)


def statistics(parts: list[bytes]) -> np.ndarray:
    """One row of STATS a text; a text without words has zeros."""
    out = np.zeros((len(parts), len(STATS)))
    w = Words(parts)
    size = w.stop - w.start
    for d, text in enumerate(parts):
        a, b = w.first[d], w.first[d + 1]
        if a == b:
            continue
        raw, n = np.frombuffer(text, np.uint8), b - a
        kinds, seen = np.unique(w.hash[a:b], return_counts=True)
        lines = text.split(b"\n")
        share = lambda m: m.mean()
        out[d] = (np.log(n), size[a:b].mean(), share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57)), share(_SYMBOL[raw]), share(raw >= 128),
                  len(kinds) / n ** 0.9, seen.max() / n, len(set(lines)) / len(lines), share(np.isin(raw, list(b".?,;:"))), text.count(b"!") / n, size[a:b].std())
    return out


def _stat_rows(batches):
    for pdf in batches:
        for first, parts in chunks(pdf["text"]):
            out = pd.DataFrame(statistics(parts), columns=list(STATS))
            for c in pdf.columns.drop("text"):
                out[c] = pdf[c].iloc[first : first + len(parts)].to_numpy()
            yield out


def _projection():
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((len(STATS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w, b = _projection()
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack([np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(z @ w + b)])


def isotonic(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing means of y (weights n) in the order given, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, k in zip(y, n, strict=True):
        pools.append([v, k, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, k2, m2 = pools.pop()
            v1, k1, m1 = pools.pop()
            pools.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, m1 + m2])
    return np.concatenate([np.full(int(m), v) for v, _, m in pools]) if pools else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text); labels: (doc_id, quality).

    Statistics of each text are stored once and joined to labels, so texts aren't shuffled.
    Null and empty texts have all statistics 0 and are scored like others; null ids are
    scored and don't train; repeated rows are scored each. Without labelled rows every score
    is 0.5. Other columns are ignored whatever their names. Empty input gives no rows.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    kind = dict(docs.dtypes)["doc_id"]
    stats = stored(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_stat_rows, f"{_ROWS}, doc_id string"))
    y = training_labels(labels, "quality").withColumn("doc_id", F.col("doc_id").cast("string"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLD)) == 0
    both = stored(stats.join(y.hint("merge"), "doc_id").select(*STATS, "y", fold.alias("calibrates")))
    train = both.where("NOT calibrates")
    ms = train.agg(*[F.avg(s) for s in STATS], *[F.stddev_pop(s) for s in STATS]).first()
    if ms[0] is None:
        return stats.select(F.col("doc_id").cast(kind).alias("doc_id"), F.lit(0.5).alias("score"))
    mean, scale = np.array(ms[: len(STATS)], float), np.maximum(np.array(ms[len(STATS) :], float), 1e-9)

    def normal(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for pdf in batches:
            z = fourier(pdf[list(STATS)].to_numpy(), mean, scale)
            total += z.T @ np.column_stack([z, pdf["y"].to_numpy()])
        yield pd.DataFrame({"m": [total.tobytes()]})

    def added(batches):
        total = np.zeros((FEATURES + 1) * (FEATURES + 2))
        for pdf in batches:
            for b in pdf["m"]:
                total += np.frombuffer(b)
        yield pd.DataFrame({"m": [total.tobytes()]})

    sums = stored(train.select(*STATS, "y").mapInPandas(normal, "m binary")).repartition(8).mapInPandas(added, "m binary").collect()
    m = sum(np.frombuffer(r.m) for r in sums).reshape(FEATURES + 1, FEATURES + 2)
    beta = np.linalg.solve(m[:, :-1] + RIDGE * np.eye(FEATURES + 1), m[:, -1])
    cell = lambda z: np.clip(((z + 0.5) * CELLS / 2).astype(int), 0, CELLS - 1)

    def cells(batches):
        for pdf in batches:
            yield pd.DataFrame({"cell": cell(fourier(pdf[list(STATS)].to_numpy(), mean, scale) @ beta), "y": pdf["y"]})

    held = both.where("calibrates")
    held = train if held.isEmpty() else held  # a handful of labelled rows
    hist = held.mapInPandas(cells, "cell int, y int").groupBy("cell").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("cell").toPandas()
    level = np.interp(np.arange(CELLS), hist["cell"], isotonic(hist["cell"].to_numpy(), hist["y"].to_numpy(), hist["n"].to_numpy()))

    def scored(batches):
        for pdf in batches:
            z = fourier(pdf[list(STATS)].to_numpy(), mean, scale) @ beta
            # the raw score breaks ties within a level
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.clip(level[cell(z)] + 1e-6 * (np.clip(z, 0, 1) - 0.5), 0, 1)})

    return stats.mapInPandas(scored, "doc_id string, score double").select(F.col("doc_id").cast(kind).alias("doc_id"), "score")


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """score() with held_out (false for a null id) and predicted."""
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score(docs, labels).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
