"""Negative-binomial regression by reweighted least squares, one aggregation of normal equations a step."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def negative_binomial(df: DataFrame, y: str, xs: list[str], effect: str, exposure: str, alpha: float = 1.0, steps: int = 50) -> list[tuple]:
    """(term, beta, standard error, exp(beta)) of a log-link model with variance m + alpha * m^2.

    effect: a column whose values, but the first, get an indicator each (a bounded dimension);
    exposure: the offset. Rows with nulls are left out. ArithmeticError without convergence.
    """
    rows = df.select(y, *xs, effect, exposure).dropna()
    levels = sorted(r[0] for r in rows.select(effect).distinct().collect())
    names = ["const", *xs, *[f"{effect}={v}" for v in levels[1:]]]
    design = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], *[(F.col(effect) == v).cast("double") for v in levels[1:]]]
    rows = rows.select(F.col(y).cast("double").alias("y"), F.col(exposure).cast("double").alias("o"), *[d.alias(f"d{i}") for i, d in enumerate(design)])
    k = len(names)
    # from the mean rate on, where the weights are tame
    mean = rows.agg(F.log(F.greatest(F.sum("y"), F.lit(1e-9)) / F.sum(F.exp("o")))).first()[0]
    beta = np.zeros(k)
    beta[0] = mean or 0.0
    for _ in range(steps):
        eta = F.col("o")
        for i, b in enumerate(beta):
            eta = eta + F.lit(float(b)) * F.col(f"d{i}")
        m = F.exp(eta)
        work = rows.withColumn("m", m).withColumn("w", F.expr(f"m / (1 + {alpha} * m)")).withColumn("z", eta - F.col("o") + (F.col("y") - F.col("m")) / F.col("m"))
        sums = work.agg(*[F.sum(F.expr(f"w * d{i} * d{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.expr(f"w * d{i} * z")).alias(f"g{i}") for i in range(k)]).first()
        h = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = sums[f"h{i}_{j}"]
        new = np.linalg.solve(h, np.array([sums[f"g{i}"] for i in range(k)]))
        moved, beta = np.abs(new - beta).max(), new
        if moved < 1e-9:
            se = np.sqrt(np.diag(np.linalg.inv(h)))
            return [(n, b, s, math.exp(b)) for n, b, s in zip(names, beta, se, strict=True)]
    raise ArithmeticError("the fit did not converge")
