"""Shared by the learned scores: who is labelled for training, and small logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import stored


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, mod by; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the ids that training may see: remainder not 1, label 0 or 1.

    Of several labels for one id the greatest counts; null labels and ids don't.
    """
    seen = labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", 3) != 1))
    return seen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of about `most` rows of training_labels() at most, those with the least hashes.

    So few ids and labels (17 bytes each) are broadcast; texts stay where they are.
    """
    y = stored(training_labels(labels, label))
    n = y.count()
    if n > most:
        y = stored(y.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * most / n)))
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
    return w
