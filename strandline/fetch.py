"""Bring a table of proven bounded size to the driver, as arrays without a Python object a row or as what a task makes of it."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fetched(df: DataFrame) -> dict[str, np.ndarray]:
    """The long and double columns of df (no nulls) as int64 and float64 arrays of one row order."""
    names, kinds = df.columns, {n: np.float64 if t == "double" else np.int64 for n, t in df.dtypes}

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({n: [pdf[n].to_numpy(kinds[n]).tobytes()] for n in names})

    rows = df.mapInPandas(run, ", ".join(f"{n} binary" for n in names)).collect()
    return {n: np.frombuffer(b"".join(r[n] for r in rows), kinds[n]) for n in names}


#: Bytes of a row that carries a piece of what made() pickles.
PIECE = 8 << 20


def opened(data: bytes):
    return pickle.loads(zlib.decompress(data))


class Sent:
    """Pickled, compressed bytes that a broadcast hands to workers as the object they hold; the driver never opens them."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return opened, (self.data,)


def made(rows: DataFrame, make: Callable):
    """A broadcast of make(arrays by column), which one task makes of all rows (long and double columns, no nulls).

    Work on the arrays takes several times their memory, which an executor's worker has and
    the driver lacks; only the packed result passes through the driver.
    """
    names, kinds = rows.columns, {n: np.float64 if t == "double" else np.int64 for n, t in rows.dtypes}

    def run(batches):
        held = {n: [np.empty(0, kinds[n])] for n in names}
        for pdf in batches:
            for n in names:
                held[n].append(pdf[n].to_numpy(kinds[n]))
        data = zlib.compress(pickle.dumps(make({n: np.concatenate(held.pop(n)) for n in names}), pickle.HIGHEST_PROTOCOL), 1)
        for a in range(0, len(data), PIECE):
            yield pd.DataFrame({"at": [a], "piece": [data[a : a + PIECE]]})

    pieces = rows.repartition(1).mapInPandas(run, "at long, piece binary").collect()
    data = b"".join(bytes(r["piece"]) for r in sorted(pieces, key=lambda r: r["at"]))
    del pieces
    return rows.sparkSession.sparkContext.broadcast(Sent(data))
