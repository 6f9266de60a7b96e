"""Closures as intervals of days, and what is closed and cut off each day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.fetch import made
from strandline.operators.flow import MOST_ARCS
from strandline.session import ensure_workers


def days(closures: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and day of each day that a closure (start, stop) is in force, both ends included.

    Null ends and stops before starts have none.
    """
    return closures.where("start <= stop").select(*keep, F.explode(F.expr("sequence(start, stop, interval 1 day)")).alias("day"))


def calendar(closures: DataFrame) -> DataFrame:
    """day of each day from the first start to the last stop."""
    ends = closures.where("start <= stop").agg(F.min("start").alias("a"), F.max("stop").alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))


def daily(closures: DataFrame, key: str = "segment") -> DataFrame:
    """day, n_active, n_segments of every day of the calendar: closures in force and distinct segments among them."""
    d = days(closures, key).groupBy("day").agg(F.count("*").alias("n_active"), F.countDistinct(key).alias("n_segments"))
    return calendar(closures).join(d, "day", "left").fillna(0)


def deduped(permits: DataFrame, first: str, second: str, order: list[str]) -> DataFrame:
    """One row a permit key with n_permits: the key is `first`, or `second` where that is null or empty; the first by `order` stays.

    A partial aggregation keeps the least row, so copies of a key never meet in one task. Rows without a key go.
    """
    key = F.coalesce(F.nullif(F.col(first), F.lit("")), F.nullif(F.col(second), F.lit("")))
    cols = [c for c in permits.columns if c not in order]
    best = F.min(F.struct(*order, *[c for c in cols]))
    out = permits.withColumn("_key", key).where("_key IS NOT NULL").groupBy("_key").agg(best.alias("b"), F.count("*").alias("n_permits"))
    return out.select(F.col("_key").alias("key"), *[F.col(f"b.{c}").alias(c) for c in permits.columns], "n_permits")


def phase(start: Column, stop: Column, today: Column) -> Column:
    """'open', 'finished' or 'future' on a day, ends included."""
    return F.when(stop < today, "finished").when(start > today, "future").when((start <= today) & (stop >= today), "open")


def streets_of(match: DataFrame, names: DataFrame) -> DataFrame:
    """closure, n_streets: distinct names of the arcs (closure, u, v) of a closure, 1 at least; names: (u, v, name)."""
    return match.join(names, ["u", "v"], "left").groupBy("closure").agg(F.greatest(F.lit(1).cast("long"), F.countDistinct("name")).alias("n_streets"))


def severed_days(stranded: DataFrame, closures: DataFrame, weights: DataFrame) -> DataFrame:
    """d, days, w_days: on how many distinct days a demand is cut off by any closure, and its weight times them.

    stranded: (closure, d); closures: (closure, start, stop); weights: (d, w).
    """
    d = days(closures, "closure").join(stranded, "closure").select("d", "day").distinct().groupBy("d").agg(F.count("*").alias("days"))
    return d.join(weights, "d").select("d", "days", (F.col("w") * F.col("days")).alias("w_days"))


def walks(arcs: DataFrame, starts: DataFrame, length: str = "size", times: int = 1) -> DataFrame:
    """closure, rep, arcs: a random contiguous walk of `size` arcs for each (closure, size) and replicate.

    Steps are chosen by an integer hash of (closure, rep, step); a walk that has nowhere to go
    ends early. Arcs are a bounded dimension, and each walk is taken whole in a task.
    """
    ensure_workers(arcs.sparkSession)
    plain = arcs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").cache()
    if (n := plain.count()) > MOST_ARCS:
        raise ValueError(f"{n} arcs exceed MOST_ARCS; split the table by city")

    def rows_of(t):
        order = np.lexsort((t["v"], t["u"]))
        nodes, start = np.unique(t["u"][order], return_index=True)
        return nodes, np.append(start, len(order)), t["v"][order]

    bc = made(plain, rows_of)
    plain.unpersist()

    def run(batches):
        nodes, start, to = bc.value
        place = {x: i for i, x in enumerate(nodes.tolist())}
        for pdf in batches:
            out = []
            for closure, size, rep in zip(pdf["closure"].tolist(), pdf["size"], pdf["rep"].tolist(), strict=True):
                if not place or pd.isna(closure):
                    continue
                i, walk = (closure * 48271 + rep * 69621 + 16807) % len(nodes), []
                for step in range(0 if pd.isna(size) else int(size)):
                    if i is None:
                        break
                    y = int(to[start[i] + (closure * 31 + rep * 17 + step * 13) % (start[i + 1] - start[i])])
                    walk.append({"u": int(nodes[i]), "v": y})
                    i = place.get(y)
                out.append((closure, rep, walk))
            yield pd.DataFrame(out, columns=["closure", "rep", "arcs"])

    rows = starts.select("closure", F.col(length).cast("int").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("rep"))
    dealt = rows.repartition(max(arcs.sparkSession.sparkContext.defaultParallelism * 2, 1), "closure", "rep")
    return dealt.mapInPandas(run, f"closure {dict(starts.dtypes)['closure']}, rep int, arcs array<struct<u:bigint,v:bigint>>")


def overlap(closures: DataFrame, lines: DataFrame, trim: float = 10.0, buffer: float = 12.0, least: float = 0.6, samples: int = 21) -> DataFrame:
    """closure, u, v, share of the street lines that run along a closure.

    closures: (closure, ax, ay, bx, by), lines: (u, v, ax, ay, bx, by), straight in metres. A
    line is shortened by `trim` at both ends; `share` is the part of its sample points within
    `buffer` of the closure's line, kept from `least` on. Boxes meet by grid cells.
    """
    cell = 200.0
    span = lambda p, q: F.sequence(F.floor((F.least(p, q) - buffer) / cell), F.floor((F.greatest(p, q) + buffer) / cell))
    spread = lambda df: df.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))
    c = spread(closures.select("closure", "ax", "ay", "bx", "by")).select("closure", "cx", "cy", F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"))
    pairs = spread(lines.select("u", "v", "ax", "ay", "bx", "by")).join(c, ["cx", "cy"]).drop("cx", "cy").dropDuplicates(["closure", "u", "v"])
    size = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    cut = F.when(size > 2 * trim, trim / size).otherwise(0.0)  # a short line stays whole

    def near(i):
        t = cut + (1 - 2 * cut) * i / float(samples - 1)
        x, y = F.col("ax") + t * (F.col("bx") - F.col("ax")), F.col("ay") + t * (F.col("by") - F.col("ay"))
        dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
        s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - F.col("px")) * dx + (y - F.col("py")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        ex, ey = x - F.col("px") - s * dx, y - F.col("py") - s * dy
        return F.when(ex * ex + ey * ey <= buffer * buffer, 1).otherwise(0)

    hits = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), near), F.lit(0), lambda a, x: a + x)
    return pairs.withColumn("share", hits / float(samples)).where(F.col("share") >= least).select("closure", "u", "v", "share")
