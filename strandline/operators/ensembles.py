"""What a demand's route ensemble says: entropy, overlap, disjoint families, budgets.

Ensembles are rows (d, route, cost, arcs); arcs is an array of any comparable elements. A
demand has a bounded number of routes, so its rows meet in one aggregate of a few dozen.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import ensure_workers

ETA = 0.5


def with_arcs(routes: DataFrame) -> DataFrame:
    """routes with arcs: (u, v) of successive nodes."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v")))
    return routes.withColumn("arcs", F.when(F.size("nodes") > 1, pairs).otherwise(F.expr("cast(array() AS array<struct<u:bigint,v:bigint>>)")))


def route_costs(routes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cost of each route (keys, arcs of u and v): the sum of its edges' (u, v, w) costs; null if one is missing."""
    steps = routes.select(*keys, F.posexplode("arcs").alias("_i", "_arc")).select(*keys, "_i", "_arc.u", "_arc.v")
    priced = steps.join(edges.select("u", "v", "w"), ["u", "v"], "left")
    return priced.groupBy(*keys).agg(F.when(F.count("w") == F.count("*"), F.sum("w")).alias("cost"))


def within_budget(routes: DataFrame, slack: float, k: int, by: list[str]) -> DataFrame:
    """The first k routes, by route number, that cost at most (1 + slack) times the cheapest of their group."""
    least = F.min("cost").over(Window.partitionBy(*by))
    kept = routes.withColumn("_least", least).where(F.col("cost") <= (1 + slack) * F.col("_least")).drop("_least")
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("route"))).where(F.col("_k") <= k).drop("_k")


def shares(routes: DataFrame, by: list[str], eta: float = ETA) -> DataFrame:
    """routes with p: exp(-eta * (cost - cheapest)) over the group's sum."""
    w = Window.partitionBy(*by)
    g = routes.withColumn("_g", F.exp(-eta * (F.col("cost") - F.min("cost").over(w))))
    return g.withColumn("p", F.col("_g") / F.sum("_g").over(w)).drop("_g")


def indices(routes: DataFrame, by: list[str] | None = None, eta: float = ETA, k: int = 15) -> DataFrame:
    """by, n, exp_h, rpe, li, deng, h_norm of each ensemble.

    exp_h: exp of the entropy of the shares; rpe: 1 / sum of p_i p_j Jaccard_ij; li: one less
    the mean Jaccard of two routes (0 for a single one); deng: number of routes; h_norm:
    entropy over ln k.
    """
    by = by or ["d"]
    p = shares(routes, by, eta)
    h = p.groupBy(*by).agg(F.count("*").alias("n"), (-F.sum(F.col("p") * F.log(F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-12))))).alias("h"), F.sum(F.col("p") * F.col("p")).alias("own"))
    a = p.select(*by, F.col("route").alias("i"), F.col("arcs").alias("a"), F.col("p").alias("pa"))
    b = p.select(*by, F.col("route").alias("j"), F.col("arcs").alias("b"), F.col("p").alias("pb"))
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    # both sides grow with the demands: merged, never built as one table in the driver, however small they look compressed
    pairs = a.join(b.hint("merge"), by).where("i < j").withColumn("jac", F.when(either > 0, both / either).otherwise(0.0))
    cross = pairs.groupBy(*by).agg(F.sum(F.expr("2 * pa * pb * jac")).alias("cross"), F.avg("jac").alias("mean"))
    out = h.join(cross.hint("merge"), by, "left")
    return out.select(*by, "n", F.exp("h").alias("exp_h"), (1 / (F.col("own") + F.coalesce("cross", F.lit(0.0)))).alias("rpe"), (1 - F.coalesce("mean", F.lit(1.0))).alias("li"),
                      F.col("n").cast("double").alias("deng"), (F.col("h") / F.greatest(F.log(F.lit(float(max(k, 1)))), F.lit(1e-9))).alias("h_norm"))


def largest_disjoint(sets: list[frozenset]) -> int:
    """Size of the largest family of pairwise disjoint sets: branch on the set that meets most others."""
    n = len(sets)
    meets = [sum(1 << j for j in range(n) if j != i and sets[i] & sets[j]) for i in range(n)]
    known: dict[int, int] = {0: 0}

    def best(left: int) -> int:
        if left in known:
            return known[left]
        bits = [i for i in range(n) if left >> i & 1]
        i = max(bits, key=lambda x: ((meets[x] & left).bit_count(), -x))
        if not meets[i] & left:  # no two of them meet
            known[left] = len(bits)
        else:
            rest = left & ~(1 << i)
            known[left] = max(best(rest), 1 + best(rest & ~meets[i]))
        return known[left]

    return best((1 << n) - 1)


MEASURED = "n long, exp_h double, rpe double, li double, deng double, h_norm double, disjoint int"


def measured(costs: list[float], sets: list[frozenset], eta: float = ETA, k: int = 15) -> tuple:
    """MEASURED of one ensemble, of its routes' costs and arcs: the numbers of indices() and disjoint_routes()."""
    n, least = len(costs), min(costs)
    p = [math.exp(-eta * (c - least)) for c in costs]
    total = sum(p)
    p = [x / total for x in p]
    h = -sum(x * math.log(max(min(x, 1.0), 1e-12)) for x in p)
    own, mean = sum(x * x for x in p), 1.0
    if n > 1:
        jac = [(i, j, (both := len(sets[i] & sets[j])) and both / (len(sets[i]) + len(sets[j]) - both)) for i in range(n) for j in range(i + 1, n)]
        own += sum(2 * p[i] * p[j] * x for i, j, x in jac)
        mean = sum(x for _, _, x in jac) / len(jac)
    return n, math.exp(h), 1 / own, 1 - mean, float(n), h / max(math.log(max(k, 1)), 1e-9), largest_disjoint(sets)


def disjoint_routes(routes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n, disjoint: the most routes of an ensemble of which no two share an arc."""
    ensure_workers(routes.sparkSession)
    by = by or ["d"]
    rows = routes.groupBy(*by).agg(F.collect_list(F.transform("arcs", lambda x: F.xxhash64(x))).alias("sets"))
    kinds = dict(routes.dtypes)

    def run(batches):
        for pdf in batches:
            out = pdf[by].copy()
            out["n"] = [len(s) for s in pdf["sets"]]
            out["disjoint"] = [largest_disjoint([frozenset(x) for x in s]) for s in pdf["sets"]]
            yield out.astype({"n": "int64", "disjoint": "int32"}) if len(out) else pd.DataFrame(columns=[*by, "n", "disjoint"])

    return rows.mapInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in by] + ["n long", "disjoint int"]))


def horizon(cheapest: Column, hops: Column, k: Column, rho: Column, beta: float = 1.0) -> Column:
    """Cost that k penalised routes can't exceed: rho^(k-1) * (cheapest + (k-1) * beta * hops); infinite without a route."""
    out = F.pow(rho, k - 1) * (cheapest + (k - 1) * beta * hops)
    return F.when(cheapest.isNull() | (cheapest == float("inf")), F.lit(float("inf"))).otherwise(out)
