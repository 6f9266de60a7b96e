"""Least budgets at which a demand has r disjoint routes, and routes that attain them."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fetch import fetched, made
from strandline.operators.flow import Graph, broadcast_graph, cancelled, graph_of, graph_rows, packed
from strandline.operators.paths import Streets, broadcast_streets

TOLERANCE = 1e-9


class _Within:
    """Whether the cheapest route over an arc keeps to the budget; arcs that were not met do not."""

    def __init__(self, mu: dict, budget: float, twin=None):
        self.mu, self.budget, self.twin = mu, budget + TOLERANCE, twin

    def __getitem__(self, e: int) -> bool:
        return self.mu.get(e if self.twin is None else self.twin[e], np.inf) <= self.budget


class Support:
    """Arcs of a graph ordered by the cheapest route that uses each, from one entry set.

    Arcs are met in that order: a search by cost so far plus cost to access pops nodes so that
    an arc within a budget is known as soon as all nodes within it are, so what is searched
    follows the budget and not the graph. mu has the arcs met up to now.
    """

    def __init__(self, graph: Graph, streets: Streets, entry_nodes, goals, to_access, targets=None):
        self.graph, self.streets, self.to_access = graph, streets, to_access
        self.targets = set(graph.index(goals)) if targets is None else targets
        self.entry = graph.index(entry_nodes)
        at = streets.index(entry_nodes)
        self.dist = dict.fromkeys(at, 0.0)
        self.heap = [(to_access[x], x) for x in self.dist]
        heapq.heapify(self.heap)
        self.done: set[int] = set()
        self.mu: dict[int, float] = {}
        self.cheapest = float(min((to_access[x] for x in self.dist), default=np.inf))
        self.most: dict[int, int] = {}

    def extend(self, budget: float) -> bool:
        """Meet all arcs within the budget; whether any may be left."""
        streets, to_access, dist, heap, done = self.streets, self.to_access, self.dist, self.heap, self.done
        head, start, cost = streets.head, streets.start, streets.cost
        while heap and heap[0][0] <= budget + 2 * TOLERANCE:
            _, x = heapq.heappop(heap)
            if x in done or to_access[x] == np.inf:
                continue
            done.add(x)
            d = dist[x]
            for e in range(start[x], start[x + 1]):
                y = head[e]
                rest = to_access[y]
                if rest < np.inf and y != x:
                    t, at = d + cost[e], self.graph.place(x, y)
                    self.mu[at] = min(t + rest, self.mu.get(at, np.inf))
                    if t < dist.get(y, np.inf):
                        dist[y] = t
                        if y not in done:
                            heapq.heappush(heap, (t + rest, y))
        return bool(heap) and heap[0][0] < np.inf

    def mask(self, budget: float) -> dict:
        """Arcs within the budget, for searches in either direction."""
        self.extend(budget)
        return {False: _Within(self.mu, budget), True: _Within(self.mu, budget, self.graph.twin)}

    def count(self, budget: float, cap: int) -> int:
        return self.graph.routes(self.entry, self.targets, cap, mask=self.mask(budget))[0]

    def possible(self, r: int) -> bool:
        """Whether any budget has r disjoint routes: arcs of routes lie within some budget, so the whole graph tells."""
        if r not in self.most:
            self.most[r] = self.graph.routes(self.entry, self.targets, r)[0]
        return self.most[r] >= r

    def enough(self, r: int) -> float:
        """A budget with r disjoint routes; all arcs within it are met."""
        budget, step = self.cheapest, max(self.cheapest / 4, 1.0)
        while self.count(budget, r) < r:
            budget, step = budget + step, step * 2
        return budget

    def thresholds(self, budget: float) -> np.ndarray:
        """Costs up to the budget at which arcs come in."""
        self.extend(budget)
        v = np.unique(np.fromiter(self.mu.values(), float, len(self.mu)))
        return v[(v >= self.cheapest - TOLERANCE) & (v <= budget + TOLERANCE)]

    def least_budget(self, r: int) -> float:
        """The least threshold with r disjoint routes; infinite if no budget has them."""
        if not np.isfinite(self.cheapest) or not self.possible(r):
            return np.inf
        v = self.thresholds(self.enough(r))
        lo, hi = 0, len(v) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.count(v[mid], r) >= r else (mid + 1, hi)
        return float(v[lo])

    def swept(self, r: int) -> tuple[float, bool]:
        """The same by trying all thresholds in order, and whether counts never fell."""
        last, steady = 0, True
        if not np.isfinite(self.cheapest) or not self.possible(r):
            return np.inf, steady
        for b in self.thresholds(self.enough(r)):
            k = self.count(b, r)
            steady &= k >= last
            last = k
            if k >= r:
                return float(b), steady
        return np.inf, steady

    def witness(self, r: int, budget: float) -> list[list[int]]:
        """r routes within the budget that share no arc, streets used both ways cancelled; empty if there are none."""
        mask = self.mask(budget)
        k, changed, _ = self.graph.routes(self.entry, self.targets, r, mask=mask)
        if k < r:
            return []
        used, _ = cancelled(self.graph, self.graph.flow(changed, mask=mask))
        found = self.graph.decompose(used, self.entry, self.targets)
        return [self.graph.nodes[p].tolist() for p in found]


def _supports(arcs: DataFrame, access: DataFrame):
    """What a kernel needs: broadcast graph, broadcast streets and access nodes."""
    goals = fetched(access.select(F.col("node").cast("long").alias("n")).where("n IS NOT NULL").distinct())["n"]  # at most a graph's nodes
    return broadcast_graph(arcs, access), broadcast_streets(arcs), goals


def _run(arcs, access, demands, schema, row):
    bg, bs, goals = _supports(arcs, access)

    def run(batches):
        graph, streets = bg.value[0], bs.value
        to_access = streets.distances(streets.index(goals), True)
        targets = set(graph.index(goals))
        for pdf in batches:
            out = []
            for d, entry in zip(pdf["d"], pdf["entry"], strict=True):
                s = Support(graph, streets, entry, goals, to_access, targets)
                if s.entry:
                    out.append((d, *row(s)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    spark = arcs.sparkSession
    return demands.select(F.col("d").cast("long"), "entry").repartition(max(spark.sparkContext.defaultParallelism * 2, 1), "d").mapInPandas(run, schema)


def least_budgets(arcs: DataFrame, access: DataFrame, demands: DataFrame, ranks=(2, 3)) -> DataFrame:
    """d, colocated, reachable, cheapest, budget<r> of each entry set (d, entry).

    budget<r> is the least cost bound B such that arcs on routes within B hold r disjoint
    routes; null for colocated and unreachable demands, infinite if no bound has them.
    """
    def row(s: Support):
        here = bool(set(s.entry) & s.targets)
        if here or not np.isfinite(s.cheapest):
            return (here, bool(np.isfinite(s.cheapest)), s.cheapest if np.isfinite(s.cheapest) else None, *[None] * len(ranks))
        return (False, True, s.cheapest, *[s.least_budget(r) for r in ranks])

    return _run(arcs, access, demands, "d long, colocated boolean, reachable boolean, cheapest double, " + ", ".join(f"budget{r} double" for r in ranks), row)


def attained(arcs: DataFrame, access: DataFrame, demands: DataFrame, r: int = 2) -> DataFrame:
    """d, budget, swept, steady, routes of the demands that have r disjoint routes.

    swept: the bound by exhaustive search, steady: counts never fell on the way; routes: r
    routes within the bound that share no arc.
    """
    def row(s: Support):
        if set(s.entry) & s.targets or not np.isfinite(s.cheapest):
            return (None, None, None, None)
        b = s.least_budget(r)
        if not np.isfinite(b):
            return (None, None, None, None)
        swept, steady = s.swept(r)
        return (b, swept, steady, s.witness(r, b))

    out = _run(arcs, access, demands, "d long, budget double, swept double, steady boolean, routes array<array<bigint>>", row)
    return out.where("budget IS NOT NULL")


class _Open:
    """Whether an arc's way is not closed."""

    def __init__(self, of, closed: set[int]):
        self.of, self.closed = of, closed

    def __getitem__(self, e: int) -> bool:
        return self.of[e] not in self.closed


def way_disjoint(arcs: DataFrame, access: DataFrame, demands: DataFrame, rounds: int = 3) -> DataFrame:
    """d, status, cancelled of demands with two disjoint routes: 'witness' if two share no way, else 'affected'.

    arcs: (u, v, way); when two routes share ways these are closed and the search repeated, at
    most `rounds` times. cancelled: streets that the first flow used both ways.
    """
    # a way's name travels as its hash, once, and its arcs as numbers
    rows = graph_rows(arcs.select("u", "v", F.xxhash64(F.col("way").cast("string")).alias("way")), access, "way")

    def make(t):
        arc = t["goal"] == 0
        _, number = np.unique(t["way"][arc], return_inverse=True)
        graph, targets = graph_of(t)
        u, v = t["u"][arc], t["v"][arc]
        of = np.full(len(graph.head), -1, np.int32)
        of[graph.places(u, v)] = number[u != v]
        return graph, targets, packed(of)

    bg = made(rows, make)
    rows._strandline_plain.unpersist()

    def run(batches):
        graph, targets, of = bg.value
        for pdf in batches:
            out = []
            for d, nodes in zip(pdf["d"], pdf["entry"], strict=True):
                entry = graph.index(nodes)
                if not entry or set(entry) & targets:
                    continue
                closed: set[int] = set()
                status, pairs = "affected", None
                for _ in range(rounds):
                    mask = {False: _Open(of, closed)} if closed else None  # routes lead from entries here
                    k, changed, _ = graph.routes(entry, targets, 2, mask=mask)
                    if k < 2:
                        break
                    used, n = cancelled(graph, graph.flow(changed, mask=mask))
                    pairs = n if pairs is None else pairs
                    two = graph.decompose(used, entry, targets)[:2]
                    if len(two) < 2:
                        break
                    names = [{of[graph.place(x, y)] for x, y in zip(p[:-1], p[1:], strict=True)} for p in two]
                    shared = names[0] & names[1]
                    if not shared:
                        status = "witness"
                        break
                    closed |= shared
                if pairs is not None:
                    out.append((d, status, pairs))
            yield pd.DataFrame(out, columns=["d", "status", "cancelled"]).astype({"cancelled": "int32"})

    spark = arcs.sparkSession
    return demands.select(F.col("d").cast("long"), "entry").repartition(max(spark.sparkContext.defaultParallelism * 2, 1), "d").mapInPandas(run, "d long, status string, cancelled int")
