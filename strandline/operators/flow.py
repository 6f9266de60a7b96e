"""Disjoint routes and named minimum cuts, by augmenting paths on unit arcs.

The graph is a bounded dimension (a city); its arrays are broadcast behind a check of their
size. Demands are partitioned rows, so the work is as parallel as the demand table is long.
Where a table of arcs names cities, `by_city` runs each city's graph in a task of its own.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fetch import fetched, made
from strandline.session import ensure_workers

#: Arcs up to which one graph is broadcast (two longs each).
MOST_ARCS = 20_000_000
CAP = 50


def packed(x) -> array:
    """Whole numbers below 2^31 at four bytes each; kernels read them one by one as from a list, which takes nine times that."""
    return array("i", np.ascontiguousarray(x, np.int32).tobytes())


class _Masked:
    """Capacities where a mask holds, else 0."""

    def __init__(self, room, mask):
        self.room, self.mask = room, mask

    def __getitem__(self, e: int) -> int:
        return self.room[e] if self.mask[e] else 0


class Graph:
    """Distinct unit arcs in compressed rows, with the place of each arc's reverse.

    Arrays are packed, as the driver and each Python worker hold a copy. Searches reuse one
    stamp array, and undo the capacities that they touched.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray):
        u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
        self.nodes = np.unique(np.concatenate([u, v]))
        n = max(len(self.nodes), 1)
        a, b = np.searchsorted(self.nodes, u), np.searchsorted(self.nodes, v)
        real = np.unique((a * n + b)[a != b])
        del u, v  # the driver holds as few arrays as it can
        code = np.unique(np.concatenate([real, real % n * n + real // n]))
        a, b = code // n, code % n
        twin = np.searchsorted(code, b * n + a)
        forward = (real[np.minimum(np.searchsorted(real, code), len(real) - 1)] == code).astype(np.int8) if len(real) else np.zeros(0, np.int8)
        self.n, self.tail, self.head = len(self.nodes), packed(a), packed(b)
        self.start, self.twin = packed(np.searchsorted(a, np.arange(n + 1))), packed(twin)
        self.room = {False: forward.tobytes(), True: forward[twin].tobytes()}
        self.seen, self.stamp = [0] * n, 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.seen = [0] * max(self.n, 1)

    def index(self, keys) -> list[int]:
        keys = np.asarray(keys if isinstance(keys, np.ndarray) else list(keys), np.int64)
        at = np.searchsorted(self.nodes, keys)
        ok = (at < self.n) & (self.nodes[np.minimum(at, self.n - 1)] == keys) if self.n else np.zeros(len(keys), bool)
        return at[ok].tolist()

    def places(self, u, v) -> np.ndarray:
        """Where the arcs (u, v) stand, reverses of one-way arcs included; pairs that the graph lacks are left out."""
        known = self.code
        if not len(known):
            return np.zeros(0, np.int64)
        a, b = (np.minimum(np.searchsorted(self.nodes, x), self.n - 1) for x in (u, v))
        ok = (self.nodes[a] == u) & (self.nodes[b] == v)
        code = a * max(self.n, 1) + b
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return at[ok & (known[at] == code)]

    @property
    def code(self) -> np.ndarray:
        """tail * nodes + head of each arc, in order; made anew, as few searches need it."""
        return np.array(self.tail, np.int64) * max(self.n, 1) + np.array(self.head, np.int64)

    def place(self, x: int, y: int) -> int:
        """Where the arc between two places of nodes stands; the graph must have it."""
        return bisect_left(self.head, y, self.start[x], self.start[x + 1])

    def routes(self, entry: list[int], targets, cap: int = CAP, backwards: bool = False, mask=None):
        """(number of arc-disjoint routes, changed capacities, nodes of the last search with their hops).

        Routes lead from entry nodes to targets (backwards: from targets to entry nodes) over
        the arcs of mask (all). The search stops at cap; then the last search is empty. entry
        and targets should share no node. The changed capacities are a flow: an arc of which
        the capacity went from 1 to 0 is used.
        """
        room = self.room[backwards]
        if mask is not None:
            room = _Masked(room, mask[backwards])
        head, start, twin, seen = self.head, self.start, self.twin, self.seen
        changed: dict[int, int] = {}
        routes = 0
        while routes < cap:
            self.stamp += 1
            stamp = self.stamp
            came, hops, queue, end = {}, {}, deque(), -1
            for s in entry:
                if seen[s] != stamp:
                    seen[s], came[s], hops[s] = stamp, -1, 0
                    queue.append(s)
            while queue and end < 0:
                x = queue.popleft()
                for e in range(start[x], start[x + 1]):
                    y = head[e]
                    if seen[y] != stamp and (changed[e] if e in changed else room[e]) > 0:
                        seen[y], came[y], hops[y] = stamp, e, hops[x] + 1
                        if y in targets:
                            end = y
                            break
                        queue.append(y)
            if end < 0:
                return routes, changed, hops
            routes += 1
            while came[end] >= 0:
                e = came[end]
                t = twin[e]
                changed[e] = (changed[e] if e in changed else room[e]) - 1
                changed[t] = (changed[t] if t in changed else room[t]) + 1
                end = head[t]
        return routes, changed, {}

    def cut(self, hops: dict[int, int], backwards: bool = False, mask=None) -> list[tuple[int, int]]:
        """Arcs (as node pairs) that leave the nodes of the last search: the minimum cut nearest the search's start."""
        room, out = self.room[backwards], []
        for x in hops:
            for e in range(self.start[x], self.start[x + 1]):
                y = self.head[e]
                if y not in hops and room[e] and (mask is None or mask[backwards][e]):
                    pair = (int(self.nodes[x]), int(self.nodes[y]))
                    out.append(pair[::-1] if backwards else pair)
        return sorted(out)

    def kappa(self, entry, targets, cap: int = CAP, backwards: bool = False):
        """(routes, cut arcs); the cut is the one nearest the entry nodes, whichever way routes lead."""
        k, _, hops = self.routes(entry, targets, cap, backwards)
        return k, self.cut(hops, backwards) if hops else []

    def flow(self, changed: dict[int, int], backwards: bool = False, mask=None) -> set[int]:
        """Arcs that the routes of routes() use, given the same mask."""
        room = self.room[backwards]
        return {e for e, r in changed.items() if r == 0 and room[e] and (mask is None or mask[backwards][e])}

    def decompose(self, used: set[int], entry, targets) -> list[list[int]]:
        """Simple routes (lists of nodes) that use each of the arcs at most once; arcs of mere loops stay unused."""
        out_of: dict[int, list[int]] = {}
        for e in sorted(used):
            out_of.setdefault(self.tail[e], []).append(e)
        found = []
        for s in sorted(set(entry)):
            while out_of.get(s):
                path, at = [s], {s: 0}
                while path[-1] not in targets and out_of.get(path[-1]):
                    y = self.head[out_of[path[-1]].pop()]
                    if y in at:  # splice the loop out
                        for z in path[at[y] + 1 :]:
                            del at[z]
                        del path[at[y] + 1 :]
                    else:
                        at[y] = len(path)
                        path.append(y)
                if path[-1] in targets:
                    found.append(path)
                elif len(path) == 1:
                    break
        return found


def spread_hops(start: np.ndarray, head: np.ndarray, at: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Mask of the nodes that those at `at` reach over the arcs with room (all), all nodes of as many hops at once."""
    n = len(start) - 1
    seen, owner = np.zeros(n, bool), np.zeros(n, np.int32)
    at = np.unique(at)
    seen[at] = True
    while len(at):
        each = start[at + 1] - start[at]
        e = np.arange(each.sum()) + np.repeat(start[at] - np.cumsum(each) + each, each)
        y = head[e if room is None else e[room[e]]]
        y = y[~seen[y]]
        owner[y] = np.arange(len(y))
        at = y[owner[y] == np.arange(len(y))].astype(np.int64)  # each once
        seen[at] = True
    return seen


def strong_labels(start, head) -> list[int]:
    """A number a node, equal for nodes of one strongly connected component."""
    n = len(start) - 1
    number, low, label, at = [0] * n, [0] * n, [-1] * n, list(start[:-1])
    stack, count, labels = [], 0, 0
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        stack.append(root)
        way = [root]
        while way:
            x = way[-1]
            if at[x] < start[x + 1]:
                y = head[at[x]]
                at[x] += 1
                if not number[y]:
                    count += 1
                    number[y] = low[y] = count
                    stack.append(y)
                    way.append(y)
                elif label[y] < 0 and number[y] < low[x]:
                    low[x] = number[y]
                continue
            way.pop()
            if way and low[x] < low[way[-1]]:
                low[way[-1]] = low[x]
            if low[x] == number[x]:
                while label[x] < 0:
                    label[stack.pop()] = labels
                labels += 1
    return label


def cancelled(graph: Graph, used: set[int]) -> tuple[set[int], int]:
    """The arcs without pairs that run against each other, and how many such pairs there were."""
    twins = {e for e in used if graph.twin[e] in used}
    return used - twins, len(twins) // 2


def dominators(start, head, back_start, back, root: int):
    """(number, idom) by depth-first order from the root: each node's number (-1: not reached) and each number's immediate dominator.

    start, head: arcs in compressed rows; back_start, back: their tails by head. Semidominators
    come from path compression, dominators from walking up (semi-NCA).
    """
    n = len(start) - 1
    number, order, parent, at = [-1] * n, [root], [0], list(start[:-1])
    number[root], stack = 0, [root]
    while stack:
        x = stack[-1]
        e = at[x]
        if e == start[x + 1]:
            stack.pop()
            continue
        at[x] = e + 1
        y = head[e]
        if number[y] < 0:
            number[y] = len(order)
            parent.append(number[x])
            order.append(y)
            stack.append(y)
    del at
    k = len(order)
    idom, semi, label = parent[:], list(range(k)), list(range(k))
    for i in range(k - 1, 0, -1):
        y, best = order[i], parent[i]
        for e in range(back_start[y], back_start[y + 1]):
            p = number[back[e]]
            if p < 0:
                continue
            if parent[p] > i:  # compress the linked part of the way up
                path = []
                while parent[p] > i:
                    path.append(p)
                    p = parent[p]
                while path:
                    q = path.pop()
                    parent[q] = parent[p]
                    if semi[label[p]] < semi[label[q]]:
                        label[q] = label[p]
                    p = q
            if semi[label[p]] < best:
                best = semi[label[p]]
        semi[i] = best
    for i in range(1, k):
        x = idom[i]
        while x > semi[i]:
            x = idom[x]
        idom[i] = x
    return number, idom


def fragile(u: np.ndarray, v: np.ndarray, goals: np.ndarray, orientation: str = "DA") -> pd.DataFrame:
    """node, goal, reached, top of each node of arcs (u, v).

    reached: a route leads to a goal (AD: from one); top: of the arcs that every such route
    uses, the end far from the goals of the one nearest to them, -1 without any. An arc is on
    every route to a node if it comes from the immediate dominator of a node above, all
    other arcs into which come from below it.
    """
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    nodes = np.unique(np.concatenate([u, v]))
    n = len(nodes)
    a, b = (np.searchsorted(nodes, x) for x in ((v, u) if orientation == "DA" else (u, v)))
    goal = np.isin(nodes, goals)
    at = np.flatnonzero(goal)
    code = np.unique(np.concatenate([(a * (n + 1) + b)[a != b], n * (n + 1) + at]))  # node n leads to all goals
    a, b = code // (n + 1), code % (n + 1)
    del code, u, v
    back = np.argsort(b, kind="stable")
    rows = np.arange(n + 2)
    number, idom = dominators(packed(np.searchsorted(a, rows)), packed(b), packed(np.searchsorted(b[back], rows)), packed(a[back]), n)
    k, size = len(idom), [1] * len(idom)
    for i in range(k - 1, 0, -1):
        size[idom[i]] += size[i]
    place, free = [0] * k, [1] * k  # nodes below i stand from place[i] on
    for i in range(1, k):
        d = idom[i]
        place[i] = free[d]
        free[d] += size[i]
        free[i] = place[i] + 1
    number, dom, place, size = np.array(number), np.array(idom), np.array(place), np.array(size)
    a, b = number[a], number[b]
    a, b = a[a >= 0], b[a >= 0]
    direct = a == dom[b]
    below = (place[a] >= place[b]) & (place[a] < place[b] + size[b])
    bridge = np.zeros(k, bool)
    bridge[b[direct]] = True
    bridge[b[~direct & ~below]] = False
    bridge[dom == 0] = False  # goals, and nodes that two of them serve apart
    top, marks = [-1] * k, bridge.tolist()
    for i in range(1, k):
        t = top[idom[i]]
        top[i] = t if t >= 0 else i if marks[i] else -1
    number, top = number[:n], np.array(top)
    name = np.empty(k, np.int64)
    name[number[number >= 0]] = nodes[number >= 0]
    found = np.where(number >= 0, top[np.maximum(number, 0)], -1)
    return pd.DataFrame({"node": nodes, "goal": goal, "reached": number >= 0, "top": pd.array(np.where(found >= 0, name[np.maximum(found, 0)], 0), "Int64")}).assign(top=lambda t: t["top"].mask(found < 0))


def collapse(segments: DataFrame, *keep: str) -> DataFrame:
    """u, v, w: the least finite cost of each parallel bundle; null, NaN and infinite costs are dropped.

    keep: columns of the cheapest segment that stay; ties go to their least values.
    """
    finite = segments.where("w IS NOT NULL AND NOT isnan(w) AND abs(w) < double('Infinity')")
    if not keep:
        return finite.groupBy("u", "v").agg(F.min("w").alias("w"))
    best = finite.groupBy("u", "v").agg(F.min(F.struct("w", *keep)).alias("b"))
    return best.select("u", "v", "b.w", *[f"b.{c}" for c in keep])


def split_nodes(arcs: DataFrame) -> DataFrame:
    """u, v of the graph in which node n is an arc from 2n to 2n + 1, so arc-disjoint routes there are node-disjoint here."""
    ends = arcs.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    return arcs.select((F.col("u") * 2 + 1).alias("u"), (F.col("v") * 2).alias("v")).unionByName(ends.select((F.col("n") * 2).alias("u"), (F.col("n") * 2 + 1).alias("v")))


def graph_rows(arcs: DataFrame, access: DataFrame, *more: str) -> DataFrame:
    """u, v, more, goal of the distinct arcs and, as (node, node) with goal 1, of the access nodes they have; checked against MOST_ARCS."""
    ensure_workers(arcs.sparkSession)
    plain = arcs.select(F.col("u").cast("long"), F.col("v").cast("long"), *more).where("u IS NOT NULL AND v IS NOT NULL").distinct().cache()
    n = plain.select("u", "v").distinct().count() if more else plain.count()
    if n > MOST_ARCS:
        plain.unpersist()
        raise ValueError(f"{n} arcs exceed MOST_ARCS; pass a table that names cities to by_city()")
    # at most as many as the graph has nodes
    goals = access.join(plain.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select(F.col("node").cast("long").alias("u")).distinct()
    rows = plain.withColumn("goal", F.lit(0).cast("long")).unionByName(goals.select("u", F.col("u").alias("v"), *[F.lit(0).cast("long").alias(c) for c in more], F.lit(1).cast("long").alias("goal")))
    rows._strandline_plain = plain
    return rows


def graph_of(t: dict[str, np.ndarray]):
    """(graph, set of access nodes it has) of the arrays of graph_rows()."""
    arc = t["goal"] == 0
    graph = Graph(t["u"][arc], t["v"][arc])
    return graph, set(graph.index(t["u"][~arc]))


def broadcast_graph(arcs: DataFrame, access: DataFrame):
    """A broadcast (graph, set of access nodes it has), made in a task: arcs (u, v) are checked against MOST_ARCS first."""
    rows = graph_rows(arcs, access)
    bc = made(rows, graph_of)
    rows._strandline_plain.unpersist()
    return bc


CUT = "array<struct<u:bigint,v:bigint>>"


def _rows(graph: Graph, targets: set, keys, entries, cap: int, backwards: bool):
    out = []
    for d, nodes in zip(keys, entries, strict=True):
        entry = graph.index(nodes)
        if not entry:
            continue
        if any(s in targets for s in entry):
            out.append((d, None, True, None, None, None))
            continue
        k, _, hops = graph.routes(entry, targets, cap, backwards)
        cut = graph.cut(hops, backwards) if hops and not backwards else None
        first = depth = None
        if cut is not None and k == 1:
            tail = graph.index([cut[0][0]])[0]
            first, depth = tail in set(entry), hops[tail]
        out.append((d, k, False, None if cut is None else [{"u": a, "v": b} for a, b in cut], first, depth))
    return pd.DataFrame(out, columns=["d", "kappa", "colocated", "cut", "cut_first", "cut_hops"]).astype({"kappa": "Int32", "colocated": "boolean", "cut_first": "boolean", "cut_hops": "Int32"})


def route_counts(arcs: DataFrame, demands: DataFrame, access: DataFrame, orientation: str = "DA", cap: int = CAP, bc=None) -> DataFrame:
    """d, kappa, colocated, cut, cut_first, cut_hops of each demand that the graph has.

    demands: (d) or (d, entry: array of nodes); each distinct entry set is solved once. A
    demand with an access point in its entry set is colocated and has a null kappa. kappa
    stops at cap, with a null cut. DA routes lead from entry nodes to access points, and the
    cut is the one nearest the demand; AD routes lead the other way and have no cut. For a
    bc: a broadcast_graph() of the arcs, which saves another one; access is then its own if
    None, else those given. For a single arc as cut, cut_first says that it leaves an entry node and cut_hops how many hops
    of the residual graph its tail is away. arcs: (u, v), repeats count once; access: (node).
    """
    spark = arcs.sparkSession
    goals = None if bc is None or access is None else spark.sparkContext.broadcast(fetched(access.select(F.col("node").cast("long").alias("node")).where("node IS NOT NULL").distinct())["node"])
    bc = bc or broadcast_graph(arcs, access)
    backwards = orientation == "AD"
    rows = demands if "entry" in demands.columns else demands.select("d", F.array(F.col("d").cast("long")).alias("entry"))
    rows = rows.where("d IS NOT NULL").select("d", F.array_sort(F.array_distinct("entry")).alias("entry")).distinct()
    kind = dict(rows.dtypes)["d"]

    def run(batches):
        graph, targets = bc.value
        if goals is not None:
            targets = set(graph.index(goals.value))
        for pdf in batches:
            yield _rows(graph, targets, pdf["d"], pdf["entry"], cap, backwards)

    # entry sets are dealt evenly and never grouped: one demand is one unit of work
    dealt = rows.repartition(max(spark.sparkContext.defaultParallelism * 2, 1), "d")
    return dealt.mapInPandas(run, f"d {kind}, kappa int, colocated boolean, cut {CUT}, cut_first boolean, cut_hops int")


def by_city(arcs: DataFrame, demands: DataFrame, access: DataFrame, orientation: str = "DA", cap: int = CAP) -> DataFrame:
    """route_counts() of many cities: arcs (city, u, v), demands (city, d), access (city, node); adds city.

    A city's arcs meet its demands in one task; a city is the unit that must fit one.
    """
    ensure_workers(arcs.sparkSession)
    a = arcs.select("city", F.lit(0).alias("what"), F.col("u").cast("long").alias("x"), F.col("v").cast("long").alias("y"))
    d = demands.select("city", F.lit(1).alias("what"), F.col("d").cast("long").alias("x"), F.lit(None).cast("long").alias("y"))
    g = access.select("city", F.lit(2).alias("what"), F.col("node").cast("long").alias("x"), F.lit(None).cast("long").alias("y"))
    rows = a.unionByName(d).unionByName(g).where("x IS NOT NULL").distinct()

    def run(pdf):
        part = {k: pdf[pdf["what"] == k] for k in range(3)}
        graph = Graph(part[0]["x"].to_numpy(np.int64), part[0]["y"].to_numpy(np.int64))
        out = _rows(graph, set(graph.index(part[2]["x"])), part[1]["x"], [[x] for x in part[1]["x"]], cap, orientation == "AD")
        return out.assign(city=pdf["city"].iloc[0])[["city", "d", "kappa", "colocated"]]

    return rows.groupBy("city").applyInPandas(run, f"city {dict(arcs.dtypes)['city']}, d long, kappa int, colocated boolean")


def two_counts(arcs: DataFrame, demands: DataFrame, access: DataFrame, orientation: str = "DA") -> DataFrame:
    """city, d, kappa (2 at most), colocated of the demands in each city's graph, as of route_counts() with a cap of 2.

    arcs (city, u, v), access (city, node), and demands (d) or (d, entry), which all cities
    share. A city's arcs meet in one task, which answers for all nodes at once: one arc cuts
    an entry set off if it is the topmost on every route of each of its nodes that has any.
    """
    ensure_workers(arcs.sparkSession)
    a = arcs.select("city", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    rows = a.unionByName(access.select("city", F.col("node").cast("long").alias("u"), F.lit(None).cast("long").alias("v")).where("u IS NOT NULL"))

    def run(pdf):
        arc = pdf["v"].notna()
        out = fragile(pdf["u"][arc], pdf["v"][arc], pdf["u"][~arc].to_numpy(np.int64), orientation)
        return out.assign(city=pdf["city"].iloc[0])[["city", "node", "goal", "reached", "top"]]

    kind = dict(arcs.dtypes)["city"]
    table = rows.groupBy("city").applyInPandas(run, f"city {kind}, node long, goal boolean, reached boolean, top long")
    entry = F.explode("entry" if "entry" in demands.columns else F.array("d")).alias("node")
    asked = demands.where("d IS NOT NULL").select("d", entry).select("d", F.col("node").cast("long")).distinct()
    met = asked.join(table, "node").groupBy("city", "d").agg(F.max("goal").alias("colocated"), F.sum(F.col("reached").cast("long")).alias("n"), F.count("top").alias("cut"), F.min("top").alias("lo"), F.max("top").alias("hi"))
    return met.select("city", "d", F.expr("CASE WHEN colocated THEN NULL WHEN n = 0 THEN 0 WHEN cut = n AND lo = hi THEN 1 ELSE 2 END").cast("int").alias("kappa"), "colocated")
