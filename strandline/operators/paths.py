"""Shortest paths, route ensembles and betweenness, by kernels over a broadcast weighted graph of checked size.

Searches are rows: of sources, of demands, or of (demand, generator). Equal costs are settled
by the smaller node, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.fetch import fetched, made
from strandline.operators import ensembles, layers
from strandline.operators.flow import MOST_ARCS, packed, spread_hops, strong_labels
from strandline.session import ensure_workers, stored

INF = float("inf")
#: Costs of searches that advance together, and how many times the least arc's cost the greatest may be for that.
COSTS_HELD, MOST_RANGES = 12_000_000, 1_000


class _Raised(dict):
    """Costs of the arcs that were raised, over those of all: a search copies nothing."""

    def __init__(self, cost):
        super().__init__()
        self.cost = cost

    def __missing__(self, e: int) -> float:
        return self.cost[e]


class Streets:
    """Arcs with costs in compressed rows, both ways; packed, as the driver and each Python worker hold a copy."""

    def __init__(self, u, v, w):
        u, v, w = np.asarray(u, np.int64), np.asarray(v, np.int64), np.asarray(w, np.float64)
        self.nodes = np.unique(np.concatenate([u, v]))
        self.n = len(self.nodes)
        a, b = np.searchsorted(self.nodes, u), np.searchsorted(self.nodes, v)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        self.tail, self.head, self.cost = packed(a), packed(b), array("d", np.ascontiguousarray(w[order]).tobytes())
        self.start = packed(np.searchsorted(a, np.arange(self.n + 1)))
        back = np.lexsort((a, b))
        self.back = packed(back)  # arc places by head
        self.back_start = packed(np.searchsorted(b[back], np.arange(self.n + 1)))

    def place(self, x: int, y: int) -> int:
        """Where the arc from x to y stands (the last of parallel ones); the graph must have it."""
        return bisect_right(self.head, y, self.start[x], self.start[x + 1]) - 1

    def index(self, keys) -> list[int]:
        keys = np.asarray(keys if isinstance(keys, np.ndarray) else list(keys), np.int64)
        if not self.n:
            return []
        at = np.minimum(np.searchsorted(self.nodes, keys), self.n - 1)
        return at[self.nodes[at] == keys].tolist()

    def distances(self, sources, backwards: bool = False, cutoff: float = INF, cost=None) -> list[float]:
        """Cost from the nearest source to each node (backwards: from each node to a source); infinite beyond the cutoff."""
        cost = cost or self.cost
        dist, heap = [INF] * self.n, []
        for s in sources:
            dist[s] = 0.0
            heap.append((0.0, s))
        heapq.heapify(heap)
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            arcs = self.back[self.back_start[x] : self.back_start[x + 1]] if backwards else range(self.start[x], self.start[x + 1])
            for e in arcs:
                y = self.tail[e] if backwards else self.head[e]
                t = d + cost[e]
                if t < dist[y] and t <= cutoff:
                    dist[y] = t
                    heapq.heappush(heap, (t, y))
        return dist

    def spread(self, sources: list[int], backwards: bool = False, cutoff: float = INF) -> np.ndarray:
        """A row a source: costs to all nodes (backwards: from them), infinite beyond the cutoff.

        The searches advance together through ranges of cost narrower than any arc's, so a
        range is final once it is reached and all its nodes are relaxed at once.
        """
        n, start, head, cost = self.n, *(np.array(x) for x in (self.start, self.head, self.cost))
        if backwards:
            back = np.array(self.back)
            start, head, cost = np.array(self.back_start), np.array(self.tail)[back], cost[back]
        if not len(cost) or cost.min() <= 0 or cost.max() > MOST_RANGES * cost.min():
            return np.array([self.distances([x], backwards, cutoff) for x in sources]).reshape(len(sources), n)
        width = float(cost.min()) * 0.999
        keys = np.arange(len(sources)) * n + np.array(sources, np.int64)
        dist, done, owner = np.full(len(sources) * n, INF), np.zeros(len(sources) * n, bool), np.zeros(len(sources) * n, np.int32)
        dist[keys] = 0.0
        ranges, k = {0: [keys]}, 0
        while ranges:
            if k not in ranges:
                k += 1
                continue
            keys = np.concatenate(ranges.pop(k))
            keys = keys[~done[keys]]
            owner[keys] = np.arange(len(keys))
            keys = keys[owner[keys] == np.arange(len(keys))]  # each once
            done[keys] = True
            x = keys % n
            each = start[x + 1] - start[x]
            e = np.arange(each.sum()) + np.repeat(start[x] - np.cumsum(each) + each, each)
            to, t = np.repeat(keys - x, each) + head[e], np.repeat(dist[keys], each) + cost[e]
            at = np.flatnonzero((t < dist[to]) & (t <= cutoff))
            at = at[np.argsort(-t[at], kind="stable")]
            to, t = to[at], t[at]
            dist[to] = t  # the least comes last
            won = dist[to] == t
            to, t = to[won], np.floor(t[won] / width).astype(np.int64)
            cuts = np.flatnonzero(np.diff(t)) + 1
            for part, r in zip(np.split(to, cuts), t[np.concatenate(([0], cuts))] if len(t) else (), strict=False):
                ranges.setdefault(int(r), []).append(part)
        return dist.reshape(len(sources), n)

    def route(self, entry, targets, cost=None, banned=frozenset(), closed=frozenset(), ahead=None):
        """(cost, nodes) of the cheapest route from an entry node to a target, without banned nodes and closed arcs; or None.

        ahead: cost from each node to the nearest target by the graph's own costs, all above 0
        and none above `cost`. It leads the search; the route is the same one.
        """
        if ahead is not None:
            return self._led(entry, targets, cost, banned, closed, ahead)
        cost = self.cost if cost is None else cost
        dist, came, done = {}, {}, set()
        heap = [(0.0, s, -1) for s in sorted(set(entry)) if s not in banned]
        heapq.heapify(heap)
        while heap:
            d, x, e = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            came[x] = e
            if x in targets:
                path = [x]
                while came[path[-1]] >= 0:
                    path.append(self.tail[came[path[-1]]])
                return d, path[::-1]
            for e in range(self.start[x], self.start[x + 1]):
                y = self.head[e]
                t = d + cost[e]
                if y not in done and y not in banned and e not in closed and t < dist.get(y, INF):
                    dist[y] = t
                    heapq.heappush(heap, (t, y, e))
        return None

    def _led(self, entry, targets, cost, banned, closed, ahead):
        """route(), by nodes in order of their cost and that ahead of them; those at the cheapest route's or less are all settled."""
        cost = self.cost if cost is None else cost
        start, head, tail, back, back_start, push, pop = self.start, self.head, self.tail, self.back, self.back_start, heapq.heappush, heapq.heappop
        dist = {s: 0.0 for s in entry if s not in banned and ahead[s] < INF}
        heap, done, most, goal = [(ahead[s], 0.0, s) for s in dist], {}, INF, None
        heapq.heapify(heap)
        while heap:
            f, d, x = pop(heap)
            if f > most:
                break
            if d > dist[x] or x in done and done[x] <= d:
                continue
            done[x] = d
            if x in targets:
                if goal is None or (d, x) < goal:
                    goal, most = (d, x), d + d * 1e-9 + 1e-9
                continue
            for e in range(start[x], start[x + 1]):
                y = head[e]
                t = d + cost[e]
                if t < dist.get(y, INF) and ahead[y] < INF and y not in banned and e not in closed:
                    dist[y] = t
                    push(heap, (t + ahead[y], t, y))
        if goal is None:
            return None
        d, x = goal
        path = [x]
        while d > 0:
            # the first settled node (by cost, then number) from which the cost is attained
            d, x = min((done[u], u) for i in range(back_start[x], back_start[x + 1]) if (u := tail[e := back[i]]) in done and done[u] + cost[e] == d and e not in closed and u not in targets)
            path.append(x)
        return goal[0], path[::-1]

    def ahead(self, targets):
        """What route() takes as ahead; None if an arc costs nothing or less."""
        return array("d", self.distances(targets, True)) if len(self.cost) and min(self.cost) > 0 else None

    def arcs_of(self, path) -> list[int]:
        return [self.place(x, y) for x, y in zip(path[:-1], path[1:], strict=True)]

    def length(self, path) -> float:
        return float(sum(self.cost[e] for e in self.arcs_of(path)))

    def penalised(self, entry, targets, k: int, penalty: float, first=None, ahead=None) -> list[list[int]]:
        """k cheapest routes in turn, each used arc then costing penalty * cost + 1; a prefix for a smaller k.

        first: what route() found, if that is known; ahead: as in route().
        """
        cost, out = _Raised(self.cost), []
        for i in range(k):
            found = first if first and not i else self.route(entry, targets, cost if i else None, ahead=ahead if penalty >= 1 else None)
            if not found:
                break
            out.append(found[1])
            for e in self.arcs_of(found[1]):
                cost[e] = cost[e] * penalty + 1.0
        return out

    def shortest(self, entry, targets, k: int, first=None, ahead=None) -> list[list[int]]:
        """The k cheapest routes without loops from any entry node to any target, by deviations from those found."""
        first = first or self.route(entry, targets, ahead=ahead)
        if not first:
            return []
        found, heap, seen = [first[1]], [], {tuple(first[1])}
        while len(found) < k:
            last = found[-1]
            # a deviation leaves a found route at its i-th node (-1: it begins at another entry node)
            for i in range(-1, len(last) - 1):
                root = last[: i + 1]
                if root and root[-1] in targets:
                    break
                if i < 0:
                    starts = [s for s in entry if s not in {p[0] for p in found}]
                    spur = self.route(starts, targets, ahead=ahead) if starts else None
                    new = spur[1] if spur else None
                else:
                    closed = {self.place(p[i], p[i + 1]) for p in found if len(p) > i + 1 and p[: i + 1] == root}
                    spur = self.route([root[-1]], targets, banned=frozenset(root[:-1]), closed=closed, ahead=ahead)
                    new = root[:-1] + spur[1] if spur else None
                if new and tuple(new) not in seen:
                    seen.add(tuple(new))
                    heapq.heappush(heap, (self.length(new), new))
            if not heap:
                break
            found.append(heapq.heappop(heap)[1])
        return found

    def dependencies(self, source: int, weights: dict[int, float], damping: float = 0.0, tolerance: float = 1e-9) -> dict[int, float]:
        """For each arc the sum over targets of weight * exp(-damping * cost) * share of the cheapest routes that use it."""
        if isinstance(weights, dict):
            weights = array("d", [weights.get(x, 0.0) for x in range(self.n)])
        return self.loads(source, [weights], damping, tolerance)[0]

    def loads(self, source: int, weights: list, damping: float = 0.0, tolerance: float = 1e-9) -> list[dict[int, float]]:
        """dependencies() for each of several weights (by node), of one search."""
        n, start, head, tail, cost, back, back_start = self.n, self.start, self.head, self.tail, self.cost, self.back, self.back_start
        # a few bytes a node, as the search may reach the whole graph; rank: order of settling, from 1
        dist, rank, order, heap = array("d", [INF]) * n, array("i", [0]) * n, array("i"), [(0.0, source)]
        ways, last, ends = array("d", [0.0]) * n, array("i"), array("i")  # last: arcs that cheapest routes to a node end with
        dist[source], ways[source] = 0.0, 1.0
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            d, x = pop(heap)
            if rank[x]:
                continue
            if x != source:
                total = 0.0
                for i in range(back_start[x], back_start[x + 1]):
                    e = back[i]
                    u = tail[e]
                    if rank[u] and -tolerance <= dist[u] + cost[e] - d <= tolerance:
                        last.append(e)
                        total += ways[u]
                ways[x] = total
            order.append(x)
            rank[x] = len(order)
            ends.append(len(last))
            for e in range(start[x], start[x + 1]):
                y = head[e]
                if not rank[y]:
                    t = d + cost[e]
                    if t < dist[y] - tolerance:
                        dist[y] = t
                        push(heap, (t, y))
        return [self._shares(order, ends, last, dist, ways, w, damping) for w in weights]

    def _shares(self, order, ends, last, dist, ways, weight, damping: float) -> dict[int, float]:
        share, out, tail, exp = array("d", [0.0]) * self.n, {}, self.tail, math.exp
        for i in range(len(order) - 1, 0, -1):
            x = order[i]
            s = share[x]
            if weight[x]:
                s += weight[x] * (exp(-damping * dist[x]) if damping else 1.0)
            if s:
                s /= ways[x]
                for j in range(ends[i - 1], ends[i]):
                    e = last[j]
                    u = tail[e]
                    part = s * ways[u]
                    out[e] = part
                    share[u] += part
        return out

    def turned(self) -> Streets:
        """The graph with each arc the other way, made of the same packed arrays."""
        out, back = Streets.__new__(Streets), np.array(self.back)
        out.nodes, out.n = self.nodes, self.n
        out.tail, out.head = (packed(np.array(x)[back]) for x in (self.head, self.tail))
        out.cost, out.start = array("d", np.array(self.cost)[back].tobytes()), self.back_start
        out.back, out.back_start = packed(np.argsort(back, kind="stable")), self.start
        return out


def broadcast_streets(arcs: DataFrame, of=None):
    """A broadcast Streets (or what `of` makes of it) of collapsed arcs (u, v, w), made in a task behind a check of their number."""
    ensure_workers(arcs.sparkSession)
    plain = arcs.select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("w").cast("double")).cache()
    n = plain.count()
    if n > MOST_ARCS:
        raise ValueError(f"{n} arcs exceed MOST_ARCS; split the table by city")
    bc = made(plain, lambda t: (of or (lambda g: g))(Streets(t["u"], t["v"], t["w"])))
    plain.unpersist()
    return bc


def _nodes(df: DataFrame, name: str) -> np.ndarray:
    return fetched(df.select(F.col(name).cast("long").alias("n")).where("n IS NOT NULL").distinct())["n"]


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism * 2, 1), key)


def _searched(g, ids, backwards: bool, cutoff: float = INF):
    """(place in ids, costs to all nodes) of each id that the graph has."""
    known = [(i, at[0]) for i, x in enumerate(ids) if (at := g.index([x]))]
    size = max(1, COSTS_HELD // max(g.n, 1))
    for a in range(0, len(known), size):
        part = known[a : a + size]
        yield from zip((i for i, _ in part), g.spread([x for _, x in part], backwards, cutoff), strict=True)


def _whole(batches):
    """All rows of a task at once: one a source."""
    held = [pdf for pdf in batches if len(pdf)]
    return [pd.concat(held, ignore_index=True)] if held else []


def distances(bc, sources: DataFrame, backwards: bool = False, cutoff: float = INF) -> DataFrame:
    """s, node, dist from each distinct source (s) to all nodes it reaches (backwards: from them to it)."""
    def run(batches):
        g = bc.value
        for pdf in _whole(batches):
            for i, d in _searched(g, pdf["s"], backwards, cutoff):
                ok = np.isfinite(d)
                yield pd.DataFrame({"s": np.full(ok.sum(), pdf["s"][i]), "node": g.nodes[ok], "dist": d[ok]})

    return _dealt(sources.select(F.col("s").cast("long")).where("s IS NOT NULL").distinct(), "s").mapInPandas(run, "s long, node long, dist double")


def reach(bc, sources: DataFrame, backwards: bool = False) -> DataFrame:
    """s, nodes, total, farthest of distances(): how many, their sum and the greatest, summed where they are found.

    Many sources of a long, narrow graph are swept (layers.reach), one side of some
    neighbouring sources a task; otherwise each is searched.
    """
    spark, kind = sources.sparkSession, "s long, nodes long, total double, farthest double"
    ids = _nodes(sources, "s")
    wanted, parts = spark.sparkContext.broadcast(ids), max(1, -(-len(ids) // layers.PART))  # at most a graph's nodes count

    def sweep(batches):
        for pdf in batches:
            for i in pdf["id"]:
                g = bc.value
                at = np.sort(np.array(g.index(wanted.value), np.int64))
                found = layers.reach(g, np.array_split(at, parts)[i // 2], backwards, i % 2 == 1) if len(at) >= layers.FEW else None
                if found is None:
                    yield pd.DataFrame({"s": [None], "nodes": [0], "total": [0.0], "farthest": [0.0]}).astype({"s": "Int64"})
                else:
                    yield pd.DataFrame({"s": g.nodes[found[0]], **dict(zip(["nodes", "total", "farthest"], found[1:], strict=True))})

    swept = stored(spark.range(0, 2 * parts, 1, 2 * parts).mapInPandas(sweep, kind))
    if not swept.where("s IS NULL").limit(1).count():
        return swept.groupBy("s").agg(F.sum("nodes").alias("nodes"), F.sum("total").alias("total"), F.max("farthest").alias("farthest"))

    def run(batches):
        g = bc.value
        for pdf in _whole(batches):
            out = []
            for i, d in _searched(g, pdf["s"], backwards):
                d = d[np.isfinite(d)]
                out.append((pdf["s"][i], len(d), float(d.sum()), float(d.max())))
            yield pd.DataFrame(out, columns=["s", "nodes", "total", "farthest"])

    return _dealt(sources.select(F.col("s").cast("long")).where("s IS NOT NULL").distinct(), "s").mapInPandas(run, kind)


def gravity(bc, sources: DataFrame, weights: DataFrame, backwards: bool = False) -> DataFrame:
    """s, score: the sum over the weighted nodes (node, w) that a source (s, extra) reaches of w / (cost + extra).

    Sources without such a node have no row. Pairs are summed where they are found.
    """
    known = weights.where("node IS NOT NULL AND w IS NOT NULL").groupBy(F.col("node").cast("long").alias("node")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    wanted = weights.sparkSession.sparkContext.broadcast(fetched(known))  # at most a graph's nodes count

    def run(batches):
        g, t = bc.value, wanted.value
        w = np.full(g.n, np.nan)
        at = np.minimum(np.searchsorted(g.nodes, t["node"]), max(g.n - 1, 0))
        there = g.nodes[at] == t["node"] if g.n else np.zeros(len(at), bool)
        w[at[there]] = t["w"][there]
        for pdf in _whole(batches):
            out = []
            for i, d in _searched(g, pdf["s"], backwards):
                ok = np.isfinite(d) & ~np.isnan(w)
                if ok.any():
                    out.append((pdf["s"][i], float((w[ok] / (d[ok] + pdf["extra"][i])).sum())))
            yield pd.DataFrame(out, columns=["s", "score"])

    rows = sources.select(F.col("s").cast("long"), F.col("extra").cast("double")).where("s IS NOT NULL").distinct()
    return _dealt(rows, "s").mapInPandas(run, "s long, score double")


def to_nearest(bc, access: DataFrame, backwards: bool = True, cutoff: float = INF) -> DataFrame:
    """node, dist to the nearest access point (backwards False: from it) of each node that has one; a single search."""
    goals = _nodes(access, "node")
    spark = access.sparkSession

    def run(batches):
        for _ in batches:
            g = bc.value
            d = np.array(g.distances(g.index(goals), backwards, cutoff))
            ok = np.isfinite(d)
            yield pd.DataFrame({"node": g.nodes[ok], "dist": d[ok]})

    return spark.range(1, numPartitions=1).mapInPandas(run, "node long, dist double")


def potentials(bc, demands: DataFrame, access: DataFrame, budget: float) -> DataFrame:
    """d, nodes, total, arcs, least, within of each entry set (d, entry).

    nodes that it reaches and the sum of their costs; arcs with a route over them to access,
    the least cost of such a route, and arcs with one within the budget.
    """
    goals = _nodes(access, "node")

    def run(batches):
        g = bc.value
        tail, head, cost = np.array(g.tail, np.int64), np.array(g.head, np.int64), np.array(g.cost)
        rest = cost + np.array(g.distances(g.index(goals), True))[head] if len(head) else cost
        for pdf in batches:
            out = []
            for d, nodes in zip(pdf["d"], pdf["entry"], strict=True):
                at = g.index(nodes)
                if at:
                    t = np.array(g.distances(at))
                    mu = t[tail] + rest
                    ok = np.isfinite(mu)
                    out.append((d, int(np.isfinite(t).sum()), float(t[np.isfinite(t)].sum()), int(ok.sum()), float(mu[ok].min()) if ok.any() else None, int((mu[ok] <= budget).sum())))
            yield pd.DataFrame(out, columns=["d", "nodes", "total", "arcs", "least", "within"])

    return _dealt(demands.select(F.col("d").cast("long"), "entry"), "d").mapInPandas(run, "d long, nodes long, total double, arcs long, least double, within long")


class Corridors:
    """Answers on the arcs that routes from entry nodes to access points use, without a search of the whole graph each.

    A search ends where it meets a strong component of `large` nodes or more; what a set of
    those reaches is found once.
    """

    KEPT = 64

    def __init__(self, g: Streets, goals: list[int], large: int = 64):
        self.g, self.to, self.reached = g, array("d", g.distances(goals, True)), {}
        tail, head = np.array(g.tail, np.int64), np.array(g.head, np.int64)
        rest = np.array(g.cost) + np.array(self.to)[head]
        self.rest = array("d", rest.tobytes())  # from an arc's tail over it to access
        # arcs of a node from which access is reached
        self.good = array("q", np.bincount(tail[np.isfinite(rest)], minlength=g.n).astype(np.int64).tobytes())
        label = np.array(strong_labels(g.start, g.head), np.int64)
        size = np.bincount(label, minlength=1)
        self.large = packed(np.where(size[label] >= large, label, -1)) if g.n else packed([])

    def _reached(self, some: dict[int, int]):
        """(mask of the nodes that these large components reach, arcs of theirs from which access is reached)."""
        key = frozenset(some)
        if key not in self.reached:
            if len(self.reached) >= self.KEPT:
                self.reached.clear()
            mask = spread_hops(np.frombuffer(self.g.start, np.int32), np.frombuffer(self.g.head, np.int32), np.array(list(some.values())))
            self.reached[key] = mask.tobytes(), int(np.frombuffer(self.good, np.int64)[mask].sum())
        return self.reached[key]

    def arcs(self, entry) -> int:
        """Arcs with a route over them from an entry node to access."""
        g, met, stack, seen = self.g, {}, list(entry), set(entry)
        while stack:
            x = stack.pop()
            if self.large[x] >= 0:
                met[self.large[x]] = x
                continue
            for e in range(g.start[x], g.start[x + 1]):
                y = g.head[e]
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        if not met:
            return sum(self.good[x] for x in seen)
        mask, n = self._reached(met)
        return n + sum(self.good[x] for x in seen if not mask[x])

    def least(self, entry) -> float:
        """Cost of the cheapest route of one arc or more: it begins with an arc of an entry node."""
        g = self.g
        return min((self.rest[e] for x in entry for e in range(g.start[x], g.start[x + 1])), default=INF)

    def within(self, entry, budget: float) -> int:
        """Arcs with such a route within the budget; nodes from which access is farther aren't left."""
        g, most, n = self.g, budget * (1 + 1e-9) + 1e-9, 0
        dist, heap = dict.fromkeys(entry, 0.0), [(0.0, x) for x in entry]
        heapq.heapify(heap)
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in range(g.start[x], g.start[x + 1]):
                n += d + self.rest[e] <= budget
                y, t = g.head[e], d + g.cost[e]
                if t < dist.get(y, INF) and t + self.to[y] <= most:
                    dist[y] = t
                    heapq.heappush(heap, (t, y))
        return n


def corridors(arcs: DataFrame, demands: DataFrame, access: DataFrame, budget: float) -> DataFrame:
    """d, arcs, least, within of potentials(), for entry sets (d, entry) that have an arc with a route over it to access."""
    goals = arcs.sparkSession.sparkContext.broadcast(_nodes(access, "node"))  # at most a graph's nodes count
    bc = broadcast_streets(arcs, lambda g: Corridors(g, g.index(goals.value)))

    def run(batches):
        c = bc.value
        for pdf in batches:
            out = []
            for d, nodes in zip(pdf["d"], pdf["entry"], strict=True):
                at = sorted(set(c.g.index(nodes)))
                if at and (n := c.arcs(at)):
                    least = c.least(at)
                    out.append((d, n, least, c.within(at, budget) if least <= budget else 0))
            yield pd.DataFrame(out, columns=["d", "arcs", "least", "within"])

    return _dealt(demands.select(F.col("d").cast("long"), "entry"), "d").mapInPandas(run, "d long, arcs long, least double, within long")


ROUTES = "d long, generator string, route int, cost double, nodes array<long>"


def routes(bc, demands: DataFrame, access: DataFrame, k: int, generators: dict) -> DataFrame:
    """d, generator, route (from 0), cost, nodes of the routes from entry sets (d, entry) to access points.

    generators: name -> penalty of the iterated penalised search, or None for the k cheapest
    loopless routes. Demands that reach no access point have no rows.
    """
    def rows(g, d, name, found):
        return [(d, name, i, g.length(p), g.nodes[p].tolist()) for i, p in enumerate(found)]

    return _found(bc, demands, access, k, generators, rows, ROUTES)


def _found(bc, demands: DataFrame, access: DataFrame, k: int, generators: dict, rows, schema: str) -> DataFrame:
    """What rows(graph, d, generator, its routes) makes of the routes of each demand (d, entry) and generator."""
    goals = access.sparkSession.sparkContext.broadcast(_nodes(access, "node"))  # at most a graph's nodes count
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {x.split()[0]: "int32" for x in schema.split(", ") if x.split()[1] == "int"}

    def run(batches):
        g = bc.value
        targets = set(g.index(goals.value))
        ahead = g.ahead(targets)
        for pdf in batches:
            out = []
            for d, nodes in zip(pdf["d"], pdf["entry"], strict=True):
                entry = g.index(nodes)
                first = g.route(entry, targets, ahead=ahead) if entry else None
                if first:
                    for name, penalty in generators.items():
                        out += rows(g, d, name, g.shortest(entry, targets, k, first, ahead) if penalty is None else g.penalised(entry, targets, k, penalty, first, ahead))
            yield pd.DataFrame(out, columns=names).astype(kinds)

    return _dealt(demands.select(F.col("d").cast("long"), "entry").distinct(), "d").mapInPandas(run, schema)


def route_indices(bc, demands: DataFrame, access: DataFrame, k: int, generators: dict) -> DataFrame:
    """d, generator, n, exp_h, rpe, li, deng, h_norm, disjoint of routes(): ensembles.measured(), where the routes are found."""
    def rows(g, d, name, found):
        sets = [frozenset(g.arcs_of(p)) for p in found]
        return [(d, name, *ensembles.measured([g.length(p) for p in found], sets))]

    return _found(bc, demands, access, k, generators, rows, f"d long, generator string, {ensembles.MEASURED}")


def betweenness(bc, sources: DataFrame, targets: DataFrame, damping: float = 0.0, backwards: bool = False, plain: bool = False) -> DataFrame:
    """u, v, b: pair-weighted shares of cheapest routes over each arc that has any.

    sources (node, w) and targets (node, w); a pair weighs the product. Each source is one
    search; a task sums its sources before the shuffle, so what is moved is arcs, not pairs.
    backwards: routes lead from targets to sources. plain: adds b_plain, of the same searches
    with 1 for each target's weight.
    """
    known = targets.where("node IS NOT NULL AND w IS NOT NULL").groupBy(F.col("node").cast("long").alias("node")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    wanted = targets.sparkSession.sparkContext.broadcast(fetched(known))  # at most a graph's nodes count
    names = ["b", "b_plain"][: 1 + plain]

    def run(batches):
        g, t = bc.value, wanted.value
        if backwards:
            g = g.turned()
        w, at = np.zeros((len(names), g.n)), np.minimum(np.searchsorted(g.nodes, t["node"]), max(g.n - 1, 0))
        there = g.nodes[at] == t["node"] if g.n else np.zeros(len(at), bool)
        w[0, at[there]] = t["w"][there]
        if plain:
            w[1, at[there]] = 1.0
        w, total, any_ = [array("d", x.tobytes()) for x in w], np.zeros((len(names), len(g.head))), np.zeros(len(g.head), bool)
        for pdf in batches:
            for s, ws in zip(pdf["node"], pdf["w"], strict=True):
                for at in g.index([s]):
                    for row, found in zip(total, g.loads(at, w, damping), strict=True):
                        e = np.fromiter(found, np.int64, len(found))
                        row[e] += ws * np.fromiter(found.values(), float, len(found))
                        any_[e] = True
        hit = np.flatnonzero(any_)
        for a in range(0, len(hit), 100_000):
            e = hit[a : a + 100_000]
            u, v = g.nodes[np.array(g.tail)[e]], g.nodes[np.array(g.head)[e]]
            yield pd.DataFrame({"u": v if backwards else u, "v": u if backwards else v, **dict(zip(names, total[:, e], strict=True))})

    rows = _dealt(sources.groupBy(F.col("node").cast("long").alias("node")).agg(F.sum("w").alias("w")), "node")
    return rows.mapInPandas(run, "u long, v long, " + ", ".join(f"{x} double" for x in names)).groupBy("u", "v").agg(*[F.sum(x).alias(x) for x in names])
