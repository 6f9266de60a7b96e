"""Route counts, cuts and routes against enumeration on small random graphs."""

from itertools import combinations

import numpy as np
import pytest

from strandline.operators import flow, frontier
from strandline.operators.flow import Graph, collapse, route_counts


def drawn(seed, n=7, m=12):
    """Distinct random arcs, loops left out, among nodes 10, 20, ..."""
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(1, n + 1, (m, 2)) * 10 if a != b}
    return sorted(pairs)


def reach(arcs, start, without=()):
    seen, open_ = set(start), list(start)
    while open_:
        x = open_.pop()
        for u, v in arcs:
            if u == x and v not in seen and (u, v) not in without:
                seen.add(v)
                open_.append(v)
    return seen


def least_cut(arcs, start, goals):
    """Fewest arcs whose removal cuts the goals off, and the source side of the cut nearest the source."""
    for k in range(len(arcs) + 1):
        sides = [reach(arcs, start, c) for c in combinations(arcs, k) if not reach(arcs, start, c) & goals]
        if sides:
            return k, min(sides, key=len)


@pytest.mark.parametrize("seed", range(25))
def test_counts_and_cuts(seed):
    arcs = drawn(seed)
    u, v = np.array(arcs).T
    nodes = sorted(set(u) | set(v))
    g, start, goals = Graph(u, v), {int(nodes[0])}, {int(x) for x in nodes[-2:]}
    k, side = least_cut(arcs, start, goals)
    got, cut = g.kappa(g.index(start), set(g.index(goals)))
    assert got == k and cut == sorted(a for a in arcs if a[0] in side and a[1] not in side)
    back = Graph(v, u)
    assert back.kappa(back.index(start), set(back.index(goals)), backwards=True)[0] == k
    assert g.kappa(g.index(start), set(g.index(goals)), cap=1)[0] == min(k, 1)
    # routes of the flow share no arc and lead from start to goals
    n, changed, _ = g.routes(g.index(start), set(g.index(goals)))
    paths = g.decompose(flow.cancelled(g, g.flow(changed))[0], g.index(start), set(g.index(goals)))
    steps = [(int(g.nodes[a]), int(g.nodes[b])) for p in paths for a, b in zip(p[:-1], p[1:])]
    assert len(paths) == n and len(set(steps)) == len(steps) and set(steps) <= set(arcs)
    assert all(int(g.nodes[p[0]]) in start and int(g.nodes[p[-1]]) in goals for p in paths)


@pytest.mark.parametrize("seed", range(10))
def test_masks(seed):
    arcs = drawn(seed, m=14)
    u, v = np.array(arcs).T
    g = Graph(u, v)
    open_ = [a for i, a in enumerate(arcs) if i % 3]
    place = g.places(*np.array(open_).T)
    forward = np.zeros(len(g.head), bool)
    forward[place] = True
    mask = {False: forward.tolist(), True: forward[g.twin].tolist()}
    nodes = sorted(set(u) | set(v))
    start, goals = {int(nodes[0])}, {int(nodes[-1])}
    k, changed, _ = g.routes(g.index(start), set(g.index(goals)), mask=mask)
    assert k == least_cut(open_, start, goals)[0]
    paths = g.decompose(g.flow(changed, mask=mask), g.index(start), set(g.index(goals)))
    assert len(paths) == k and {(int(g.nodes[a]), int(g.nodes[b])) for p in paths for a, b in zip(p[:-1], p[1:])} <= set(open_)


def test_dataframes(spark):
    arcs = spark.createDataFrame([(0, 1, 2.0), (0, 1, 1.0), (1, 2, float("nan")), (1, 2, None), (1, 2, 3.0)], "u long, v long, w double")
    assert sorted(map(tuple, collapse(arcs).collect())) == [(0, 1, 1.0), (1, 2, 3.0)]
    d = spark.createDataFrame([(0,), (2,), (9,), (None,)], "d long")
    a = spark.createDataFrame([(2,)], "node long")
    got = {r.d: (r.kappa, r.colocated, r.cut_first, r.cut_hops) for r in route_counts(arcs, d, a).collect()}
    assert got == {0: (1, False, True, 0), 2: (None, True, None, None)}
    cities = [x.withColumn("city", flow.F.lit("one")) for x in (arcs, d, a)]
    assert {(r.city, r.d, r.kappa) for r in flow.by_city(*cities).collect()} == {("one", 0, 1), ("one", 2, None)}


def node_disjoint(arcs, start, goal):
    """Fewest inner nodes whose removal cuts the goal off; None if an arc joins the ends."""
    inner = {x for a in arcs for x in a} - {start, goal}
    if (start, goal) in arcs:
        return None
    for k in range(len(inner) + 1):
        for gone in combinations(sorted(inner), k):
            left = [a for a in arcs if not set(a) & set(gone)]
            if goal not in reach(left, {start}):
                return k


def test_node_disjoint(spark):
    for seed in range(4):
        arcs = drawn(seed, m=13)
        nodes = sorted({x for a in arcs for x in a})
        start, goal = nodes[0], nodes[-1]
        want = node_disjoint(arcs, start, goal)
        if want is None:
            continue
        split = flow.split_nodes(spark.createDataFrame(arcs, "u long, v long"))
        asked = spark.createDataFrame([(start, [2 * start + 1])], "d long, entry array<long>")
        got = route_counts(split, asked, spark.createDataFrame([(2 * goal,)], "node long")).collect()
        assert got[0].kappa == want


@pytest.mark.parametrize("seed", range(8))
def test_least_budgets(seed):
    rng = np.random.default_rng(seed)
    arcs = drawn(seed, n=6, m=16)
    cost = {a: float(c) for a, c in zip(arcs, rng.permutation(len(arcs)) + 1)}
    u, v = np.array(arcs).T
    g, s = Graph(u, v), frontier.Streets(u, v, [cost[a] for a in arcs])
    nodes = sorted(set(u) | set(v))
    start, goal = int(nodes[0]), int(nodes[-1])
    sup = frontier.Support(g, s, [start], [goal], np.array(s.distances(s.index([goal]), True)))
    found = sup.least_budget(2)
    swept, steady = sup.swept(2)
    assert steady and (found == swept or not np.isfinite(found) and not np.isfinite(swept))
    if np.isfinite(found):
        routes = sup.witness(2, found)
        steps = [x for p in routes for x in zip(p[:-1], p[1:])]
        assert len(routes) == 2 and len(set(steps)) == len(steps)
        dist = lambda a, b: min((c for c in walk(arcs, cost, a, b)), default=np.inf)
        inside = [a for a in arcs if dist(start, a[0]) + cost[a] + dist(a[1], goal) <= found]
        tighter = [a for a in arcs if dist(start, a[0]) + cost[a] + dist(a[1], goal) < found]
        assert least_cut(inside, {start}, {goal})[0] >= 2 > least_cut(tighter, {start}, {goal})[0]


def walk(arcs, cost, a, b, seen=()):
    """Costs of all simple routes."""
    if a == b:
        yield 0.0
        return
    for x, y in arcs:
        if x == a and y not in seen:
            for c in walk(arcs, cost, y, b, (*seen, a)):
                yield c + cost[x, y]
