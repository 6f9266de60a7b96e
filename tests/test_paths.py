"""Routes, ensembles and betweenness against listing all routes of small graphs."""

import math
from itertools import combinations

import numpy as np
import pytest

from strandline.functions.glm import negative_binomial
from strandline.functions.stats import logistic_slope
from strandline.operators import ensembles, reach, replay
from strandline.operators.paths import Streets
from tests.test_flow import drawn


def priced(seed, ties=False):
    rng = np.random.default_rng(seed)
    arcs = drawn(seed, n=6, m=15)
    cost = rng.integers(1, 4, len(arcs)) if ties else rng.permutation(len(arcs)) * 1.37 + 1
    return dict(zip(arcs, cost.astype(float).tolist()))


def routes(cost, a, goals, seen=()):
    if a in goals:
        yield (a,)
        return
    for x, y in cost:
        if x == a and y not in seen:
            for r in routes(cost, y, goals, (*seen, a)):
                yield (a, *r)


def length(cost, r):
    return sum(cost[x] for x in zip(r[:-1], r[1:]))


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_routes(seed):
    cost = priced(seed)
    u, v = np.array(list(cost)).T
    s = Streets(u, v, list(cost.values()))
    nodes = [int(x) for x in s.nodes]
    entry, goals = nodes[:2], set(nodes[-2:])
    every = sorted({round(length(cost, r), 6): r for e in entry for r in routes(cost, e, goals) if not set(r[1:]) & set(entry) or len(r) > 1}.items())
    got = [tuple(int(s.nodes[x]) for x in p) for p in s.shortest(s.index(entry), set(s.index(goals)), 5)]
    assert [round(length(cost, r), 6) for r in got] == [c for c, _ in every][:5] and len(set(got)) == len(got)
    # penalised: each route is cheapest when used arcs cost 4 times as much and one more
    now = dict(cost)
    for p in s.penalised(s.index(entry), set(s.index(goals)), 4, 4.0):
        r = tuple(int(s.nodes[x]) for x in p)
        assert math.isclose(length(now, r), min(length(now, q) for e in entry for q in routes(now, e, goals)))
        for x in zip(r[:-1], r[1:]):
            now[x] = now[x] * 4 + 1


@pytest.mark.parametrize("seed", range(8))
def test_dependencies(seed):
    cost = priced(seed, ties=True)
    u, v = np.array(list(cost)).T
    s = Streets(u, v, list(cost.values()))
    nodes = [int(x) for x in s.nodes]
    weight, want = {x: 1.0 + i for i, x in enumerate(nodes)}, {}
    for t in nodes[1:]:
        found = list(routes(cost, nodes[0], {t}))
        best = min((length(cost, r) for r in found), default=None)
        ties = [r for r in found if length(cost, r) == best]
        for r in ties:
            for x in zip(r[:-1], r[1:]):
                want[x] = want.get(x, 0.0) + weight[t] * math.exp(-0.1 * best) / len(ties)
    got = s.dependencies(s.index([nodes[0]])[0], {i: weight[x] for i, x in enumerate(nodes)}, 0.1)
    got = {(int(s.nodes[s.tail[e]]), int(s.nodes[s.head[e]])): b for e, b in got.items()}
    assert set(got) == set(want) and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)


def test_largest_disjoint():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sets = [frozenset(rng.integers(0, 9, 3).tolist()) for _ in range(int(rng.integers(0, 9)))]
        want = max((k for k in range(len(sets) + 1) for c in combinations(sets, k) if all(not a & b for a, b in combinations(c, 2))), default=0)
        assert ensembles.largest_disjoint(sets) == want


def test_failures_hash():
    u, v = np.arange(50), np.arange(50) + 1
    share = np.mean([reach.fails(r, u, v, 0.2).mean() for r in range(200)])
    assert 0.17 < share < 0.23


def test_walks_are_contiguous(spark):
    arcs = spark.createDataFrame([(i, (i + k) % 9) for i in range(9) for k in (1, 4)] + [(3, 77)], "u long, v long")
    rows = replay.walks(arcs, spark.createDataFrame([(c, 5) for c in range(20)], "closure long, size int"), times=3).collect()
    every = {(r.u, r.v) for r in arcs.collect()}
    assert len(rows) == 60
    for r in rows:
        steps = [(a.u, a.v) for a in r.arcs]
        assert set(steps) <= every and all(a[1] == b[0] for a, b in zip(steps[:-1], steps[1:])) and (len(steps) == 5 or steps[-1][1] == 77)


def test_overlap(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "closure long, ax double, ay double, bx double, by double")
    lines = spark.createDataFrame([(1, 2, 0.0, 5.0, 100.0, 5.0), (3, 4, 0.0, 30.0, 100.0, 30.0), (5, 6, 50.0, 0.0, 250.0, 0.0), (7, 8, 20.0, 0.0, 20.0, 300.0)], "u long, v long, ax double, ay double, bx double, by double")
    got = {(r.u, r.v): r.share for r in replay.overlap(c, lines, least=0.1).collect()}
    assert got[1, 2] == 1.0 and (3, 4) not in got and 0.2 < got[5, 6] < 0.4 and (7, 8) not in got


def test_regressions(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 9, 3000)
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(1 - 1.5 * np.log1p(x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    assert abs(logistic_slope(df, "x", "y") - 1.5) < 0.25 and logistic_slope(df.limit(5), "x", "y") is None
    z, g, o = rng.standard_normal(4000), rng.integers(0, 3, 4000), rng.uniform(-1, 1, 4000)
    rate = np.exp(0.4 + 0.5 * z + 0.3 * (g == 1) + o)
    n = rng.poisson(rate * rng.gamma(1.0, 1.0, 4000))
    df = spark.createDataFrame([(int(a), float(b), f"g{c}", float(d)) for a, b, c, d in zip(n, z, g, o)], "y int, z double, g string, o double")
    fit = {t: (b, se) for t, b, se, _ in negative_binomial(df, "y", ["z"], "g", "o")}
    assert abs(fit["z"][0] - 0.5) < 4 * fit["z"][1] < 0.3 and abs(fit["g=g1"][0] - 0.3) < 4 * fit["g=g1"][1]
