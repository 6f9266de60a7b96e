"""Searches that several results share or that a bound leads give what the plain ones give."""

import numpy as np
import pytest

from strandline.operators import ensembles, paths


class Read(list):
    """A list that counts how often it is read."""

    def __init__(self, x):
        super().__init__(x)
        self.times = 0

    def __getitem__(self, e):
        self.times += 1
        return super().__getitem__(e)


def street(seed: int, wide: int = 12, least: float = 1.0):
    rng = np.random.default_rng(seed)
    x = np.arange(wide * wide)
    east, south = x[x % wide < wide - 1], x[x + wide < len(x)]
    u, v = np.concatenate([east, east + 1, south, south + wide]), np.concatenate([east + 1, east, south + wide, south])
    kept = rng.random(len(u)) < 0.8
    return rng, paths.Streets(u[kept], v[kept], least * rng.integers(1, 5, kept.sum()))


def test_dependencies_look_back_once():
    _, g = street(0)
    g.cost = Read(g.cost)
    found = g.dependencies(3, dict.fromkeys(range(g.n), 1.0), 0.1)
    assert found and g.cost.times <= 2 * len(g.head)


@pytest.mark.parametrize("seed", range(6))
def test_led_routes_are_the_plain_ones(seed):
    rng, g = street(seed, least=1.0 if seed % 2 else 0.1)
    targets = set(rng.choice(g.n, 6, replace=False).tolist())
    ahead, read = g.ahead(targets), [0, 0]
    g.cost = Read(g.cost)
    for _ in range(40):
        entry, out = sorted(set(rng.choice(g.n, 3).tolist())), []
        for i, a in enumerate((None, ahead)):
            g.cost.times = 0
            out.append([g.route(entry, targets, ahead=a), g.shortest(entry, targets, 4, ahead=a), g.penalised(entry, targets, 4, 4.0, ahead=a), g.penalised(entry, targets, 4, 1.25, ahead=a)])
            read[i] += g.cost.times
        assert out[0] == out[1]
    assert read[1] < 0.7 * read[0]


def test_no_lead_over_arcs_that_cost_nothing():
    assert paths.Streets([0, 1], [1, 2], [0.0, 1.0]).ahead({2}) is None


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_indices_where_routes_are_found(spark):
    _, g = street(2, 6)
    arcs = spark.createDataFrame([(int(g.nodes[a]), int(g.nodes[b]), c) for a, b, c in zip(g.tail, g.head, g.cost, strict=True)], "u long, v long, w double")
    bc = paths.broadcast_streets(arcs)
    # 35 lies at an access point, 99 isn't in the graph
    d = spark.createDataFrame([(x, [x, x + 1]) for x in (0, 7, 14, 34)] + [(99, [99])], "d long, entry array<long>")
    access = spark.createDataFrame([(35,), (28,)], "node long")
    kinds = {"penalty4": 4.0, "penalty125": 1.25, "shortest": None}
    by = ["d", "generator"]
    r = ensembles.with_arcs(paths.routes(bc, d, access, 4, kinds))
    want = ensembles.indices(r, by).join(ensembles.disjoint_routes(r, by).drop("n"), by)
    got = paths.route_indices(bc, d, access, 4, kinds)
    assert got.dtypes == want.dtypes
    a, b = rows(got), rows(want)
    assert len(a) == len(b) > 0 and {x[0] for x in a} >= {34}
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], rel=1e-12)


def test_one_search_loads_several_weights():
    _, g = street(0)
    weights = [[float(x % 5) for x in range(g.n)], [1.0] * g.n, [0.0] * g.n]
    want = [g.dependencies(3, dict(enumerate(w)), 0.1) for w in weights]
    g.cost = Read(g.cost)
    g.dependencies(3, dict(enumerate(weights[0])), 0.1)
    once, g.cost.times = g.cost.times, 0
    found = g.loads(3, weights, 0.1)
    assert g.cost.times == once and not found[2]
    for a, b in zip(found, want, strict=True):
        assert a == pytest.approx(b, rel=1e-12)


def test_betweenness_of_two_weights(spark):
    _, g = street(1, 6)
    arcs = spark.createDataFrame([(int(g.nodes[a]), int(g.nodes[b]), c) for a, b, c in zip(g.tail, g.head, g.cost, strict=True)], "u long, v long, w double")
    bc = paths.broadcast_streets(arcs)
    src = spark.createDataFrame([(3, 1.0), (20, 2.0)], "node long, w double")
    to = spark.createDataFrame([(x, float(x % 4)) for x in range(0, 36, 2)] + [(99, 1.0)], "node long, w double")
    both = paths.betweenness(bc, src, to, 0.1, plain=True)
    one, ones = paths.betweenness(bc, src, to, 0.1), paths.betweenness(bc, src, to.selectExpr("node", "1D AS w"), 0.1)
    for got, want in ((both.select("u", "v", "b").where("b > 0"), one), (both.select("u", "v", "b_plain").where("b_plain > 0"), ones)):
        a, b = rows(got), rows(want)
        assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], rel=1e-12)
