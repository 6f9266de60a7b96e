from collections import defaultdict

from strandline import catalog
from strandline.session import table
from strandline.sources import lattice

DIR = "/root/testdata/sf0.001"


def reached(starts, out, without=None):
    seen, open_ = set(starts), list(starts)
    while open_:
        x = open_.pop()
        for y in out[x]:
            if y not in seen and (x, y) != without:
                seen.add(y)
                open_.append(y)
    return seen


def test_every_order_and_supplier_counts(spark):
    arcs = {(r.u, r.v) for r in lattice.arcs(spark, DIR).collect()}
    out = defaultdict(set)
    for u, v in arcs:
        out[u].add(v)
    n = table(spark, DIR, "customer").count()
    nodes = {x for e in arcs for x in e}
    goals = {(r.s_suppkey * 37 + 11) % n for r in table(spark, DIR, "supplier").collect()} & nodes
    weight = defaultdict(float)
    for r in table(spark, DIR, "orders").collect():
        weight[r.o_custkey] += 1
    zones = set(weight) & nodes

    base = reached(goals, out)
    bad = {e: base - reached(goals, out, e) for e in arcs}
    got = {r.d: (r.k2, r.colocated) for r in catalog.QUERIES["g2_kappa_access_to_demand"](spark, DIR).collect()}
    assert set(got) == zones
    for d in zones:
        want = None if d in goals else 0 if d not in base else 1 if any(d in x for x in bad.values()) else 2
        assert got[d][1] == (d in goals) and (got[d][0] if got[d][0] is None else min(got[d][0], 2)) == want

    want = dict.fromkeys(arcs, 0.0)
    for d in zones - goals:
        if reached([d], out) & goals:
            cuts = {e: reached([d], out, e) for e in arcs}
            cuts = {e: side for e, side in cuts.items() if not side & goals}
            if cuts:
                want[min(cuts, key=lambda e: len(cuts[e]))] += weight[d]  # the cut nearest the source
    got = catalog.QUERIES["g13_cut_criticality"](spark, DIR).collect()
    assert {(r.u, r.v, r.key): r.cutcrit for r in got} == {(u, v, k): w for (u, v), w in want.items() for k in range((u + v) % 3 + 1)} and len(got) == len(set((r.u, r.v, r.key) for r in got))
