"""What round 2 found: results on odd inputs, and kernels that hold larger graphs and searches."""

import pickle
import re
import sys

import duckdb
import numpy as np
import pandas as pd

from strandline import catalog
from strandline.llm import lm
from strandline.operators import flow, frontier, paths


def test_horizon_of_odd_prices(spark, tmp_path):
    rows = "(1, 'NULL'), (2, 'inf'), (3, '-inf'), (4, 'nan'), (5, '-3.25'), (6, '900.1'), (10, 'NULL'), (NULL, '901.7'), (7, '1234567.89'), (8, '987654321.13'), (9, '1e300'), (11, '1e307')"
    duckdb.sql(f"COPY (SELECT k::BIGINT AS p_partkey, nullif(v, 'NULL')::DOUBLE AS p_retailprice, CASE WHEN k = 6 THEN NULL ELSE 7 END::INTEGER AS p_size FROM (VALUES {rows}) t(k, v)) TO '{tmp_path}/part.parquet'")
    duckdb.sql(f"CREATE OR REPLACE VIEW part AS FROM '{tmp_path}/part.parquet'")
    got = {(r.p_partkey, r.rho, r.k): repr(r.horizon) for r in catalog.QUERIES["i10_horizon"](spark, str(tmp_path)).collect()}
    want = {(a, b, c): repr(h) for a, b, c, h in duckdb.sql(f"SELECT p_partkey, rho, k, horizon FROM ({catalog.ORACLE_SQL['i10_horizon']}) q").fetchall()}
    assert got == want and len(got) == 48


def test_filter_rows_are_packed_by_call():
    rng = np.random.default_rng(5)
    h, q, blocks = rng.integers(-(2**63), 2**63, 30_000), rng.integers(0, 4, 30_000).astype(np.int8), 500
    batches = [pd.DataFrame({"h": h[a : a + 7_000], "q": q[a : a + 7_000]}) for a in range(0, 30_000, 7_000)]
    rows = pd.concat(lm._packed(blocks)(iter([*batches, batches[0][:0]])))
    assert len(rows) == rows["call"].nunique() == -(-blocks // lm.BLOCKS_A_CALL)  # a row a call, not a row an n-gram
    assert rows["h"].map(len).sum() == 8 * len(h) and rows["q"].map(len).sum() == len(h)
    found = pd.concat([lm._fill(blocks)((int(c),), g) for c, g in rows.groupby("call")])
    got = lm.Filter(blocks, list(found.itertuples(index=False))).counts(h.view(np.uint64))
    assert (got >= 2.0 ** ((q + 0.5) / 2) - 1e-9).all() and (got == 2.0 ** ((q + 0.5) / 2)).mean() > 0.9
    assert not list(lm._packed(blocks)(iter([])))


def test_graphs_are_packed():
    n = 100_000
    u = np.concatenate([np.arange(n), np.arange(n)])
    v = np.concatenate([np.arange(n) + 1, np.arange(n) + 400])
    g = flow.Graph(u, v)
    assert len(pickle.dumps(g)) < 30 * len(g.head) and sys.getsizeof(g.head) < 5 * len(g.head)
    s = paths.Streets(u, v, np.ones(len(u)))
    assert len(pickle.dumps(s)) < 40 * len(u) and s.place(5, 405) == s.start[5] + 1 and s.head[s.place(5, 6)] == 6
    assert g.routes([0], {500})[0] == 2 and g.routes([500], {0}, backwards=True)[0] == 2
    # a search with a penalty copies no costs
    assert s.penalised([0], {401}, 2, 4.0)[0] == [0, 1, 401] or s.penalised([0], {401}, 2, 4.0)[0] == [0, 400, 401]


def test_a_graph_serves_several_access_sets(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "u long, v long")
    d = spark.createDataFrame([(1,)], "d long")
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    bc = flow.broadcast_graph(arcs, node(4))
    got = [flow.route_counts(arcs, d, a, bc=bc).first().kappa for a in (None, node(3), node(4, 99))]
    assert got == [1, 2, 1]


def test_budgets_are_searched_near_the_demand():
    wide, n = 200, 200 * 200
    x = np.arange(n)
    east, south = x[x % wide < wide - 1], x[x + wide < n]
    u, v = np.concatenate([east, east + 1, south, south + wide]), np.concatenate([east + 1, east, south + wide, south])
    w = 50.0 + (u * 37 + v * 11) % 100
    graph, streets, goal = flow.Graph(u, v), paths.Streets(u, v, w), 100 * wide + 100
    to = streets.distances(streets.index([goal]), True)
    s = frontier.Support(graph, streets, [goal - 3], [goal], to)
    found, (swept, steady) = s.least_budget(2), s.swept(2)
    assert found == swept and steady and len(s.mu) < 2_000  # of 159,200 arcs
    t, tail, head = np.array(streets.distances([goal - 3])), np.array(streets.tail), np.array(streets.head)
    mu = t[tail] + np.array(streets.cost) + np.array(to)[head]
    whole = lambda b: graph.routes([goal - 3], {goal}, 2, mask={False: mu <= b + 1e-9})[0]
    assert whole(found) == 2 and whole(mu[mu < found - 1e-9].max()) == 1
    assert len(s.witness(2, found)) == 2 and s.least_budget(5) == np.inf  # four streets lead from a node


def test_matched_controls_join_cells(spark, tmp_path):
    # 2,000 labelled rows and 12,000 others of one brand stand in 50 places: before, all 24 million pairs were made
    duckdb.sql(f"COPY (SELECT i AS p_partkey, 'part' AS p_name, 'b' AS p_brand, CAST(1 + i % 50 AS INTEGER) AS p_size, 900.0 + i % 997 AS p_retailprice FROM range(14000) r(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    duckdb.sql(f"CREATE OR REPLACE VIEW part AS FROM '{tmp_path}/part.parquet'")
    df = catalog.QUERIES["r14_matched_controls"](spark, str(tmp_path))
    got = {tuple(r) for r in df.select("id", "control", "k").collect()}
    assert got == set(duckdb.sql(f"SELECT id, control, k FROM ({catalog.ORACLE_SQL['r14_matched_controls']}) q").fetchall()) and len(got) == 10_000
    node = df._jdf.queryExecution().executedPlan()
    joined = max(int(x) for x in re.findall(r"numOutputRows=(\d+)", _metrics(node)))
    assert joined < 100_000


def _metrics(plan) -> str:
    """numOutputRows of each join of an executed plan."""
    out = ""
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    if "QueryStage" in plan.nodeName():
        plan = plan.plan()
    if "Join" in plan.nodeName():
        out += f"numOutputRows={plan.metrics().apply('numOutputRows').value()} "
    kids = plan.children()
    return out + "".join(_metrics(kids.apply(i)) for i in range(kids.size()))


def test_searches_together_equal_searches_apart():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 300, 900), rng.integers(0, 300, 900)
    arcs = np.unique(np.stack([u, v], axis=1), axis=0)
    for w in (rng.integers(50, 150, len(arcs)).astype(float), rng.random(len(arcs)) + 0.01, rng.integers(0, 3, len(arcs)).astype(float)):
        s = paths.Streets(arcs[:, 0], arcs[:, 1], w)
        for back in (False, True):
            for cutoff in (np.inf, 200.0):
                got = s.spread(list(range(40)), back, cutoff)
                assert np.allclose(got, [s.distances([x], back, cutoff) for x in range(40)])
