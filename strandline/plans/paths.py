"""Distances, service scores, removals and betweenness on the lattice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import weighted
from strandline.operators import flow, paths, spatial, streets
from strandline.plans.kappa import graph, near, single
from strandline.registry import query
from strandline.session import stored
from strandline.sources import lattice

TAU = (300.0, 600.0)

#: Shortest costs to each goal (to) and from it (fro), and to the nearest (da) and from it.
_NET = f"{lattice.SQL}, net AS (SELECT u, v, min(w) AS w FROM arcs GROUP BY 1, 2), seats AS (SELECT node FROM goals WHERE node IN (SELECT u FROM net UNION SELECT v FROM net))"


def _relax(name: str, seed: str, here: str, there: str, key: str = "s", net: str = "net") -> str:
    """A CTE name(key, x, t) of least costs, by relaxing arcs until nothing falls."""
    return f"""{name}({key}, x, t) USING KEY ({key}, x) AS ({seed} UNION SELECT n.{key}, n.x, n.t FROM (SELECT r.{key}, e.{there} AS x, min(r.t + e.w) AS t FROM {name} r JOIN {net} e ON e.{here} = r.x GROUP BY 1, 2) n
 LEFT JOIN recurring.{name} c ON c.{key} = n.{key} AND c.x = n.x WHERE c.t IS NULL OR n.t < c.t)"""


_EACH = _relax("toward", "SELECT node, node, 0.0::DOUBLE FROM seats", "v", "u") + ", " + _relax("away", "SELECT node, node, 0.0::DOUBLE FROM seats", "u", "v")
_NEAREST = _relax("da", "SELECT 0, node, 0.0::DOUBLE FROM seats", "v", "u", "k")


def _bc(spark, sf_dir):
    return paths.broadcast_streets(graph(spark, sf_dir))


def _seats(spark, sf_dir):
    return lattice.access(spark, sf_dir).select(F.col("node").alias("s"))


def _weights(spark, sf_dir):
    """d, w: zone weights summed a node."""
    return lattice.demands(spark, sf_dir).groupBy("d").agg(F.sum("w").alias("w"))


@query(f"WITH RECURSIVE {_NET}, {_EACH} SELECT s, 'AD' AS orientation, count(*) AS nodes, sum(t) AS total, max(t) AS farthest FROM away GROUP BY s UNION ALL SELECT s, 'DA', count(*), sum(t), max(t) FROM toward GROUP BY s")
def p1_distances(spark, sf_dir):
    """Least costs from and to each access point over all nodes: how many, their sum and the greatest."""
    bc = _bc(spark, sf_dir)
    both = [paths.reach(bc, _seats(spark, sf_dir), b).withColumn("orientation", F.lit(o)) for o, b in (("AD", False), ("DA", True))]
    return both[0].unionByName(both[1]).select("s", "orientation", "nodes", "total", "farthest")


@query(f"WITH RECURSIVE {_NET}, {_NEAREST} SELECT d, min(t) AS t FROM zones JOIN da ON x = d WHERE t <= 400 GROUP BY d")
def p2_nearest_within(spark, sf_dir):
    """Cost to the nearest access point of each demand node, 400 s at most; the search ends there."""
    t = paths.to_nearest(_bc(spark, sf_dir), lattice.access(spark, sf_dir), cutoff=400.0)
    return single(spark, sf_dir).join(t.select(F.col("node").alias("d"), F.col("dist").alias("t")), "d")


@query(f"WITH RECURSIVE {_NET}, {_NEAREST} SELECT x AS node, t FROM da")
def p3_to_access(spark, sf_dir):
    """Cost to the nearest access point of every node, in one search."""
    return paths.to_nearest(_bc(spark, sf_dir), lattice.access(spark, sf_dir)).select("node", F.col("dist").alias("t"))


_ENTRY = f"ent AS (SELECT d, e FROM (SELECT q.node AS d, p.node AS e, row_number() OVER (PARTITION BY q.node ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.node) AS k FROM spots q, spots p WHERE q.node IN (SELECT d FROM zones)) n WHERE k <= 3 AND e IN (SELECT u FROM net UNION SELECT v FROM net))"


def _entries(spark, sf_dir):
    """d, entry of all demand nodes: the three nearest nodes."""
    return spatial.entry_sets(near(spark, sf_dir, 3), 3)


@query(f"WITH RECURSIVE {_NET}, {_ENTRY}, {_relax('ds', 'SELECT d, e, 0.0::DOUBLE FROM ent', 'u', 'v', 'd')} SELECT d, count(*) AS nodes, sum(t) AS total FROM ds GROUP BY d")
def p4_from_entry(spark, sf_dir):
    """Costs from entry sets to all nodes: how many and their sum."""
    return paths.potentials(_bc(spark, sf_dir), _entries(spark, sf_dir), lattice.access(spark, sf_dir), 800.0).select("d", "nodes", "total")


@query(f"""WITH RECURSIVE {_NET}, {_ENTRY}, {_NEAREST}, {_relax('ds', 'SELECT d, e, 0.0::DOUBLE FROM ent', 'u', 'v', 'd')}
SELECT s.d, count(*) AS arcs, min(s.t + n.w + a.t) AS least, sum(CASE WHEN s.t + n.w + a.t <= 800 THEN 1 ELSE 0 END)::BIGINT AS within FROM ds s JOIN net n ON n.u = s.x JOIN da a ON a.x = n.v GROUP BY s.d""")
def i11_potentials(spark, sf_dir):
    """Cost of the cheapest route from an entry set to access that uses an arc: arcs with one, the least, and those within 800."""
    return paths.corridors(graph(spark, sf_dir), _entries(spark, sf_dir), lattice.access(spark, sf_dir), 800.0)


GENERATORS = {"penalty4": 4.0, "penalty125": 1.25, "shortest": None}


def _route_rows(spark, sf_dir, k: int = 4):
    return paths.routes(_bc(spark, sf_dir), _entries(spark, sf_dir), lattice.access(spark, sf_dir), k, GENERATORS)


@query(f"""WITH RECURSIVE {_NET}, {_ENTRY}, {_NEAREST} SELECT d, g.generator, min(t) AS cost FROM ent JOIN da ON x = e, (SELECT unnest(['penalty4', 'penalty125', 'shortest']) AS generator) g GROUP BY 1, 2""")
def p5_first_routes(spark, sf_dir):
    """Cost of the first route of each generator, which is the cheapest of all."""
    return _route_rows(spark, sf_dir, 1).select("d", "generator", "cost")


@query()
def p6_penalised_routes(spark, sf_dir):
    """Four routes of each penalty; tests replay the search plainly."""
    return _route_rows(spark, sf_dir).where("generator <> 'shortest'")


@query()
def p8_shortest_routes(spark, sf_dir):
    """The four cheapest loopless routes from entry sets; tests list all routes of small graphs."""
    return _route_rows(spark, sf_dir).where("generator = 'shortest'")


@query(f"""WITH {lattice.SQL}, s AS (SELECT u, v, k AS key, w + (u * k * 7 + v * 3) % 11 AS w FROM arcs, (SELECT unnest([0, 1, 2]) AS k) x WHERE k <= (u + v) % 3)
SELECT u, v, min(w) AS w, arg_min(key, (w, key)) AS key FROM s GROUP BY 1, 2""")
def p16_collapse_with_key(spark, sf_dir):
    """The cheapest of parallel segments with its key, ties to the least key."""
    s = lattice.arcs(spark, sf_dir).withColumn("key", F.explode(F.sequence(F.lit(0), F.expr("cast((u + v) % 3 AS int)")))).withColumn("w", F.expr("w + (u * key * 7 + v * 3) % 11"))
    return flow.collapse(s, "key")


_PHI = "SELECT u, v, CASE WHEN (u + v) % 9 > 0 THEN (u * 13 + v * 5) % 50 / 100.0 END AS phi FROM net"


def _phi(spark, sf_dir):
    return graph(spark, sf_dir).withColumn("phi", F.expr("CASE WHEN (u + v) % 9 > 0 THEN (u * 13 + v * 5) % 50 / 100D END"))


@query(f"WITH {_NET}, p AS ({_PHI}) SELECT node, round(CAST(coalesce(avg(phi), 0) AS DOUBLE), 9) AS phi FROM seats LEFT JOIN (SELECT u AS node, phi FROM p UNION ALL SELECT v, phi FROM p) x USING (node) GROUP BY node")
def p18_proximity(spark, sf_dir):
    """Mean friction of the arcs at each access point, missing ones skipped, 0 without any."""
    return _proximity(spark, sf_dir, 0)


@query(f"""WITH {_NET}, p AS ({_PHI}), hop AS (SELECT node, node AS x FROM seats UNION SELECT node, u FROM seats JOIN net ON v = node UNION SELECT node, v FROM seats JOIN net ON u = node),
t AS (SELECT DISTINCT h.node, p.u, p.v, phi FROM hop h JOIN p ON p.u = h.x OR p.v = h.x) SELECT s.node, round(CAST(coalesce(avg(phi), 0) AS DOUBLE), 9) AS phi FROM seats s LEFT JOIN t USING (node) GROUP BY s.node""")
def p18_proximity_one_hop(spark, sf_dir):
    """The same over the arcs of an access point and its neighbours, each arc once."""
    return _proximity(spark, sf_dir, 1)


def _proximity(spark, sf_dir, hops: int):
    p = _phi(spark, sf_dir)
    ends = p.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(p.select(F.col("v").alias("x"), F.col("u").alias("y")))
    seats = lattice.access(spark, sf_dir).join(ends.select(F.col("x").alias("node")).distinct(), "node", "left_semi")
    ball = seats.select("node", F.col("node").alias("x"))
    for _ in range(hops):
        ball = ball.unionByName(ball.join(ends, "x").select("node", F.col("y").alias("x"))).distinct()
    if hops:
        at = p.select("u", "v", "phi", F.explode(F.array("u", "v")).alias("x"))
        t = ball.join(at, "x").select("node", "u", "v", "phi").distinct()
    else:
        t = seats.join(p.select(F.explode(F.array("u", "v")).alias("node"), "phi"), "node")
    out = t.groupBy("node").agg(F.avg("phi").alias("phi"))
    return seats.join(out, "node", "left").select("node", F.round(F.coalesce("phi", F.lit(0.0)), 9).alias("phi"))


_SERVICE = f"""p AS ({_PHI}), near AS (SELECT node, coalesce(avg(phi), 0) AS phi FROM seats LEFT JOIN (SELECT u AS node, phi FROM p UNION ALL SELECT v, phi FROM p) x USING (node) GROUP BY node),
z AS (SELECT d, sum(w) AS w FROM zones GROUP BY d),
svc AS (SELECT node, sum(CASE WHEN o = 'AD' THEN z.w / (t + 20 * phi + 1) END) AS ad, sum(CASE WHEN o = 'DA' THEN z.w / (t + 20 * phi + 1) END) AS da FROM near JOIN (SELECT s, x, t, 'AD' AS o FROM away UNION ALL SELECT s, x, t, 'DA' FROM toward) r ON r.s = node JOIN z ON z.d = r.x GROUP BY node)"""


def _extra(spark, sf_dir, strength: float = 20.0, least: float = 1.0):
    """s, extra: what friction at each access point adds to the costs."""
    return _proximity(spark, sf_dir, 0).select(F.col("node").alias("s"), F.expr(f"{strength} * phi + {least}").alias("extra"))


def _service(spark, sf_dir):
    """node, servc_AD, servc_DA: demand weight over cost, friction at the access point added."""
    bc, w = _bc(spark, sf_dir), _weights(spark, sf_dir).withColumnRenamed("d", "node")
    seats = _extra(spark, sf_dir)
    out = [paths.gravity(bc, seats, w, back).withColumnRenamed("score", f"servc_{name}") for name, back in (("AD", False), ("DA", True))]
    return out[0].join(out[1], "s").withColumnRenamed("s", "node")


@query(f"WITH RECURSIVE {_NET}, {_EACH}, {_SERVICE} SELECT node, round(ad, 6) AS \"servc_AD\", round(da, 6) AS \"servc_DA\" FROM svc")
def p17_service(spark, sf_dir):
    """Gravity score of each access point, both orientations."""
    return _service(spark, sf_dir).select("node", F.round("servc_AD", 6).alias("servc_AD"), F.round("servc_DA", 6).alias("servc_DA"))


_TOUCHED = "(SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM net)"


@query(f"""WITH RECURSIVE {_NET}, {_NEAREST}, top AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY (u * 7919 + v * 104729) % 9973 DESC, u, v) AS k, count(*) OVER () AS n FROM net) x WHERE k <= greatest(1, CAST(round(n * 0.02) AS BIGINT))),
net2 AS (SELECT u, v, w FROM net ANTI JOIN top USING (u, v)), {_relax("d2", "SELECT 0, node, 0.0::DOUBLE FROM seats", "v", "u", "k", "net2")},
h AS (SELECT d, row_number() OVER (ORDER BY (d * 31) % 101, d) * 1.0 / count(*) OVER () AS r FROM (SELECT DISTINCT d FROM zones) z),
t AS (SELECT CASE WHEN r <= 1 / 3.0 THEN 1 WHEN r <= 2 / 3.0 THEN 2 ELSE 3 END AS tertile, (d2.t - da.t) / da.t AS rel FROM h JOIN da ON da.x = d JOIN d2 ON d2.x = d WHERE da.t > 0)
SELECT tertile, count(*) AS n, round(quantile_cont(rel, 0.5) * 100, 9) AS median, round(max(rel) * 100, 6) AS worst FROM t GROUP BY tertile""")
def p20_targeted_removal(spark, sf_dir):
    """How much longer the way to access gets when the top 2 % of arcs by a score go: median and worst, a third of the demand nodes by another score."""
    a = stored(graph(spark, sf_dir).withColumn("score", F.expr("(u * 7919 + v * 104729) % 9973")))
    k = max(1, round(a.count() * 0.02))
    gone = a.orderBy(F.desc("score"), "u", "v").limit(k).select("u", "v")
    access = lattice.access(spark, sf_dir)
    t0 = paths.to_nearest(paths.broadcast_streets(a), access).select(F.col("node").alias("d"), F.col("dist").alias("t0"))
    t1 = paths.to_nearest(paths.broadcast_streets(a.join(gone, ["u", "v"], "left_anti")), access).select(F.col("node").alias("d"), F.col("dist").alias("t1"))
    d = single(spark, sf_dir).withColumn("s", F.expr("(d * 31) % 101")).withColumn("tertile", streets.tertile(["s", "d"], []))
    rel = d.join(t0, "d").join(t1, "d").where("t0 > 0").withColumn("rel", F.expr("(t1 - t0) / t0"))
    return rel.groupBy("tertile").agg(F.count("*").alias("n"), F.round(F.percentile("rel", F.lit(0.5)) * 100, 9).alias("median"), F.round(F.max("rel") * 100, 6).alias("worst"))


@query(f"""WITH RECURSIVE {_NET}, {_EACH}, {_SERVICE}, o AS (SELECT node, row_number() OVER (ORDER BY round(da, 6) DESC, node) AS k, count(*) OVER () AS n FROM svc),
q AS (SELECT unnest(range(1, 21)) AS i), sets AS (SELECT i, 'top' AS what, node FROM q, o WHERE k <= greatest(1, ceil(i * 0.05 * n)) UNION ALL SELECT i, 'middle', node FROM q, o WHERE k > greatest(0, n // 2 - CAST(greatest(1, ceil(i * 0.05 * n)) AS BIGINT) // 2) AND k <= greatest(0, n // 2 - CAST(greatest(1, ceil(i * 0.05 * n)) AS BIGINT) // 2) + greatest(1, ceil(i * 0.05 * n))),
best AS (SELECT i, what, x, min(t) AS t FROM sets JOIN toward ON s = node GROUP BY 1, 2, 3), cov AS (SELECT i, what, sum(CASE WHEN t <= 300 THEN w ELSE 0 END) / (SELECT sum(w) FROM z) AS y FROM best JOIN z ON d = x GROUP BY 1, 2),
tr AS (SELECT what, (y + lag(y) OVER (PARTITION BY what ORDER BY i)) / 2 * 0.05 AS a FROM cov) SELECT round(sum(CASE WHEN what = 'top' THEN a ELSE -a END), 9) AS gain FROM tr""")
def p21_coverage_gain(spark, sf_dir):
    """Area between the coverage curves of the access points with the best service and of those in the middle, by the trapezoid rule (300 s, DA)."""
    bc, w = _bc(spark, sf_dir), stored(_weights(spark, sf_dir))
    seats = stored(_extra(spark, sf_dir))
    nodes = w.withColumnRenamed("d", "node")
    da = paths.gravity(bc, seats, nodes, True).select(F.col("s").alias("node"), F.round("score", 6).alias("r"))
    # a seat that no demand reaches, but that reaches one, has a service in the other direction only and comes last
    out = paths.to_nearest(bc, nodes).select("node").join(seats.select(F.col("s").alias("node")), "node", "left_semi")
    svc = stored(da.join(out, "node", "full").select("node", "r"))
    w1 = Window.orderBy(F.desc_nulls_last("r"), "node")  # a row an access point
    o = svc.select("node", F.row_number().over(w1).alias("k"))
    n = svc.count()
    o = o.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("size", F.greatest(F.lit(1), F.ceil(F.round(F.col("i") * 0.05 * n, 9))))
    first = F.greatest(F.lit(0), F.lit(n // 2) - F.expr("size div 2"))
    sets = o.withColumn("what", F.explode(F.array(F.lit("top"), F.lit("middle")))).where(F.when(F.col("what") == "top", F.col("k") <= F.col("size")).otherwise((F.col("k") > first) & (F.col("k") <= first + F.col("size"))))
    since = stored(sets.groupBy("what", "node").agg(F.min("i").alias("i")))  # each set holds those before it
    t = paths.distances(bc, seats.select("s"), True, 300.0).select(F.col("s").alias("node"), F.col("node").alias("d")).join(nodes.select(F.col("node").alias("d")), "d", "left_semi")
    best = t.join(since, "node").groupBy("what", "d").agg(F.min("i").alias("i")).join(w, "d").groupBy("what", "i").agg(F.sum("w").alias("w"))
    total = w.agg(F.sum("w")).first()[0]
    steps = since.select("what").distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20))))
    upto = steps.join(F.broadcast(best.select("what", F.col("i").alias("j"), "w")), "what", "left").groupBy("what", "i")
    cov = upto.agg((F.coalesce(F.sum(F.when(F.col("j") <= F.col("i"), F.col("w"))), F.lit(0.0)) / total).alias("y"))
    tr = cov.withColumn("a", (F.col("y") + F.lag("y").over(Window.partitionBy("what").orderBy("i"))) / 2 * 0.05)
    return tr.agg(F.round(F.sum(F.when(F.col("what") == "top", F.col("a")).otherwise(-F.col("a"))), 9).alias("gain"))


@query(f"WITH {_NET}, p AS ({_PHI}) SELECT u, v, round(CAST(w * (1 + 0.7 * coalesce(phi, 0)) AS DOUBLE), 6) AS w FROM p JOIN net USING (u, v)")
def p22_override(spark, sf_dir):
    """Arc costs under another friction strength."""
    return _phi(spark, sf_dir).select("u", "v", F.round(streets.overridden(F.col("w"), F.col("phi"), 0.7), 6).alias("w"))


@query("SELECT unnest([0.0, 0.5, 2.0])::DOUBLE AS strength, 0::BIGINT AS differ")
def p23_invariance(spark, sf_dir):
    """Route counts don't depend on the friction strength: how many differ from those without friction."""
    plain = graph(spark, sf_dir).select("u", "v", F.lit(-1.0).alias("city"))
    strengths = [0.0, 0.5, 2.0]
    cities = [flow.collapse(_phi(spark, sf_dir).select("u", "v", streets.overridden(F.col("w"), F.col("phi"), x).alias("w"))).select("u", "v", F.lit(x).alias("city")) for x in strengths]
    access = lattice.access(spark, sf_dir).withColumn("city", F.explode(F.array(*[F.lit(x) for x in (-1.0, *strengths)])))
    # a graph a task, each with counts of its own
    k = stored(flow.two_counts(reduce(DataFrame.unionByName, [plain, *cities]), single(spark, sf_dir), access).select("city", "d", "kappa"))
    base = k.where("city = -1").select("d", F.col("kappa").alias("k0"))

    def one(strength):
        t = k.where(F.col("city") == strength).join(base, "d", "full")
        return t.agg(F.coalesce(F.sum((~F.col("kappa").eqNullSafe(F.col("k0"))).cast("long")), F.lit(0).cast("long")).alias("differ")).select(F.lit(strength).alias("strength"), "differ")

    return reduce(DataFrame.unionByName, [one(x) for x in strengths])


@query(f"""WITH {_NET}, p AS ({_PHI}), g AS (SELECT unnest([0.0, 0.5, 1.0, 2.0]) AS strength), t AS (SELECT strength, round(CAST(sum(w * (1 + strength * coalesce(phi, 0))) AS DOUBLE), 6) AS total FROM p JOIN net USING (u, v), g GROUP BY 1)
SELECT CAST(strength AS DOUBLE) AS strength, total, round((total - (SELECT total FROM t WHERE strength = 1)) / (SELECT total FROM t WHERE strength = 1), 9) AS change FROM t""")
def p24_sweep(spark, sf_dir):
    """A sweep of the friction strength: total cost and its change against the reference setting."""
    g = _phi(spark, sf_dir).withColumn("strength", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 2.0)])))
    t = g.groupBy("strength").agg(F.round(F.sum(F.expr("w * (1 + strength * coalesce(phi, 0))")), 6).alias("total"))
    ref = t.where("strength = 1").select(F.col("total").alias("ref"))
    return t.join(F.broadcast(ref)).select("strength", "total", F.round(F.expr("(total - ref) / ref"), 9).alias("change"))


@query(f"""WITH RECURSIVE {_NET}, {_NEAREST}, z AS (SELECT d, sum(w) AS w FROM zones GROUP BY d), lim AS (SELECT unnest([100.0, 300.0]) AS tau)
SELECT CAST(tau AS DOUBLE) AS tau, round(sum(CASE WHEN t <= tau THEN w ELSE 0 END) / sum(w), 9) AS covered FROM z LEFT JOIN da ON x = d, lim GROUP BY tau""")
def r43_coverage(spark, sf_dir):
    """Share of demand weight within 100 and 300 s of access."""
    t = paths.to_nearest(_bc(spark, sf_dir), lattice.access(spark, sf_dir)).select(F.col("node").alias("d"), F.col("dist").alias("t"))
    z = _weights(spark, sf_dir).join(t, "d", "left").withColumn("tau", F.explode(F.array(F.lit(100.0), F.lit(300.0))))
    return z.groupBy("tau").agg(F.round(weighted.share(F.coalesce(F.col("t") <= F.col("tau"), F.lit(False)), F.col("w")), 9).alias("covered"))


def _normalised(b):
    top = b.agg(F.max("b").alias("top"))
    return b.join(F.broadcast(top)).select("u", "v", (F.col("b") / F.col("top")).alias("b"))


@query()
def p11_betweenness(spark, sf_dir):
    """Pair-weighted betweenness of arcs, access to demand, damped by cost and over its greatest; tests check it by listing routes."""
    src = lattice.access(spark, sf_dir).withColumn("w", F.lit(1.0))
    return _normalised(paths.betweenness(_bc(spark, sf_dir), src, _weights(spark, sf_dir).withColumnRenamed("d", "node"), 0.001))


@query()
def p12_dual_betweenness(spark, sf_dir):
    """Weighted and unweighted betweenness of arcs next to the key of the cheapest parallel segment."""
    a = p16_collapse_with_key(spark, sf_dir)
    bc = paths.broadcast_streets(a)
    src = lattice.access(spark, sf_dir).withColumn("w", F.lit(1.0))
    d = _weights(spark, sf_dir).withColumnRenamed("d", "node")
    both = paths.betweenness(bc, src, d, plain=True).withColumnRenamed("b", "b_weighted")
    return a.select("u", "v", "key").join(both, ["u", "v"], "left").fillna(0.0)


@query()
def p13_source_weighted(spark, sf_dir):
    """Betweenness of routes from demand to access, demand weighing its sources (matching orientation)."""
    src = lattice.access(spark, sf_dir).withColumn("w", F.lit(1.0))
    return paths.betweenness(_bc(spark, sf_dir), src, _weights(spark, sf_dir).withColumnRenamed("d", "node"), backwards=True)


@query()
def p15_sampled_sources(spark, sf_dir):
    """Betweenness from 80 sources, the least by an integer hash (the sample is the operator)."""
    src = lattice.places(spark, sf_dir).select("node").orderBy(F.expr("node * 48271 % 2147483647"), "node").limit(80).withColumn("w", F.lit(1.0))
    return paths.betweenness(_bc(spark, sf_dir), src, src)


@query()
def r57_prefix_sensitivity(spark, sf_dir):
    """AUC of route diversity for two and more disjoint routes by the number of routes, prefixes of one ensemble."""
    from strandline.operators import ensembles

    sets = near(spark, sf_dir, 1).select(F.col("q").alias("d"), F.array("q").alias("entry"))
    r = stored(ensembles.with_arcs(paths.routes(_bc(spark, sf_dir), sets, lattice.access(spark, sf_dir), 8, {"penalty4": 4.0})))
    k = flow.route_counts(graph(spark, sf_dir), sets, lattice.access(spark, sf_dir), cap=2).where("NOT colocated").select("d", (F.col("kappa") >= 2).cast("int").alias("y"))
    one = lambda n: weighted.auc(ensembles.indices(r.where(F.col("route") < n)).join(k, "d"), "li", "y", []).select(F.lit(n).alias("k"), "auc")
    return reduce(DataFrame.unionByName, [one(n) for n in (2, 4, 8)])


