"""Route counts and cuts on the lattice: entry sets, orientations, masks, access variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import weighted
from strandline.operators import flow, reach, spatial
from strandline.registry import query
from strandline.session import stored, table
from strandline.sources import lattice

#: Nearest nodes of an entry set, steps of the anchoring sweep, and its radius in metres.
KNN, SWEEP, RADIUS = 3, 5, 250.0
CELL = 150.0

_NEAR = """near AS (SELECT q, node, k FROM (SELECT q.node AS q, p.node, row_number() OVER (PARTITION BY q.node ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.node) AS k FROM spots q, spots p) n WHERE k <= 5)"""
_SINGLE = "entries AS (SELECT DISTINCT d, d AS e FROM zones)"
_MULTI = f"{_NEAR}, entries AS (SELECT DISTINCT d, d AS e FROM zones UNION SELECT d, node FROM zones JOIN near ON q = d WHERE k <= {KNN})"


def _kappa_sql(entries: str = _SINGLE, backwards: bool = True, goals: str = "", arcs: str = "", graph: str = lattice.SQL) -> str:
    """CTEs up to kappa (d, k2, colocated): min(kappa, 2) by removing every arc in turn.

    goals and arcs replace the CTEs of those names; backwards: routes from entries to goals.
    """
    step = "SELECT r.ru, r.rv, e.u FROM reach r JOIN net e ON e.v = r.x AND NOT (e.u = r.ru AND e.v = r.rv)" if backwards else "SELECT r.ru, r.rv, e.v FROM reach r JOIN net e ON e.u = r.x AND NOT (e.u = r.ru AND e.v = r.rv)"
    return f"""WITH RECURSIVE {graph}, {entries}, ends AS ({goals or "SELECT node FROM goals"}), net AS ({arcs or "SELECT DISTINCT u, v FROM arcs"}),
reach(ru, rv, x) AS (SELECT a.u, a.v, g.node FROM net a, ends g UNION {step}),
there AS (SELECT u AS x FROM net UNION SELECT v FROM net),
asked AS (SELECT d, e FROM entries WHERE e IN (SELECT x FROM there)),
hits AS (SELECT d, count(DISTINCT ru * 10000000 + rv) AS n FROM asked JOIN reach ON x = e GROUP BY d),
kappa AS (SELECT d, CASE WHEN bool_or(e IN (SELECT node FROM ends WHERE node IN (SELECT x FROM there))) THEN NULL ELSE CASE WHEN coalesce(any_value(n), 0) = 0 THEN 0 WHEN any_value(n) < (SELECT count(*) FROM net) THEN 1 ELSE 2 END END AS k2 FROM asked LEFT JOIN hits USING (d) GROUP BY d)
"""


def graph(spark, sf_dir):
    """Collapsed arcs of the lattice."""
    return flow.collapse(lattice.arcs(spark, sf_dir))


def single(spark, sf_dir):
    return lattice.demands(spark, sf_dir).select("d").distinct()


def near(spark, sf_dir, k: int = SWEEP):
    """q, node, d2, k of the k nodes nearest each demand node."""
    places = lattice.places(spark, sf_dir)
    q = places.join(single(spark, sf_dir).withColumnRenamed("d", "node"), "node", "left_semi").withColumnRenamed("node", "q")
    return spatial.nearest(q, places, k, CELL)


def multi(spark, sf_dir):
    """d, entry: demand nodes with their KNN nearest nodes."""
    return spatial.entry_sets(near(spark, sf_dir, KNN), KNN)


def _k2(df):
    return df.select("d", F.when(F.col("kappa").isNotNull(), F.least("kappa", F.lit(2))).cast("int").alias("k2"))


def _summary(z):
    k, w = F.col("kappa"), F.col("w")
    return z.agg(F.count("*").alias("n"), weighted.share(k == 0, w).alias("w0"), weighted.share(k == 1, w).alias("w1"), weighted.share(k >= 2, w).alias("w2"))


@query(_kappa_sql() + """SELECT stratum, count(*) AS n, sum(CASE WHEN k2 = 0 THEN w ELSE 0 END) / sum(w) AS w0, sum(CASE WHEN k2 = 1 THEN w ELSE 0 END) / sum(w) AS w1,
 sum(CASE WHEN k2 = 2 THEN w ELSE 0 END) / sum(w) AS w2 FROM zones JOIN kappa USING (d) WHERE k2 IS NOT NULL GROUP BY GROUPING SETS ((stratum), ())""")
def g3_kappa_summary(spark, sf_dir):
    """Shares of demand weight with 0, 1 and 2 or more edge-disjoint routes, a stratum and pooled (null)."""
    k = flow.route_counts(graph(spark, sf_dir), single(spark, sf_dir), lattice.access(spark, sf_dir), cap=2)
    z = lattice.demands(spark, sf_dir).join(k.where("NOT colocated").select("d", "kappa"), "d")
    return _summary(z.groupingSets([[F.col("stratum")], []], "stratum"))


@query(_kappa_sql(_MULTI) + """SELECT stratum, count(*) AS n, sum(CASE WHEN k2 = 0 THEN w ELSE 0 END) / sum(w) AS w0, sum(CASE WHEN k2 = 1 THEN w ELSE 0 END) / sum(w) AS w1,
 sum(CASE WHEN k2 = 2 THEN w ELSE 0 END) / sum(w) AS w2 FROM zones JOIN kappa USING (d) WHERE k2 IS NOT NULL GROUP BY GROUPING SETS ((stratum), ())""")
def g3_multi_entry_summary(spark, sf_dir):
    """The same from entry sets of a node and its three nearest."""
    k = flow.route_counts(graph(spark, sf_dir), multi(spark, sf_dir), lattice.access(spark, sf_dir), cap=2)
    z = lattice.demands(spark, sf_dir).join(k.where("NOT colocated").select("d", "kappa"), "d")
    return _summary(z.groupingSets([[F.col("stratum")], []], "stratum"))


@query(_kappa_sql(_MULTI, backwards=False) + "SELECT d, CAST(k2 AS INTEGER) AS k2 FROM kappa")
def g3_multi_entry_access_to_demand(spark, sf_dir):
    """min(kappa, 2) of routes from access points to entry sets."""
    return _k2(flow.route_counts(graph(spark, sf_dir), multi(spark, sf_dir), lattice.access(spark, sf_dir), "AD", cap=2))


@query(_kappa_sql(backwards=False) + "SELECT d, CAST(k2 AS INTEGER) AS k2, k2 IS NULL AS colocated FROM kappa")
def g2_kappa_access_to_demand(spark, sf_dir):
    """min(kappa, 2) of routes from access points to each demand node."""
    k = flow.route_counts(graph(spark, sf_dir), single(spark, sf_dir), lattice.access(spark, sf_dir), "AD", cap=2)
    return _k2(k).withColumn("colocated", F.col("k2").isNull())


@query()
def g2_kappa(spark, sf_dir):
    """Edge-disjoint routes of each demand node, uncapped; the SQL twins check it at 2 and tests by enumeration."""
    return flow.route_counts(graph(spark, sf_dir), single(spark, sf_dir), lattice.access(spark, sf_dir)).select("d", "kappa", "colocated", F.size("cut").alias("n_cut"))


_MASK = "SELECT DISTINCT u, v FROM arcs WHERE w <= 130"


@query(_kappa_sql(arcs=_MASK) + "SELECT d, CAST(k2 AS INTEGER) AS k2, k2 IS NULL AS colocated FROM kappa")
def g6_kappa_capped(spark, sf_dir):
    """min(kappa, 2) of each demand node on the arcs that cost 130 at most; the search stops at 2."""
    masked = graph(spark, sf_dir).where("w <= 130")
    return _k2(flow.route_counts(masked, single(spark, sf_dir), lattice.access(spark, sf_dir), cap=2)).withColumn("colocated", F.col("k2").isNull())


@query(_kappa_sql(f"""{_NEAR}, ball AS (SELECT q.node AS q, p.node FROM spots q, spots p WHERE (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= {RADIUS * RADIUS}),
entries AS (SELECT DISTINCT d * 10 + s.k AS d, n.node AS e FROM zones, (SELECT unnest([1, 2, 3, 4, 5]) AS k) s, near n WHERE n.q = zones.d AND n.k <= s.k
 UNION SELECT d * 10 + s.k, d FROM zones, (SELECT unnest([1, 2, 3, 4, 5]) AS k) s UNION SELECT d * 10 + 9, node FROM zones JOIN ball ON q = d)""")
       + "SELECT d // 10 AS d, CAST(d % 10 AS INTEGER) AS step, CAST(k2 AS INTEGER) AS k2 FROM kappa")
def g4_anchoring_sweep(spark, sf_dir):
    """min(kappa, 2) of nested entry sets: the 1..5 nearest nodes, and (step 9) all within 250 m."""
    places, nodes = lattice.places(spark, sf_dir), single(spark, sf_dir)
    n = stored(near(spark, sf_dir))
    steps = [spatial.entry_sets(n, k).select((F.col("d") * 10 + k).alias("d"), "entry") for k in range(1, SWEEP + 1)]
    q = places.join(nodes.withColumnRenamed("d", "node"), "node", "left_semi").withColumnRenamed("node", "q")
    ball = spatial.radius_join(q, places, RADIUS).groupBy((F.col("q") * 10 + 9).alias("d")).agg(F.array_sort(F.collect_list("node")).alias("entry"))
    for s in steps:
        ball = ball.unionByName(s)
    k = _k2(flow.route_counts(graph(spark, sf_dir), ball, lattice.access(spark, sf_dir), cap=2))
    return k.select(F.expr("d div 10").alias("d"), F.expr("cast(d % 10 AS int)").alias("step"), "k2")


@query()
def g5_node_disjoint(spark, sf_dir):
    """Routes that share no node but their ends; tests check it by enumeration on small graphs."""
    split = flow.split_nodes(graph(spark, sf_dir))
    asked = single(spark, sf_dir).select("d", F.array(F.col("d") * 2 + 1).alias("entry"))
    goals = lattice.access(spark, sf_dir)
    k = flow.route_counts(split, asked, goals.select((F.col("node") * 2).alias("node"))).select("d", "kappa")
    return k.join(goals.withColumnRenamed("node", "d"), "d", "left_anti")


@query(_kappa_sql("""entries AS (SELECT DISTINCT d, d AS e FROM zones UNION SELECT d, v FROM zones JOIN arcs ON u = d UNION SELECT d, u FROM zones JOIN arcs ON v = d)""") + "SELECT d, CAST(k2 AS INTEGER) AS k2 FROM kappa")
def g7_neighbour_entry(spark, sf_dir):
    """min(kappa, 2) from a node and all its predecessors and successors."""
    a = graph(spark, sf_dir)
    ends = a.select(F.col("u").alias("d"), F.col("v").alias("e")).unionByName(a.select(F.col("v").alias("d"), F.col("u").alias("e")))
    sets = single(spark, sf_dir).join(ends, "d", "left").groupBy("d").agg(F.concat(F.array("d"), F.collect_set("e")).alias("entry"))
    return _k2(flow.route_counts(a, sets, lattice.access(spark, sf_dir), cap=2))


_FRACTIONS = (25, 50, 75)


@query(" UNION ALL ".join(f"""SELECT * FROM ({_kappa_sql(goals=f"SELECT node FROM goals WHERE (node * 7919 + 13) % 100 < {f}")}
SELECT {f} AS percent, sum(CASE WHEN k2 = 1 THEN w ELSE 0 END) / sum(w) AS w1, sum(CASE WHEN k2 = 2 THEN w ELSE 0 END) / sum(w) AS w2 FROM zones JOIN kappa USING (d) WHERE k2 IS NOT NULL) q{f}""" for f in _FRACTIONS))
def g8_subsampled_access(spark, sf_dir):
    """Shares of demand weight with one and more routes when only some percent of the access points stay (the sampling is the operator)."""
    a, d, z, out = graph(spark, sf_dir), single(spark, sf_dir), lattice.demands(spark, sf_dir), None
    bc = flow.broadcast_graph(a, lattice.access(spark, sf_dir))  # one graph for all samples
    for f in _FRACTIONS:
        some = lattice.access(spark, sf_dir).where(F.expr(f"(node * 7919 + 13) % 100 < {f}"))
        k = flow.route_counts(a, d, some, cap=2, bc=bc).where("NOT colocated").select("d", "kappa")
        one = z.join(k, "d").agg(weighted.share(F.col("kappa") == 1, F.col("w")).alias("w1"), weighted.share(F.col("kappa") >= 2, F.col("w")).alias("w2")).select(F.lit(f).alias("percent"), "w1", "w2")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH before AS ({_kappa_sql()} SELECT d, k2 FROM kappa), after AS ({_kappa_sql(goals="SELECT node FROM goals UNION SELECT node FROM spots WHERE (node * 104729 + 7) % 100 < 10")} SELECT d, k2 FROM kappa)
SELECT count(*) AS ones, sum(CASE WHEN a.k2 = 2 OR a.k2 IS NULL THEN 1 ELSE 0 END)::BIGINT AS flips FROM before b JOIN after a USING (d) WHERE b.k2 = 1""")
def g9_densification(spark, sf_dir):
    """How many demand nodes with one route gain another when every tenth node (by hash) becomes an access point too; only those are solved again."""
    a, goals = graph(spark, sf_dir), lattice.access(spark, sf_dir)
    ones = stored(flow.route_counts(a, single(spark, sf_dir), goals, cap=2).where("kappa = 1").select("d"))
    more = goals.unionByName(lattice.places(spark, sf_dir).where("(node * 104729 + 7) % 100 < 10").select("node"))
    k = flow.route_counts(a, ones, more, cap=2)
    return k.agg(F.count("*").alias("ones"), F.sum(F.expr("CASE WHEN colocated OR kappa >= 2 THEN 1 ELSE 0 END")).alias("flips"))


_CARE = "SELECT DISTINCT (n_nationkey * 53 + 5) % (SELECT count(*) FROM customer) AS node FROM nation"


@query(_kappa_sql(_MULTI, goals=_CARE) + """SELECT stratum, sum(CASE WHEN k2 = 1 THEN w ELSE 0 END) / sum(w) AS w1, sum(CASE WHEN k2 = 0 THEN w ELSE 0 END) / sum(w) AS w0
 FROM (SELECT o_orderstatus AS stratum, o_custkey AS d, CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY 1, 2) z JOIN kappa USING (d) WHERE k2 IS NOT NULL GROUP BY stratum""")
def g10_other_access(spark, sf_dir):
    """Route shares with another set of access points (a nation each) and other weights (by order status)."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    care = table(spark, sf_dir, "nation").join(F.broadcast(n)).select(F.expr("(n_nationkey * 53 + 5) % n").cast("long").alias("node")).distinct()
    one = lambda df: df.withColumn("city", F.lit(0))
    k = flow.two_counts(one(graph(spark, sf_dir)), multi(spark, sf_dir), one(care)).where("NOT colocated").select("d", "kappa")
    z = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("stratum"), F.col("o_custkey").alias("d")).agg(F.count("*").cast("double").alias("w"))
    return z.join(k, "d").groupBy("stratum").agg(weighted.share(F.col("kappa") == 1, F.col("w")).alias("w1"), weighted.share(F.col("kappa") == 0, F.col("w")).alias("w0"))


_CUTS = """, ones AS (SELECT d FROM kappa WHERE k2 = 1), cutting AS (SELECT o.d, n.u, n.v FROM ones o, net n EXCEPT SELECT a.d, r.ru, r.rv FROM asked a JOIN reach r ON r.x = a.e JOIN ones USING (d)),
hop(d, x, h) AS (SELECT o.d, a.e, 0 FROM ones o JOIN asked a USING (d) UNION SELECT p.d, n.v, p.h + 1 FROM hop p JOIN net n ON n.u = p.x WHERE p.h < 120),
hops AS (SELECT d, x, min(h) AS h FROM hop GROUP BY d, x),
named AS (SELECT c.d, arg_min(c.u, h) AS cut_u, arg_min(c.v, h) AS cut_v FROM cutting c JOIN hops p ON p.d = c.d AND p.x = c.u GROUP BY c.d)
"""
# the hop search names each (d, x) once
_CUTS = _CUTS.replace("hop(d, x, h) AS (", "hop(d, x, h) USING KEY (d, x) AS (").replace(
    "SELECT p.d, n.v, p.h + 1 FROM hop p JOIN net n ON n.u = p.x WHERE p.h < 120",
    "SELECT p.d, n.v, min(p.h) + 1 FROM hop p JOIN net n ON n.u = p.x WHERE NOT EXISTS (SELECT 1 FROM recurring.hop c WHERE c.d = p.d AND c.x = n.v) GROUP BY p.d, n.v")


def _named(spark, sf_dir, sets=None):
    k = flow.route_counts(graph(spark, sf_dir), sets if sets is not None else single(spark, sf_dir), lattice.access(spark, sf_dir), cap=2)
    return k.where("kappa = 1").select("d", F.col("cut")[0]["u"].alias("cut_u"), F.col("cut")[0]["v"].alias("cut_v"), "cut_first", "cut_hops")


@query(_kappa_sql() + _CUTS + "SELECT d, cut_u, cut_v, cut_u = d AS cut_first FROM named")
def g11_named_cut(spark, sf_dir):
    """The one arc, nearest the demand, that all routes of a demand node need."""
    return _named(spark, sf_dir).select("d", "cut_u", "cut_v", "cut_first")


@query(_kappa_sql(_MULTI) + _CUTS + """, wide AS (SELECT a.d, max((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS m FROM entries a JOIN entries b USING (d) JOIN spots p ON p.node = a.e JOIN spots q ON q.node = b.e GROUP BY a.d)
SELECT d, cut_u, cut_v, EXISTS (SELECT 1 FROM entries e WHERE e.d = named.d AND e.e = cut_u) AS cut_first, round(sqrt(m), 6) AS diameter FROM named JOIN wide USING (d)""")
def g12_cut_characters(spark, sf_dir):
    """Named cuts of entry sets: whether they leave an entry node, and how wide the entry set is."""
    sets = stored(multi(spark, sf_dir))
    wide = spatial.diameter(sets, lattice.places(spark, sf_dir))
    return _named(spark, sf_dir, sets).join(wide, "d").select("d", "cut_u", "cut_v", "cut_first", F.round("diameter", 6).alias("diameter"))


_SEGMENTS = "SELECT u, v, key FROM arcs, (SELECT unnest([0, 1, 2]) AS key) k WHERE key <= (u + v) % 3"


@query(_kappa_sql() + _CUTS + f""", crit AS (SELECT cut_u AS u, cut_v AS v, sum(w) AS cutcrit FROM named JOIN zones USING (d) GROUP BY 1, 2)
SELECT u, v, key, coalesce(cutcrit, 0) AS cutcrit FROM ({_SEGMENTS}) s LEFT JOIN crit USING (u, v)""")
def g13_cut_criticality(spark, sf_dir):
    """Demand weight that each segment (u, v, key) cuts off as the single minimum cut; parallel segments inherit their arc's."""
    w = lattice.demands(spark, sf_dir).groupBy("d").agg(F.sum("w").alias("w"))
    cuts = _named(spark, sf_dir).join(w, "d").groupBy(F.col("cut_u").alias("u"), F.col("cut_v").alias("v")).agg(F.sum("w").alias("cutcrit"))
    segments = lattice.arcs(spark, sf_dir).select("u", "v", F.explode(F.sequence(F.lit(0), F.expr("cast((u + v) % 3 AS int)"))).alias("key"))
    return segments.join(cuts, ["u", "v"], "left").select("u", "v", "key", F.coalesce("cutcrit", F.lit(0.0)).alias("cutcrit"))


@query(f"""WITH RECURSIVE {lattice.SQL}, net AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM arcs), ways2 AS (SELECT a AS u, b AS v FROM net UNION SELECT b, a FROM net),
walk(a, b, x) AS (SELECT a, b, a FROM net UNION SELECT w.a, w.b, e.v FROM walk w JOIN ways2 e ON e.u = w.x AND NOT (e.u = w.a AND e.v = w.b) AND NOT (e.u = w.b AND e.v = w.a))
SELECT a, b FROM net EXCEPT SELECT a, b FROM walk WHERE x = b""")
def g18_bridges(spark, sf_dir):
    """Streets whose closure splits the undirected graph."""
    return reach.bridges(graph(spark, sf_dir).withColumn("city", F.lit("one"))).select("a", "b")


@query(f"""WITH RECURSIVE {lattice.SQL}, net AS (SELECT DISTINCT u, v FROM arcs), walk(s, x) AS (SELECT u, v FROM net UNION SELECT s, v FROM walk JOIN net ON u = x),
n AS (SELECT u AS node FROM net UNION SELECT v FROM net), m AS (SELECT node, least(node, coalesce(min(w.x), node)) AS component FROM n LEFT JOIN (SELECT a.s, a.x FROM walk a JOIN walk b ON a.s = b.x AND a.x = b.s) w ON w.s = node GROUP BY node),
big AS (SELECT component FROM m GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT node, component, component = (SELECT component FROM big) AS in_largest FROM m""")
def g19_strong_components(spark, sf_dir):
    """The strongly connected component of each node, and whether it is the largest."""
    return reach.strong_components(graph(spark, sf_dir).withColumn("city", F.lit("one"))).select("node", "component", "in_largest")
