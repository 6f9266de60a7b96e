"""Indices of route ensembles against route counts.

The ensembles of these queries are orders: each line item is a route, its price the cost, and
four small numbers of it the arcs, so SQL can say the same. Route searches are in paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars, stats, weighted
from strandline.operators import ensembles, flow, paths
from strandline.plans.kappa import graph
from strandline.plans.paths import GENERATORS, _bc, _entries
from strandline.plans.statistics import _auc_sql
from strandline.registry import query
from strandline.session import stored, table
from strandline.sources import lattice

COLOCATED, ETA = 50, ensembles.ETA

_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_R = f"""r AS (SELECT l_orderkey AS d, CAST(row_number() OVER (PARTITION BY l_orderkey {_ORDER}) - 1 AS INTEGER) AS route, floor(l_extendedprice) / 1000 AS cost,
 list_distinct([l_partkey % 5, 10 + l_suppkey % 4, 20 + CAST(l_quantity AS BIGINT) % 3, 30 + l_linenumber % 4]) AS arcs FROM lineitem)"""
_K = "k AS (SELECT o_orderkey AS d, o_orderpriority AS config, CASE WHEN o_orderkey % 11 = 0 THEN 50 ELSE o_custkey % 4 END AS kappa, o_totalprice AS w FROM orders)"


def _routes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    arcs = F.expr("array_distinct(array(l_partkey % 5, 10 + l_suppkey % 4, 20 + cast(l_quantity AS bigint) % 3, 30 + cast(l_linenumber AS bigint) % 4))")
    return line.select(F.col("l_orderkey").alias("d"), n.alias("route"), (F.floor("l_extendedprice").cast("double") / 1000).alias("cost"), arcs.alias("arcs"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"), F.col("o_orderpriority").alias("config"), F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 50 ELSE cast(o_custkey % 4 AS int) END").alias("kappa"), F.col("o_totalprice").alias("w"))


_P = f"""g AS (SELECT *, exp(-{ETA} * (cost - min(cost) OVER (PARTITION BY d))) AS g FROM r), p AS (SELECT *, g / sum(g) OVER (PARTITION BY d) AS p FROM g),
h AS (SELECT d, count(*) AS n, -sum(p * ln(greatest(least(p, 1), 1e-12))) AS h, sum(p * p) AS own FROM p GROUP BY d),
j AS (SELECT a.d, 2 * a.p * b.p AS pp, len(list_intersect(a.arcs, b.arcs)) * 1.0 / len(list_distinct(list_concat(a.arcs, b.arcs))) AS jac FROM p a JOIN p b ON a.d = b.d AND a.route < b.route),
x AS (SELECT d, sum(pp * jac) AS c, avg(jac) AS m FROM j GROUP BY d), ind AS (SELECT d, n, h, exp(h) AS exp_h, 1 / (own + coalesce(c, 0)) AS rpe, 1 - coalesce(m, 1) AS li FROM h LEFT JOIN x USING (d))"""


@query(f"WITH {_R}, {_P} SELECT d, round(exp_h, 8) AS exp_h FROM ind")
def i1_entropy(spark, sf_dir):
    """Exponential of the entropy of each ensemble's Gibbs shares."""
    return ensembles.indices(_routes(spark, sf_dir)).select("d", F.round("exp_h", 8).alias("exp_h"))


@query(f"WITH {_R}, {_P} SELECT d, round(CAST(rpe AS DOUBLE), 8) AS rpe FROM ind")
def i2_overlap_entropy(spark, sf_dir):
    """Effective number of routes when shared arcs count as one."""
    return ensembles.indices(_routes(spark, sf_dir)).select("d", F.round("rpe", 8).alias("rpe"))


@query(f"WITH {_R}, {_P} SELECT d, round(CAST(li AS DOUBLE), 8) AS li FROM ind")
def i3_dissimilarity(spark, sf_dir):
    """One less the mean Jaccard similarity of two routes."""
    return ensembles.indices(_routes(spark, sf_dir)).select("d", F.round("li", 8).alias("li"))


@query(f"WITH {_R} SELECT d, CAST(count(*) AS DOUBLE) AS deng FROM r GROUP BY d")
def i4_multiplicity(spark, sf_dir):
    """Number of routes of an ensemble."""
    return ensembles.indices(_routes(spark, sf_dir)).select("d", "deng")


@query(f"WITH {_R}, {_P} SELECT d, abs(round(h / ln(15), 8)) AS h_norm FROM ind")
def p19_normalised_entropy(spark, sf_dir):
    """Entropy of the shares over the logarithm of 15."""
    return ensembles.indices(_routes(spark, sf_dir), k=15).select("d", F.abs(F.round("h_norm", 8)).alias("h_norm"))


_D = """cf AS (SELECT a.d, a.route AS i, b.route AS j FROM r a JOIN r b ON a.d = b.d AND a.route < b.route WHERE len(list_intersect(a.arcs, b.arcs)) > 0),
s AS (SELECT d, any_value(n) AS n, unnest(range(1, CAST(1 << any_value(n) AS BIGINT))) AS s FROM (SELECT d, count(*)::INTEGER AS n FROM r GROUP BY d) c GROUP BY d),
dd AS (SELECT d, any_value(n)::BIGINT AS n, CAST(max(bit_count(s)) AS INTEGER) AS disjoint FROM s WHERE NOT EXISTS (SELECT 1 FROM cf WHERE cf.d = s.d AND (s.s >> cf.i) & 1 = 1 AND (s.s >> cf.j) & 1 = 1) GROUP BY d)"""


@query(f"WITH {_R}, {_D} SELECT * FROM dd")
def i5_disjoint_family(spark, sf_dir):
    """Most routes of an ensemble of which no two share an arc."""
    return ensembles.disjoint_routes(_routes(spark, sf_dir))


@query(f"WITH {_R}, {_D}, {_K} SELECT config, CAST(sum(CASE WHEN kappa < {COLOCATED} THEN 1 ELSE 0 END) AS BIGINT) AS tested, CAST(sum(CASE WHEN kappa < {COLOCATED} AND disjoint > kappa THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM dd JOIN k USING (d) GROUP BY 1")
def i6_soundness(spark, sf_dir):
    """Demands that are not colocated, and those of them with more disjoint routes than their label allows."""
    t = _with_labels(spark, sf_dir)
    real = F.col("kappa") < COLOCATED
    return t.groupBy("config").agg(F.sum(real.cast("long")).alias("tested"), F.sum((real & (F.col("disjoint") > F.col("kappa"))).cast("long")).alias("violations"))


def _with_labels(spark, sf_dir):
    return ensembles.disjoint_routes(_routes(spark, sf_dir)).join(_labels(spark, sf_dir), "d")


_T = f"{_R}, {_D}, {_K}, t AS (SELECT d, config, kappa, disjoint AS f, CASE WHEN kappa >= 2 THEN 1 ELSE 0 END AS y2, CASE WHEN kappa = 1 THEN 1 ELSE 0 END AS y1 FROM dd JOIN k USING (d))"
_AP = """SELECT config, round(CAST(sum(CAST(p AS DOUBLE) * tp / total) / nullif(sum(p), 0) AS DOUBLE), 9) AS ap FROM (SELECT config, p, sum(p) OVER w AS tp, sum(n) OVER w AS total
 FROM (SELECT config, f, sum(y1) AS p, count(*) AS n FROM t GROUP BY 1, 2) g WINDOW w AS (PARTITION BY config ORDER BY f ROWS UNBOUNDED PRECEDING)) c GROUP BY config"""


@query(f"""WITH {_T}, a AS ({_auc_sql("SELECT config, f, y2 FROM t", "config", "f", "y2")}), ap AS ({_AP})
SELECT config, count(*) AS n, round(avg(y1), 9) AS base_rate, CAST(sum(CASE WHEN f > kappa AND kappa < 50 THEN 1 ELSE 0 END) AS BIGINT) AS violations, round(avg(CASE WHEN y2 = 1 THEN CASE WHEN f >= 2 THEN 1.0 ELSE 0 END END), 9) AS coverage,
 round(avg(CASE WHEN f >= 2 THEN 1.0 ELSE 0 END), 9) AS certified, round(avg(CASE WHEN f = 1 THEN y1 END), 9) AS uncertified_ones, quantile_cont(CASE WHEN kappa = 1 THEN f END, 0.5) AS median_1, quantile_cont(CASE WHEN kappa >= 3 AND kappa < 50 THEN f END, 0.5) AS median_3,
 round(any_value(auc), 9) AS auc, any_value(ap) AS ap FROM t JOIN a USING (config) JOIN ap USING (config) GROUP BY config""")
def i7_summary(spark, sf_dir):
    """What the disjoint family certifies, a configuration: coverage, shares, medians, AUC and average precision."""
    t = stored(_with_labels(spark, sf_dir).withColumn("y2", (F.col("kappa") >= 2).cast("int")).withColumn("y1", (F.col("kappa") == 1).cast("int")))
    return _cell(t, ["config"])


def _cell(t: DataFrame, by: list[str]) -> DataFrame:
    """Certificate statistics of rows (by, D, kappa, y1, y2)."""
    mean = lambda c, when, name: F.round(F.avg(F.when(when, c)), 9).alias(name)
    two, real = (F.col("disjoint") >= 2).cast("double"), F.col("kappa") < COLOCATED
    out = t.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("y1"), 9).alias("base_rate"), F.sum((real & (F.col("disjoint") > F.col("kappa"))).cast("long")).alias("violations"), mean(two, F.col("y2") == 1, "coverage"),
        F.round(F.avg(two), 9).alias("certified"), mean(F.col("y1"), F.col("disjoint") == 1, "uncertified_ones"), F.percentile(F.when(F.col("kappa") == 1, F.col("disjoint")), F.lit(0.5)).alias("median_1"),
        F.percentile(F.when((F.col("kappa") >= 3) & real, F.col("disjoint")), F.lit(0.5)).alias("median_3"))
    auc = weighted.auc(t, "disjoint", "y2", by).select(*by, F.round("auc", 9).alias("auc"))
    ap = stats.average_precision(t, "disjoint", "y1", by, descending=False).withColumn("ap", F.round("ap", 9))
    return out.join(auc, by).join(ap, by)


#: Replicates of the bootstrap of i8.
REPLICATES = 50


@query(f"""WITH {_R}, {_P}, {_K}, t AS (SELECT d, round(CAST(li AS DOUBLE), 8) AS x, CASE WHEN kappa >= 2 THEN 1 ELSE 0 END AS y, kappa FROM ind JOIN k USING (d)), pos AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n FROM t),
dr AS (SELECT rep, {stats.draw_sql("rep", "pos")} % n AS pos FROM pos, (SELECT unnest(range({REPLICATES})) AS rep) reps), bt AS (SELECT rep, x, y FROM dr JOIN pos USING (pos)), v AS ({_auc_sql("SELECT rep, x, y FROM bt", "rep", "x")}),
e AS ({_auc_sql("SELECT x, y FROM t", "", "x")}), th AS (SELECT quantile_cont(x, 2.0 / 3) AS q FROM t)
SELECT count(*) AS n, round(avg(y), 9) AS redundant, (SELECT round(auc, 9) FROM e) AS auc, (SELECT round(quantile_cont(auc, 0.025), 9) FROM v) AS lo, (SELECT round(quantile_cont(auc, 0.975), 9) FROM v) AS hi,
 round(avg(CASE WHEN x >= (SELECT q FROM th) THEN CASE WHEN kappa = 1 THEN 1.0 ELSE 0 END END), 9) AS top_third_ones FROM t""")
def i8_misranking(spark, sf_dir):
    """How well route diversity ranks demands with two and more routes, its bootstrap interval, and the ones among its top third."""
    x = ensembles.indices(_routes(spark, sf_dir)).join(_labels(spark, sf_dir).hint("merge"), "d")
    t = stored(x.select("d", F.round("li", 8).alias("x"), (F.col("kappa") >= 2).cast("int").alias("y"), "kappa"))
    v = stats.resampled_auc(t.select("d", "x", "y"), REPLICATES, ["d"], "x", "y")
    ci = v.agg(F.round(F.percentile("auc", F.lit(0.025)), 9).alias("lo"), F.round(F.percentile("auc", F.lit(0.975)), 9).alias("hi"))
    q = t.agg(F.percentile("x", F.lit(2.0 / 3)).alias("q"))
    head = t.join(F.broadcast(q)).agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("redundant"), F.round(F.avg(F.when(F.col("x") >= F.col("q"), (F.col("kappa") == 1).cast("double"))), 9).alias("top_third_ones"))
    return head.join(F.broadcast(weighted.auc(t, "x", "y", []).select(F.round("auc", 9).alias("auc")))).join(F.broadcast(ci)).select("n", "redundant", "auc", "lo", "hi", "top_third_ones")


_D2 = _D.replace("r a JOIN r b", "r2 a JOIN r2 b").replace("FROM r GROUP BY d", "FROM r2 GROUP BY d")


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH {_R}, r2 AS (SELECT * FROM r WHERE route < {k}), {_D2}, {_K}, t AS (SELECT d, config, kappa, disjoint AS f, CASE WHEN kappa >= 2 THEN 1 ELSE 0 END AS y2 FROM dd JOIN k USING (d)), a AS ({_auc_sql("SELECT config, f, y2 FROM t", "config", "f", "y2")})
SELECT config, CAST({k} AS INTEGER) AS k, count(*) AS n, CAST(sum(CASE WHEN f > kappa AND kappa < 50 THEN 1 ELSE 0 END) AS BIGINT) AS violations, round(avg(CASE WHEN y2 = 1 THEN CASE WHEN f >= 2 THEN 1.0 ELSE 0 END END), 9) AS coverage, round(any_value(auc), 9) AS auc FROM t JOIN a USING (config) GROUP BY config) q{k}""" for k in (2, 4)))
def i9_envelope_cells(spark, sf_dir):
    """Certificate statistics of prefixes of two and four routes, a generator."""
    r, labels = stored(_routes(spark, sf_dir)), _labels(spark, sf_dir)

    def one(k):
        t = ensembles.disjoint_routes(r.where(F.col("route") < k)).join(labels, "d").withColumn("y2", (F.col("kappa") >= 2).cast("int")).withColumn("y1", (F.col("kappa") == 1).cast("int"))
        return _cell(stored(t), ["config"]).select("config", F.lit(k).alias("k"), "n", "violations", "coverage", "auc")

    return reduce(DataFrame.unionByName, [one(k) for k in (2, 4)])


@query("""SELECT p_partkey, CAST(rho AS DOUBLE) AS rho, CAST(k AS INTEGER) AS k, round(CASE WHEN p_partkey % 10 = 0 THEN 'inf'::DOUBLE ELSE pow(rho, k - 1) * (p_retailprice + (k - 1) * p_size) END, 3) AS horizon
 FROM part, (SELECT unnest([1.25, 4.0]) AS rho) a, (SELECT unnest([3, 5]) AS k) b""")
def i10_horizon(spark, sf_dir):
    """Cost that penalised routes can't exceed; infinite where there is no route."""
    p = table(spark, sf_dir, "part").withColumn("rho", F.explode(F.array(F.lit(1.25), F.lit(4.0)))).withColumn("k", F.explode(F.array(F.lit(3), F.lit(5))))
    cheapest = F.expr("CASE WHEN p_partkey % 10 = 0 THEN double('Infinity') ELSE p_retailprice END")
    # a price that isn't known leaves the horizon unknown, as in SQL; only an infinite one says that there is no route
    known = F.when(cheapest.isNotNull(), ensembles.horizon(cheapest, F.col("p_size"), F.col("k"), F.col("rho")))
    return p.select("p_partkey", "rho", "k", scalars.rounded(known, 3).alias("horizon"))


@query(f"WITH {_R}, b AS (SELECT *, min(cost) OVER (PARTITION BY d) AS m FROM r), k AS (SELECT d, route, row_number() OVER (PARTITION BY d ORDER BY route) AS k FROM b WHERE cost <= 1.25 * m) SELECT d, route FROM k WHERE k <= 3")
def p9_budget(spark, sf_dir):
    """The first three routes within 25 % of the cheapest."""
    return ensembles.within_budget(_routes(spark, sf_dir), 0.25, 3, ["d"]).select("d", "route")


@query(f"""WITH {lattice.SQL}, net AS (SELECT u, v, min(w) AS w FROM arcs GROUP BY 1, 2), t AS (SELECT a.u AS s, a.v AS m, b.v AS e, a.w + b.w AS cost FROM net a JOIN net b ON a.v = b.u WHERE b.v <> a.u) SELECT s, m, e, cost FROM t""")
def p10_route_costs(spark, sf_dir):
    """Costs of all routes of two arcs, summed over their arcs."""
    net = stored(graph(spark, sf_dir))
    a, b = net.select(F.col("u").alias("s"), F.col("v").alias("m")), net.select(F.col("u").alias("m"), F.col("v").alias("e"))
    r = a.join(b, "m").where("e <> s").withColumn("nodes", F.array("s", "m", "e"))
    return ensembles.route_costs(ensembles.with_arcs(r), net, ["s", "m", "e"])


@query()
def r56_route_ensembles(spark, sf_dir):
    """Indices, disjoint families and labels of penalised routes from entry sets."""
    entries, access = stored(_entries(spark, sf_dir)), lattice.access(spark, sf_dir)
    k = flow.route_counts(graph(spark, sf_dir), entries, access).select("d", "kappa", "colocated")
    return paths.route_indices(_bc(spark, sf_dir), entries, access, 4, GENERATORS).join(k, "d")


@query()
def p7_shortest_from_node(spark, sf_dir):
    """The three cheapest loopless routes from single nodes to any access point."""
    e = _entries(spark, sf_dir).select("d", F.array("d").alias("entry"))
    return paths.routes(_bc(spark, sf_dir), e, lattice.access(spark, sf_dir), 3, {"shortest": None}).select("d", "route", "cost", "nodes")
