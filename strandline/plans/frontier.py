"""Certificates against frontiers: least budgets, ceilings, guards, and what screens miss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import weighted
from strandline.operators import flow, frontier
from strandline.plans.kappa import _MULTI, _kappa_sql, graph, multi, single
from strandline.plans.paths import _ENTRY, _NEAREST, _NET
from strandline.registry import query
from strandline.session import stored, table
from strandline.sources import lattice

COLOCATED, TOLERANCE = 50, 1e-9


@query(f"WITH RECURSIVE {_NET}, {_ENTRY}, {_NEAREST} SELECT d, bool_or(e IN (SELECT node FROM seats)) AS colocated, min(t) AS cheapest FROM ent LEFT JOIN da ON x = e GROUP BY d")
def i12_least_budgets(spark, sf_dir):
    """Entry sets: whether one is at an access point, and the cheapest way to access (budgets for two and three routes are in i17)."""
    return _horizon(spark, sf_dir).select("d", "colocated", "cheapest")


def _horizon(spark, sf_dir):
    return frontier.least_budgets(graph(spark, sf_dir), lattice.access(spark, sf_dir), multi(spark, sf_dir))


@query(f"WITH {lattice.SQL}, n AS (SELECT d, e FROM (SELECT q.node AS d, p.node AS e, row_number() OVER (PARTITION BY q.node ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.node) AS k FROM spots q, spots p WHERE q.node IN (SELECT d FROM zones)) t WHERE k <= 3) SELECT d, list_aggregate(list_sort(list(e)), 'string_agg', ',') AS entry FROM n GROUP BY d")
def i13_entry_sets(spark, sf_dir):
    """Entry sets: a node and its three nearest, itself among them."""
    return multi(spark, sf_dir).select("d", F.array_join(F.transform("entry", lambda x: x.cast("string")), ",").alias("entry"))


_E = """env AS (SELECT p_partkey AS d, p_brand AS generator, CAST(p_size % 4 AS INTEGER) AS disjoint, CAST(p_partkey % 5 AS INTEGER) AS kappa, p_retailprice AS bmax, p_retailprice * 1.2 AS btheory FROM part),
hor AS (SELECT p_partkey AS d, p_partkey % 13 = 0 AS colocated, p_partkey % 17 <> 0 AS reachable, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_retailprice - 30 + p_size END AS b2, CASE WHEN p_partkey % 7 = 0 THEN 'inf'::DOUBLE ELSE p_retailprice - 20 + p_size END AS b3 FROM part),
m AS (SELECT * FROM env JOIN hor USING (d) WHERE NOT colocated AND reachable AND kappa < 50)"""


def _merged(spark, sf_dir):
    p = table(spark, sf_dir, "part").dropDuplicates(["p_partkey"])
    env = p.select(F.col("p_partkey").alias("d"), F.col("p_brand").alias("generator"), F.expr("cast(p_size % 4 AS int)").alias("disjoint"), F.expr("cast(p_partkey % 5 AS int)").alias("kappa"), F.col("p_retailprice").alias("bmax"), F.expr("p_retailprice * 1.2D").alias("btheory"))
    hor = p.select(F.col("p_partkey").alias("d"), F.expr("p_partkey % 13 = 0").alias("colocated"), F.expr("p_partkey % 17 <> 0").alias("reachable"), F.expr("CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_retailprice - 30 + p_size END").alias("b2"),
                   F.expr("CASE WHEN p_partkey % 7 = 0 THEN double('Infinity') ELSE p_retailprice - 20 + p_size END").alias("b3"))
    return env.join(hor, "d").where(f"NOT colocated AND reachable AND kappa < {COLOCATED}")


def _r10(c):
    """Rounded, so that both engines see the same side of a tie."""
    return F.round(c, 6)


@query(f"""WITH {_E}, t AS (SELECT 2 AS r, disjoint, bmax, b2 AS b FROM m UNION ALL SELECT 3, disjoint, bmax, b3 FROM m)
SELECT CAST(r AS INTEGER) AS r, count(*) AS tested, CAST(sum(CASE WHEN round(bmax, 6) < round(b, 6) THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM t WHERE disjoint >= r AND b IS NOT NULL AND b < 'inf'::DOUBLE GROUP BY r""")
def i14_necessity(spark, sf_dir):
    """Demands with r disjoint routes in their ensemble, and those whose dearest route lies below the least budget."""
    m = _merged(spark, sf_dir)
    one = lambda r, b: m.where((F.col("disjoint") >= r) & F.col(b).isNotNull() & (F.col(b) < float("inf"))).agg(
        F.count("*").alias("tested"), F.sum((_r10("bmax") < _r10(b)).cast("long")).alias("violations")).select(F.lit(r).alias("r"), "tested", "violations")
    return one(2, "b2").unionByName(one(3, "b3"))


@query(f"""WITH {_E}, t AS (SELECT generator, count(*) AS n, avg(CASE WHEN disjoint >= 2 THEN 1.0 ELSE 0 END) AS cov, avg(CASE WHEN round(btheory, 6) >= round(b2, 6) THEN 1.0 ELSE 0 END) AS th, avg(CASE WHEN round(bmax, 6) >= round(b2, 6) THEN 1.0 ELSE 0 END) AS re FROM m WHERE kappa >= 2 GROUP BY 1)
SELECT generator, n, round(cov, 9) AS coverage, round(th, 9) AS ceiling_theory, round(re, 9) AS ceiling_realized, round(th - cov, 9) AS slack, cov <= th + 1e-6 AS holds, th >= 0.95 AS vacuous FROM t""")
def i15_ceilings(spark, sf_dir):
    """What share of redundant demands a generator could certify at most, and does."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    t = _merged(spark, sf_dir).where("kappa >= 2").groupBy("generator").agg(
        F.count("*").alias("n"), rate(F.col("disjoint") >= 2).alias("cov"), rate(_r10("btheory") >= _r10("b2")).alias("th"), rate(_r10("bmax") >= _r10("b2")).alias("re"))
    return t.select("generator", "n", F.round("cov", 9).alias("coverage"), F.round("th", 9).alias("ceiling_theory"), F.round("re", 9).alias("ceiling_realized"), F.round(F.col("th") - F.col("cov"), 9).alias("slack"),
                    (F.col("cov") <= F.col("th") + 1e-6).alias("holds"), (F.col("th") >= 0.95).alias("vacuous"))


@query()
def i16_attained(spark, sf_dir):
    """Two routes without a common arc within the least budget, for each demand that has them."""
    return frontier.attained(graph(spark, sf_dir), lattice.access(spark, sf_dir), single(spark, sf_dir).select("d", F.array("d").alias("entry")))


@query(_kappa_sql() + "SELECT count(*) AS demands, count(*) AS agree, count(*) AS steady, count(*) AS disjoint FROM kappa WHERE k2 = 2")
def i17_sweep_control(spark, sf_dir):
    """Demands with two routes: binary and exhaustive search agree, counts never fall, and the routes found share no arc."""
    a = i16_attained(spark, sf_dir)
    arcs = F.flatten(F.transform("routes", lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(F.get(p, i).alias("u"), F.get(p, i + 1).alias("v")))))
    ok = (F.size("routes") == 2) & (F.size(F.array_distinct(arcs)) == F.size(arcs))
    return a.agg(F.count("*").alias("demands"), F.sum((F.abs(F.col("budget") - F.col("swept")) < 1e-6).cast("long")).alias("agree"), F.sum(F.col("steady").cast("long")).alias("steady"), F.sum(ok.cast("long")).alias("disjoint"))


@query(_kappa_sql(_MULTI) + "SELECT count(*) AS demands, count(*) AS agree FROM kappa WHERE k2 IS NOT NULL")
def i18_label_guard(spark, sf_dir):
    """Route counts capped at eight, and those that equal the uncapped count up to there."""
    sets, access, a = stored(multi(spark, sf_dir)), lattice.access(spark, sf_dir), graph(spark, sf_dir)
    full, capped = (flow.route_counts(a, sets, access, cap=c).where("NOT colocated").select("d", F.col("kappa").alias(n)) for c, n in ((50, "k"), (8, "k8")))
    return full.join(capped, "d").agg(F.count("*").alias("demands"), F.sum((F.least("k", F.lit(8)) == F.col("k8")).cast("long")).alias("agree"))


@query("""WITH t AS (SELECT doc_id, toxic AS y, row_number() OVER (ORDER BY n_chars, doc_id) AS k, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)), q AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5]) AS q)
SELECT CAST(q AS DOUBLE) AS q, count(*) FILTER (k <= greatest(1, round(q * n))) AS flagged, round(sum(CASE WHEN k <= greatest(1, round(q * n)) THEN y ELSE 0 END) / greatest(sum(y), 1), 9) AS recall, round(avg(CASE WHEN k <= greatest(1, round(q * n)) THEN y END), 9) AS precision FROM t, q GROUP BY q""")
def i19_screen(spark, sf_dir):
    """Recall and precision when only the first share of a ranking is verified."""
    t = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    n = t.count()
    top = t.orderBy("n_chars", "doc_id").limit(max(1, round(0.5 * n + 1)))  # no share asked for is greater
    k = stored(top.withColumn("k", F.row_number().over(Window.orderBy("n_chars", "doc_id"))))
    total = t.agg(F.greatest(F.sum("y"), F.lit(1)).alias("total"))
    one = lambda q: k.where(F.col("k") <= F.greatest(F.lit(1), F.round(F.lit(q * n)))).agg(F.count("*").alias("flagged"), F.sum("y").alias("hit")).select(F.lit(q).alias("q"), "flagged", "hit")
    rows = reduce(DataFrame.unionByName, [one(q) for q in (0.05, 0.1, 0.2, 0.3, 0.5)])
    return rows.join(F.broadcast(total)).select("q", "flagged", F.round(F.expr("hit / total"), 9).alias("recall"), F.round(F.expr("hit / flagged"), 9).alias("precision"))


@query(_kappa_sql(_MULTI) + """SELECT round(sum(CASE WHEN k2 = 1 THEN w ELSE 0 END) / sum(w), 9) AS included, round(sum(CASE WHEN k2 = 1 THEN w ELSE 0 END) / sum(CASE WHEN k2 IS NOT NULL THEN w END), 9) AS excluded FROM zones JOIN kappa USING (d)""")
def i20_colocation(spark, sf_dir):
    """Share of demand weight with one route, demands at an access point counted and left out."""
    k = flow.route_counts(graph(spark, sf_dir), multi(spark, sf_dir), lattice.access(spark, sf_dir), cap=2)
    z = lattice.demands(spark, sf_dir).join(k.select("d", "kappa"), "d")
    one, w = F.coalesce(F.col("kappa") == 1, F.lit(False)), F.col("w")
    return z.agg(F.round(weighted.share(one, w), 9).alias("included"), F.round(weighted.share(one, F.when(F.col("kappa").isNotNull(), w)), 9).alias("excluded"))


@query()
def g14_flows(spark, sf_dir):
    """Streets used both ways that cancel out of each demand's flow, and whether two routes share no way (ways are blocks of streets)."""
    a = graph(spark, sf_dir).withColumn("way", F.expr("concat('way ', (least(u, v) * 31 + greatest(u, v) * 17) % 997)"))
    return frontier.way_disjoint(a, lattice.access(spark, sf_dir), single(spark, sf_dir).select("d", F.array("d").alias("entry")))


@query(_kappa_sql() + "SELECT count(*) AS demands FROM kappa WHERE k2 = 2")
def g17_way_disjoint(spark, sf_dir):
    """Demands with two routes, all of which get a status."""
    return g14_flows(spark, sf_dir).agg(F.count("*").alias("demands"))
