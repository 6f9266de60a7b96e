"""Joins, aggregates, windows, reshaping, sources and built tables of the engine's data model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import stats, weighted
from strandline.operators import flow, spatial, streets
from strandline.plans.kappa import near
from strandline.registry import query
from strandline.session import shared_dir, stored, table
from strandline.sources import files, lattice


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/strandline/files/{name}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def r1_cache(spark, sf_dir):
    """A table through the fingerprinted cache: built once for each state of the file it comes from."""
    mark = files.fingerprint(spark, f"{sf_dir}/nation.parquet")
    return files.cached(spark, "nation", mark, lambda: table(spark, sf_dir, "nation")).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer WHERE c_custkey % 10 > 2")
def r2_separated_values(spark, sf_dir):
    """Customers written as lines, some of them notes, and read back through the line filter."""
    c = table(spark, sf_dir, "customer")
    path = _scratch(spark, "lines")
    c.select(F.when(F.expr("c_custkey % 10 > 2"), F.concat_ws("|", "c_custkey", "c_mktsegment")).otherwise(F.concat(F.lit("# note "), "c_custkey")).alias("value")).write.mode("overwrite").text(path)
    return files.separated(spark, path, ["id", "segment"], r"^[0-9]+\|")


@query("SELECT s_suppkey AS id, s_name AS name, 'LineString' AS kind, CAST(s_suppkey % 100 AS DOUBLE) AS x, CAST(s_suppkey // 100 AS DOUBLE) AS y, 2 AS points FROM supplier")
def r3_geojson(spark, sf_dir):
    """Suppliers written as GeoJSON lines and read back."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                                F.expr("array(array(s_suppkey % 100 * 1D, s_suppkey div 100 * 1D), array(0D, 0D))").alias("line"))
    path = _scratch(spark, "geojson")
    text = files.features(s, ["id", "name"], "line").withColumn("value", F.regexp_replace("value", r"\n", " "))
    text.write.mode("overwrite").option("lineSep", "\n").text(path)
    f = spark.read.schema("features array<struct<properties: struct<id: bigint, name: string>, geometry: struct<type: string, coordinates: array<array<double>>>>>").json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.id", "f.properties.name", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates")[0][0].alias("x"), F.col("f.geometry.coordinates")[0][1].alias("y"), F.size("f.geometry.coordinates").alias("points"))


_RASTER = "SELECT CAST(p_partkey // 45 AS BIGINT) AS row, CAST(p_partkey % 45 AS BIGINT) AS col, CASE WHEN p_size % 9 = 0 THEN -999.0 ELSE CAST(p_size AS DOUBLE) - 5 END AS v FROM part WHERE p_partkey < 2025"


def _population(spark, sf_dir):
    raster = table(spark, sf_dir, "part").where("p_partkey < 2025").select(F.expr("p_partkey div 45").alias("row"), F.expr("p_partkey % 45").alias("col"), F.expr("CASE WHEN p_size % 9 = 0 THEN -999D ELSE cast(p_size AS double) - 5 END").alias("v"))
    return files.sampled(lattice.places(spark, sf_dir), raster, 0.0, 0.0, 100.0, -999.0)


@query(f"""WITH {lattice.SQL}, r AS ({_RASTER}), p AS (SELECT node, coalesce(CASE WHEN v = -999.0 THEN 0 ELSE greatest(v, 0) END, 0) AS value FROM spots LEFT JOIN r ON r.row = floor(y / 100) AND r.col = floor(x / 100))
SELECT node, CAST(value AS DOUBLE) AS value, round(value / (SELECT max(value) FROM p), 9) AS share FROM p""")
def r4_raster_sample(spark, sf_dir):
    """The raster cell's value at each node, nodata as 0, and its share of the greatest."""
    p = _population(spark, sf_dir)
    top = p.agg(F.max("value").alias("top"))
    return p.join(F.broadcast(top)).select("node", "value", F.round(F.col("value") / F.col("top"), 9).alias("share"))


@query(f"""WITH {lattice.SQL} SELECT q, node, d2, CAST(k AS INTEGER) AS k FROM (SELECT q.node AS q, p.node, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d2,
 row_number() OVER (PARTITION BY q.node ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.node) AS k FROM spots q, spots p WHERE q.node IN (SELECT d FROM zones)) n WHERE k <= 5""")
def r6_nearest(spark, sf_dir):
    """The five nodes nearest each demand node, itself among them."""
    return near(spark, sf_dir)


@query(f"""WITH {lattice.SQL} SELECT q.node AS q, p.node, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d2 FROM spots q, spots p WHERE (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 62500""")
def r7_radius(spark, sf_dir):
    """All pairs of nodes within 250 m."""
    p = lattice.places(spark, sf_dir)
    return spatial.radius_join(p.withColumnRenamed("node", "q"), p, 250.0)


_HOODS = "SELECT n_nationkey AS poly, n_nationkey % 5 * 800.0 AS x0, n_nationkey // 5 * 800.0 AS y0, 700.0 + n_nationkey * 10 AS e FROM nation"


def _hoods(spark, sf_dir):
    """Triangles and squares, a nation each."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("poly"), F.expr("n_nationkey % 5 * 800D").alias("x"), F.expr("n_nationkey div 5 * 800D").alias("y"), F.expr("700D + n_nationkey * 10").alias("e"))
    corner = lambda dx, dy: f"named_struct('x', x + {dx} * e, 'y', y + {dy} * e)"
    square, triangle = (f"array({', '.join(corner(*c) for c in cs)})" for cs in (((0, 0), (1, 0), (1, 1), (0, 1)), ((0, 0), (1, 0), (0, 1))))
    return n.select("poly", F.expr(f"CASE WHEN poly % 2 = 0 THEN {square} ELSE {triangle} END").alias("ring"))


def _inside():
    return "x >= x0 AND x < x0 + e AND y >= y0 AND y < y0 + e AND (poly % 2 = 0 OR (x - x0) + (y - y0) < e)"


@query(f"WITH {lattice.SQL}, h AS ({_HOODS}) SELECT s.node AS id, CAST(min(h.poly) AS BIGINT) AS poly FROM (SELECT node, x + 0.3 AS x, y + 0.7 AS y FROM spots) s LEFT JOIN h ON {_inside()} GROUP BY s.node")
def r8_point_in_polygon(spark, sf_dir):
    """The neighbourhood of each node, null outside of all."""
    p = lattice.places(spark, sf_dir).select(F.col("node").alias("id"), (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.7).alias("y"))
    return spatial.polygon_join(p, _hoods(spark, sf_dir), 400.0).select("id", "poly")


@query(f"WITH {lattice.SQL}, t AS (SELECT l_orderkey % 1500 AS u, l_partkey % 1500 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a.u, a.v, coalesce(n, 0) AS n FROM arcs a LEFT JOIN t USING (u, v)")
def r9_left_join_fill(spark, sf_dir):
    """Counts by (u, v) joined to arcs, 0 where there is none."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey % 1500").alias("u"), F.expr("l_partkey % 1500").alias("v")).agg(F.count("*").alias("n"))
    return lattice.arcs(spark, sf_dir).select("u", "v").join(t, ["u", "v"], "left").fillna(0, ["n"])


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def r10_guarded_join(spark, sf_dir):
    """Customers with nation and region; keys that repeat on the right are an error."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    for df, key in ((n, "n_nationkey"), (r, "r_regionkey")):
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} repeats")
    c = table(spark, sf_dir, "customer")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS orders, c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20) AS far FROM customer")
def r11_semi_anti(spark, sf_dir):
    """Membership of customers in orders, and absence from some suppliers' nations."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 20").select(F.col("s_nationkey").alias("c_nationkey"))
    near_ = c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("orders"))
    far = c.join(s, "c_nationkey", "left_anti").select("c_custkey", F.lit(True).alias("far"))
    return c.select("c_custkey").join(near_, "c_custkey", "left").join(far, "c_custkey", "left").fillna(False, ["orders", "far"])


@query("SELECT p_partkey, p_brand, coalesce(w, 1.0) AS w FROM part LEFT JOIN (SELECT 'Brand#' || x AS p_brand, x / 10.0 AS w FROM (SELECT unnest(range(11, 30)) AS x) t) m USING (p_brand)")
def r12_lookup_default(spark, sf_dir):
    """A small map's weight of each part's brand, 1 where it has none."""
    m = spark.range(11, 30).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("p_brand"), (F.col("id") / 10.0).alias("w"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(F.broadcast(m), "p_brand", "left").fillna(1.0, ["w"])


@query("""SELECT l_shipmode_proxy AS g, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75
 FROM (SELECT *, l_linestatus || l_returnflag AS l_shipmode_proxy FROM lineitem) l GROUP BY 1""")
def r19_quantiles(spark, sf_dir):
    """Means, medians and interpolated quartiles of groups."""
    pct = lambda c, q, n: F.percentile(c, F.lit(q)).alias(n)
    return table(spark, sf_dir, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("g")).agg(
        F.round(F.avg("l_quantity"), 6).alias("mean"), pct("l_quantity", 0.5, "median"), pct("l_extendedprice", 0.25, "q25"), pct("l_extendedprice", 0.75, "q75"))


@query("""WITH t AS (SELECT c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS x, c_custkey % 9 + 1 AS w FROM customer),
m AS (SELECT c_nationkey, quantile_cont(x, 0.5) AS m FROM t GROUP BY 1) SELECT c_nationkey, round(sum(coalesce(x, m) * w) / sum(w), 6) AS mean FROM t JOIN m USING (c_nationkey) GROUP BY 1""")
def r22_imputed_mean(spark, sf_dir):
    """Weighted mean balance of a nation, missing ones taken as its median."""
    t = table(spark, sf_dir, "customer").select("c_nationkey", F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END").alias("x"), F.expr("c_custkey % 9 + 1").alias("w"))
    m = t.groupBy("c_nationkey").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return t.join(F.broadcast(m), "c_nationkey").groupBy("c_nationkey").agg(F.round(F.sum(F.coalesce("x", "m") * F.col("w")) / F.sum("w"), 6).alias("mean"))


@query("SELECT least(k, 4) AS k, count(*) AS n FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey) t GROUP BY 1")
def r23_histogram(spark, sf_dir):
    """Customers by their number of orders, 4 and more together."""
    k = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return k.groupBy(F.least("k", F.lit(4).cast("long")).alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS w1
 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))""")
def r24_pooled_share(spark, sf_dir):
    """Weighted share of a group next to that of all groups pooled."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return df.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linestatus")]], "l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), weighted.share(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("w1"))


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS whole FROM s)
SELECT l_returnflag, min(x) AS weighted_median FROM c WHERE upto >= whole / 2 GROUP BY 1""")
def r21_weighted_median(spark, sf_dir):
    """Price at which half the quantity of a flag is reached."""
    return weighted.median(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query("""WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS share FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, round(sum(share * n) / sum(n), 9) AS by_count, round(avg(share), 9) AS equal FROM g GROUP BY 1""")
def r25_pools(spark, sf_dir):
    """Shares of nations pooled by their number of customers, and evenly."""
    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") > 0).cast("double")).alias("share"))
    return g.groupBy("c_mktsegment").agg(F.round(F.sum(F.col("share") * F.col("n")) / F.sum("n"), 9).alias("by_count"), F.round(F.avg("share"), 9).alias("equal"))


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r,
 round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 9) AS pct FROM part""")
def r27_ranks(spark, sf_dir):
    """Tie-averaged and percent ranks of parts by size in their brand."""
    r = stats.ranked(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"], "r")
    n = r.groupBy("p_brand").agg(F.count("*").alias("n"))
    return r.join(F.broadcast(n), "p_brand").select("p_partkey", "r", F.round(F.col("r") / F.col("n"), 9).alias("pct"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) * 1.0 / count(*) OVER (PARTITION BY c_nationkey) AS s FROM customer)
SELECT c_custkey, CASE WHEN s <= 1 / 3.0 THEN 1 WHEN s <= 2 / 3.0 THEN 2 ELSE 3 END AS tertile FROM r""")
def r28_tertiles(spark, sf_dir):
    """Third of its nation that a customer's balance is in."""
    return table(spark, sf_dir, "customer").select("c_custkey", streets.tertile(["c_acctbal", "c_custkey"], ["c_nationkey"]).alias("tertile"))


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS demeaned FROM customer")
def r29_demeaned(spark, sf_dir):
    """Balance less the nation's mean; the means are summed before they meet the rows."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    m = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return c.join(F.broadcast(m), "c_nationkey").select("c_custkey", F.round(F.col("c_acctbal") - F.col("m"), 6).alias("demeaned"))


@query("SELECT l_linestatus, CAST(day AS DATE) AS day, CAST(sum(n) OVER (PARTITION BY l_linestatus ORDER BY day) AS BIGINT) AS upto FROM (SELECT l_linestatus, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2) t")
def r30_running(spark, sf_dir):
    """Items shipped up to each day, in ranges of days."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return weighted.running(d, ["l_linestatus"], "day", ["n"]).select("l_linestatus", "day", F.col("upto_n").alias("upto"))


@query("""SELECT c_nationkey, c_custkey, CAST(k AS INTEGER) AS k FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) t WHERE k <= 3 OR k <= n // 10""")
def r32_top(spark, sf_dir):
    """The three greatest balances of a nation, or its top tenth where that is more."""
    w = Window.partitionBy("c_nationkey")
    c = table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))).withColumn("n", F.count("*").over(w))
    return c.where("k <= 3 OR k <= n div 10").select("c_nationkey", "c_custkey", "k")


@query("SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 's', s_nationkey, s_acctbal, s_name FROM supplier")
def r33_concatenated(spark, sf_dir):
    """Customers and suppliers under one another, missing columns null."""
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1")
def r34_keep_first(spark, sf_dir):
    """The first order of each customer, by partial aggregation instead of a window."""
    first = F.min(F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(first.alias("f"), F.count("*").alias("n")).select("o_custkey", "f.o_orderkey", "n")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS x FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS x FROM orders WHERE o_orderstatus = 'F')
SELECT 'both' AS op, count(*) AS n FROM (SELECT x FROM a INTERSECT SELECT x FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT x FROM a UNION SELECT x FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT x FROM a EXCEPT SELECT x FROM b)""")
def r35_set_operations(spark, sf_dir):
    """Sizes of the intersection, union and difference of two sets, from one pass of flags."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    s = o.agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("both", F.col("a") & F.col("b")), ("either", F.col("a") | F.col("b")), ("first", F.col("a") & ~F.col("b")))])
    return s.unpivot([], ["both", "either", "first"], "op", "n")


@query("""WITH t AS (SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_custkey) AS least FROM orders GROUP BY 1)
SELECT o_orderstatus, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM t UNION ALL SELECT o_orderstatus, 'total', total FROM t UNION ALL SELECT o_orderstatus, 'least', least FROM t""")
def r36_tall(spark, sf_dir):
    """Metrics of a group as rows (metric, value)."""
    t = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_custkey").cast("double").alias("least"))
    return t.unpivot(["o_orderstatus"], ["n", "total", "least"], "metric", "value")


@query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM orders GROUP BY 1")
def r36_wide(spark, sf_dir):
    """Orders of a customer as a column for each status."""
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.fillna(0).select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def r37_csv_by_city(spark, sf_dir):
    """A table written as CSV, a folder for each region, and read back."""
    path = _scratch(spark, "csv")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.write_csv(n, path, "n_regionkey")
    return spark.read.option("header", True).schema(n.select("n_nationkey", "n_name").schema).csv(path).select("n_nationkey", "n_name", F.col("n_regionkey").cast(dict(n.dtypes)["n_regionkey"]).alias("n_regionkey"))


@query(f"""SELECT n_name, round(sum(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) / count(*), 9) AS share, round(quantile_cont(c_acctbal, 0.9), 6) AS q90 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def r38_figure_inputs(spark, sf_dir):
    """What a bar chart of shares and a map of the top tenth need; drawing is left to others."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 9).alias("share"), F.round(F.percentile("c_acctbal", F.lit(0.9)), 6).alias("q90"))
    return c.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "share", "q90")


@query(f"""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY {stats.draw_sql("7", "c_custkey")}, c_custkey) AS k, count(*) OVER () AS n FROM customer) t WHERE k <= n // 4""")
def r39_sample(spark, sf_dir):
    """A quarter of the customers without replacement, the least draws (the sample is the operator)."""
    c = table(spark, sf_dir, "customer").select("c_custkey").withColumn("r", stats.draw("7", "c_custkey"))
    k = c.count() // 4
    return c.orderBy("r", "c_custkey").limit(k).select("c_custkey")


@query(f"""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY round(-ln(({stats.draw_sql("11", "c_custkey")} + 1) / {stats.PRIME}.0) / (c_custkey % 9 + 1), 9), c_custkey) AS k, count(*) OVER () AS n FROM customer) t WHERE k <= n // 5""")
def r39_weighted_sample(spark, sf_dir):
    """A fifth of the customers without replacement, chances by weight: the least of -ln(u) / w (the sample is the operator)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.round(-F.log((stats.draw("11", "c_custkey") + 1) / float(stats.PRIME)) / F.expr("c_custkey % 9 + 1"), 9).alias("r"))
    k = c.count() // 5
    return c.orderBy("r", "c_custkey").limit(k).select("c_custkey")


_CELLS = "cells AS (SELECT gy * 10 + gx AS cell_id, gx, gy, (gx + 0.5) * 400.0 AS x, (gy + 0.5) * 400.0 AS y FROM (SELECT unnest(range(10)) AS gx) a, (SELECT unnest(range(10)) AS gy) b)"


@query(f"WITH {_CELLS} SELECT cell_id, gx, gy, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM cells")
def r40_cells(spark, sf_dir):
    """Square cells of 400 m with their centroids."""
    return spatial.grid(10, 10, 400.0, 0.0, 0.0, spark)


def _weights(spark, sf_dir):
    cells = spatial.grid(10, 10, 400.0, 0.0, 0.0, spark)
    key = lambda c: F.floor(F.col(c) / 400.0)
    pop = _population(spark, sf_dir).groupBy(key("x").alias("gx"), key("y").alias("gy")).agg(F.sum("value").alias("pop"))
    poi = lattice.places(spark, sf_dir).where("node % 17 = 0").groupBy(key("x").alias("gx"), key("y").alias("gy")).agg(F.count("*").alias("poi"))
    return cells.join(pop, ["gx", "gy"], "left").join(poi, ["gx", "gy"], "left").fillna(0)


_WEIGHTS = f"""WITH {lattice.SQL}, {_CELLS}, r AS ({_RASTER}), v AS (SELECT node, x, y, coalesce(CASE WHEN v = -999.0 THEN 0 ELSE greatest(v, 0) END, 0) AS value FROM spots LEFT JOIN r ON r.row = floor(y / 100) AND r.col = floor(x / 100)),
pop AS (SELECT floor(x / 400) AS gx, floor(y / 400) AS gy, sum(value) AS pop FROM v GROUP BY 1, 2), poi AS (SELECT floor(x / 400) AS gx, floor(y / 400) AS gy, count(*) AS poi FROM spots WHERE node % 17 = 0 GROUP BY 1, 2),
g AS (SELECT cell_id, coalesce(pop, 0) AS pop, coalesce(poi, 0) AS poi FROM cells LEFT JOIN pop USING (gx, gy) LEFT JOIN poi USING (gx, gy))"""


@query(_WEIGHTS + ", w AS (SELECT cell_id, 0.6 * pop / (SELECT max(pop) FROM g) + 0.4 * poi / (SELECT max(poi) FROM g) AS w FROM g) SELECT cell_id, round(w, 9) AS w FROM w WHERE w > 0")
def r41_demand_weights(spark, sf_dir):
    """Cells' weights from population and points of interest, those above 0."""
    return streets.demand_weight(_weights(spark, sf_dir), 0.6).select("cell_id", F.round("w", 9).alias("w"))


@query(_WEIGHTS + " SELECT round(sum(CASE WHEN poi = 0 THEN pop ELSE 0 END) / sum(pop), 9) AS share FROM g")
def r42_population_without_points(spark, sf_dir):
    """Share of the population in cells without a point of interest."""
    return _weights(spark, sf_dir).agg(F.round(weighted.share(F.col("poi") == 0, F.col("pop")), 9).alias("share"))


@query("""SELECT c_mktsegment, count(*) AS n, quantile_cont(c_acctbal, 0.5) AS c_acctbal_median, round(avg(c_acctbal), 6) AS c_acctbal_mean, round(stddev_samp(c_acctbal), 6) AS c_acctbal_sd,
 round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END), 9) AS debt_share FROM customer GROUP BY 1""")
def r44_inventory(spark, sf_dir):
    """Sizes, medians, means with deviations, and flag shares of groups."""
    c = table(spark, sf_dir, "customer").withColumn("debt", F.col("c_acctbal") < 0)
    out = streets.inventory(c, ["c_mktsegment"], ["c_acctbal"], ["debt"])
    return out.withColumn("c_acctbal_mean", F.round("c_acctbal_mean", 6)).withColumn("c_acctbal_sd", F.round("c_acctbal_sd", 6)).withColumn("debt_share", F.round("debt_share", 9))


@query(f"""WITH {lattice.SQL}, near AS (SELECT * FROM (SELECT q.node AS d, p.node AS e, row_number() OVER (PARTITION BY q.node ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.node) AS k FROM spots q, spots p) n WHERE k <= 3),
w AS (SELECT a.d, sqrt(max((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS m FROM near a JOIN near b USING (d) JOIN spots p ON p.node = a.e JOIN spots q ON q.node = b.e WHERE a.d IN (SELECT d FROM zones) GROUP BY a.d)
SELECT count(*) AS n, round(quantile_cont(m, 0.5), 6) AS median, round(max(m), 6) AS greatest FROM w""")
def r45_entry_diameters(spark, sf_dir):
    """How wide the entry sets of three are: median and greatest."""
    sets = stored(spatial.entry_sets(near(spark, sf_dir, 3), 3))
    w = spatial.diameter(sets, lattice.places(spark, sf_dir))
    return w.agg(F.count("*").alias("n"), F.round(F.percentile("diameter", F.lit(0.5)), 6).alias("median"), F.round(F.max("diameter"), 6).alias("greatest"))


@query(f"""WITH {lattice.SQL}, r AS ({_RASTER}), v AS (SELECT node, coalesce(CASE WHEN v = -999.0 THEN 0 ELSE greatest(v, 0) END, 0) AS value FROM spots LEFT JOIN r ON r.row = floor(y / 100) AND r.col = floor(x / 100))
SELECT stratum, round(sum(CASE WHEN d % 3 = 0 THEN w * value ELSE 0 END) / sum(w * value), 9) AS by_population, round(sum(CASE WHEN d % 3 = 0 THEN w ELSE 0 END) / sum(w), 9) AS by_weight FROM zones JOIN v ON node = d GROUP BY 1""")
def r46_reweighted(spark, sf_dir):
    """Shares under other weights, which are joined by the zone's key and never by position."""
    z = lattice.demands(spark, sf_dir).join(_population(spark, sf_dir).select(F.col("node").alias("d"), "value"), "d")
    mask = F.expr("d % 3 = 0")
    return z.groupBy("stratum").agg(F.round(weighted.share(mask, F.expr("w * value")), 9).alias("by_population"), F.round(weighted.share(mask, F.col("w")), 9).alias("by_weight"))


@query(f"""WITH t AS (SELECT c_mktsegment, c_nationkey % 5 AS borough, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS income, c_custkey % 7 + 1.0 AS w, c_custkey % 4 = 0 AS weak FROM customer),
o AS (SELECT c_mktsegment, weak, income, sum(w) OVER (PARTITION BY c_mktsegment, weak ORDER BY income) AS upto, sum(w) OVER (PARTITION BY c_mktsegment, weak) AS whole FROM t WHERE income IS NOT NULL)
SELECT c_mktsegment, weak, min(CASE WHEN upto >= whole / 2 THEN income END) AS median, (SELECT round(max(s) - min(s), 9) FROM (SELECT sum(CASE WHEN weak THEN w ELSE 0 END) / sum(w) AS s FROM t b WHERE b.c_mktsegment = o.c_mktsegment GROUP BY borough) x) AS spread FROM o GROUP BY 1, 2""")
def r47_equity(spark, sf_dir):
    """Weighted median income of the weakly served and the others, and how far boroughs lie apart in the share of the weak."""
    t = table(spark, sf_dir, "customer").select("c_mktsegment", F.expr("c_nationkey % 5").alias("borough"), F.expr("CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END").alias("income"), F.expr("c_custkey % 7 + 1D").alias("w"), F.expr("c_custkey % 4 = 0").alias("weak"))
    m = weighted.median(t, "income", "w", ["c_mktsegment", "weak"]).withColumnRenamed("weighted_median", "median")
    s = t.groupBy("c_mktsegment", "borough").agg(weighted.share(F.col("weak"), F.col("w")).alias("s")).groupBy("c_mktsegment").agg(F.round(F.max("s") - F.min("s"), 9).alias("spread"))
    return m.join(F.broadcast(s), "c_mktsegment")


_POINTS = "SELECT s_suppkey AS q, s_suppkey * 7919 % 3900 + 0.5 AS x, s_suppkey * 104729 % 3700 + 0.5 AS y FROM supplier"


@query(f"""WITH {lattice.SQL}, f AS ({_POINTS}) SELECT q, node FROM (SELECT q, node, row_number() OVER (PARTITION BY q ORDER BY (f.x - s.x) * (f.x - s.x) + (f.y - s.y) * (f.y - s.y), node) AS k FROM f, spots s) t WHERE k = 1""")
def r53_snapped(spark, sf_dir):
    """The node nearest each facility."""
    return _snapped(spark, sf_dir).select("q", "node")


def _snapped(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("q"), F.expr("s_suppkey * 7919 % 3900 + 0.5D").alias("x"), F.expr("s_suppkey * 104729 % 3700 + 0.5D").alias("y"))
    return spatial.nearest(f, lattice.places(spark, sf_dir), 1, 150.0)


@query(f"""WITH {lattice.SQL}, f AS ({_POINTS}) SELECT node, min(q) AS facility, count(*) AS n FROM (SELECT q, node, row_number() OVER (PARTITION BY q ORDER BY (f.x - s.x) * (f.x - s.x) + (f.y - s.y) * (f.y - s.y), node) AS k FROM f, spots s) t WHERE k = 1 GROUP BY node""")
def r48_replaced_access(spark, sf_dir):
    """Access points from facilities: snapped, one a node."""
    return _snapped(spark, sf_dir).groupBy("node").agg(F.min("q").alias("facility"), F.count("*").alias("n"))


@query(f"WITH {lattice.SQL} SELECT u, v, min(w) AS w FROM arcs GROUP BY u, v")
def r49_collapse(spark, sf_dir):
    """The least finite cost of each bundle of parallel arcs."""
    return flow.collapse(lattice.arcs(spark, sf_dir))


_STREETS = """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN '2;3' WHEN 1 THEN '1' WHEN 2 THEN '4|2' WHEN 3 THEN 'two' WHEN 4 THEN NULL WHEN 5 THEN '2, 1.9' ELSE '' END AS lanes,
 CASE p_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'Delivery' WHEN 2 THEN 'yes' END AS access, CASE p_partkey % 11 WHEN 0 THEN 'designated' WHEN 1 THEN 'no' END AS bus,
 CASE p_partkey % 13 WHEN 0 THEN 'footway' ELSE 'residential' END AS highway, CASE p_partkey % 3 WHEN 0 THEN 'x;no_parking' END AS parking, CASE WHEN p_partkey % 4 > 0 THEN p_size / 100.0 - 0.2 END AS grade,
 p_retailprice AS length, CASE WHEN p_partkey % 6 > 0 THEN p_size * 1.0 END AS speed_kph, CASE WHEN p_partkey % 8 = 0 THEN p_size * 2.0 END AS travel_time FROM part"""


def _streets(spark, sf_dir):
    e = {"lanes": "CASE p_partkey % 7 WHEN 0 THEN '2;3' WHEN 1 THEN '1' WHEN 2 THEN '4|2' WHEN 3 THEN 'two' WHEN 4 THEN NULL WHEN 5 THEN '2, 1.9' ELSE '' END",
         "access": "CASE p_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'Delivery' WHEN 2 THEN 'yes' END", "bus": "CASE p_partkey % 11 WHEN 0 THEN 'designated' WHEN 1 THEN 'no' END",
         "highway": "CASE p_partkey % 13 WHEN 0 THEN 'footway' ELSE 'residential' END", "parking": "CASE p_partkey % 3 WHEN 0 THEN 'x;no_parking' END", "grade": "CASE WHEN p_partkey % 4 > 0 THEN p_size / 100D - 0.2D END",
         "length": "p_retailprice", "speed_kph": "CASE WHEN p_partkey % 6 > 0 THEN p_size * 1D END", "travel_time": "CASE WHEN p_partkey % 8 = 0 THEN p_size * 2D END"}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[F.expr(x).alias(n) for n, x in e.items()])


@query(f"SELECT id, CAST(CASE lanes WHEN '2;3' THEN 3 WHEN '1' THEN 1 WHEN '4|2' THEN 4 WHEN '2, 1.9' THEN 2 END AS INTEGER) AS n FROM ({_STREETS}) s")
def r50_lanes(spark, sf_dir):
    """Lanes out of tags with several values."""
    return _streets(spark, sf_dir).select("id", streets.lanes(F.col("lanes")).alias("n"))


_FRICTION = f"""f AS (SELECT id, length, speed_kph, travel_time, 1 - least(coalesce(CASE lanes WHEN '2;3' THEN 3 WHEN '1' THEN 1 WHEN '4|2' THEN 4 WHEN '2, 1.9' THEN 2 END, 2), 3) / 3.0 AS a,
 CASE WHEN lower(access) IN ('no', 'private', 'delivery') THEN 1.0 ELSE 0 END AS b, CASE WHEN bus = 'designated' THEN 1.0 ELSE 0 END AS c, CASE WHEN highway = 'footway' THEN 1.0 ELSE 0 END AS d,
 least(abs(coalesce(grade, 0)), 0.12) / 0.12 AS e, CASE WHEN parking IS NOT NULL THEN 1.0 ELSE 0 END AS g FROM ({_STREETS}) s)"""


@query(f"WITH {_FRICTION} SELECT id, round(CAST(a AS DOUBLE), 9) AS f_lanes_scarcity, CAST(b AS DOUBLE) AS f_restricted_access, CAST(c AS DOUBLE) AS f_bus_only, CAST(d AS DOUBLE) AS f_pedestrian_zone, round(CAST(e AS DOUBLE), 9) AS f_slope, CAST(g AS DOUBLE) AS f_no_stopping FROM f")
def r51_friction(spark, sf_dir):
    """The friction components of segments."""
    f = streets.friction(_streets(spark, sf_dir))
    return f.select("id", *[F.round(f"f_{c}", 9).alias(f"f_{c}") if c in ("lanes_scarcity", "slope") else f"f_{c}" for c in streets.COMPONENTS])


@query(f"""WITH {_FRICTION}, b AS (SELECT *, CAST(coalesce(travel_time, length / (greatest(coalesce(speed_kph, 30.0), 1) * 1000.0 / 3600.0)) AS DOUBLE) AS c_base, CAST(0.2 * a + 0.25 * b + 0.1 * c + 0.15 * d + 0.1 * e + 0.2 * g AS DOUBLE) AS van, CAST(0.05 * a + 0.2 * b + 0.05 * c + 0.05 * d + 0.45 * e + 0.2 * g AS DOUBLE) AS bike FROM f)
SELECT id, round(c_base + 1e-7, 4) AS c_base, round(c_base * (1 + van) + 1e-7, 4) AS c_eff_van, round(c_base * (1 + 0.5 * bike) + 1e-7, 4) AS c_eff_cargo_bike FROM b""")
def r52_costs(spark, sf_dir):
    """Base cost and the effective cost of each vehicle."""
    c = streets.costs(streets.friction(_streets(spark, sf_dir)))
    return c.select("id", *[F.round(F.col(x) + 1e-7, 4).alias(x) for x in ("c_base", "c_eff_van", "c_eff_cargo_bike")])


@query("""WITH p AS (SELECT s_suppkey AS id, s_suppkey * 37 % 360 - 180.0 + 0.25 AS lon, s_suppkey * 17 % 160 - 80.0 AS lat FROM supplier), m AS (SELECT avg(lat) AS lat0 FROM p)
SELECT id, round(lon * cos(radians(lat0)) * 111320.0, 3) AS x, round(CAST(lat AS DOUBLE) * 110540.0, 3) AS y, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS INTEGER) AS epsg FROM p, m""")
def r54_coordinates(spark, sf_dir):
    """Local metres and UTM zones of points."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("s_suppkey * 37 % 360 - 180D + 0.25D").alias("lon"), F.expr("s_suppkey * 17 % 160 - 80D").alias("lat"))
    return spatial.local_metres(p).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), spatial.utm_zone(F.col("lon"), F.col("lat")).alias("epsg"))


@query("""SELECT p_brand, p_type, count(*) AS n, round(avg(p_size), 6) AS x, round(avg(p_retailprice), 6) AS y FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 ORDER BY 1 LIMIT 3) AND p_size IS NOT NULL GROUP BY 1, 2""")
def r55_features(spark, sf_dir):
    """Features of a tag set with the mean of their corners, those without any dropped."""
    p = table(spark, sf_dir, "part").where("p_size IS NOT NULL")
    tags = [r[0] for r in p.select("p_type").distinct().orderBy("p_type").limit(3).collect()]  # the tag set, a parameter of three
    return p.where(F.col("p_type").isin(*tags)).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("x"), F.round(F.avg("p_retailprice"), 6).alias("y"))


@query("SELECT p_brand, round(avg(v), 9) AS mean FROM (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 1.0 END AS v FROM part UNION ALL SELECT p_brand, length(p_name) * 1.0 FROM part) t GROUP BY 1")
def r58_cross_orientation(spark, sf_dir):
    """Mean of two measures of a group, missing ones skipped."""
    p = table(spark, sf_dir, "part")
    a = p.select("p_brand", F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 1D END").alias("v"))
    return a.unionByName(p.select("p_brand", F.expr("length(p_name) * 1D").alias("v"))).groupBy("p_brand").agg(F.round(F.avg("v"), 9).alias("mean"))


@query("""SELECT 'n' AS metric, CAST(count(*) AS DOUBLE) AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, '' AS note FROM orders
UNION ALL SELECT 'price', round(avg(o_totalprice), 4), round(quantile_cont(o_totalprice, 0.025), 4), round(quantile_cont(o_totalprice, 0.975), 4), 'mean, 95 % range' FROM orders""")
def r59_metrics(spark, sf_dir):
    """Metrics collected as rows (metric, value, lo, hi, note), four digits."""
    o = table(spark, sf_dir, "orders")
    row = lambda m, v, lo, hi, note: o.agg(v.alias("value"), lo.alias("lo"), hi.alias("hi")).select(F.lit(m).alias("metric"), *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("value", "lo", "hi")], F.lit(note).alias("note"))
    none, pct = F.max(F.lit(None).cast("double")), lambda q: F.percentile("o_totalprice", F.lit(q))
    return row("n", F.count("*"), none, none, "").unionByName(row("price", F.avg("o_totalprice"), pct(0.025), pct(0.975), "mean, 95 % range"))


@query("""WITH r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)),
a AS (SELECT lang, sum(quality) AS p, count(*) - sum(quality) AS q, sum(quality * r) AS s FROM r GROUP BY lang)
SELECT lang, CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives, CAST((s - p * (p + 1) / 2.0) / nullif(p * q, 0) AS DOUBLE) AS auc FROM a""")
def s1_auc(spark, sf_dir):
    """How well the length of a text ranks its quality label, a language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return weighted.auc(docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), "n_chars", "quality", ["lang"])

