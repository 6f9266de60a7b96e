"""The driver's tables as a street graph: arcs, weighted demands, access nodes and coordinates.

Nodes are customer keys on a grid WIDE columns wide; pairs are removed and made one-way by
integer arithmetic, so the same graph can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import table

WIDE, REMOVED = 40, 18

#: CTEs c (a), arcs (u, v, w), goals (node), zones (d, stratum, w), spots (node, x, y).
SQL = f"""c AS (SELECT c_custkey AS a FROM customer),
pairs AS (SELECT a, b FROM (SELECT a, a + 1 AS b FROM c WHERE a % {WIDE} < {WIDE - 1} UNION ALL SELECT a, a + {WIDE} FROM c) p
  WHERE b IN (SELECT a FROM c) AND (a * 7919 + b * 104729) % 100 >= {REMOVED}),
ways AS (SELECT a, b, CASE WHEN (a * 31 + b * 17) % 10 >= 3 THEN 2 ELSE (a * 13 + b * 7) % 2 END AS way, CAST(50 + (a * 37 + b * 11) % 100 AS DOUBLE) AS w FROM pairs),
arcs AS (SELECT a AS u, b AS v, w FROM ways WHERE way <> 1 UNION ALL SELECT b, a, w FROM ways WHERE way <> 0),
goals AS (SELECT DISTINCT (s_suppkey * 37 + 11) % (SELECT count(*) FROM customer) AS node FROM supplier),
zones AS (SELECT o_custkey AS d, o_orderpriority AS stratum, CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY 1, 2),
spots AS (SELECT a AS node, CAST(100 * (a % {WIDE}) + (a * 37) % 41 AS DOUBLE) AS x, CAST(100 * (a // {WIDE}) + (a * 53) % 43 AS DOUBLE) AS y FROM c)"""


def arcs(spark: SparkSession, sf_dir: str, removed: int = REMOVED) -> DataFrame:
    """u, v, w of each directed arc between grid neighbours."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    east = c.where((F.col("a") % WIDE) < WIDE - 1).withColumn("b", F.col("a") + 1)
    south = c.withColumn("b", F.col("a") + WIDE)
    pairs = east.unionByName(south).join(c.select(F.col("a").alias("b")), "b", "left_semi")
    pairs = pairs.where(F.expr(f"(a * 7919 + b * 104729) % 100 >= {removed}"))
    both = pairs.withColumn("way", F.expr("CASE WHEN (a * 31 + b * 17) % 10 >= 3 THEN 2 ELSE (a * 13 + b * 7) % 2 END"))
    length = F.expr("cast(50 + (a * 37 + b * 11) % 100 AS double)").alias("w")
    return (both.where("way <> 1").select(F.col("a").alias("u"), F.col("b").alias("v"), length)
            .unionByName(both.where("way <> 0").select(F.col("b").alias("u"), F.col("a").alias("v"), length)))


def demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d (node), stratum, w: one zone a node and order priority, weighing its orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("d"), F.col("o_orderpriority").alias("stratum")).agg(F.count("*").cast("double").alias("w"))


def access(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """node of each service point: the suppliers (those of which, an SQL condition), snapped."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").where(which)
    return s.crossJoin(F.broadcast(n)).select(F.expr("(s_suppkey * 37 + 11) % n").alias("node")).distinct()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x, y in metres."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.expr(f"cast(100 * (c_custkey % {WIDE}) + (c_custkey * 37) % 41 AS double)").alias("x"),
                                                   F.expr(f"cast(100 * (c_custkey div {WIDE}) + (c_custkey * 53) % 43 AS double)").alias("y"))
