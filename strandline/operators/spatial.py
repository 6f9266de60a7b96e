"""Nearest neighbours, radius joins, point in polygon and grids, by equi-joins on grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import stored

#: Metres a degree of latitude, and of longitude at the equator, on the local plane.
LAT_M, LON_M = 110540.0, 111320.0


def local_metres(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with x, y: metres on a plane that fits the mean latitude of all points."""
    lat0 = points.agg(F.avg(lat).alias("_lat0"))
    return points.join(F.broadcast(lat0)).withColumn("x", F.col(lon) * F.cos(F.radians("_lat0")) * LON_M).withColumn("y", F.col(lat) * LAT_M).drop("_lat0")


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the point's UTM zone on WGS84."""
    zone = F.least(F.greatest(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def _celled(df: DataFrame, cell: float) -> DataFrame:
    return df.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))


def _around(df: DataFrame, ring: int) -> DataFrame:
    """A row for each cell within `ring` cells of a row's own."""
    step = F.sequence(F.lit(-ring), F.lit(ring))
    return df.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")


def _squared(ax: str, ay: str, bx: str, by: str) -> Column:
    return (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by))


def radius_join(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """q, node, d2 of all points (node, x, y) within `radius` of queries (q, x, y), the edge included."""
    q = _around(_celled(queries.select("q", F.col("x").alias("x"), F.col("y").alias("y")), radius), 1).withColumnRenamed("x", "qx").withColumnRenamed("y", "qy")
    p = _celled(points.select("node", "x", "y"), radius)
    return q.join(p, ["cx", "cy"]).withColumn("d2", _squared("qx", "qy", "x", "y")).where(F.col("d2") <= radius * radius).select("q", "node", "d2")


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: float) -> DataFrame:
    """q, node, d2, k: the k nearest points (node, x, y) of each query (q, x, y), ties to the smaller node.

    Rings of cells around a query grow by doubling until its k-th point is nearer than what a
    ring may miss; each round joins the queries still open. Null coordinates take no part.
    """
    points = stored(points.where("x IS NOT NULL AND y IS NOT NULL").select("node", "x", "y"))
    open_ = stored(queries.where("x IS NOT NULL AND y IS NOT NULL").select("q", "x", "y").distinct())
    box = points.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    far = open_.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not box["n"] or far[0] is None:
        return open_.select("q", F.lit(None).cast(dict(points.dtypes)["node"]).alias("node"), F.lit(0.0).alias("d2"), F.lit(0).alias("k")).limit(0)
    span = max(max(box[2], far[1]) - min(box[1], far[0]), max(box[4], far[3]) - min(box[3], far[2]))
    want, ring, done = min(k, box["n"]), 1, []
    first = Window.partitionBy("q").orderBy("d2", "node")
    while True:
        width = cell * ring
        reach = stored(radius_join(open_, points, width).withColumn("k", F.row_number().over(first)).where(F.col("k") <= k))
        full = reach.groupBy("q").agg(F.max("k").alias("most")).where(F.col("most") >= want).select("q")
        done.append(reach.join(full, "q", "left_semi"))
        open_ = stored(open_.join(full, "q", "left_anti"))
        if open_.isEmpty():
            break
        if width > span * 2:
            raise ArithmeticError("a query found fewer points than there are")
        ring *= 2
    return reduce(DataFrame.unionByName, done)


def entry_sets(near: DataFrame, k: int) -> DataFrame:
    """d, entry: the query node itself and its k nearest nodes, of nearest() with q as a node."""
    near = near.where(F.col("k") <= k)
    return near.groupBy(F.col("q").alias("d")).agg(F.array_sort(F.array_distinct(F.concat(F.array(F.col("q")), F.collect_list("node")))).alias("entry"))


def diameter(sets: DataFrame, places: DataFrame) -> DataFrame:
    """d, diameter: the greatest distance between two members of each entry set (d, entry); 0 for one member."""
    at = sets.select("d", F.explode("entry").alias("node")).join(places, "node")
    a, b = at.select("d", F.col("node").alias("n1"), F.col("x").alias("x1"), F.col("y").alias("y1")), at.select("d", F.col("node").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, "d").where("n1 <= n2").groupBy("d").agg(F.sqrt(F.max(_squared("x1", "y1", "x2", "y2"))).alias("diameter"))


def grid(width: int, height: int, cell: float, x0: float, y0: float, spark) -> DataFrame:
    """cell_id, gx, gy and the centroid x, y of each square cell of a box."""
    rows = spark.range(width).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("gy"))
    return rows.select((F.col("gy") * width + F.col("gx")).alias("cell_id"), "gx", "gy", (x0 + (F.col("gx") + 0.5) * cell).alias("x"), (y0 + (F.col("gy") + 0.5) * cell).alias("y"))


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring (array of struct x, y; the last point joins the first), by crossings of a ray."""
    n = F.size(ring)
    crossings = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _crosses(x, y, F.get(ring, i), F.get(ring, (i + 1) % n)))
    return F.aggregate(crossings, F.lit(0), lambda a, c: a + c) % 2 == 1


def _crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    level = (a["y"] > y) != (b["y"] > y)
    at = a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])
    return F.when(level & (x < at), 1).otherwise(0)


def polygon_join(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """points (id, x, y) with the least poly of polygons (poly, ring) that holds each, null if none.

    Polygons are spread over the cells of their boxes, points look into their own cell only.
    """
    edge = lambda f, c: f(F.transform("ring", lambda p: F.floor(p[c] / cell)))
    spread = polygons.withColumn("cx", F.explode(F.sequence(edge(F.array_min, "x"), edge(F.array_max, "x")))).withColumn("cy", F.explode(F.sequence(edge(F.array_min, "y"), edge(F.array_max, "y"))))
    hits = _celled(points, cell).join(spread, ["cx", "cy"]).where(in_polygon(F.col("x"), F.col("y"), F.col("ring")))
    found = hits.groupBy("id").agg(F.min("poly").alias("poly"))
    return points.join(found, "id", "left")
