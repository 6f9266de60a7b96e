"""Connected components of a link table by alternating star contractions.

Links never reach the driver; each round is two aggregations and joins whose result is
written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import dropped, stored

#: Star contractions end in O(log^2 n) rounds; past so many the links are wrong, not merely many.
MOST_ROUNDS = 200


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (u, v): large re-links greater neighbours, small the rest."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least.hint("merge"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, component_id) for each node that has a link to another; the id is the least node.

    links: (u, v) of one ordered type, any direction, repeats and loops allowed. Rows with a
    null end are no links. Contractions go on until every link is one of a star around its
    least node; ArithmeticError is raised if that takes more than `rounds`.
    """
    now = stored(links.where("u <> v").select("u", "v").distinct())
    for _ in range(rounds):
        # a star forest: each greater end has one centre, and no centre is another's greater end
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("n"), (F.col("u") < F.col("v")).cast("int").alias("c"))
        ends = ends.unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("c")).distinct())
        if ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("c").alias("c")).where("n > 1 or n = 1 and c = 1").isEmpty():
            break
        nxt = stored(_star(_star(now, True), False))
        dropped(now)
        now = nxt
    else:
        raise ArithmeticError(f"links are not contracted after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )
