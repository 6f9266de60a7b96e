"""Weighted shares, medians and tie-averaged ranks as DataFrame plans.

Groups are summed a distinct value first. What is left is ordered in ranges: each range has
its own running sum, and ranges are told the sum of those before, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import stored


def share(mask: Column, w: Column) -> Column:
    """Weight of the rows where mask holds over the weight of all; null without weight."""
    return F.sum(F.when(mask, w).otherwise(0.0)) / F.nullif(F.sum(w), F.lit(0.0))


def agrees(x: Column, given: Column, digits: Column) -> Column:
    """Whether x rounds to the value given to so many digits."""
    return F.abs(x - given) <= F.lit(0.5) * F.pow(F.lit(10.0), -digits) + 1e-9


def running(df: DataFrame, by: list[str], order: str, sums: list[str], ranges: int | None = None) -> DataFrame:
    """df with upto_<c> for each c of sums: the running sum within by, in the order of `order` (distinct within by).

    Rows are sorted by (by, order) into ranges, as many as the session has shuffle partitions;
    windows run within a range, and totals of (by, range) give the offsets, so a group may be
    larger than a task.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, as bounds are sampled anew wherever a range exchange is planned again
    spread = stored(df.repartitionByRange(ranges, *by, order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = spread.select("*", *[F.sum(c).over(within).alias(f"_in_{c}") for c in sums])
    totals = spread.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *by, *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums])
    keyed = offsets.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by_{c}") for c in by], *[f"_off_{c}" for c in sums])
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = local.join(keyed, on)
    return out.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"upto_{c}") for c in sums])


def median(df: DataFrame, value: str, w: str, by: list[str]) -> DataFrame:
    """by, weighted_median: the first value whose running weight reaches half of all; nulls and NaN are left out."""
    sums = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.sum(w).alias("w"))
    whole = sums.groupBy(*by).agg(F.sum("w").alias("whole"))
    named = whole.select(*[F.col(c).alias(f"_w_{c}") for c in by], "whole")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return running(sums, by, value, ["w"]).join(named, on).where("upto_w >= whole / 2").groupBy(*by).agg(F.min(value).alias("weighted_median"))


def auc(df: DataFrame, score: str, label: str, by: list[str], times: str | None = None) -> DataFrame:
    """by, positives, negatives, auc of a 0/1 label by tie-averaged ranks; null with one class only.

    times: a column that says how often a row counts.
    """
    k = F.col(times) if times else F.lit(1)
    tied = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label) * k).alias("p"), F.sum(k).cast("long").alias("n"))
    ranked = running(tied, by, score, ["n"]).withColumn("r", F.col("upto_n") - (F.col("n") - 1) / 2.0)
    out = ranked.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"), F.sum(F.expr("p * r")).alias("s"))
    return out.select(*by, "positives", "negatives", F.expr("(s - positives * (positives + 1) / 2) / nullif(positives * negatives, 0)").alias("auc"))
