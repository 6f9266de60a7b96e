"""Mixing sources to target weights: entropy balancing, DataFrame functions only.

Document rates r minimise sum(r * ln r - r) under one token constraint a source,
sum(size * r) = target, and r <= most copies. The solution tilts exponentially by size:
r = min(most, exp(a * size / mean size)), one dual variable a for each source, which Newton
iterations find; each sums gradient and curvature over all documents, pre-aggregated to the
different sizes of a source. Rates become whole copies: everyone gets floor(rate), and those
whose hash falls within the rest get one more, the cut being moved a little for each source,
by radix search on (source, digit) sums, so that the words taken come out at the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import dropped, stored

WEIGHTS, SHARE, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2.0
#: Newton stops when each source is within TOLERANCE of its target; more steps than MOST_STEPS are an error.
TOLERANCE, MOST_STEPS = 1e-10, 60
#: Digits of the hash order; DIGIT_BITS * len(range(LEVELS)) bits tell documents of a source apart.
DIGIT_BITS, LEVELS = 10, 4
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target of (source, source_size) rows, one a source.

    Sources by code point (null last) weigh `weights`, repeating; targets stop at most * size
    and the excess is shared anew by weight. The level L with sum(min(most * size, L * weight))
    = share * sum(size) is what repeated resharing ends at. The windows run over one row a source.
    """
    everywhere = Window.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(everywhere) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.expr("cap / w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("k", F.row_number().over(by_ratio))
    rows = rows.withColumn("cut", F.min(F.expr("CASE WHEN level * w <= cap THEN struct(k, level) END")).over(total))
    return rows.select("source", "source_size", F.expr("coalesce(least(cap, cut.level * w), cap)").alias("target"))


#: Sources up to which their rows are broadcast; with more they are joined by sorted keys.
BROADCAST_SOURCES = 500_000


def _side(goal: DataFrame):
    """How tables of a row a source are joined: broadcast behind a check of their number."""
    return F.broadcast if goal.count() <= BROADCAST_SOURCES else lambda df: df.hint("merge")


def _same(a: str = "source", b: str = "s"):
    return F.col(a).eqNullSafe(F.col(b))


def tilts(goal: DataFrame, sizes: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target, mean, a of goal (source, source_size, target): the dual's solution.

    sizes: (source, size, n), the number n of documents of a size. a is null where nothing is
    to be solved: the source has no words (rate 1), or its target needs all of most copies.
    Newton steps that leave the bracket of earlier signs are replaced by its middle.
    """
    side = _side(goal)
    mean = sizes.where("size > 0").groupBy(F.col("source").alias("s")).agg((F.sum(F.expr("size * n")) / F.sum("n")).alias("mean"))
    state = goal.join(side(mean), _same(), "left").drop("s")
    state = state.withColumn("open", F.expr(f"source_size > 0 AND target < source_size * {most}D * (1 - 1e-12)"))
    state = stored(state.withColumn("a", F.expr("CASE WHEN open THEN 0D END")).withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf"))))
    sizes = stored(sizes.where("size > 0"))
    for _ in range(MOST_STEPS):
        rate = F.expr(f"least({most}D, exp(a * size / mean))")
        sums = sizes.join(side(state.where("open").select(F.col("source").alias("s"), "a", "mean")), _same()).withColumn("r", rate)
        sums = sums.groupBy(F.col("s")).agg(F.sum(F.expr("n * size * r")).alias("g"), F.sum(F.expr(f"CASE WHEN r < {most}D THEN n * size * size / mean * r ELSE 0D END")).alias("h"))
        step = state.join(side(sums), _same(), "left").drop("s").withColumn("gap", F.expr("g - target"))
        step = step.withColumn("lo", F.expr("CASE WHEN gap < 0 THEN a ELSE lo END")).withColumn("hi", F.expr("CASE WHEN gap > 0 THEN a ELSE hi END"))
        step = step.withColumn("off", F.expr("coalesce(abs(gap) / target, 0D)")).withColumn("next", F.expr("CASE WHEN h > 0 THEN a - gap / h END"))
        inside = "next > lo AND next < hi AND abs(next - a) < 50"
        middle = "CASE WHEN lo = double('-inf') THEN a - 4 * (1 + abs(a)) WHEN hi = double('inf') THEN a + 4 * (1 + abs(a)) ELSE (lo + hi) / 2 END"
        now = stored(step.withColumn("a", F.expr(f"CASE WHEN NOT open OR off <= {TOLERANCE} THEN a WHEN {inside} THEN next ELSE {middle} END")).select(*state.columns, "off"))
        worst = now.agg(F.max("off").alias("off")).first()["off"]
        dropped(state)
        state = now.drop("off")
        state._strandline_path = now._strandline_path
        if worst is None or worst <= TOLERANCE:
            return state.select("source", "source_size", "target", "mean", "a")
    raise ArithmeticError(f"a source is still {worst:.2g} of its target away after {MOST_STEPS} Newton steps")


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs (doc_id, text, source).

    size counts words (null text: 0); a null source is a source, a null id a value like
    others. Repeated rows of a doc_id and size decide alike. taken = copies * size. Other
    columns are ignored whatever their names. Empty input gives no rows.
    """
    return mixed(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """mix_sources(), with row: a struct of all columns of docs."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
                        F.expr(f"CAST(regexp_count(coalesce(text, ''), r'{WORD}') AS BIGINT)").alias("size"))
    rows = stored(whole.select("doc_id", "source", "size"))
    sizes = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = stored(targets(sizes.groupBy("source").agg(F.sum(F.expr("size * n")).alias("source_size"))))
    side = _side(goal)
    dual = side(tilts(goal, sizes).select(F.col("source").alias("s"), "source_size", "target", "mean", "a"))
    unit = (1 << DIGIT_BITS * LEVELS) // 2  # of the order: half is one copy

    def rated(frame: DataFrame) -> DataFrame:
        out = frame.join(dual, _same()).drop("s")
        most = int(MOST_COPIES)
        out = out.withColumn("rate", F.expr(f"CASE WHEN source_size = 0 THEN 1D WHEN a IS NULL THEN {MOST_COPIES}D ELSE least({MOST_COPIES}D, exp(a * size / mean)) END"))
        out = out.withColumn("whole", F.least(F.floor("rate"), F.lit(most))).withColumn("u", F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), F.lit(unit)))
        # those at the cap can take no more; all others queue by how far their hash lies above their rest
        return out.withColumn("h", F.when((F.col("whole") < most) & (F.col("size") > 0), F.col("u") + unit - F.floor((F.col("rate") - F.col("whole")) * unit)).cast("long"))

    lifted = stored(rated(rows).select("source", "size", "whole", "h"))
    need = lifted.groupBy(F.col("source").alias("s")).agg(F.sum(F.expr("whole * size")).alias("base"))
    state = stored(goal.join(side(need), _same()).select("source", "source_size", "target", F.expr("target - base").alias("need"), F.lit(0).cast("long").alias("prefix"), F.expr("target > base").alias("more")))
    lifted = lifted.where("h IS NOT NULL")
    for level in range(LEVELS):
        shift = DIGIT_BITS * (LEVELS - 1 - level)
        key = F.shiftright(F.col("h"), shift + DIGIT_BITS)
        sums = (lifted.withColumn("top", key).withColumn("digit", F.shiftright(F.col("h"), shift) % (1 << DIGIT_BITS))
                .join(side(state.select(F.col("source").alias("s"), "prefix")), F.col("source").eqNullSafe(F.col("s")) & (F.col("top") == F.col("prefix")))
                .groupBy("source", "digit").agg(F.sum("size").alias("n")))
        run = Window.partitionBy("source").orderBy("digit")
        cum = sums.withColumn("upto", F.sum("n").over(run)).withColumn("below", F.col("upto") - F.col("n"))
        cut = (cum.join(state.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s")))
               .groupBy("source").agg(F.min(F.expr("CASE WHEN upto >= need THEN struct(digit, below, n) END")).alias("hit"),
                                      F.max(F.expr("struct(digit, below, n)")).alias("end"))
               .select(F.col("source").alias("s"), F.coalesce("hit", "end").alias("c")))
        state = stored(state.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "more", F.expr("need - coalesce(c.below, 0)").alias("need"),
            F.expr(f"prefix * {1 << DIGIT_BITS} + coalesce(c.digit, 0)").alias("prefix"), F.expr("c.n").alias("last_n")))
    cut = side(state.select(F.col("source").alias("s"), "prefix", (F.col("need") * 2 >= F.coalesce("last_n", F.lit(0))).alias("inclusive"), "more"))
    out = rated(whole).join(cut, _same())
    extra = F.expr("CASE WHEN more AND h IS NOT NULL AND (h < prefix OR h = prefix AND inclusive) THEN 1 ELSE 0 END")
    return (out.withColumn("copies", F.least(F.col("whole") + extra, F.lit(int(MOST_COPIES))).cast("int"))
            .select("row", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))
