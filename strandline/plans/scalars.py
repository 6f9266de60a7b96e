"""The scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.registry import query
from strandline.session import table


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, CAST(p_name ILIKE '%1%' AS INTEGER) AS has FROM part")
def f_strings(spark, sf_dir):
    """Slugs of names, and whether a mark is in them."""
    return table(spark, sf_dir, "part").select("p_partkey", scalars.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), F.lower("p_name").contains("1").cast("int").alias("has"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS DATE) AS day, CASE WHEN o_orderkey % 7 > 0 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') + 1 END::INTEGER AS days FROM orders")
def f_dates(spark, sf_dir):
    """Dates out of texts, some of them broken, and inclusive spans."""
    text = F.when(F.expr("o_orderkey % 7 = 0"), F.lit("n/a 12-31-99")).otherwise(F.col("o_orderdate").cast("string"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", scalars.day(text).alias("day"))
    return d.withColumn("days", scalars.span_days(F.col("day"), F.lit("2030-01-01").cast("date")))


@query("""SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END AS DOUBLE) AS clipped, round(ln(1 + greatest(c_acctbal, 0)), 9) AS logged, round(sqrt(c_acctbal * c_acctbal + 9), 6) AS far, c_custkey % 5 <> 0 AS finite FROM customer""")
def f_numbers(spark, sf_dir):
    """Clipped, logged and combined numbers, and which are finite."""
    x = F.expr("CASE c_custkey % 10 WHEN 0 THEN double('Infinity') WHEN 5 THEN double('NaN') ELSE c_acctbal END")
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.clip(b, 0.0, 5000.0).alias("clipped"), F.round(F.log1p(F.greatest(b, F.lit(0.0))), 9).alias("logged"), F.round(F.sqrt(b * b + 9), 6).alias("far"), scalars.finite(x).alias("finite"))


@query("SELECT o_custkey, string_agg(o_orderkey || '|' || o_custkey, ';' ORDER BY o_orderkey) AS text, count(*)::INTEGER AS n, min(o_orderkey) AS least FROM orders GROUP BY o_custkey")
def f_edge_codec(spark, sf_dir):
    """Lists of pairs as one text, and read back from it."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("v")))).alias("e"))
    t = o.select("o_custkey", scalars.join_edges(F.col("e")).alias("text"))
    back = scalars.split_edges(F.concat("text", F.lit(";broken")))
    return t.select("o_custkey", "text", F.size(back).alias("n"), F.array_min(F.transform(back, lambda e: e["u"])).alias("least"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.absent'), '1.0') AS absent FROM events")
def f_json(spark, sf_dir):
    """Values of JSON texts, with defaults."""
    return table(spark, sf_dir, "events").select("event_id", scalars.lookup(F.col("props"), "$.k", "none").alias("k"), scalars.lookup(F.col("props"), "$.absent", "1.0").alias("absent"))


@query("""SELECT p_partkey, CAST(bit_count(p_partkey) AS INTEGER) AS ones, array_to_string(list_filter(['a', 'b', 'c', 'd', 'e'], lambda x, i: (p_partkey >> (i - 1)) & 1 = 1), '') AS members FROM part""")
def f_bits(spark, sf_dir):
    """Subsets by bit mask: their size and members."""
    items = F.array(*[F.lit(x) for x in "abcde"])
    return table(spark, sf_dir, "part").select("p_partkey", F.bit_count("p_partkey").alias("ones"), F.array_join(scalars.subset(F.col("p_partkey"), items), "").alias("members"))


@query("SELECT c_nationkey, '[' || printf('%.3f', min(c_acctbal)) || ',' || printf('%.3f', max(c_acctbal)) || ']' AS range, 'nation ' || c_nationkey || ' & ' || count(*) || ' \\\\' AS row FROM customer GROUP BY 1")
def f_formats(spark, sf_dir):
    """Intervals and table rows as texts, for sinks only."""
    t = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("*").alias("n"))
    return t.select("c_nationkey", scalars.interval_text(F.col("lo"), F.col("hi")).alias("range"), scalars.table_row([F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.col("n").cast("string")]).alias("row"))
