"""Scalar functions of the data model: texts, dates, numbers, arrays, maps, bits and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 joined by '_', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def day(text: Column) -> Column:
    """The date of an ISO text's first ten characters; null if they are none."""
    return F.substr(text, F.lit(1), F.lit(10)).try_cast("date")


def span_days(start: Column, stop: Column) -> Column:
    """Days from start to stop, both counted."""
    return F.date_diff(stop, start) + 1


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within lo and hi; a null stays."""
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def finite(x: Column) -> Column:
    """Whether a number is there and neither infinite nor NaN."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def join_edges(edges: Column) -> Column:
    """'u|v;u|v' of an array of (u, v)."""
    return F.array_join(F.transform(edges, lambda e: F.concat_ws("|", e["u"], e["v"])), ";")


def split_edges(text: Column) -> Column:
    """The array of (u, v) of join_edges(); an empty text gives an empty array, broken pairs are left out."""
    pairs = F.transform(F.filter(F.split(text, ";"), lambda p: p.rlike(r"^-?\d+\|-?\d+$")), lambda p: F.split(p, r"\|"))
    return F.transform(pairs, lambda p: F.struct(p[0].cast("bigint").alias("u"), p[1].cast("bigint").alias("v")))


def lookup(json: Column, path: str, default: str) -> Column:
    """A value of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(json, path), F.lit(default))


def subset(bits: Column, items: Column) -> Column:
    """The items of an array whose bit is set, and in what order they stood."""
    return F.filter(items, lambda x, i: F.call_function("shiftright", bits, i) % 2 == 1)


def interval_text(lo: Column, hi: Column, digits: int = 3) -> Column:
    """'[lo,hi]' for a sink; an undefined end is 'nan'."""
    one = lambda x: F.coalesce(F.format_string(f"%.{digits}f", x), F.lit("nan"))
    return F.concat(F.lit("["), one(lo), F.lit(","), one(hi), F.lit("]"))


def table_row(cells: list[Column]) -> Column:
    """A line of a LaTeX table."""
    return F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\"))


def rounded(x: Column, digits: int) -> Column:
    """x, a double, rounded as DuckDB does: x times 10^digits to the nearest integer, halves away from zero; F.round() goes by the decimals that x is printed with."""
    m = x * F.lit(10.0**digits)
    size = F.abs(m)
    whole = F.floor(size).cast("double")
    near = F.when(size < 2.0**52, F.when(size - whole >= 0.5, whole + 1).otherwise(whole) * F.when(m < 0, F.lit(-1.0)).otherwise(1.0)).otherwise(m) / F.lit(10.0**digits)
    return F.when(F.isnan(near) | (F.abs(near) == float("inf")), x).otherwise(near)
