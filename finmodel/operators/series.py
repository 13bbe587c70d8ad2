"""Series as long rows (entity, t, value): measures as grouped aggregates and windows, and the way to and from arrays.

Grouped forms combine map-side where the measure allows it. Those that need an order (drawdown, lags) are windows over one
entity, whose length is a number of periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import _root


def collect_series(df: DataFrame, by: list[str], t: str, value: str, name: str = "series", **more: str) -> DataFrame:
    """One array per entity, in the order of ``t``; ``more`` names further columns and their arrays, from the same aggregate."""
    columns = {name: value} | more
    rows = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns.values())])))
    arrays = df.groupBy(*by).agg(rows.alias("rows__"))
    return arrays.select(*by, *[F.expr(f"transform(rows__, s -> s.v{k})").alias(n) for k, n in enumerate(columns)])


def explode_series(df: DataFrame, name: str, t: str = "t", value: str = "value") -> DataFrame:
    """The other way: ``t`` counts from 0."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.posexplode(name).alias(t, value))


def npv(df: DataFrame, by: list[str], t: str, value: str, rate: float | Column, name: str = "npv") -> DataFrame:
    """Sum of value / (1 + rate) ^ t, combined map-side."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return df.groupBy(*by).agg(F.sum(F.col(value) / F.pow(F.lit(1.0) + r, F.col(t))).alias(name))


def irr(df: DataFrame, by: list[str], t: str, value: str, name: str = "irr", years: str | None = None) -> DataFrame:
    """Internal rate of return per entity; with ``years`` at those offsets instead of 0, 1, 2 ..."""
    if years is None:
        return collect_series(df, by, t, value, "flows__").select(*by, F.expr(_root("flows__", None)).alias(name))
    both = collect_series(df, by, t, value, "flows__", years__=years)
    return both.select(*by, F.expr(_root("flows__", "years__")).alias(name))


def variance(df: DataFrame, by: list[str], value: str, name: str = "variance") -> DataFrame:
    return df.groupBy(*by).agg(F.var_pop(value).alias(name))


def volatility(df: DataFrame, by: list[str], value: str, name: str = "volatility") -> DataFrame:
    return df.groupBy(*by).agg(F.stddev_pop(value).alias(name))


def value_at_risk(df: DataFrame, by: list[str], value: str, level: float = 0.95, name: str = "var") -> DataFrame:
    """Minus the exact quantile at 1 - level. Memory of a group follows its number of distinct values."""
    return df.groupBy(*by).agg((-F.percentile(value, F.lit(1.0 - level))).alias(name))


def expected_shortfall(df: DataFrame, by: list[str], value: str, level: float = 0.95, name: str = "cvar") -> DataFrame:
    """Minus the mean of the values up to the quantile at 1 - level.

    Equal values are counted first (combined map-side), then a running count tells which lie below: one read of ``df``, and a window
    that sorts and spills instead of a group held in memory.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v__")).agg(F.count("*").alias("c__"))
    group = Window.partitionBy(*by)
    placed = counts.select(*by, "v__", "c__", F.sum("c__").over(group.orderBy("v__")).alias("upto__"), F.sum("c__").over(group).alias("n__"))
    low = placed.where(F.expr(f"upto__ - c__ <= floor((n__ - 1) * {1.0 - level!r}D)"))
    return low.groupBy(*by).agg((-F.sum(F.col("v__") * F.col("c__")) / F.sum("c__")).alias(name))


def drawdown(df: DataFrame, by: list[str], t: str, value: str, name: str = "drawdown") -> DataFrame:
    """The largest fall from a running maximum, as a share of it."""
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max(value).over(w)
    fall = df.select(*by, F.coalesce(F.try_divide(top - F.col(value), top), F.lit(0.0)).alias("fall__"))
    return fall.groupBy(*by).agg(F.max("fall__").alias(name))


def period_change(df: DataFrame, by: list[str], t: str, value: str, name: str = "change", relative: bool = False) -> DataFrame:
    """Difference (or share) against the previous period; null in the first."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(t))
    diff = F.col(value) - before
    got = F.when(before.isNotNull(), F.coalesce(F.try_divide(diff, before), F.lit(float("nan")))) if relative else diff
    return df.withColumn(name, got)


def consolidate(df: DataFrame, levels: list[str], value: str, name: str = "total") -> DataFrame:
    """Totals at every level of a hierarchy, from the grand total (all nulls) down."""
    return df.rollup(*levels).agg(F.sum(value).alias(name), F.grouping_id().cast("long").alias("level"))
