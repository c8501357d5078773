"""Scores and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """A share; 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(a: Column, b: Column) -> Column:
    """Harmonic mean; 0 unless both are positive."""
    return F.when((a > 0) & (b > 0), 2 * a * b / (a + b)).otherwise(F.lit(0.0))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values; null for an empty array."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(values) / 2).cast("int"))


def rule_score(members: Column, variants: Column, files: Column, sizes: Column, meaningful: Column) -> Column:
    """Support, variety, spread and size of a cluster as points out of a hundred."""
    points = F.least(F.lit(25.0), 10 * F.log2(F.greatest(members, F.lit(1))))
    points = points + F.least(F.lit(20.0), 8 * F.log2(F.greatest(variants, F.lit(1))))
    points = points + F.when(files >= 2, 20.0).otherwise(5.0) + F.least(F.lit(20.0), F.coalesce(upper_median(sizes) / 2.0, F.lit(0.0)))
    return F.least(F.lit(100.0), points + F.when(meaningful, 15.0).otherwise(0.0))


def percentiles(column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> list[Column]:
    """Exact percentiles with linear interpolation, rounded to six decimals and named ``p25`` and so on."""
    return [F.round(F.expr(f"percentile({column}, {s})"), 6).alias(f"p{round(s * 100)}") for s in shares]
