"""Byte ranges: overlap, containment, union and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def overlapping(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``left`` (``start``, ``end``) that overlap some row of ``right`` in the same group."""
    r = right.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"))
    return left.join(r, [*[left[c] == r[c] for c in by], left["start"] < r["_e"], r["_s"] < left["end"]], "left_semi")


def not_contained(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``left`` that lie inside no row of ``right`` of the same group."""
    r = right.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"))
    return left.join(r, [*[left[c] == r[c] for c in by], r["_s"] <= left["start"], left["end"] <= r["_e"]], "left_anti")


def merged(ranges: DataFrame, by: list[str]) -> DataFrame:
    """The union of ranges as disjoint ``start``, ``end``; empty and null ranges vanish, touching ones join."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where("start < end").withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def runs(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Maximal runs of consecutive values of ``index``: ``first, last``.  Repeated values count once."""
    order = Window.partitionBy(*by).orderBy(index)
    marked = df.select(*by, index).distinct().withColumn("_run", F.col(index) - F.row_number().over(order))
    return marked.groupBy(*by, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_run")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, since: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` at or before it, null if there is none.

    Both sides go through one sort of their union, so a key of any number of rows
    costs no product of its rows.  At equal times the right side comes first; of
    several right rows at one time the largest value wins.  Null keys and times match nothing.
    """
    columns = left.columns
    tagged = left.select(*columns, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    facts = right.where(F.col(by).isNotNull() & F.col(since).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(since).alias("_t")).agg(F.max(value).alias("_v"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != by else F.col("_by").alias(by) for f in left.schema]
    both = tagged.unionByName(facts.select(*nulls, "_t", F.lit(0).alias("_side"), "_v"))
    order = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    known = F.col(by).isNotNull() & F.col(at).isNotNull()
    return found.select(*columns, F.when(known, F.col("_found")).alias(value))
