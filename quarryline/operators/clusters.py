"""Centres of clusters, and the choice among clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quarryline.functions.scores import ratio


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; 1 where a side is zero or null."""
    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def medoids(members: DataFrame, by: str, member: str, vector: str, width: int = 64) -> DataFrame:
    """The member nearest the mean vector of each cluster: ``by, size, medoid, far``.

    Distances are compared to six decimals, ties go to the smaller member.  The
    mean of the ``width`` components is taken with partial sums, a row a vector, so a
    cluster of any size never meets in one task.  Null vectors take no part.
    """
    rows = members.where(F.col(vector).isNotNull()).select(by, member, vector)
    means = rows.groupBy(by).agg(*[F.avg(F.get(F.col(vector), F.lit(d)).cast("double")).alias(f"_m{d}") for d in range(width)])
    centres = means.select(by, F.array_compact(F.array(*[f"_m{d}" for d in range(width)])).alias("_centre"))
    far = rows.join(centres, by).select(by, member, F.round(cosine_distance(F.col(vector), F.col("_centre")), 6).alias("far"))
    best = far.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("far", member)).alias("_b"))
    return best.select(by, "size", F.col(f"_b.{member}").alias("medoid"), F.col("_b.far").alias("far"))


def choose(candidates: DataFrame, by: list[str]) -> DataFrame:
    """For each group the clustering with the best balance of recurrence, coverage and even size.

    Needs ``total, members, largest, cross_file`` and ``rank``, which decides ties.
    Candidates pass the strictest of three gates that any of the group passes:
    coverage and the share of the largest cluster within ever wider bounds.
    """
    coverage, largest = ratio(F.col("members"), F.col("total")), ratio(F.col("largest"), F.col("total"))
    floor = F.least(F.lit(0.5), 5.0 / F.greatest(F.col("total"), F.lit(1)))
    limit = lambda base: largest <= F.greatest(F.lit(base), floor)
    gate = F.when(coverage.between(0.5, 0.8) & limit(0.15), 0).when(coverage.between(0.4, 0.85) & limit(0.20), 1).when(limit(0.25), 2).otherwise(3)
    group = Window.partitionBy(*by)
    pool = candidates.withColumn("gate", gate).withColumn("_best", F.min("gate").over(group)).where("gate = _best")
    zero = F.lit(0.0)
    balance = 0.5 * F.greatest(zero, 1 - F.abs(coverage - 0.65) / 0.15) + 0.5 * F.greatest(zero, 1 - largest / 0.15)
    score = F.round(0.60 * ratio(F.col("cross_file"), F.max("cross_file").over(group)) + 0.40 * balance, 6)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "rank")
    return pool.withColumn("score", score).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_best")
