"""Ranks, tiers, chunks and trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def average_rank(by: list[str], value: str) -> Column:
    """Percentile of the average rank, 0 to 1; ties share theirs, a single row has 0."""
    order = Window.partitionBy(*by).orderBy(value)
    ties, all_ = F.count(F.lit(1)).over(Window.partitionBy(*by, value)), F.count(F.lit(1)).over(Window.partitionBy(*by))
    return (F.rank().over(order) - 1 + (ties - 1) / 2) / F.greatest(all_ - 1, F.lit(1))


def tier(by: list[str], order: list[Column], tiers: int = 3) -> Column:
    """Near-equal tiers from 0 in the given total order."""
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.least(F.floor(position * tiers / size), F.lit(tiers - 1)).cast("int")


def last_rows(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The last ``keep`` rows of each group; Spark limits each partition before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def budget_chunks(sizes: Column, budget: int) -> Column:
    """Sizes of the chunks that a sequence falls into: a chunk ends before the unit that would exceed ``budget``.

    A unit counts at least one; a unit above the budget stands alone; an empty
    array has no chunks.
    """
    unit = F.transform(sizes, lambda s: F.greatest(s, F.lit(1)).cast("int"))
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("open"))
    step = lambda acc, s: F.when((acc["open"] > 0) & (acc["open"] + s > budget), F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open"))).otherwise(
        F.struct(acc["done"].alias("done"), (acc["open"] + s).alias("open"))
    )
    finish = lambda acc: F.when(acc["open"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(unit, start, step, finish)


def non_overlapping(candidates: Column, most: int, overlap: float) -> Column:
    """Greedy choice from an ordered array of structs with ``start`` and ``end``.

    A candidate is skipped if it shares ``overlap`` of the shorter range with one
    already chosen; at most ``most`` are chosen.
    """
    shared = lambda a, b: F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))
    shorter = lambda a, b: F.greatest(F.least(a["end"] - a["start"], b["end"] - b["start"]), F.lit(1))
    step = lambda acc, c: F.when((F.size(acc) >= most) | F.exists(acc, lambda a: shared(a, c) / shorter(a, c) >= overlap), acc).otherwise(F.concat(acc, F.array(c)))
    return F.aggregate(candidates, F.slice(candidates, 1, 0), step)


def opening_and_last(df: DataFrame, by: list[str], order: list[str], keep: int) -> DataFrame:
    """The first row of each group as ``opening`` and the last ``keep`` others, in a total order.

    Spark limits each partition to the rows that can be among them before the
    shuffle, so a group of any size costs a few rows a task.
    """
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    last = lambda *more: F.row_number().over(Window.partitionBy(*by, *more).orderBy(*[F.desc(c) for c in order]))
    ends = df.withColumn("_n", first).where(F.col("_n") == 1).union(df.withColumn("_n", last()).where(F.col("_n") <= keep + 1))
    few = ends.drop("_n").dropDuplicates([*by, *order]).withColumn("opening", first == 1)
    return few.withColumn("_n", last("opening")).where(F.col("opening") | (F.col("_n") <= keep)).drop("_n")
