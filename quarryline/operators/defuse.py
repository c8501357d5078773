"""Definitions and uses of names among the statements of a function."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quarryline.functions.patterns import KEYWORDS

#: Names that a statement assigns or steps, and those that a declaration declares.
ASSIGNED = r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:(?:[-+*/%|&^]|<<|>>)?=(?:[^=]|$)|\+\+|--)"
STEPPED = r"(?:\+\+|--)\s*([A-Za-z_][A-Za-z0-9_]*)"
DECLARED = r"[A-Za-z0-9_>*&]\s+[*&]*([A-Za-z_][A-Za-z0-9_]*)\s*(?:[;,(\[{]|$)"
#: What makes a defined name one that is used as well.
UPDATED = r"[-+*/%|&^]=|<<=|>>=|\+\+|--"
NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def facts(statements: DataFrame) -> DataFrame:
    """One row for each statement and name: ``symbol, defines, uses``, from ``file_id, func_idx, node_idx, kind, code_snippet``.

    A name is defined where it is assigned, stepped up or down, or declared by a
    node of kind ``declaration``.  A null kind is no declaration; a null code has no names.
    """
    by = ["file_id", "func_idx", "node_idx"]
    found = lambda pattern: F.regexp_extract_all("code_snippet", F.lit(pattern), 1)
    none = F.array().cast("array<string>")
    defined = F.concat(found(ASSIGNED), found(STEPPED), F.when(F.col("kind") == "declaration", found(DECLARED)).otherwise(none))
    rows = statements.where("code_snippet is not null").select(*by, F.array_distinct(defined).alias("d"), F.regexp_extract_all("code_snippet", F.lit(NAME), 0).alias("names"), "code_snippet")
    # a name counts as used if it occurs besides the one place that defines it, or where an operator updates it
    each = rows.select(*by, "d", F.col("code_snippet").rlike(UPDATED).alias("updated"), F.explode("names").alias("symbol")).where(~F.col("symbol").isin(KEYWORDS))
    each = each.withColumn("defines", F.array_contains("d", F.col("symbol")))
    grouped = each.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("n"), F.bool_or("defines").alias("defines"), F.bool_or("updated").alias("updated"))
    return grouped.select(*by, "symbol", "defines", (~F.col("defines") | (F.col("n") > 1) | F.col("updated")).alias("uses"))


def edges(rows: DataFrame) -> DataFrame:
    """``source, target, symbol``: each use with the latest earlier definition of its name in the function."""
    before = Window.partitionBy("file_id", "func_idx", "symbol").orderBy("node_idx").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("defines"), F.col("node_idx")), ignorenulls=True).over(before)
    found = rows.withColumn("source", latest).where("uses and source is not null")
    return found.select("file_id", "func_idx", "source", F.col("node_idx").alias("target"), "symbol")


def closure(links: DataFrame) -> DataFrame:
    """Statements within two steps back and one step forward of each anchor: ``anchor, node_idx``, the anchor among them."""
    by = ["file_id", "func_idx"]
    steps = links.select(*by, "source", "target").distinct()
    nodes = steps.select(*by, F.col("source").alias("anchor")).union(steps.select(*by, F.col("target").alias("anchor"))).distinct()
    one = steps.select(*by, F.col("target").alias("anchor"), F.col("source").alias("node_idx"))
    two = one.join(steps.select(*by, F.col("target").alias("node_idx"), F.col("source").alias("_s")), [*by, "node_idx"]).select(*by, "anchor", F.col("_s").alias("node_idx"))
    forward = steps.select(*by, F.col("source").alias("anchor"), F.col("target").alias("node_idx"))
    return nodes.select(*by, "anchor", F.col("anchor").alias("node_idx")).union(one).union(two).union(forward).distinct()
