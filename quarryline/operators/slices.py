"""Slices: runs of statements that definitions and uses hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quarryline.functions.text import extent

#: The gates of a slice.
MOST_SPAN, LEAST_COHESION, MOST_BYTES, MOST_LINES = 12, 0.5, 4000, 80
#: What a statement does, by its text, and what counts as leaving or allocating.
CORE = {
    "assignment_expression": r"[^=!<>]=[^=]",
    "call_expression": r"[A-Za-z_][A-Za-z0-9_]*\s*\(",
    "delete_expression": r"\bdelete\b",
    "new_expression": r"\bnew\b",
    "return_statement": r"^\s*(?:co_)?return\b",
    "throw_statement": r"\bthrow\b",
    "update_expression": r"\+\+|--",
}
LEAVING = ("return_statement", "throw_statement", "new_expression", "delete_expression")
_BY = ["file_id", "func_idx"]


def statements(nodes: DataFrame) -> DataFrame:
    """``node_idx, kinds, bytes, first_line, last_line`` of the statements of each function; a null extent has null lines."""
    place = extent(F.col("extent"))
    kinds = F.filter(F.array(*[F.when(F.col("code_snippet").rlike(pattern), name) for name, pattern in CORE.items()]), lambda k: k.isNotNull())
    coded = nodes.where("node_idx > 0 and code_snippet is not null")
    return coded.select(*_BY, "node_idx", kinds.alias("kinds"), F.octet_length("code_snippet").alias("bytes"), place["sl"].alias("first_line"), place["el"].alias("last_line"))


def slices(nodes: DataFrame, reached: DataFrame, links: DataFrame) -> DataFrame:
    """The slices of each function: ``anchor, first, last, selected, edges, cohesion, bytes, lines, position``.

    ``reached`` are the statements near each anchor, ``links`` the definitions and
    uses.  A slice has two statements or more, an edge among them, at most 12
    statements from its first to its last, half of them selected, at most 4000 bytes
    and 2 to 80 lines.  Of slices with the same ends the best by cohesion, edges and
    anchor stays; ``position`` ranks those of a function.
    """
    near = reached.where(F.abs(F.col("node_idx") - F.col("anchor")) < MOST_SPAN)
    inner = links.select(*_BY, F.col("source").alias("node_idx"), "target", "symbol").join(near, [*_BY, "node_idx"])
    inner = inner.join(near.select(*_BY, "anchor", F.col("node_idx").alias("target")), [*_BY, "anchor", "target"])
    edges = inner.groupBy(*_BY, "anchor").agg(F.count_distinct("node_idx", "target", "symbol").alias("edges"))
    ends = near.groupBy(*_BY, "anchor").agg(F.min("node_idx").alias("first"), F.max("node_idx").alias("last"), F.count_distinct("node_idx").alias("selected"))
    span = F.col("last") - F.col("first") + 1
    gated = ends.where(F.col("selected") >= 2).where(span <= MOST_SPAN).withColumn("cohesion", F.col("selected") / span).where(F.col("cohesion") >= LEAST_COHESION).join(edges, [*_BY, "anchor"])
    facts = statements(nodes)
    parts = gated.select(*_BY, "anchor", "first", "last", F.explode(F.sequence("first", "last")).alias("node_idx")).join(facts, [*_BY, "node_idx"])
    whole = parts.groupBy(*_BY, "anchor").agg(
        (F.sum("bytes") + F.count(F.lit(1)) - 1).alias("bytes"),
        (F.max("last_line") - F.min("first_line") + 1).alias("lines"),
        F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"),
        F.max(F.when(F.col("node_idx") == F.col("anchor"), F.struct("kinds"))).alias("own"),
    )
    joined = gated.join(whole, [*_BY, "anchor"]).withColumn("own", F.coalesce("own.kinds", F.array().cast("array<string>")))
    plain = F.size(F.array_except("own", F.array(F.lit("assignment_expression"), F.lit("update_expression")))) == 0
    kept = joined.where((F.col("bytes") <= MOST_BYTES) & F.col("lines").between(2, MOST_LINES) & ~(plain & (F.col("cohesion") < 1)))
    best = Window.partitionBy(*_BY, "first", "last").orderBy(F.desc("cohesion"), F.desc("edges"), "anchor")
    kept = kept.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    leaves = F.arrays_overlap("own", F.array(*map(F.lit, LEAVING)))
    calls = lambda kinds: F.array_contains(kinds, "call_expression")
    rank = Window.partitionBy(*_BY).orderBy(
        F.desc(calls("own")), F.desc(leaves), F.desc(F.size("own")), F.desc(calls("kinds")), F.desc(F.size("kinds")), F.desc("cohesion"), F.desc("edges"), "bytes", "first", "anchor"
    )
    return kept.withColumn("position", F.row_number().over(rank)).select(*_BY, "anchor", "first", "last", "selected", "edges", F.round("cohesion", 6).alias("cohesion"), "bytes", "lines", "position")
