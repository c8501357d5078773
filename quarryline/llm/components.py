"""Connected components by concurrent breadth-first search from many seeds.

Adjacency lists are hash-partitioned by node.  Every node starts as the seed of a
search, or joins that of a smaller neighbour at once.  All searches expand
together, one frontier a round: the frontier holds the nodes whose label has just
changed, and where two searches collide the smaller seed takes the node.  A round
reads the labels of the nodes it reaches and writes only its own frontier; the label
of a node is the smallest of all its frontiers.  If the frontier isn't empty after
``ROUNDS`` rounds, labels that still touch form the edges of a much smaller graph,
which is solved in the same way, and its answer relabels the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarryline.plans.lineage import cut

ROUNDS = 8


def frontier_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """Component of every node that has an edge, as ``node, component``.

    ``component`` is a node of the component, the same for all its members.
    Edges are undirected; repeated edges and self-loops are allowed (a node with
    only a self-loop is a component of its own), edges with a null end are
    ignored, and an empty table gives an empty result.  Other columns are ignored.
    """
    pairs = edges.select(F.col(left).alias("src"), F.col(right).alias("dst")).where("src is not null and dst is not null")
    adjacency = cut(pairs.union(pairs.select("dst", "src")).distinct())
    least = adjacency.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    frontier = cut(least.select("node", F.least("node", "least").alias("label")))
    written, ended = frontier, False
    for _ in range(ROUNDS):
        offers = frontier.join(adjacency, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        reached = written.join(offers, "node").groupBy("node").agg(F.min("label").alias("label"), F.first("offer").alias("offer"))
        frontier = cut(reached.where("offer < label").select("node", F.col("offer").alias("label")))
        if ended := frontier.isEmpty():
            break
        written = written.union(frontier)
    ends = written.groupBy("node").agg(F.min("label").alias("label"))
    if ended:
        return ends.select("node", F.col("label").alias("component"))
    ends = cut(ends)
    meetings = adjacency.join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst").where("a <= b")
    merged = frontier_components(meetings.select("a", "b").distinct(), "a", "b")
    return ends.join(merged.toDF("label", "component"), "label").select("node", "component")
