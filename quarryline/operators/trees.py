"""Syntax trees as rows in depth-first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Kinds of nodes that are candidates, and their order of worth.
REGION_KINDS = "case_statement catch_clause do_statement for_range_loop for_statement if_statement lambda_expression switch_statement try_statement while_statement".split()
STATEMENT_KINDS = "break_statement co_return_statement continue_statement declaration expression_statement goto_statement labeled_statement return_statement static_assert_declaration throw_statement".split()
JUMP_KINDS = "break_statement continue_statement co_return_statement return_statement throw_statement".split()
PRIORITY = {"throw_statement": 5, "co_return_statement": 5, "return_statement": 4, "expression_statement": 3, "declaration": 2}


def function_nodes(files: DataFrame) -> DataFrame:
    """One row for each node: ``file_id, func_idx, node_idx`` and the node's fields; null trees give none."""
    functions = files.select("file_id", F.posexplode("func_ast").alias("func_idx", "tree"))
    return functions.select("file_id", "func_idx", F.posexplode("tree").alias("node_idx", "node")).select("file_id", "func_idx", "node_idx", "node.*")


def _set_at(values: Column, place: Column, value: Column) -> Column:
    """An array with one element set, lengthened by nulls where it is shorter."""
    padded = F.concat(F.slice(values, 1, place), F.array_repeat(F.lit(None).cast("int"), F.greatest(place - F.size(values), F.lit(0))))
    return F.concat(padded, F.array(value), F.slice(values, place + 2, F.greatest(F.size(values) - place - 1, F.lit(0))))


def parents(depths: Column) -> Column:
    """For each depth of a depth-first list the index of the nearest earlier node one level up, or null.

    One pass; its state is the last node of each level.
    """
    start = F.struct(F.array().cast("array<int>").alias("last"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, depth: Column) -> Column:
        above = F.when(depth > 0, F.get(state["last"], depth - 1))
        return F.struct(_set_at(state["last"], depth, F.size(state["out"])).alias("last"), F.concat(state["out"], F.array(above)).alias("out"))

    return F.aggregate(depths, start, step, lambda state: state["out"])


def spans(depths: Column) -> Column:
    """For each depth of a depth-first list the rows of the node's subtree.

    One pass from the end; its state is the nearest later node of each level.
    """
    n = F.size(depths)
    start = F.struct(F.array().cast("array<int>").alias("next"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, depth: Column) -> Column:
        index = n - F.size(state["out"]) - 1
        ended = F.coalesce(F.array_min(F.slice(state["next"], 1, depth + 1)), n)
        return F.struct(_set_at(state["next"], depth, index).alias("next"), F.concat(state["out"], F.array(ended - index)).alias("out"))

    return F.aggregate(F.reverse(depths), start, step, lambda state: F.reverse(state["out"]))


def placed_nodes(files: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, func_idx, node_idx, depth, kind, parent_idx, parent_kind, span`` and more fields of every node.

    Parents and spans come from the function's own array before its nodes become
    rows, so nothing is joined or shuffled.  A null depth counts as 0.
    """
    functions = files.select("file_id", F.posexplode("func_ast").alias("func_idx", "tree")).where("tree is not null")
    depths = F.transform("tree", lambda n: F.coalesce(n["depth"], F.lit(0)))
    nodes = F.transform(F.arrays_zip(F.col("tree").alias("node"), parents(depths).alias("p"), spans(depths).alias("span")), lambda x: F.struct(x["node"].alias("node"), x["p"].alias("parent_idx"), F.get(F.col("tree"), x["p"])["kind"].alias("parent_kind"), x["span"].alias("span")))
    rows = functions.select("file_id", "func_idx", F.posexplode(nodes).alias("node_idx", "x"))
    return rows.select("file_id", "func_idx", "node_idx", *[F.col(f"x.node.{f}").alias(f) for f in dict.fromkeys(("depth", "kind", *fields))], "x.parent_idx", "x.parent_kind", "x.span")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Add ``parent_idx`` and ``span`` to nodes that are rows already: one shuffle by function, one pass in it.

    Other columns come through; a repeated node of a function counts as another one after it.
    """
    by = ["file_id", "func_idx"]
    rest = [c for c in nodes.columns if c not in by]
    trees = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node_idx", *[c for c in rest if c != "node_idx"]))).alias("tree"))
    depths = F.transform("tree", lambda n: F.coalesce(n["depth"], F.lit(0)))
    index = lambda a: F.transform(a, lambda i: F.get(F.col("tree"), i)["node_idx"])
    zipped = F.arrays_zip(F.col("tree").alias("node"), index(parents(depths)).alias("parent_idx"), spans(depths).alias("span"))
    rows = trees.select(*by, F.explode(zipped).alias("x"))
    return rows.select(*[F.col(c) if c in by else F.col(f"x.node.{c}").alias(c) for c in nodes.columns], "x.parent_idx", "x.span")


def diverse_top(df: DataFrame, by: list[str], kind: str, score: list[Column], limit: int) -> DataFrame:
    """The best ``limit`` rows of each group, the best of each kind before second ones.

    ``score`` gives the descending order; it must end in a total order.
    """
    heads = Window.partitionBy(*by, kind).orderBy(*score)
    order = Window.partitionBy(*by).orderBy(F.when(F.col("_head") == 1, 0).otherwise(1), *score)
    ranked = df.withColumn("_head", F.row_number().over(heads)).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= limit).drop("_head", "_rank")


def quality_candidates(nodes: DataFrame, least_nodes: int = 10, least_children: int = 5, regions: int = 2, statements: int = 2) -> DataFrame:
    """Functions, regions and statements worth keeping: ``file_id, func_idx, node_idx, level``.

    A function counts if it is a definition at index 0 with code and
    ``least_nodes`` nodes; its regions and statements are limited to the most
    diverse ones.  Null sizes count as 0.
    """
    size, children = F.coalesce("subtree_size", F.lit(0)), F.coalesce("ast_num", F.lit(0))
    coded = nodes.where(F.coalesce("code_snippet", F.lit("")) != "")
    roots = coded.where((F.col("node_idx") == 0) & (F.col("kind") == "function_definition") & (size >= least_nodes))
    inner = coded.where(F.col("node_idx") > 0).join(roots.select("file_id", "func_idx"), ["file_id", "func_idx"], "left_semi")
    big = F.col("kind").isin(REGION_KINDS) & (size >= max(least_nodes, least_children + 1))
    region = big & ((F.col("kind") == "lambda_expression") | (children >= 3))
    fits = (F.octet_length("code_snippet") <= 4000) & (F.size(F.split("code_snippet", "\n")) <= 80)
    least = F.when(F.col("kind").isin(JUMP_KINDS), 3).otherwise(least_children)
    statement = ~big & F.col("kind").isin(STATEMENT_KINDS) & fits & (size >= least)
    worth = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")], F.lit(1))
    by = ["file_id", "func_idx"]
    chosen_regions = diverse_top(inner.where(region), by, "kind", [F.least(size, F.lit(500)).desc(), size, F.col("node_idx")], regions)
    chosen_statements = diverse_top(inner.where(statement), by, "kind", [worth.desc(), F.least(size, F.lit(120)).desc(), F.col("node_idx")], statements)
    pick = lambda df, level: df.select(*by, "node_idx", F.lit(level).alias("level"))
    return pick(roots, "function").union(pick(chosen_regions, "region")).union(pick(chosen_statements, "statement"))
