import random

from quarryline.llm import components
from quarryline.llm.components import frontier_components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[find(a)] = find(b)
    return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}


def found(spark, edges, kind="long"):
    groups = {}
    for r in frontier_components(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert all(c in members for c, members in groups.items())
    return {frozenset(g) for g in groups.values()}


def test_random_graphs(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(7, 7), (200, 200), (None, 3), (4, None)]
    assert found(spark, edges) == plain(edges)


def test_long_chain_needs_the_small_graph(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 2)
    order = list(range(30))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(100, 101)]
    assert found(spark, edges) == plain(edges)


def test_strings_and_empty(spark):
    assert found(spark, [("b", "a"), ("b", "c")], "string") == {frozenset("abc")}
    assert found(spark, []) == set()
