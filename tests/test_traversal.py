"""Traversals at their full depth against plain enumeration of all simple paths."""

import numpy as np
import pytest

from codegrain.operators import traversal


def graph(spark, edges, kind="CALLS"):
    return spark.createDataFrame([(str(a), str(b), kind) for a, b in edges], "source_entity_id string, target_entity_id string, edge_type string")


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "entity_id string")


def slow_edges(edges, start, depth):
    """Edges on paths that hold no node twice, the start apart, at their least depth."""
    out, level = {}, [(start, ())]
    for d in range(1, depth + 1):
        nxt = []
        for here, path in level:
            for a, b in edges:
                if a == here and b not in path:
                    out.setdefault((a, b), d)
                    nxt.append((b, (*path, b)))
        level = nxt
    return out


def slow_calls(edges, start, depth):
    """(node, depth) of paths that hold no node twice, the start included."""
    out, level = set(), [(start, (start,))]
    for d in range(1, depth + 1):
        level = [(b, (*path, b)) for here, path in level for a, b in edges if a == here and b not in path]
        out |= {(b, d) for b, _ in level}
    return out


GRAPHS = [
    [("a", "b"), ("b", "c"), ("c", "a")],
    [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "b")],
    [("a", "b"), ("b", "c"), ("b", "d"), ("c", "a"), ("c", "b")],
    [("a", "a"), ("a", "b")],
    [("a", "b"), ("b", "b"), ("b", "c")],
    *[sorted({("abcdefgh"[i], "abcdefgh"[j]) for i, j in np.random.default_rng(seed).integers(0, 8, (14, 2))} | {("a", "b")}) for seed in range(6)],
]


@pytest.mark.parametrize("edges", GRAPHS)
def test_dependencies_at_full_depth(spark, edges):
    df = graph(spark, edges)
    for start in (["a"], starts(spark, "a")):
        got = {(r["source_entity_id"], r["target_entity_id"]): r["depth"] for r in traversal.graph_deps(df, start, 10).collect()}
        assert got == slow_edges(edges, "a", 10)
    back = {(r["target_entity_id"], r["source_entity_id"]): r["depth"] for r in traversal.graph_dependents(df, ["a"], 10).collect()}
    assert back == slow_edges([(b, a) for a, b in edges], "a", 10)


@pytest.mark.parametrize("edges", GRAPHS[:4] + GRAPHS[-2:])
def test_call_graph_at_full_depth(spark, edges):
    nodes = spark.createDataFrame([(c, c, "function", "f.ts") for c in "abcdefgh"], "entity_id string, name string, kind string, file_path string")
    got = {(r["entity_id"], r["depth"]) for r in traversal.call_graph(graph(spark, edges), nodes, ["a"], 10, limit=1000).collect()}
    assert got == slow_calls(edges, "a", 10)


def test_reachable_affected_and_first_edges(spark):
    edges = [("r1:p:f:a", "r1:p:f:b"), ("r2:p:f:c", "r1:p:f:a"), ("r3:p:f:d", "r2:p:f:c"), ("r3:p:f:d", "r1:p:f:a"), ("r4:p:f:e", "r3:p:f:d"), ("r1:p:f:b", "r4:p:f:e")]
    df, start = graph(spark, edges), starts(spark, "r1:p:f:b")
    rows = {r["entity_id"]: (r["depth"], r["is_direct"]) for r in traversal.affected(df, start).collect()}
    assert rows == {"r1:p:f:a": (1, True), "r2:p:f:c": (2, False), "r3:p:f:d": (2, False), "r4:p:f:e": (3, False)}
    assert {r["entity_id"] for r in traversal.affected(df, start, exclude=["r3"]).collect()} == {"r1:p:f:a", "r2:p:f:c"}
    assert {r["repo"]: (r["entities"], r["impact"]) for r in traversal.affected_repos(traversal.affected(df, start)).collect()}["r3"] == (1, "transitive")
    first = [(r["source_entity_id"], r["target_entity_id"], r["depth"]) for r in traversal.first_edges(df, starts(spark, "r4:p:f:e"), 10).collect()]
    assert first == [("r4:p:f:e", "r3:p:f:d", 1), ("r3:p:f:d", "r1:p:f:a", 2), ("r3:p:f:d", "r2:p:f:c", 2), ("r1:p:f:a", "r1:p:f:b", 3)]
    assert traversal.reachable(df, starts(spark, "nowhere")).count() == 0


def test_importers_walk_by_file(spark):
    refs = spark.createDataFrame([("x", "s", "x.ts", True), ("y", "x", "y.ts", True), ("z", "y", "z.ts", True), ("w", "s", "s.ts", True), ("v", "s", "v.ts", False)], "source_entity_id string, target_entity_id string, source_file_path string, is_resolved boolean")
    nodes = spark.createDataFrame([("s", "s.ts")], "entity_id string, file_path string")
    got = [(r["file_path"], r["depth"]) for r in traversal.symbol_importers(refs, nodes, starts(spark, "s"), 2).orderBy("depth").collect()]
    assert got == [("x.ts", 1), ("y.ts", 2)]


def test_arguments_are_checked(spark):
    df = graph(spark, GRAPHS[0])
    for bad in (lambda: traversal.graph_deps(df, ["a"], 11), lambda: traversal.graph_calls(df, ["a"], "sideways"), lambda: traversal.edges_at_level(df, df, "all")):
        with pytest.raises(ValueError):
            bad()
