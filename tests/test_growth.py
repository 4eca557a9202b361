"""Steps whose cost has to grow no faster than the input."""

from pyspark.sql import functions as F

from codegrain.operators import datoms, overlay, symbols, traversal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_keeps_one_row_of_keys_without_news(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], "k string, age int, v string")
    new = spark.createDataFrame([("b", 1, "w"), (None, 2, "m")], "k string, age int, v string")
    assert sorted(map(str, overlay.upsert(old, new, ["k"], F.col("age")).select("k", "v").collect())) == sorted(map(str, spark.createDataFrame([("a", "y"), ("b", "w"), (None, "m")], "k string, v string").collect()))


def test_upsert_is_one_shuffle(spark):
    old = spark.range(100).selectExpr("cast(id as string) k", "id age")
    assert plan(overlay.upsert(old, old, ["k"], F.col("age"))).count("Exchange hash") == 1


def test_sorts_are_led_by_a_hash(spark):
    rows = spark.range(100).selectExpr("cast(id as string) k", "id v", "false is_deleted").hint("merge")
    for df in (overlay.overlay(rows, rows, ["k"]), overlay.diff(rows, rows, ["k"], ["v"])):
        assert "hashpartitioning(_h" in plan(df)


def test_resolved_edges_of_other_types_are_not_shuffled(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "EXTENDS"), ("c", "d", None), (None, "b", "CALLS")], "source_entity_id string, target_entity_id string, edge_type string")
    found = spark.createDataFrame([("a", "b", "z"), ("a", "b", "y"), ("a", "b", None), (None, "b", "x")], "source_entity_id string, target_entity_id string, resolved_id string")
    out = overlay.resolve_edges(edges, found, "CALLS")
    assert sorted(map(str, map(tuple, out.select(*edges.columns).collect()))) == sorted(map(str, [("a", "y", "CALLS"), ("a", "b", "EXTENDS"), ("c", "d", None), (None, "b", "CALLS")]))
    assert "SortAggregate" not in plan(out)


def test_counts_of_entities_are_dealt_by_entity(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("a", "y", "1"), ("b", "x", "1"), (None, "x", "1"), ("b", None, "1")], "e string, a string, v string")
    assert [tuple(r) for r in datoms.stats(datoms.asserted(rows, rows)).collect()] == [(10, 2, 2)]
    assert [tuple(r) for r in datoms.load_counts(f=rows, none=rows.limit(0)).orderBy("family").collect()] == [("f", 5, 2), ("none", 0, 0)]
    assert sorted(map(tuple, datoms.attribute_counts(rows).collect()), key=str) == sorted([("x", 3, 2), ("y", 1, 1), (None, 1, 1)], key=str)
    for df in (datoms.stats(rows), datoms.load_counts(f=rows), datoms.attribute_counts(rows)):
        assert "REPARTITION_BY_NUM" in plan(df)


def test_walks_build_the_edges_once(spark):
    built = spark.sparkContext.accumulator(0)

    def seen(a):
        built.add(1)
        return a

    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")]
    edges = spark.createDataFrame(pairs, "s string, target_entity_id string").select(F.udf(seen)("s").alias("source_entity_id"), "target_entity_id", F.lit("CALLS").alias("edge_type"))
    nodes = spark.createDataFrame([("e", "f.ts"), ("x", "g.ts")], "entity_id string, file_path string")
    start = spark.createDataFrame([("a",)], "entity_id string")
    for walk, rows in ((lambda: traversal.reachable(edges, start), 4), (lambda: traversal.graph_deps(edges, start, 10), 4), (lambda: traversal.affected_by_file(edges, nodes, "f.ts"), 4)):
        before = built.value
        assert walk().count() == rows
        assert built.value - before <= 3 * len(pairs)


def test_fix_context_looks_up_few_nodes(spark):
    nodes = spark.createDataFrame([("a", "A", "function", "f.ts"), ("b", "B", "function", "g.ts")], "entity_id string, name string, kind string, file_path string").hint("merge")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "source_entity_id string, target_entity_id string")
    out = symbols.fix_context(nodes, edges, "f.ts")
    assert sorted(map(tuple, out.select("target_entity_id", "name").collect())) == [("b", "B"), ("c", None)]
    assert "BroadcastHashJoin" in plan(out)
