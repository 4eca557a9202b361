"""Callees that groups share, the 100 most used of each group."""

from oracle import SF

from codegrain.plans import catalog
from codegrain.plans.projection import project


def test_no_callee_of_a_file_is_dropped(spark):
    effects = project(spark, SF).effects.filter("callee_name is not null")
    want = {r["callee_name"]: r["count"] for r in effects.groupBy("callee_name").count().collect()}
    got = {r["callee_name"]: r["total"] for r in catalog.queries()["cross_patterns_files"](spark, SF).collect()}
    assert len(want) > 10 and got == want


def test_repos_share_callees_to_the_hundredth(spark):
    f = catalog._Q["cross_patterns_repos"][0]
    rows = [(f"{repo}:p:hook:1", f"c{i:03d}") for repo in ("a", "b") for i in range(101) for _ in range(101 - i)] + [("c:p:hook:1", "alone")] * 200
    g = project(spark, SF).replaced(effects=spark.createDataFrame(rows, "source_entity_id string, callee_name string"))
    got = {(r["callee_name"], r["groups"], r["total"]) for r in f(g, spark, SF).collect()}
    assert got == {(f"c{i:03d}", 2, 2 * (101 - i)) for i in range(100)}
