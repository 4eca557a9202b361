"""Merges, diffs and resolution reach every row of every table."""

from collections import Counter

import pytest
from oracle import SF

from codegrain.plans import catalog
from codegrain.plans.projection import project

QUERIES = catalog.queries()
KINDS = {"namespace", "module", "class", "interface", "function", "method", "hook"}
TABLES = {"nodes", "edges", "external_refs", "effects"}


@pytest.mark.parametrize("name", ["overlay_all", "upsert_all", "diff_all", "incremental_merge_all", "tombstones_all"])
def test_all_tables_and_kinds(spark, name):
    rows = QUERIES[name](spark, SF).select("table_name", "key").collect()
    assert {r["table_name"] for r in rows} == TABLES
    kinds = {r["key"].removeprefix("branch:").split(":")[2] for r in rows if r["table_name"] == "nodes"}
    assert kinds == KINDS or name == "tombstones_all" and kinds  # files without a tombstone stay


def test_changes_of_each_sort(spark):
    found = Counter((r["table_name"], r["change"]) for r in QUERIES["diff_all"](spark, SF).collect())
    assert set(found) == {(t, c) for t in TABLES for c in ("added", "removed", "modified")}


def test_all_names_and_references(spark):
    g = project(spark, SF)
    names = QUERIES["resolve_names_all"](spark, SF).collect()
    assert len(names) == 3 * g.nodes.count() and {r["use_id"].split(":")[2] for r in names} == KINDS
    refs = QUERIES["resolve_imports_all"](spark, SF).collect()
    assert len(refs) == g.external_refs.count() and {r["resolved_id"] is None for r in refs} == {True, False}
