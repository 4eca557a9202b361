"""Built-in rules on named callees and paths, with the answers written out."""

import pytest
from pyspark.sql import functions as F

from codegrain.functions import ids, infer
from codegrain.operators import hub, rules

CALLS = {
    "dynamodb.client.put": ("Database", "Write"), "db.selectFrom": ("Database", "Read"), "prisma.user.create": ("Database", "Write"), "stripe.charges.create": ("Payment", "Charge"),
    "stripe.refunds.create": ("Payment", "Refund"), "jwt.sign": ("Auth", None), "bcrypt.compareSync": ("Auth", None), "axios.post": ("HTTP", None), "sqsClient.sendMessage": ("Messaging", None),
    "s3.putObject": ("Storage", None), "console.log": ("Observability", None), "formatDate": (None, None), "helper.compute": (None, None),
}


def test_domains_of_callees(spark):
    e = spark.createDataFrame([("FunctionCall", c, True) for c in CALLS], "effect_type string, callee_name string, is_external boolean").withColumns({"target_resource": F.lit(None).cast("string"), "target": F.lit(None).cast("string"), "is_async": F.lit(False)})
    got = {r["callee_name"]: (r["domain"], r["action"]) for r in rules.run_rules(e).collect()}
    for callee, (domain, action) in CALLS.items():
        assert got.get(callee, (None, None))[0] == domain, callee
        assert action is None or got[callee][1] == action, (callee, got[callee])


@pytest.mark.parametrize(("pattern", "yes", "no"), [("db.*", ["db.x", "db.x.y"], ["db.", "dbx.y", "adb.x"]), ("*.find", ["a.find"], [".find", "a.finder"]), ("a+b(*)", ["a+b(x)"], ["aab(x)", "a+bx"]), ("exact", ["exact"], ["exactly", "exact\n"])])
def test_wildcards_are_literal_but_for_stars(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "n string")
    assert {r["n"] for r in df.filter(ids.wildcard(F.col("n"), pattern)).collect()} == set(yes)


def test_links_of_all_shapes(spark):
    links = {
        "code://app/packages/core/src/auth.ts#Auth.login()?version=v%201&line=45&col=2": ("app", "packages/core", "src/auth.ts", "Auth.login()", "v 1", 45, 2),
        "code://app": ("app", ".", None, None, None, None, None), "code://app/./src/x.ts": ("app", ".", "src/x.ts", None, None, None, None), "code://app/main.py#f": ("app", ".", "main.py", "f", None, None, None),
        "code://app/libs/core": ("app", "libs/core", None, None, None, None, None), "http://app/x": None, "code://": None,
    }
    df = spark.createDataFrame([(x,) for x in links], "link string").select("link", infer.parsed_uri(F.col("link")).alias("p"))
    for r in df.collect():
        want = links[r["link"]]
        assert (r["p"] and tuple(r["p"][k] for k in ("repo", "package", "file", "symbol", "version", "line", "col"))) == want, r["link"]


def test_siblings(spark):
    want = {"shared": "shared", "@org/shared": "shared", "shared-utils/x": "shared", "my-shared": "shared", "./shared": None, "node:fs": None, "fs": None, "other": None, "own": None, "@org/pkg/shared": None}
    df = spark.createDataFrame([(m,) for m in want], "m string")
    assert {r["m"]: r["s"] for r in df.select("m", hub.sibling(F.col("m"), ["own", "shared"], "own", ("fs",)).alias("s")).collect()} == want


CONTAINERS = {
    "src/parsers/ts.ts": "Analysis Layer", "PARSERS/x.ts": "Analysis Layer", "src/analyzer.ts": "Analysis Layer", "src/symbols.ts": "Analysis Layer", "lib/extraction.ts": "Analysis Layer",
    "src/seed-writer.ts": "Storage Layer", "src/cache/lru.ts": "Storage Layer", "x/parquet.ts": "Storage Layer", "src/hub/seeds/a.ts": "Federation Layer", "manifest.ts": "Federation Layer", "cross-repo.ts": "Federation Layer",
    "src/commands/run.ts": "API Layer", "mcp.ts": "API Layer", "src/handlers/a.ts": "API Layer", "src/rules/list.ts": "Rules Layer", "rule-engine.ts": "Rules Layer", "src/views/page.ts": "Views Layer", "diagram.ts": "Views Layer", "src/main.ts": "Other", "rules/list.ts": "Other",
}


def test_containers_of_paths(spark):
    got = rules.grouped(spark.createDataFrame([(p,) for p in CONTAINERS], "source_file_path string"))
    assert {r["source_file_path"]: r["container"] for r in got.collect()} == CONTAINERS


#: domain, action, provider, file, source's name, kind and export flag, dependents -> level
LEVELS = [
    (("Payment", "Charge", "stripe", "src/a.ts", "pay", "function", False, 0), "critical"),
    (("Database", "Read", None, "src/a.ts", "load", "method", False, 0), "important"),
    (("Database", "Read", None, "src/a.ts", "load", "method", False, 7), "critical"),
    (("Database", "Read", None, "src/a.test.ts", "load", "method", False, 0), "hidden"),
    (("Database", "Read", None, "src/a.ts", "load", "class", True, 0), "critical"),
    (("Observability", "Log", "console", "src/a.ts", "load", "method", False, 0), "hidden"),
    (("Observability", "Metric", "datadog", "src/a.ts", "load", "method", False, 0), "minor"),
    (("Other", "Do", None, "src/a.ts", "load", "method", False, 2), "important"),
    (("Other", "Do", None, "src/utils/a.ts", "load", "method", False, 0), "minor"),
    (("Messaging", "Send", None, "src/debug/a.ts", "load", "method", False, 0), "hidden"),
    (("HTTP", "Call", None, "src/a.generated.ts", "load", "method", False, 0), "hidden"),
]


def test_levels_of_effects(spark):
    rows = [(str(i), *x[:4], i) for i, (x, _) in enumerate(LEVELS)]
    d = spark.createDataFrame(rows, "source_entity_id string, domain string, action string, provider string, source_file_path string, n int")
    nodes = spark.createDataFrame([(str(i), x[4], x[5], x[6]) for i, (x, _) in enumerate(LEVELS)], "entity_id string, name string, kind string, is_exported boolean")
    dependents = spark.createDataFrame([(str(i), x[7]) for i, (x, _) in enumerate(LEVELS) if x[7]], "source_entity_id string, dependents int")
    got = {r["n"]: r["significance"] for r in rules.significance(d, dependents, nodes).collect()}
    assert [got[i] for i in range(len(LEVELS))] == [level for _, level in LEVELS]
