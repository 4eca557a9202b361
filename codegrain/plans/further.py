"""Queries over lookups, hub tables, chains, links, templates and written tables, with SQL spelled out by hand.

The SQL shares the projections of the test tables with Spark, and nothing of the
operators: keyword lists, ranks and mappings stand in it as literals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions import ids, infer
from codegrain.operators import datoms, effects, hub, overlay, resolution, rules, symbols, traversal, views
from codegrain.plans.catalog import _RULED, _S, _SEEDS, _T, _branch_pairs, _pathed, _seed, _table, _walk, query
from codegrain.plans.projection import Graph
from codegrain.sources import seeds
from codegrain.sources.written import shared_dir, written

_KEY = "cast(regexp_extract(entity_id, '([0-9]+)$', 1) as bigint)"

# --- pages and totals

query("symbols_paged", "select entity_id, count(*) over () as total, count(*) over () > 50 as has_more from nodes where kind = 'function' and is_exported order by file_path, start_line, entity_id limit 50 offset 10", "nodes")(lambda g, *_: symbols.paged(symbols.matching(g.nodes, kind="function", exported=True), ["file_path", "start_line", "entity_id"], 50, 10).select("entity_id", "total", "has_more"))
query("effects_paged", "select effect_id, count(*) over () as total, count(*) over () > 130 as has_more from effects where effect_type = 'Store' order by timestamp desc, effect_id limit 100 offset 30", "effects")(lambda g, *_: symbols.effect_page(effects.effects_where(g.effects, types=["Store"]), 100, 30).select("effect_id", "total", "has_more"))
query("schema_top_kinds", "select kind, count(*) as count from nodes group by 1 order by count desc, kind limit 5", "nodes")(lambda g, *_: symbols.top_counts(g.nodes, "kind"))
query("schema_top_edges", "select edge_type, count(*) as count from edges group by 1 order by count desc, edge_type limit 5", "edges")(lambda g, *_: symbols.top_counts(g.edges, "edge_type"))
query("cross_patterns_ordered", "with n as (select source_file_path, callee_name, count(*) as n from effects where callee_name is not null group by 1, 2) select callee_name, count(*) as groups, cast(sum(n) as bigint) as total from n group by 1 having count(*) >= 2 order by groups desc, total desc, callee_name limit 20", "effects")(lambda g, *_: effects.cross_patterns(g.effects, "source_file_path").orderBy(F.desc("groups"), F.desc("total"), "callee_name").limit(20))

# --- traversal

_DEPS = _walk(_S, _T, 2, "edges", False, "select 'geo:atlas:module:3' as entity_id") + ", m as (select here as source_entity_id, there as target_entity_id, edge_type, min(depth) as depth from w group by 1, 2, 3 order by depth, 1, 2, 3 limit 100) "
query("graph_deps_summary", _DEPS + "select m.*, s.name as source_name, t.name as target_name from m left join nodes s on s.entity_id = m.source_entity_id left join nodes t on t.entity_id = m.target_entity_id", "edges", "nodes")(lambda g, *_: traversal.edges_at_level(traversal.graph_deps(g.edges, ["geo:atlas:module:3"], 2), g.nodes))
query("graph_deps_counts", _DEPS + "select edge_type, count(*) as count from m group by 1", "edges")(lambda g, *_: traversal.edges_at_level(traversal.graph_deps(g.edges, ["geo:atlas:module:3"], 2), None, "counts"))
query("graph_deps_deep", _walk(_S, _T, 10, "edges", False, "select 'geo:atlas:namespace:2' as entity_id") + "select depth, edge_type, count(*) as edges from (select here, there, edge_type, min(depth) as depth from w group by 1, 2, 3) group by 1, 2", "edges")(lambda g, *_: traversal.graph_deps(g.edges, ["geo:atlas:namespace:2"], 10).groupBy("depth", "edge_type").agg(F.count("*").alias("edges")))
query("graph_dependents_1", "select distinct source_entity_id, target_entity_id, edge_type, 1 as depth from edges where target_entity_id = 'supply:catalog:function:5'", "edges")(lambda g, *_: traversal.graph_dependents(g.edges, ["supply:catalog:function:5"]))
query("graph_dependents_deep", _walk(_T, _S, 10, "edges", False, "select 'supply:catalog:function:5' as entity_id") + "select there as source_entity_id, here as target_entity_id, edge_type, min(depth) as depth from w group by 1, 2, 3", "edges")(lambda g, *_: traversal.graph_dependents(g.edges, ["supply:catalog:function:5"], 10))
_BOTH = "select * from (select {a} as source_entity_id, {b} as target_entity_id, edge_type, min(depth) as depth, '{d}' as direction from w{n} group by 1, 2, 3 order by depth, 1, 2 limit 100)"
_NESTED = tuple(_walk(a, b, 2, "clicks", False, _SEEDS).replace("with hop", "with recursive hop") + "select * from w" for a, b in ((_S, _T), (_T, _S)))
query("graph_calls_both", f"with w1 as (select * from ({_NESTED[0]})), w2 as (select * from ({_NESTED[1]})) " + _BOTH.format(a="here", b="there", d="callees", n=1) + " union all " + _BOTH.format(a="there", b="here", d="callers", n=2), "clicks")(lambda g, *_: traversal.graph_calls(g.clicks, _seed(g), "both", 2))
query("call_graph_callers", _walk(_T, _S, 3, "clicks", True, _SEEDS) + ", m as (select distinct there, depth from w where here <> there) select n.entity_id, m.depth, n.name, n.kind, n.file_path from m join nodes n on n.entity_id = m.there order by m.depth, n.name, n.entity_id limit 500", "clicks", "nodes")(lambda g, *_: traversal.call_graph(g.clicks, g.nodes, _seed(g), 3, callers=True, limit=500))
query("graph_imports_file", "select e.source_entity_id, e.target_entity_id, n.name as target_name from (select * from edges where edge_type in ('IMPORTS', 'RE_EXPORTS') and source_file_path = 'src/IMPORTS.ts' order by source_entity_id, target_entity_id, edge_type limit 50) e left join nodes n on n.entity_id = e.target_entity_id", "edges", "nodes")(lambda g, *_: traversal.graph_imports(g.edges, g.nodes, file="src/IMPORTS.ts", limit=50).select("source_entity_id", "target_entity_id", "target_name"))
query("graph_exports", "select count(*) as exports from edges where edge_type = 'EXPORTS'", "edges")(lambda g, *_: traversal.graph_imports(g.edges, g.nodes, exports=True).agg(F.count("*").alias("exports")))


def _levels(seed: str, edges: str, reverse: bool, depth: int = 10, where: str = "true") -> str:
    """Least levels by sets of (node, level), no paths."""
    a, b = ("target_entity_id", "source_entity_id") if reverse else ("source_entity_id", "target_entity_id")
    return f"with s as ({seed}), r as (select entity_id as id, 0 as depth from s union select e.{b}, r.depth + 1 from r join (select distinct {a}, {b} from {edges}) e on e.{a} = r.id where r.depth < {depth} and {where}), l as (select id as entity_id, min(depth) as depth from r group by 1 having min(depth) > 0) "


query("reachable_deep", _levels(_SEEDS, "clicks", False) + "select entity_id, depth from l", "clicks")(lambda g, *_: traversal.reachable(g.clicks, _seed(g), 10))
query("affected_deep", _levels(_SEEDS, "clicks", True) + "select entity_id, depth, split_part(entity_id, ':', 1) as repo, depth = 1 as is_direct from l", "clicks")(lambda g, *_: traversal.affected(g.clicks, _seed(g)))
_ONE = "select 'supply:catalog:function:1' as entity_id"


def _one(g: Graph) -> DataFrame:
    return g.edges.select(F.lit("supply:catalog:function:1").alias("entity_id")).limit(1)


query("affected_without_repos", _levels(_ONE, "edges", True, where="split_part(e.source_entity_id, ':', 1) not in ('geo')") + "select split_part(entity_id, ':', 1) as repo, depth, count(*) as entities from l group by 1, 2", "edges")(lambda g, *_: traversal.affected(g.edges, _one(g), exclude=["geo"]).groupBy("repo", "depth").agg(F.count("*").alias("entities")))
query("affected_repos", _levels(_ONE, "edges", True) + "select split_part(entity_id, ':', 1) as repo, count(*) as entities, case when min(depth) = 1 then 'direct' else 'transitive' end as impact from l group by 1", "edges")(lambda g, *_: traversal.affected_repos(traversal.affected(g.edges, _one(g))))
query("affected_by_file", _levels("select entity_id from nodes n where file_path = 'supplier/3.ts' and exists (select 1 from edges e where e.target_entity_id = n.entity_id)", "edges", True) + "select entity_id, depth from l", "edges", "nodes")(lambda g, *_: traversal.affected_by_file(g.edges, g.nodes, "supplier/3.ts").select("entity_id", "depth"))
query("first_edges", _levels(_SEEDS, "clicks", False, 4) + ", a as (select * from l union all select entity_id, 0 from s) select * from (select min(e.source_entity_id) as source_entity_id, e.target_entity_id, 'CALLS' as edge_type, t.depth from clicks e join a f on f.entity_id = e.source_entity_id join a t on t.entity_id = e.target_entity_id and f.depth = t.depth - 1 group by e.target_entity_id, t.depth order by t.depth, 1, 2 limit 100)", "clicks")(lambda g, *_: traversal.first_edges(g.clicks, _seed(g), 4))
query("transitive_known", _levels(_ONE.replace("function:1", "function:1"), "edges", True) + "select n.entity_id, n.kind, l.depth from l join nodes n on n.entity_id = l.entity_id", "edges", "nodes")(lambda g, *_: traversal.transitive(g.edges.select(F.col("target_entity_id").alias("source_entity_id"), F.col("source_entity_id").alias("target_entity_id"), "edge_type"), g.nodes, _one(g)).select("entity_id", "kind", "depth"))
query("symbol_importers", "with s as (select entity_id, file_path from nodes where kind = 'function' and is_exported) select source_file_path as file_path, 1 as depth, min(source_entity_id) as entity_id from external_refs where is_resolved and target_entity_id in (select entity_id from s) and source_file_path not in (select file_path from s) group by 1", "nodes", "external_refs")(lambda g, *_: traversal.symbol_importers(g.external_refs, g.nodes, g.nodes.filter("kind = 'function' and is_exported"), 3))


def _impact(g: Graph) -> tuple[DataFrame, DataFrame]:
    new = g.nodes.filter("not (kind = 'function' and is_static)").withColumn("type_signature", F.when(F.col("is_async"), "() => changed").otherwise(F.col("type_signature")))
    return traversal.file_change_impact(g.nodes, new, g.external_refs, ["type_signature"], 2)


_CHANGES = "with c as (select entity_id, file_path, case when kind = 'function' and is_static then 'removed' else 'modified' end as change from nodes where is_exported and ((kind = 'function' and is_static) or is_async)) "
query("file_change_symbols", _CHANGES + "select entity_id, change from c", "nodes")(lambda g, *_: _impact(g)[0])
query("file_change_importers", _CHANGES + "select source_file_path as file_path, 1 as depth, min(source_entity_id) as entity_id from external_refs where is_resolved and target_entity_id in (select entity_id from c) and source_file_path not in (select file_path from c) group by 1", "nodes", "external_refs")(lambda g, *_: _impact(g)[1])

# --- overlay and unresolved edges

_NODE_SIDES = "with base as (select entity_id, name, file_path from nodes), branch as (select case when is_exported then 'branch:' || entity_id else entity_id end as entity_id, case when visibility = 'private' then 'new_' || name else name end as name, file_path, is_abstract and is_default_export as is_deleted from nodes) "
_IDS = ["sales:ledger:method:8", "branch:sales:ledger:method:9", "sales:ledger:method:9", "geo:atlas:module:3", "web:clicks:hook:4"]


def _node_sides(g: Graph) -> tuple[DataFrame, DataFrame]:
    _, base, branch, *_ = next(iter(_branch_pairs(g)))
    return base, branch


query("overlay_lookup_ids", _NODE_SIDES + "select entity_id, name from branch where not is_deleted and entity_id in ('" + "', '".join(_IDS) + "') union all select entity_id, name from base b where entity_id in ('" + "', '".join(_IDS) + "') and not exists (select 1 from branch r where r.entity_id = b.entity_id)", "nodes")(lambda g, *_: overlay.lookup(*_node_sides(g), ["entity_id"], "entity_id", _IDS).select("entity_id", "name"))
query("overlay_lookup_file", _NODE_SIDES + "select entity_id, name from branch where not is_deleted and file_path = 'supplier/3.ts' union all select entity_id, name from base where file_path = 'supplier/3.ts' and not exists (select 1 from branch where file_path = 'supplier/3.ts')", "nodes")(lambda g, *_: overlay.lookup_file(*_node_sides(g), "supplier/3.ts").select("entity_id", "name"))
query("deleted_files", "select kind, count(*) as count from nodes where file_path not in (select distinct file_path from nodes where kind = 'hook') group by 1", "nodes")(lambda g, *_: overlay.deleted(g.nodes, g.nodes.filter("kind = 'hook'"), "file_path").groupBy("kind").agg(F.count("*").alias("count")))
query("unresolved_refs", "select module_specifier, count(*) as refs from external_refs where not is_resolved group by 1", "external_refs")(lambda g, *_: overlay.unresolved_refs(g.external_refs).groupBy("module_specifier").agg(F.count("*").alias("refs")))
_OPEN_SQL = "with o as (select source_entity_id, case when source_line % 2 = 0 then 'unresolved:fn' || source_line else target_entity_id end as target_entity_id, case edge_type when 'IMPORTS' then 'EXTENDS' else edge_type end as edge_type, source_file_path, source_line, case when source_line % 4 = 0 then 'given' || source_line end as given from edges) "


def _open_edges(g: Graph) -> DataFrame:
    kind = F.when(F.col("edge_type") == "IMPORTS", "EXTENDS").otherwise(F.col("edge_type"))
    field = F.when(kind == "CALLS", "callee").otherwise("name")
    given = F.when(F.col("source_line") % 4 == 0, F.concat(F.lit('{"'), field, F.lit('": "given'), F.col("source_line").cast("string"), F.lit('"}'))).otherwise("{}")
    target = F.when(F.col("source_line") % 2 == 0, F.concat(F.lit("unresolved:fn"), F.col("source_line").cast("string"))).otherwise(F.col("target_entity_id"))
    return g.edges.withColumns({"properties": given, "target_entity_id": target, "edge_type": kind})


for _type in ("CALLS", "EXTENDS"):
    query(f"unresolved_{_type.lower()}", _OPEN_SQL + f"select coalesce(given, 'fn' || source_line) as name, count(*) as edges from o where edge_type = '{_type}' and source_line % 2 = 0 group by 1", "edges")(lambda g, *_, t=_type: overlay.unresolved_edges(_open_edges(g), t).groupBy("name").agg(F.count("*").alias("edges")))
    query(f"resolved_{_type.lower()}", _OPEN_SQL + f"select case when edge_type = '{_type}' and source_line % 2 = 0 and source_line < 40 then 'to:' || source_line else target_entity_id end as target_entity_id, edge_type, count(*) as edges from o group by 1, 2", "edges")(
        lambda g, *_, t=_type: (lambda o: overlay.resolve_edges(o, overlay.unresolved_edges(o, t).filter("source_line < 40").select("source_entity_id", "target_entity_id", F.concat(F.lit("to:"), F.col("source_line").cast("string")).alias("resolved_id")), t).groupBy("target_entity_id", "edge_type").agg(F.count("*").alias("edges")))(_open_edges(g))
    )
query("overridden", "select key, level from (select *, row_number() over (partition by key order by case level when 'package' then 0 when 'repo' then 1 else 2 end, doc_id) as rn from (select doc_id, imported as key, case doc_id % 3 when 0 then 'workspace' when 1 then 'repo' else 'package' end as level from (select doc_id, doc_id % 50 as imported from documents))) where rn = 1")(lambda g, spark, d: overlay.by_precedence(_table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("key"), F.when(F.col("doc_id") % 3 == 0, "workspace").when(F.col("doc_id") % 3 == 1, "repo").otherwise("package").alias("level")), ["key"], F.struct(F.when(F.col("level") == "package", 0).when(F.col("level") == "repo", 1).otherwise(2), "doc_id")).select("key", "level"))

# --- effects and symbols

query("effects_of_target", "select effect_id from effects where coalesce(target_resource, target) = 'table3'", "effects")(lambda g, *_: effects.effects_where(g.effects, target="table3").select("effect_id"))
query("effects_summary_total", "select effect_type, count(*) as count, cast(sum(count(*)) over () as bigint) as total from effects group by 1", "effects")(lambda g, *_: effects.summary_with_total(g.effects))
query("package_patterns", "select callee_name, count(*) as count, array_to_string(list_sort(list(distinct split_part(source_entity_id, ':', 2))), ',') as packages, count(distinct split_part(source_entity_id, ':', 2)) > 1 as is_cross_package from (select callee_name, case when source_line % 5 = 0 then 'web:pages:x' else source_entity_id end as source_entity_id from effects) where callee_name is not null group by 1", "effects")(lambda g, *_: effects.package_patterns(g.effects.withColumn("source_entity_id", F.when(F.col("source_line") % 5 == 0, "web:pages:x").otherwise(F.col("source_entity_id")))))
query("static_and_runtime", "select source_file_path, effect_type, count(*) as static, (select count(*) from effects r where r.is_async and r.source_file_path = e.source_file_path and r.effect_type = e.effect_type) as runtime from effects e group by 1, 2", "effects")(lambda g, *_: effects.static_and_runtime(g.effects, g.effects.filter("is_async"), ["source_file_path", "effect_type"]))
_THEMED_SQL = "with t as (select name || case start_line % 4 when 0 then '_theme' when 1 then '_color' when 2 then '_token' else '' end as name, file_path, case kind when 'function' then 'const' when 'method' then 'variable' else kind end as kind from nodes) "
query("theme_tokens", _THEMED_SQL + "select name, file_path from t where (contains(name, 'theme') or contains(name, 'color') or contains(name, 'token')) and kind in ('variable', 'const', 'property') order by 1, 2 limit 20", "nodes")(lambda g, *_: symbols.theme_tokens(g.nodes.select(F.concat("name", F.when(F.col("start_line") % 4 == 0, "_theme").when(F.col("start_line") % 4 == 1, "_color").when(F.col("start_line") % 4 == 2, "_token").otherwise("")).alias("name"), "file_path", F.when(F.col("kind") == "function", "const").when(F.col("kind") == "method", "variable").otherwise(F.col("kind")).alias("kind"))))
query("usage_examples", "select distinct file_path, name from nodes where kind = 'hook' and file_path <> 'hooks/3.tsx' and file_path like '%.tsx' order by 1, 2 limit 5", "nodes")(lambda g, *_: symbols.usage_examples(g.nodes, "hooks/3.tsx", kind="hook"))
query("fix_context", "select t.target_entity_id, n.name, n.kind, n.file_path from (select distinct target_entity_id from edges where source_entity_id in (select entity_id from nodes where file_path = 'supplier/3.ts') order by 1 limit 50) t left join nodes n on n.entity_id = t.target_entity_id", "edges", "nodes")(lambda g, *_: symbols.fix_context(g.nodes, g.edges, "supplier/3.ts"))
_A11Y = "case when source_line % 3 = 0 then 'critical' when source_line % 3 = 1 then 'minor' end"
query("violations_where", f"select effect_id, 'rule' || source_line % 7 as rule_id, coalesce({_A11Y}, 'moderate') as impact, 'AA' as wcag_level, 1.0::double as confidence, source_file_path as file_path, source_line as line from effects where effect_type = 'Send' and {_A11Y} = 'critical' and contains(source_file_path, 'hooks/1') order by effect_id limit 100", "effects")(lambda g, *_: symbols.violations_where(g.effects.withColumns({"effect_type": F.when(F.col("effect_type") == "Send", "A11yViolation").otherwise(F.col("effect_type")), "properties": F.to_json(F.struct(F.concat(F.lit("rule"), (F.col("source_line") % 7).cast("string")).alias("rule_id"), F.expr(_A11Y).alias("impact")))}), file="hooks/1", impact="critical").select("effect_id", "rule_id", "impact", "wcag_level", "confidence", "file_path", "line"))

# --- hub

query("validation_where", "select diagnostic_id from diagnostics where repo_id = 'repo2' and severity = 'error' and contains(file_path, 'f1') order by repo_id, file_path, line_number, column_number, diagnostic_id limit 100", "diagnostics")(lambda g, *_: hub.validation_where(g.diagnostics, "repo2", "error", file="f1", limit=100).select("diagnostic_id"))
query("validation_counts", "select count(*) filter (where severity in ('critical', 'error')) as errors, count(*) filter (where severity = 'warning') as warnings, count(*) as total from diagnostics", "diagnostics")(lambda g, *_: hub.validation_counts(g.diagnostics))
for _by in ("repo_id", "source", "severity"):
    query(f"validation_by_{_by}", f"select {_by}, count(*) filter (where severity in ('critical', 'error')) as errors, count(*) filter (where severity = 'warning') as warnings, count(*) as total from diagnostics where not resolved group by 1", "diagnostics")(lambda g, *_, by=_by: hub.validation_summary(g.diagnostics.filter("not resolved"), by))
query("diagnostics_of_sources", "select severity, count(*) filter (where severity = 'critical') as n_critical, count(*) as total from diagnostics where not resolved and source in ('eslint', 'test') group by 1", "diagnostics")(lambda g, *_: hub.diagnostics_summary(hub.among_sources(g.diagnostics, ("eslint", "test")), "severity").select("severity", F.col("critical").alias("n_critical"), "total"))
query("diagnostics_in_file", "select diagnostic_id from diagnostics where contains(file_path, 'f3') and resolved", "diagnostics")(lambda g, *_: hub.diagnostics_where(g.diagnostics, True, file="f3").select("diagnostic_id"))
query("cleared", "select source, count(*) as left_over from diagnostics where not (repo_id = 'repo1' and source in ('eslint', 'tsc')) group by 1", "diagnostics")(lambda g, *_: hub.cleared(g.diagnostics, repo_id="repo1", source=["eslint", "tsc"]).groupBy("source").agg(F.count("*").alias("left_over")))
query("alive", "select count(*) as alive from (select o_orderdate as created_at, o_custkey % 400 * 86400 as ttl from orders) where ttl > 0 and epoch(timestamp '1996-01-01 00:00:00') - epoch(created_at) < ttl")(lambda g, spark, d: hub.alive(_table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_custkey") % 400 * 86400).alias("ttl_seconds")), F.expr("timestamp '1996-01-01 00:00:00'")).agg(F.count("*").alias("alive")))


def _between(g: Graph) -> DataFrame:
    return g.edges.withColumns({"source_repo": symbols.repo_of(F.col("source_entity_id")), "target_repo": symbols.repo_of(F.col("target_entity_id"))})


query("edges_into", "select source_entity_id, target_entity_id, edge_type, count(*) as edges from edges where target_entity_id like 'sales:%' and contains(target_entity_id, ':interface:1') group by 1, 2, 3", "edges")(lambda g, *_: hub.edges_into(_between(g), "sales", ":interface:1").groupBy("source_entity_id", "target_entity_id", "edge_type").agg(F.count("*").alias("edges")))
query("repos_into", "select split_part(source_entity_id, ':', 1) as source_repo, count(*) as edges, count(distinct source_entity_id) as sources, count(distinct target_entity_id) as targets from edges where target_entity_id like 'supply:%' and source_entity_id not like 'supply:%' group by 1", "edges")(lambda g, *_: hub.repos_into(_between(g), "supply"))
query("from_issues", "select 'eslint:' || repo_id || ':' || file_path || ':' || line_number || ':' || column_number || ':' as diagnostic_id, 'linting' as category, severity, title from diagnostics where source = 'eslint'", "diagnostics")(lambda g, *_: hub.from_issues(g.diagnostics.filter("source = 'eslint'").select("repo_id", "file_path", "line_number", "column_number", "severity", F.lit(None).cast("string").alias("code"), F.col("title").alias("message")), "eslint").select("diagnostic_id", "category", "severity", "title"))
query("from_checks", "select 'ci:r' || o_custkey || ':' || o_orderkey as diagnostic_id, case o_orderstatus when 'F' then 'error' when 'P' then 'warning' else 'note' end as severity, o_orderstatus = 'O' as resolved from orders")(lambda g, spark, d: hub.from_checks(_table(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo_id"), F.col("o_orderkey").cast("string").alias("check_id"), F.lit("build").alias("name"), F.when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "P", "timed_out").otherwise("success").alias("conclusion"), F.lit("").alias("url"))).select("diagnostic_id", "severity", "resolved"))
query("from_violations", "select 'axe:repo:rule' || page_id % 5 || ':' || substr(sha256(url || '|main'), 1, 8) as diagnostic_id, case page_id % 5 when 0 then 'critical' when 1 then 'error' when 2 then 'warning' when 3 then 'suggestion' else 'warning' end as severity from pages")(lambda g, spark, d: hub.from_violations(_table(spark, d, "pages").select(F.lit("repo").alias("repo_id"), F.concat(F.lit("rule"), (F.col("page_id") % 5).cast("string")).alias("rule_id"), F.element_at(F.array(*map(F.lit, ("critical", "serious", "moderate", "minor", "odd"))), (F.col("page_id") % 5 + 1).cast("int")).alias("impact"), F.col("url").alias("page"), F.lit("main").alias("target"))).select("diagnostic_id", "severity"))
query("top_issues", "select file_path as rule_id, count(*) as count from diagnostics group by 1 order by count desc, 1 limit 10", "diagnostics")(lambda g, *_: hub.top_issues(g.diagnostics.withColumnRenamed("file_path", "rule_id")))
query("merged_dependencies", "select 'p' || l_partkey % 40 as package, arg_max('v' || l_suppkey, l_orderkey * 10 + l_linenumber) as version, count(*) as mentions from lineitem group by 1")(lambda g, spark, d: hub.merged_dependencies(_table(spark, d, "lineitem").select(F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("package"), F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("version"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order"), F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))))
_SIBLINGS = ["src1", "src", "de", "src2", "web"]
query("cross_repo_needs", """with u as (select source_file_path, imported_symbol, module_specifier, case when module_specifier like '@%' then split_part(module_specifier, '/', 1) || '/' || split_part(module_specifier, '/', 2) else split_part(module_specifier, '/', 1) end as p from external_refs where not is_resolved and module_specifier not like '.%' and module_specifier not like '/%' and module_specifier not like 'node:%'),
m as (select *, case when p = 'src1' or p like '%/src1' or p like 'src1-%' or p like '%-src1' then 'src1' when p = 'src' or p like '%/src' or p like 'src-%' or p like '%-src' then 'src' when p = 'de' or p like '%/de' or p like 'de-%' or p like '%-de' then 'de' when p = 'src2' or p like '%/src2' or p like 'src2-%' or p like '%-src2' then 'src2' end as target_repo from u)
select source_file_path, target_repo, count(*) as refs, count(distinct imported_symbol) as symbols, min(module_specifier) as module_specifier from m where target_repo is not null group by 1, 2""", "external_refs")(lambda g, *_: hub.cross_repo_needs(g.external_refs, _SIBLINGS, current="web"))
_PAIRS = "select conv_id as question_id, case conv_id % 3 when 0 then 'baseline' when 1 then 'enhanced' else 'tie' end as winner from (select distinct conv_id from conversations)"
query("preferences", f"select count(*) filter (where winner = 'baseline') as baseline_wins, count(*) filter (where winner = 'enhanced') as enhanced_wins, count(*) filter (where winner = 'tie') as ties from ({_PAIRS})")(lambda g, spark, d: hub.preferences(_table(spark, d, "conversations").select("conv_id").distinct().select(F.when(F.col("conv_id") % 3 == 0, "baseline").when(F.col("conv_id") % 3 == 1, "enhanced").otherwise("tie").alias("winner"))))
_SCORES = "with s as (select doc_id % 40 as question_id, case when doc_id % 2 = 0 then 'baseline' else 'enhanced' end as mode, max(quality + 1) as c, max(toxic) as h from labels group by 1, 2), d as (select question_id, coalesce(max(c + h) filter (where mode = 'enhanced') - max(c + h) filter (where mode = 'baseline'), 0) as delta from s group by 1) "


def _deltas(spark, d: str) -> DataFrame:
    s = _table(spark, d, "labels").groupBy((F.col("doc_id") % 40).alias("question_id"), F.when(F.col("doc_id") % 2 == 0, "baseline").otherwise("enhanced").alias("mode")).agg(F.max(F.col("quality") + 1).alias("c"), F.max("toxic").alias("h"))
    return hub.question_deltas(s, ["c", "h"])


query("question_deltas", _SCORES + "select question_id, delta from d")(lambda g, spark, d: _deltas(spark, d))
query("regressions", _SCORES + "select question_id, delta from d where delta < 0")(lambda g, spark, d: hub.regressions(_deltas(spark, d)))
query("top_improvements", _SCORES + "select question_id, delta from d order by delta desc, question_id limit 5")(lambda g, spark, d: hub.top_improvements(_deltas(spark, d)))
query("extremes", "with d as (select source as dimension, avg(n_chars) as delta from documents group by 1) select (select dimension from d order by delta desc, dimension limit 1) as best, round((select max(delta) from d), 6) as best_delta, (select dimension from d order by delta, dimension limit 1) as worst, round((select min(delta) from d), 6) as worst_delta")(lambda g, spark, d: hub.extremes(_table(spark, d, "documents").groupBy(F.col("source").alias("dimension")).agg(F.avg("n_chars").alias("delta"))).select("best", F.round("best_delta", 6).alias("best_delta"), "worst", F.round("worst_delta", 6).alias("worst_delta")))

# --- chains, contexts, models


def _ruled(g: Graph) -> DataFrame:
    return rules.run_rules(g.effects).withColumn("order", F.col("effect_id").cast("long"))


_CHAINS = _RULED + """, d2 as (select *, coalesce(is_external, false) as ext, cast(effect_id as bigint) as ord, coalesce(provider, 'external') as via from h),
own as (select domain, via as flow, source_entity_id, action, 0 as late, ord, effect_id, ext from d2 where ext),
near as (select b.domain, a.flow, b.source_entity_id, b.action, 1 as late, b.ord, b.effect_id, b.ext from d2 b join (select distinct domain, flow, source_entity_id from own) a on a.domain = b.domain and a.source_entity_id = b.source_entity_id
 union all select b.domain, a.flow, b.source_entity_id, b.action, 1, b.ord, b.effect_id, b.ext from d2 b join (select distinct domain, via as flow, source_file_path from d2 where ext) a on a.domain = b.domain and a.source_file_path = b.source_file_path),
rel as (select * from (select *, row_number() over (partition by domain, flow, source_entity_id, action order by late, ord) as rn from (select * from own union all select * from near)) where rn = 1),
ev as (select domain, flow, effect_id, late, ord, ext from rel union all select domain, '', effect_id, 0, ord, ext from d2 where domain in (select domain from d2 group by 1 having count(*) >= 3 and not bool_or(ext))),
sc as (select domain, flow, count(*) as length, sum(case when ext then 10 else 0 end + case domain when 'Payment' then 5 when 'Auth' then 4 when 'Database' then 2 else 1 end) + case when count(*) >= 3 then count(*) else 0 end as score from ev group by 1, 2),
ch as (select lower(domain) || case when flow = '' then '' else '_' || flow end || '_flow' as chain_id, * from sc order by score desc, 1 limit 5),
me as (select * from (select c.chain_id, e.*, row_number() over (partition by c.chain_id order by e.late, e.ord) as place from ev e join ch c on c.domain = e.domain and c.flow = e.flow) where flow <> '' or place <= 10) """
_VIEWS = ("effects",)
query("effect_chains", _CHAINS + "select chain_id, domain, flow, length, cast(score as bigint) as score from ch", *_VIEWS)(lambda g, *_: views.effect_chains(_ruled(g))[0])
query("chain_members", _CHAINS + "select chain_id, domain, effect_id, place from me", *_VIEWS)(lambda g, *_: views.effect_chains(_ruled(g))[1])


def _steps(g: Graph) -> DataFrame:
    d = written(_ruled(g))  # chains and steps read it once each
    return views.flow_steps(views.effect_chains(d)[1], d)


query("flow_steps", _CHAINS + """, st as (select m.chain_id, m.effect_id, e.source_entity_id, row_number() over (partition by m.chain_id order by case when e.domain = 'API' or contains(lower(e.action), 'request') then 0 when e.domain = 'Auth' then 1 when e.domain in ('Payment', 'HTTP') then 2 when e.domain = 'Database' then 3 when e.domain = 'Messaging' then 4 else 5 end, m.place) as step,
 case when e.ext then 'external_' || e.domain || '_' || e.via else lower(e.domain) || '_service' end as target, case when e.ext then replace(array_to_string(list_transform(string_split(replace(regexp_replace(e.via, '^aws-', ''), '_', '-'), '-'), lambda w: upper(w[1:1]) || w[2:]), ' '), '', '') else e.domain || ' Service' end as target_name,
 coalesce(list_last(string_split(e.callee_name, '.')), e.domain || ':' || e.action) as label from me m join d2 e on e.effect_id = m.effect_id)
select * from st where step <= 8""", *_VIEWS)(lambda g, *_: _steps(g))
query("relationships", _RULED + "select container, 'external_' || domain || '_' || coalesce(provider, 'external') as target, count(*) as count, case when count(*) = 1 then min(domain || ':' || action) else array_to_string(list_sort(list(distinct action))[1:3], ', ') || ' (' || count(*) || ' calls)' end as label from h where is_external group by 1, 2", "effects")(lambda g, *_: views.relationships(rules.grouped(_pathed(rules.run_rules(g.effects)))))
query("container_entities", _RULED + "select container, source_entity_id, array_to_string(list_sort(list(distinct domain || ':' || action)), ',') as effects from h group by 1, 2", "effects")(lambda g, *_: views.container_entities(rules.grouped(_pathed(rules.run_rules(g.effects)))))
query("boundaries", _RULED + "select domain, count(distinct source_file_path) as files, count(distinct source_entity_id) as components, array_to_string(list_sort(list(distinct action)), ',') as actions, coalesce(array_to_string(list_sort(list(distinct provider) filter (where is_external and provider is not null)), ','), '') as externals, round(least(1.0, count(distinct source_entity_id)::double / greatest(1, 2 * count(distinct source_file_path))), 6) as cohesion from h group by 1", "effects")(lambda g, *_: views.boundaries(rules.run_rules(g.effects)))
query("significance_context", _RULED + "select 'total' as scope, '' as name, count(*) as count from h union all select 'domain', domain, count(*) from h group by 2 union all select 'action', action, count(*) from h group by 2", "effects")(lambda g, *_: views.significance_context(rules.run_rules(g.effects)))
_ELEMENTS = "with e as (select 'r' || r_regionkey as id, 'System' as kind, cast(null as varchar) as parent, false as tagged from region union all select 'n' || n_nationkey, case n_nationkey % 3 when 0 then 'Layer' else 'component' end, 'r' || n_regionkey, n_nationkey % 5 = 4 from nation union all select 's' || s_suppkey, case s_suppkey % 9 when 0 then 'database' else 'component' end, 'n' || s_nationkey, false from supplier), c as (select *, case when lower(kind) in ('external', 'database', 'queue', 'storage') or tagged then 'external' when lower(kind) in ('container', 'system', 'layer') or coalesce(parent, '') = '' then 'container' else 'component' end as role from e) "


def _elements(spark, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    tags = lambda c: F.when(c, F.array(F.lit("external"))).otherwise(F.array().cast("array<string>"))
    r = _table(spark, d, "region").select(F.concat(F.lit("r"), text("r_regionkey")).alias("id"), F.lit("System").alias("kind"), F.lit(None).cast("string").alias("parent"), tags(F.lit(False)).alias("tags"))
    n = _table(spark, d, "nation").select(F.concat(F.lit("n"), text("n_nationkey")).alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "Layer").otherwise("component").alias("kind"), F.concat(F.lit("r"), text("n_regionkey")).alias("parent"), tags(F.col("n_nationkey") % 5 == 4).alias("tags"))
    s = _table(spark, d, "supplier").select(F.concat(F.lit("s"), text("s_suppkey")).alias("id"), F.when(F.col("s_suppkey") % 9 == 0, "database").otherwise("component").alias("kind"), F.concat(F.lit("n"), text("s_nationkey")).alias("parent"), tags(F.lit(False)).alias("tags"))
    return views.classified(r.unionByName(n).unionByName(s))


query("element_roles", _ELEMENTS + "select id, role from c")(lambda g, spark, d: _elements(spark, d).select("id", "role"))
query("element_containers", _ELEMENTS + "select a.id, case when a.role = 'container' then a.id when b.role = 'container' then b.id when t.role = 'container' then t.id end as container from c a left join c b on b.id = a.parent left join c t on t.id = b.parent")(lambda g, spark, d: views.containers_of(_elements(spark, d)))
query("layer_coverage", "select case when name ilike '%order_1%' then 'First' when name ilike '%order%' then 'Orders' when name ilike 'use%' then 'Hooks' else 'none' end as result, case when name ilike '%order_1%' then 'a' when name ilike '%order%' then 'b' when name ilike 'use%' then 'c' end as rule_id, count(*) as count from nodes group by 1, 2", "nodes")(lambda g, *_: views.layer_coverage(g.nodes.select("name"), [(F.col("name").rlike("(?i)order_1"), "a", "First"), (F.col("name").rlike("(?i)order"), "b", "Orders"), (F.col("name").rlike("(?i)^use"), "c", "Hooks")], "none"))
_HITS = "with h as (select 'f' || l_suppkey % 30 as file, case l_linenumber % 4 when 0 then 'lines' when 1 then 'branches' when 2 then 'functions' else 'statements' end as measure, l_partkey % 3 as hits from lineitem), p as (select file, measure, floor(count(*) filter (where hits > 0) * 1000 / count(*) + 0.5) / 10 as percent from h group by 1, 2) "


def _hits(spark, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("lines", "branches", "functions", "statements")))
    return _table(spark, d, "lineitem").select(F.concat(F.lit("f"), (F.col("l_suppkey") % 30).cast("string")).alias("file"), F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("measure"), (F.col("l_partkey") % 3).alias("hits"))


query("coverage", _HITS + "select file, measure, percent from p")(lambda g, spark, d: views.coverage(_hits(spark, d)))
query("coverage_summary", _HITS + "select " + ", ".join(f"floor(avg(coalesce(v_{m}, 100)) * 10 + 0.5) / 10 as {m}" for m in ("lines", "branches", "functions", "statements")) + " from (select file, " + ", ".join(f"max(percent) filter (where measure = '{m}') as v_{m}" for m in ("lines", "branches", "functions", "statements")) + " from p group by 1)")(lambda g, spark, d: views.coverage_summary(views.coverage(_hits(spark, d))))
query("gap_scores", "select repo, round(0.25 * f + 0.45 * s + 0.3 * f, 6) as score, round(s, 6) as signal from (select *, least(1.0, gen / 2000.0) as f, case when val = 0 then case when gen > 0 then 0.5 else 1.0 end else greatest(0.0, least(1.0, case when gen / val between 0.5 and 2.0 then 1 - abs(1 - gen / val) * 0.5 when gen / val > 2.0 then greatest(0.0, 1 - (gen / val - 2) * 0.2) else gen / val end)) end as s from (select split_part(entity_id, ':', 1) as repo, cast(count(*) as double) as gen, cast(count(*) filter (where is_exported) as double) as val from nodes group by 1))", "nodes")(
    lambda g, *_: g.nodes.groupBy(symbols.repo_of(F.col("entity_id")).alias("repo")).agg(F.count("*").cast("double").alias("gen"), F.count_if("is_exported").cast("double").alias("val")).select("repo", F.least(F.lit(1.0), F.col("gen") / 2000).alias("f"), views.signal_to_noise(F.col("gen"), F.col("val")).alias("s")).select("repo", F.round(views.gap_score(F.col("f"), F.col("s"), F.col("f"), F.col("f")), 6).alias("score"), F.round("s", 6).alias("signal"))
)

# --- mappings, inference, links, ids

_MAPPINGS = (
    rules.Mapping("store", "dynamo*.put", "database", "workspace", "insert", "dynamo"),
    rules.Mapping("store", "prisma.*.create", "database", "repo", "insert", "prisma", "users"),
    rules.Mapping("store", "prisma.*.create", "database", "package", "write", "own", "people"),
    rules.Mapping("retrieve", "*.find*", "database", "workspace", "select", "any"),
    rules.Mapping("retrieve", "s3*", "storage", "repo", "get", "s3"),
    rules.Mapping("send", "axios.*", "external", "workspace", service="http-client", third_party=True),
    rules.Mapping("send", "*.create", "email", "package", service="mailer"),
    rules.Mapping("send", "sqs*", "m2m", "workspace", service="queue"),
)
query("mapped_effects", r"""with m as (select *, case when effect_type <> 'FunctionCall' or callee_name is null then null
 when regexp_full_match(callee_name, 'dynamo.+[.]put') then 1 when regexp_full_match(callee_name, 'prisma[.].+[.]create') then 2
 when regexp_full_match(callee_name, '.+[.]find.+') then 3 when regexp_full_match(callee_name, 's3.+') then 4
 when regexp_full_match(callee_name, 'axios[.].+') then 5 when regexp_full_match(callee_name, 'sqs.+') then 6 when regexp_full_match(callee_name, '.+[.]create') then 7 end as n from effects)
select case when n in (1, 2) then 'Store' when n in (3, 4) then 'Retrieve' when n > 4 then 'Send' else effect_type end as mapped_type, case n when 1 then 'database' when 2 then 'database' when 3 then 'database' when 4 then 'storage' when 5 then 'http' when 6 then 'm2m' when 7 then 'email' end as mapped_kind,
 case n when 1 then 'insert' when 2 then 'write' when 3 then 'select' when 4 then 'get' end as operation, case n when 1 then 'dynamo' when 2 then 'own' when 3 then 'any' when 4 then 's3' end as provider, case when n = 2 then 'people' when n is not null then callee_name end as resource, case n when 5 then 'http-client' when 6 then 'queue' when 7 then 'mailer' end as service, count(*) as count from m group by all""", "effects")(lambda g, *_: rules.mapped(g.effects, _MAPPINGS).groupBy("mapped_type", "mapped_kind", "operation", "provider", "resource", "service").agg(F.count("*").alias("count")))
_C = "contains(lower(callee_name), '{}')"


def _any(*words: str) -> str:
    return "(" + " or ".join(_C.format(w) for w in words) + ")"


query("inferred", f"""select callee_name, case when {_any('insert', 'create', 'add')} then 'insert' when {_any('update', 'upsert')} then 'update' when {_any('delete', 'remove')} then 'delete' else 'write' end as store, case when {_any('findmany', 'findall', 'query', 'select')} then 'query' when {_any('get', 'find', 'read')} then 'get' when {_any('scan')} then 'scan' else 'get' end as retrieve,
case when {_any('log', 'console', 'debug')} then 'logging' when {_any('error', 'throw', 'exception')} then 'error-handling' when {_any('validate', 'check', 'assert')} then 'validation' when {_any('parse', 'stringify', 'serialize')} then 'serialization' when {_any('path', 'file', 'fs.')} then 'filesystem' when {_any('date', 'time')} then 'datetime' when {_any('push', 'pop', 'map', 'filter')} then 'array-ops' else '-' end as category,
case when {_any('stripe')} then 'stripe' when {_any('axios', 'fetch')} then 'http' when {_any('prisma')} then 'prisma' else callee_name end as service from (select distinct callee_name from effects where callee_name is not null)""", "effects")(lambda g, *_: g.effects.filter("callee_name is not null").select("callee_name").distinct().select("callee_name", infer.operation(F.col("callee_name"), "store").alias("store"), infer.operation(F.col("callee_name"), "retrieve").alias("retrieve"), infer.category(F.col("callee_name")).alias("category"), infer.service(F.concat(F.lit("lib/"), "callee_name")).alias("service")))
_FOLDERS = "case page_id % 8 when 0 then '/Users/a/ws/proj/src/cache/x.ts' when 1 then 'src/hub/a.ts' when 2 then 'packages/core/src/a.ts' when 3 then 'lib' when 4 then '' when 5 then 'tools/a.ts' when 6 then '/home/a/ws' else 'packages' end"
query("folders", "select page_id, case page_id % 8 when 0 then 'cache' when 1 then 'hub' when 2 then 'core' when 3 then 'lib' when 4 then 'root' when 5 then 'tools' when 6 then 'root' else 'packages' end as folder, case page_id % 8 when 2 then 'core' else 'main' end as package from pages")(lambda g, spark, d: _table(spark, d, "pages").select("page_id", F.expr(_FOLDERS).alias("path")).select("page_id", infer.container_of(F.col("path")).alias("folder"), infer.container_of(F.col("path"), "package").alias("package")))
def _link() -> Column:
    return infer.uri(symbols.repo_of(F.col("entity_id")), F.split_part("entity_id", F.lit(":"), F.lit(2)), F.col("file"), F.col("name"), F.lit("main"), F.col("start_line"))


def _linked(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'class'").select("entity_id", F.concat(F.lit("src/"), "file_path").alias("file"), F.regexp_replace("name", "[#?]", "").alias("name"), "start_line")


query("uris", "select entity_id, 'code://supply/vendors/src/' || file_path || '#' || regexp_replace(name, '[#?]', '', 'g') || '?version=main&line=' || start_line as link from nodes where kind = 'class'", "nodes")(lambda g, *_: _linked(g).select("entity_id", _link().alias("link")))
query("uris_parsed", "select entity_id, 'supply' as repo, 'vendors' as package, 'src/' || file_path as file, regexp_replace(name, '[#?]', '', 'g') as symbol, 'main' as version, start_line as line from nodes where kind = 'class'", "nodes")(lambda g, *_: _linked(g).select("entity_id", infer.parsed_uri(_link()).alias("p")).select("entity_id", "p.repo", "p.package", "p.file", "p.symbol", "p.version", "p.line"))
query("uris_resolved", "select count(*) as links, count(*) as known from nodes where kind = 'class'", "nodes")(lambda g, *_: infer.resolve_uris(_linked(g).select(_link().alias("link")), _linked(g).select("entity_id", F.lit("supply").alias("repo"), F.lit("vendors").alias("package"), "file", F.col("name").alias("symbol"))).agg(F.count("*").alias("links"), F.count("entity_id").alias("known")))
query("scope_hashes", "select entity_id, substr(sha256(file_path || chr(0) || name || chr(0) || kind), 1, 8) as hash from nodes where kind = 'part' or kind = 'class'", "nodes")(lambda g, *_: g.nodes.filter("kind in ('part', 'class')").select("entity_id", ids.scope_hash(F.col("file_path"), F.col("name"), F.col("kind")).alias("hash")))
query("parsed_ids", "select split_part(entity_id, ':', 1) as repo, split_part(entity_id, ':', 2) as package, split_part(entity_id, ':', 3) as kind, count(*) as count from nodes group by 1, 2, 3", "nodes")(lambda g, *_: g.nodes.select(ids.parsed_id(F.col("entity_id")).alias("p")).groupBy("p.repo", "p.package", "p.kind").agg(F.count("*").alias("count")))

# --- attribute rows

_LOADED = "select 'edges' as family, count(*) as datoms, count(distinct source_entity_id) as entities from edges union all select 'refs', count(*), count(distinct source_entity_id) from external_refs"
query("datom_load_counts", _LOADED, "edges", "external_refs")(lambda g, *_: datoms.load_counts(edges=datoms.edge_datoms(g.edges), refs=datoms.ref_datoms(g.external_refs)))
query("datom_stats", "select 2 * count(*) as datoms, count(distinct source_entity_id) as entities, count(distinct edge_type) as attributes from edges", "edges")(lambda g, *_: (lambda d: datoms.stats(datoms.asserted(d, d)))(datoms.edge_datoms(g.edges)))
query("datom_callees", "select n.entity_id, n.name, n.kind from edges e join nodes n on n.entity_id = e.target_entity_id where e.edge_type = 'CALLS' and e.source_entity_id = 'sales:accounts:interface:4'", "edges", "nodes")(lambda g, *_: datoms.callees(datoms.edge_datoms(g.edges), "sales:accounts:interface:4", g.nodes))
query("datom_callers", "select distinct n.entity_id, n.name, n.kind from edges e join nodes n on n.entity_id = e.source_entity_id where e.edge_type = 'CALLS' and e.target_entity_id = 'supply:catalog:function:5'", "edges", "nodes")(lambda g, *_: datoms.callers(datoms.edge_datoms(g.edges), "supply:catalog:function:5", g.nodes))
query("template_entities", "select entity_id, name, kind from nodes where kind = 'method' and contains(name, '_99')", "nodes")(lambda g, *_: datoms.find_entities(g.nodes, "method", "_99"))
query("template_callees", _levels("select 'sales:accounts:interface:4' as entity_id", "(select * from edges where edge_type = 'CALLS')", False, 3) + "select entity_id, depth from l", "edges")(lambda g, *_: datoms.trace(g.edges, g.edges.select(F.lit("sales:accounts:interface:4").alias("entity_id")).limit(1)))
query("template_callers", _levels(_ONE, "(select * from edges where edge_type = 'CALLS')", True, 3) + "select entity_id, depth from l", "edges")(lambda g, *_: datoms.trace(g.edges, _one(g), callers=True))
query("template_blast_radius", _levels(_ONE, "edges", True, 5) + "select depth, count(*) as entities from l group by 1", "edges")(lambda g, *_: datoms.blast_radius(g.edges, _one(g)))
query("template_external_deps", "select module_specifier, count(distinct source_entity_id) as entities, count(distinct imported_symbol) as symbols from external_refs where not is_resolved group by 1", "external_refs")(lambda g, *_: datoms.external_deps(g.external_refs))

# --- services

_SENDS = "with s as (select event_id as send_id, 'repo' || user_id % 3 as repo_id, '/api/v' || event_id % 4 || '/x' as target, case event_id % 5 when 0 then null when 1 then 'Orders' when 2 then 'pay' when 3 then 'zzz' else 'the-users-service' end as service_name from events where event_type = 'signup'), q as (select event_id as request_id, case event_id % 4 when 0 then 'orders' when 1 then 'payments' when 2 then 'users' else 'repo1' end as repo_id, '/api/v' || event_id % 3 as route_pattern from events where event_type = 'error'), "


def _services(spark, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    sends = e.filter("event_type = 'signup'").selectExpr("event_id as send_id", "concat('repo', user_id % 3) as repo_id", "concat('/api/v', event_id % 4, '/x') as target", "case event_id % 5 when 0 then null when 1 then 'Orders' when 2 then 'pay' when 3 then 'zzz' else 'the-users-service' end as service_name")
    requests = e.filter("event_type = 'error'").selectExpr("event_id as request_id", "case event_id % 4 when 0 then 'orders' when 1 then 'payments' when 2 then 'users' else 'repo1' end as repo_id", "concat('/api/v', event_id % 3) as route_pattern")
    return resolution.match_services(sends, requests)


query("match_services", _SENDS + "f as (select s.send_id, s.target, min(q.repo_id) as target_repo from s join (select distinct repo_id from q) q on q.repo_id <> s.repo_id and (contains(lower(q.repo_id), lower(s.service_name)) or contains(lower(s.service_name), lower(q.repo_id))) group by 1, 2) select f.send_id, f.target_repo, (select min(request_id) from q where q.repo_id = f.target_repo and contains(f.target, q.route_pattern)) as request_id from f")(lambda g, spark, d: _services(spark, d))

# --- written tables


def _path(spark) -> str:
    return f"{shared_dir(spark)}/codegrain-table-{uuid.uuid4().hex}"


@query("written_nodes", "select kind, count(*) as count from nodes group by 1", "nodes")
def _written_nodes(g: Graph, spark, _: str) -> DataFrame:
    path = _path(spark)
    seeds.write(g.nodes.filter("kind = 'class'"), path)
    seeds.write(g.nodes, path, meta={"packages": 2})
    return seeds.load(spark, path).groupBy("kind").agg(F.count("*").alias("count"))


@query("packages_read", "select case when split_part(entity_id, ':', 2) = 'vendors' then 'vendors' else 'clicks' end as package, count(*) as nodes, count(*) filter (where split_part(entity_id, ':', 2) = 'vendors' and is_exported) as exported from nodes where split_part(entity_id, ':', 2) in ('vendors', 'clicks') group by 1", "nodes")
def _packages_read(g: Graph, spark, _: str) -> DataFrame:
    """Two packages of different columns, found below a folder and read by name."""
    root = _path(spark)
    for package, columns in (("vendors", ["entity_id", "is_exported"]), ("clicks", ["entity_id"])):
        g.nodes.filter(F.split_part("entity_id", F.lit(":"), F.lit(2)) == package).select(columns).write.parquet(f"{root}/{package}/nodes.parquet")
    found = seeds.package_tables(spark, seeds.discover(spark, root))
    text = "select * from nodes@*"
    rows = seeds.query(spark, text, **found)
    return rows.groupBy(F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("package")).agg(F.count("*").alias("nodes"), F.count_if("is_exported").alias("exported"))


@query("package_view", "select count(*) as nodes from nodes where kind = 'class'", "nodes")
def _package_view(g: Graph, spark, _: str) -> DataFrame:
    root = _path(spark)
    g.nodes.filter("kind = 'class'").select("entity_id").write.parquet(f"{root}/apps/vendors-1/nodes.parquet")
    g.nodes.filter("kind = 'hook'").select("entity_id").write.parquet(f"{root}/clicks/nodes.parquet")
    return seeds.query(spark, "select count(*) as nodes from nodes@apps/vendors-1", **seeds.package_tables(spark, seeds.discover(spark, root)))


@query("read_with_files", "select kind, count(*) as count from nodes where kind in ('class', 'hook') group by 1", "nodes")
def _read_with_files(g: Graph, spark, _: str) -> DataFrame:
    root = _path(spark)
    for kind in ("class", "hook"):
        g.nodes.filter(F.col("kind") == kind).select("entity_id", "kind").write.parquet(f"{root}/{kind}.parquet")
    rows, warnings = seeds.read(spark, [f"{root}/{k}.parquet" for k in ("class", "hook", "gone")], g.nodes.select("entity_id", "kind").schema, filename=True)
    assert warnings == ["1 of 3 packages have no data"]
    return rows.groupBy(F.regexp_extract("filename", "/([a-z]+)[.]parquet/", 1).alias("kind")).agg(F.count("*").alias("count"))


for _format in ("csv", "json"):

    def _sink(g: Graph, spark, _: str, form: str = _format) -> DataFrame:
        path = _path(spark)
        rows = g.nodes.filter("kind = 'class'").select("entity_id", "name", "documentation")
        (seeds.write_csv if form == "csv" else seeds.write_json)(rows, path)
        return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path) if form == "csv" else spark.read.schema(rows.schema).json(path)

    query(f"written_{_format}", "select entity_id, name, documentation from nodes where kind = 'class'", "nodes")(_sink)
