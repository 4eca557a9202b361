"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.operators import datoms, effects, hub, overlay, resolution, rules, symbols, traversal, views, wcag
from codegrain.plans.projection import Graph, project, with_views
from codegrain.sources import seeds
from codegrain.streaming import changes

_Q: dict[str, tuple[Callable, str | None, tuple[str, ...]]] = {}


def query(name: str, sql: str | None, *needs: str):
    """Register a function of a Graph (and the session and folder) with its SQL over the named views."""

    def put(f: Callable):
        _Q[name] = (f, sql, needs)
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from codegrain.plans import further  # noqa: F401  it registers its queries here

    return {n: (lambda spark, sf_dir, f=f: f(project(spark, sf_dir), spark, sf_dir)) for n, (f, _, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {n: with_views(sql, *needs) if needs else sql for n, (_, sql, needs) in _Q.items() if sql}


# --- symbols and schema

_SUMMARY = "entity_id, name, kind, split_part(entity_id, ':', 1) || '/' || file_path as file, start_line as line"
_DETAILS = _SUMMARY + ", end_line, qualified_name, is_exported, visibility, type_signature, documentation"

query("schema_kinds", "select kind, count(*) as count, cast(count(*) filter (where is_exported) as bigint) as exported_count from nodes group by kind", "nodes")(lambda g, *_: symbols.schema_kinds(g.nodes))
query("schema_edges", "select edge_type, count(*) as count from edges group by edge_type", "edges")(lambda g, *_: symbols.schema_edges(g.edges))
query("schema_stats", "select (select count(*) from nodes) as nodes, (select count(distinct file_path) from nodes) as files, (select count(distinct split_part(entity_id, ':', 2)) from nodes) as packages, (select count(*) from edges) as edges", "nodes", "edges")(lambda g, *_: symbols.schema_stats(g.nodes, g.edges))
query("schema_tables", "select 'nodes' as table_name, count(*) as row_count from nodes union all select 'edges', count(*) from edges union all select 'effects', count(*) from effects union all select 'external_refs', count(*) from external_refs", "nodes", "edges", "effects", "external_refs")(lambda g, *_: symbols.schema_tables(nodes=g.nodes, edges=g.edges, effects=g.effects, external_refs=g.external_refs).drop("columns"))
query("symbol_find_glob", f"select {_SUMMARY} from (select * from nodes where name like 'order\\_1%' escape '\\' order by file_path nulls last, start_line, entity_id limit 200 offset 20)", "nodes")(lambda g, *_: symbols.symbol_find(g.nodes, name="order_1*", limit=200, offset=20))
query("symbol_find_counts", "select kind, count(*) as count from nodes where is_exported and entity_id like 'supply:%' group by kind", "nodes")(lambda g, *_: symbols.symbol_find(g.nodes, "counts", repo="supply", exported=True))
query("symbol_find_details", f"select {_DETAILS} from (select * from nodes where kind = 'function' and file_path like 'Brand#1%' order by file_path, start_line, entity_id limit 1000)", "nodes")(lambda g, *_: symbols.symbol_find(g.nodes, "details", kind="function", file="Brand#1*", limit=1000))
query("symbol_get", f"select {_DETAILS} from nodes where entity_id = 'supply:catalog:function:7'", "nodes")(lambda g, *_: symbols.symbol_get(g.nodes, "supply:catalog:function:7"))
query("symbol_file", f"select {_SUMMARY} from (select * from nodes where file_path = 'hooks/3.tsx' order by start_line, entity_id limit 100)", "nodes")(lambda g, *_: symbols.symbol_file(g.nodes, "hooks/3.tsx"))
query("doc_coverage", "select file_path, count(*) as symbols, count(documentation) as documented, cast(round(count(documentation) * 100.0 / count(*), 1) as double) as coverage from nodes group by file_path having count(*) >= 5", "nodes")(lambda g, *_: symbols.doc_coverage(g.nodes, 5))
query("kind_shares", "select kind, count(*) as count, cast(round(count(*) * 100.0 / sum(count(*)) over (), 2) as double) as percent from nodes group by kind", "nodes")(lambda g, *_: symbols.kind_shares(g.nodes))
query("decorator_usage", "select decorator, count(*) as uses from (select unnest(decorators) as decorator from nodes) group by decorator", "nodes")(lambda g, *_: symbols.decorator_usage(g.nodes))
query("duplicate_names", "select name, count(*) as count, count(distinct split_part(entity_id, ':', 2)) as packages from (select entity_id, substr(name, 1, 1) as name from nodes) group by name having count(distinct split_part(entity_id, ':', 2)) > 1", "nodes")(lambda g, *_: symbols.duplicate_names(g.nodes.withColumn("name", F.substring("name", 1, 1))))
query("unused_exports", "select entity_id, name, kind from nodes n where is_exported and not exists (select 1 from edges e where e.edge_type = 'IMPORTS' and e.target_entity_id = n.entity_id)", "nodes", "edges")(lambda g, *_: symbols.unused_exports(g.nodes, g.edges))
query("most_called", "select target_entity_id, count(*) as calls from edges where edge_type = 'CALLS' group by 1 order by calls desc, 1 limit 20", "edges")(lambda g, *_: symbols.most_called(g.edges))
query("orphan_edges", "select count(*) as orphans from (select source_entity_id, target_entity_id from edges union all select 'gone:' || source_entity_id, target_entity_id from clicks) e where not exists (select 1 from nodes n where n.entity_id = e.source_entity_id)", "nodes", "edges", "clicks")(lambda g, *_: symbols.orphan_edges(g.edges.select("source_entity_id", "target_entity_id").unionByName(g.clicks.select(F.concat(F.lit("gone:"), "source_entity_id").alias("source_entity_id"), "target_entity_id")), g.nodes).agg(F.count("*").alias("orphans")))
query("integrity", "select (select count(*) from nodes) as node_count, (select count(distinct file_path) from nodes) as file_count, (select count(*) from edges) as edge_count, (select count(*) from external_refs) as ref_count, (select count(*) from external_refs where not is_resolved) as unresolved_count, (select count(*) from edges e where not exists (select 1 from nodes n where n.entity_id = e.source_entity_id)) as orphan_count", "nodes", "edges", "external_refs")(lambda g, *_: symbols.integrity(g.nodes, g.edges, g.external_refs))
query("edges_named", "select e.edge_type, s.kind as source_kind, t.kind as target_kind, count(*) as count from edges e join nodes s on s.entity_id = e.source_entity_id join nodes t on t.entity_id = e.target_entity_id group by 1, 2, 3", "nodes", "edges")(lambda g, *_: symbols.endpoints(g.edges, g.nodes).groupBy("edge_type", "source_kind", "target_kind").agg(F.count("*").alias("count")))
query("mutual_edges", "select distinct a.source_entity_id, a.target_entity_id from clicks a join clicks b on a.source_entity_id = b.target_entity_id and a.target_entity_id = b.source_entity_id where a.source_entity_id < a.target_entity_id", "clicks")(lambda g, *_: symbols.mutual_edges(g.clicks))
query("symbol_at_line", "select file_path, line, entity_id from (select p.file_path, p.line, n.entity_id, row_number() over (partition by p.file_path, p.line order by n.end_line - n.start_line, n.start_line, n.entity_id) as rn from (select distinct source_file_path as file_path, source_line as line from effects) p join nodes n on n.file_path = p.file_path and p.line between n.start_line and n.end_line) where rn = 1", "nodes", "effects")(lambda g, *_: symbols.symbol_at_line(g.nodes, g.effects.select(F.col("source_file_path").alias("file_path"), F.col("source_line").alias("line")).distinct()))

# --- traversal

_SEEDS = "select min(source_entity_id) as entity_id from clicks"


def _seed(g: Graph) -> DataFrame:
    return g.clicks.agg(F.min("source_entity_id").alias("entity_id"))


def _walk(a: str, b: str, depth: int, edges: str, closed: bool, seeds: str) -> str:
    path = f"[e.{a}, e.{b}]" if closed else f"[e.{b}]"
    return f"""with hop as (select distinct source_entity_id, target_entity_id, edge_type from {edges}), seeds as ({seeds}),
w as (select e.{a} as here, e.{b} as there, e.edge_type, {path} as path, 1 as depth from hop e join seeds s on e.{a} = s.entity_id
 union all select e.{a}, e.{b}, e.edge_type, list_append(w.path, e.{b}), w.depth + 1 from w join hop e on e.{a} = w.there where w.depth < {depth} and not list_contains(w.path, e.{b}))
"""


_S, _T = "source_entity_id", "target_entity_id"
query("graph_deps_1", f"select e.source_entity_id, e.target_entity_id, e.edge_type, 1 as depth from (select distinct source_entity_id, target_entity_id, edge_type from edges) e where e.source_entity_id = 'geo:atlas:module:3'", "edges")(lambda g, spark, _: traversal.graph_deps(g.edges, ["geo:atlas:module:3"]))
query("graph_deps_cyclic", _walk(_S, _T, 3, "clicks", False, _SEEDS) + "select here as source_entity_id, there as target_entity_id, edge_type, min(depth) as depth from w group by 1, 2, 3", "clicks")(lambda g, *_: traversal.graph_deps(g.clicks, _seed(g), 3))
query("graph_dependents_cyclic", _walk(_T, _S, 2, "clicks", False, _SEEDS) + "select there as source_entity_id, here as target_entity_id, edge_type, min(depth) as depth from w group by 1, 2, 3", "clicks")(lambda g, *_: traversal.graph_dependents(g.clicks, _seed(g), 2))
query("graph_deps_layers", _walk(_S, _T, 4, "edges", False, "select 'geo:atlas:namespace:1' as entity_id") + "select edge_type, depth, count(*) as edges from (select here, there, edge_type, min(depth) as depth from w group by 1, 2, 3) group by 1, 2", "edges")(lambda g, spark, _: traversal.graph_deps(g.edges, ["geo:atlas:namespace:1"], 4).groupBy("edge_type", "depth").agg(F.count("*").alias("edges")))
query("call_graph", _walk(_S, _T, 2, "clicks", True, _SEEDS) + ", m as (select distinct there, depth from w where here <> there) select n.entity_id, m.depth, n.name, n.kind, n.file_path from m join nodes n on n.entity_id = m.there order by m.depth, n.name, n.entity_id limit 100", "clicks", "nodes")(lambda g, *_: traversal.call_graph(g.clicks, g.nodes, _seed(g), 2))
query("graph_imports", "select e.source_entity_id, e.target_entity_id, n.name as target_name, n.kind as target_kind from edges e left join nodes n on n.entity_id = e.target_entity_id where e.edge_type in ('IMPORTS', 'RE_EXPORTS')", "edges", "nodes")(lambda g, *_: traversal.graph_imports(g.edges, g.nodes).select("source_entity_id", "target_entity_id", "target_name", "target_kind"))
query("affected", f"with seeds as ({_SEEDS}), a as (select distinct e.source_entity_id as id from clicks e join seeds s on e.target_entity_id = s.entity_id where e.source_entity_id <> s.entity_id), b as (select distinct e.source_entity_id as id from clicks e join a on e.target_entity_id = a.id where e.source_entity_id not in (select id from a) and e.source_entity_id not in (select entity_id from seeds)) select id as entity_id, 1 as depth, split_part(id, ':', 1) as repo, true as is_direct from a union all select id, 2, split_part(id, ':', 1), false from b", "clicks")(lambda g, *_: traversal.affected(g.clicks, _seed(g), 2))

# --- effects

query("effect_statistics", "select count(*) as total, count(*) filter (where effect_type = 'FunctionCall') as functioncall, count(*) filter (where effect_type = 'Store') as store, count(*) filter (where effect_type = 'Retrieve') as retrieve, count(*) filter (where effect_type = 'Send') as send, count(*) filter (where effect_type = 'Request') as request, count(*) filter (where effect_type = 'Response') as response, count(*) filter (where is_external) as external, count(distinct source_entity_id) as sources, count(distinct coalesce(target_resource, target)) as targets from effects", "effects")(lambda g, *_: effects.statistics(g.effects))
query("effects_page", "select effect_id, effect_type, source_entity_id from effects where effect_type in ('Store', 'Send') order by timestamp desc, effect_id limit 50 offset 10", "effects")(lambda g, *_: effects.page(effects.effects_where(g.effects, types=["Store", "Send"]), 50, 10).select("effect_id", "effect_type", "source_entity_id"))
query("effects_filtered", "select effect_id, callee_name from effects where is_external and is_async and callee_name like '%put%'", "effects")(lambda g, *_: effects.effects_where(g.effects, external=True, asynchronous=True, callee="put").select("effect_id", "callee_name"))
query("effects_summary_file", "select source_file_path, count(*) as count from effects group by 1", "effects")(lambda g, *_: effects.summary(g.effects, "source_file_path"))
query("callee_patterns", "select callee_name, is_method_call, is_async, is_external, external_module, count(*) as count from effects where effect_type = 'FunctionCall' group by all having count(*) >= 3", "effects")(lambda g, *_: effects.callee_patterns(g.effects, 3))
query("workspace_effects", "select split_part(source_entity_id, ':', 1) as repo, count(*) filter (where lower(effect_type) = 'store') as store, count(*) filter (where lower(effect_type) = 'retrieve') as retrieve, count(*) filter (where lower(effect_type) in ('send', 'external')) as external, count(*) filter (where lower(effect_type) not in ('store', 'retrieve', 'send', 'external')) as other from effects group by 1", "effects")(lambda g, *_: effects.workspace_counts(g.effects))
for _name, _by, _column in (("cross_patterns_files", "source_file_path", "source_file_path"), ("cross_patterns_repos", "split_part(source_entity_id, ':', 1)", "repo")):
    query(_name, f"with n as (select {_by} as grp, callee_name, count(*) as n from effects where callee_name is not null group by 1, 2), r as (select *, row_number() over (partition by grp order by n desc, callee_name) as rn from n) select callee_name, count(*) as groups, cast(sum(n) as bigint) as total from r where rn <= 100 group by 1 having count(*) >= 2", "effects")(lambda g, *_, column=_column: effects.cross_patterns(g.effects.withColumn("repo", symbols.repo_of(F.col("source_entity_id"))), column))
query("async_by_file", "select source_file_path, count(*) filter (where is_async) as async_calls, count(*) filter (where not is_async) as sync_calls from effects where effect_type = 'FunctionCall' group by 1", "effects")(lambda g, *_: effects.async_by_file(g.effects))
query("effects_enriched", "select e.effect_type, coalesce(n.kind, 'unknown') as source_kind, count(*) as count from effects e left join nodes n on n.entity_id = e.source_entity_id group by 1, 2", "effects", "nodes")(lambda g, *_: effects.enriched(g.effects, g.nodes).groupBy("effect_type", "source_kind").agg(F.count("*").alias("count")))

# --- rules and views


def _case(column: str) -> str:
    """DuckDB CASE chain of the built-in rules."""
    def when(r: rules.Rule) -> str:
        pattern, flags = (r.callee[4:], "i") if r.callee.startswith("(?i)") else (r.callee, "c")
        more = " and is_external" if r.external else ""
        return f"when effect_type = 'FunctionCall' and regexp_matches(callee_name, '{pattern}', '{flags}'){more} then '{getattr(r, column) or ''}'"

    return "nullif(case " + " ".join(when(r) for r in rules.ordered(rules.BUILTIN)) + " end, '')"


_PATHS = ("src/parsers/ts.ts", "src/storage/pool.ts", "src/hub/client.ts", "src/commands/run.ts", "src/rules/list.ts", "src/views/page.ts", "src/cache/lru.ts", "src/utils/debug/x.ts", "src/app.test.ts", "src/main.ts")
_PATH = "case source_line % 10 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PATHS)) + " end"


def _pathed(effects: DataFrame) -> DataFrame:
    """Effects with paths that the grouping and significance rules know."""
    return effects.withColumn("source_file_path", F.expr(_PATH))


_GROUP = "case " + " ".join(f"when regexp_matches(path, '{r[1]}', 'i') then '{r[2]}'" for r in sorted(rules.GROUPING_RULES, key=lambda r: -r[5])) + " else 'Other' end"


def _level(rule: tuple) -> str:
    said = {"domain": "domain = '{}'", "action": "action = '{}'", "console": "provider = 'console'", "file": "regexp_matches(path, '{}', 'i')", "name": "regexp_matches(n.name, '{}', 'i')", "exported": "coalesce(n.is_exported, false) = {}", "min_dependents": "coalesce(k.dependents, 0) >= {}"}
    parts = ["n.kind in (" + ", ".join(f"'{x}'" for x in v) + ")" if c == "kinds" else said[c].format(str(v).lower() if c == "exported" else v) for c, v in rule[3].items()]
    return f"when {' and '.join(parts)} then '{rule[1]}'"


_LEVEL = "case " + " ".join(_level(r) for r in sorted(rules.SIGNIFICANCE_RULES, key=lambda r: -r[2])) + " else 'minor' end"
_RULED = f"with d as (select *, {_case('id')} as rule_id, {_case('domain')} as domain, {_case('action')} as action, {_case('provider')} as provider from effects), h as (select *, {_GROUP} as container from (select *, {_PATH} as path from d where rule_id is not null)) "
query("run_rules", _RULED + "select effect_id, rule_id, domain, action, provider from h", "effects")(lambda g, *_: rules.run_rules(g.effects).select("effect_id", "rule_id", "domain", "action", "provider"))
query("rule_stats", _RULED + "select i.rule_id, count(h.rule_id) as matches from (select unnest([" + ", ".join(f"'{r.id}'" for r in rules.BUILTIN) + "]) as rule_id) i left join h on h.rule_id = i.rule_id group by 1", "effects")(lambda g, *_: rules.rule_stats(g.effects))
query("domain_summary", _RULED + "select domain, array_to_string(list_sort(list(distinct action)), ',') as actions, count(*) as count from h group by 1", "effects")(lambda g, *_: views.domain_summary(rules.run_rules(g.effects)))
query("containers", _RULED + "select container, count(distinct source_entity_id) as components, count(*) as effects, array_to_string(list_sort(list(distinct domain)), ',') as domains from h group by 1", "effects")(lambda g, *_: views.containers(rules.grouped(_pathed(rules.run_rules(g.effects)))))
query("external_systems", _RULED + "select domain, provider, count(*) as count from h where is_external and provider is not null group by 1, 2", "effects")(lambda g, *_: views.external_systems(rules.run_rules(g.effects)))
query("significance", _RULED + f", k as (select target_entity_id, count(*) as dependents from clicks group by 1) select {_LEVEL} as significance, count(*) as count from h left join k on k.target_entity_id = h.source_entity_id left join nodes n on n.entity_id = h.source_entity_id group by 1", "effects", "clicks", "nodes")(lambda g, *_: rules.significance(_pathed(rules.run_rules(g.effects)), g.clicks.groupBy(F.col("target_entity_id").alias("source_entity_id")).agg(F.count("*").alias("dependents")), g.nodes).groupBy("significance").agg(F.count("*").alias("count")))
query("internal_relationships", "select s.c as source, t.c as target, count(*) as calls from edges e join (select entity_id, kind as c from nodes) s on s.entity_id = e.source_entity_id join (select entity_id, kind as c from nodes) t on t.entity_id = e.target_entity_id where e.edge_type = 'CALLS' and s.c <> t.c group by 1, 2", "edges", "nodes")(lambda g, *_: views.internal_relationships(g.edges, g.nodes.select("entity_id", F.col("kind").alias("container"))))
query("f1_of_sets", "with a as (select distinct source_entity_id as k from edges where edge_type = 'CONTAINS'), p as (select distinct target_entity_id as k from edges where edge_type = 'CONTAINS'), n as (select count(*) filter (where a.k is not null and p.k is not null) as tp, count(*) filter (where a.k is null) as fp, count(*) filter (where p.k is null) as fn from a full join p on a.k = p.k), r as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as recall from n) select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from r", "edges")(lambda g, *_: (lambda e: views.f1(e.select(F.col("source_entity_id").alias("k")), e.select(F.col("target_entity_id").alias("k")), "k"))(g.edges.filter("edge_type = 'CONTAINS'")))

# --- overlay and merges


query("resolve_refs", "select module_specifier, count(*) as refs, count(*) filter (where is_resolved or try_cast(substr(imported_symbol, 4) as int) % 2 = 0) as resolved from external_refs group by 1", "external_refs")(lambda g, *_: overlay.resolve(g.external_refs, g.external_refs.select("imported_symbol").distinct().filter("cast(substr(imported_symbol, 4) as int) % 2 = 0").withColumn("resolved_id", F.concat(F.lit("to:"), "imported_symbol")), ["imported_symbol"]).groupBy("module_specifier").agg(F.count("*").alias("refs"), F.count_if("is_resolved").alias("resolved")))

#: Branches over whole tables, without a row left out: per table the columns that a branch changes (a key under a condition, so that rows
#: are added and removed, and a value), its tombstones, and the columns of file, value and age.
_BRANCHES = {
    "nodes": ({"entity_id": "case when is_exported then 'branch:' || entity_id else entity_id end", "name": "case when visibility = 'private' then 'new_' || name else name end"}, "is_abstract and is_default_export", "file_path", "name", "start_line"),
    "edges": ({"target_entity_id": "case when source_line > 60 then 'branch:' || target_entity_id else target_entity_id end", "source_line": "case when source_line < 30 then source_line + 100 else source_line end"}, "source_line between 30 and 34 and edge_type <> 'CALLS'", "source_file_path", "source_line", "source_line"),
    "external_refs": ({"imported_symbol": "case when is_reexport then 'branch:' || imported_symbol else imported_symbol end", "source_line": "case when is_type_only then source_line + 100 else source_line end"}, "is_reexport and module_specifier like './%'", "source_file_path", "source_line", "source_line"),
    "effects": ({"effect_id": "case when coalesce(is_external, false) then 'branch:' || effect_id else effect_id end", "effect_type": "case when source_line < 30 then 'new_' || effect_type else effect_type end"}, "source_line < 10 and source_file_path < 'hooks/4'", "source_file_path", "effect_type", "source_line"),
}


def _branch_pairs(g: Graph):
    """(table, base, branch, keys, file, value, age) of each table."""
    for t, (changes_, gone, *columns) in _BRANCHES.items():
        base = getattr(g, t).withColumn("is_deleted", F.lit(False))
        yield t, base, base.withColumns({c: F.expr(e) for c, e in changes_.items()} | {"is_deleted": F.expr(gone)}), overlay.KEYS[t], *columns


def _over_all(g: Graph, f: Callable[..., DataFrame], *more: str) -> DataFrame:
    """f's rows of every table: table_name, key, and value or the columns in more."""
    out = None
    for t, base, branch, keys, file, value, age in _branch_pairs(g):
        key = F.concat_ws("|", *keys).alias("key")
        rows = f(base, branch, keys, file, value, age).select(F.lit(t).alias("table_name"), key, *(more or [F.col(value).cast("string").alias("value")]))
        out = rows if out is None else out.unionByName(rows)
    return out


def _sides() -> str:
    sides = {"base": [], "branch": []}
    for t, (changed, gone, file, value, age) in _BRANCHES.items():
        for side, new, deleted in (("base", {}, "false"), ("branch", changed, gone)):
            key = ", ".join(new.get(c, c) for c in overlay.KEYS[t])
            sides[side].append(f"select '{t}' as table_name, concat_ws('|', {key}) as key, {file} as file, cast({new.get(value, value)} as varchar) as value, {new.get(age, age)} as age, {deleted} as is_deleted from {t}")
    return "with " + ", ".join(f"{k} as ({' union all '.join(v)})" for k, v in sides.items()) + " "


def _newest(rows: DataFrame, keys: list[str], age: str) -> DataFrame:
    return overlay.first_of(rows, keys, F.desc(age))


_SIDES, _GONE, _FOUR = _sides(), "select 1 from branch r where r.is_deleted and r.table_name = b.table_name and r.file = b.file", ("nodes", "edges", "external_refs", "effects")
query("overlay_all", _SIDES + "select table_name, key, value from branch where not is_deleted union all select table_name, key, value from base b where not exists (select 1 from branch r where r.table_name = b.table_name and r.key = b.key)", *_FOUR)(lambda g, *_: _over_all(g, lambda base, branch, keys, *_: overlay.overlay(base, branch, keys)))
query("upsert_all", _SIDES + "select table_name, key, value from (select *, row_number() over (partition by table_name, key order by age desc, src desc) as rn from (select *, 0 as src from base union all select *, 1 from branch)) where rn = 1", *_FOUR)(lambda g, *_: _over_all(g, lambda base, branch, keys, file, value, age: overlay.upsert(base, branch, keys, F.col(age))))
query("diff_all", _SIDES + ", ".join(["", *(f"{n} as (select * from (select *, row_number() over (partition by table_name, key order by age desc) as rn from {t}) where rn = 1)" for n, t in (("a", "base"), ("b", "branch")))]) + " select coalesce(a.table_name, b.table_name) as table_name, coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' else 'modified' end as change from a full join b on a.table_name = b.table_name and a.key = b.key where a.key is null or b.key is null or a.value is distinct from b.value", *_FOUR)(lambda g, *_: _over_all(g, lambda base, branch, keys, file, value, age: overlay.diff(_newest(base, keys, age), _newest(branch, keys, age), keys, [value]), "change"))
query("incremental_merge_all", _SIDES + f"select table_name, key, value from base b where not exists ({_GONE}) union all select table_name, key, value from branch b where not is_deleted and exists ({_GONE})", *_FOUR)(lambda g, *_: _over_all(g, lambda base, branch, keys, file, *_: (lambda gone: overlay.merge_files(base, gone, branch.filter("not is_deleted").join(gone, file, "left_semi"), file))(branch.filter("is_deleted").select(file).distinct())))
query("tombstones_all", _SIDES + f"select table_name, key, value from base b where exists ({_GONE})", *_FOUR)(lambda g, *_: _over_all(g, lambda base, branch, keys, file, *_: overlay.tombstones(base, branch.filter("is_deleted"), file)))

# --- hub

query("diagnostics_query", "select diagnostic_id, severity, source from diagnostics where not resolved and severity in ('critical', 'error') and source = 'eslint' order by case severity when 'critical' then 0 else 1 end, updated_at desc, diagnostic_id limit 100", "diagnostics")(lambda g, *_: hub.diagnostics_ordered(hub.diagnostics_where(g.diagnostics, False, severity=["critical", "error"], source=["eslint"])).select("diagnostic_id", "severity", "source"))
for _by in ("source", "severity", "category", "repo_id"):
    query(f"diagnostics_by_{_by}", f"select {_by}, " + ", ".join(f"count(*) filter (where severity = '{s}') as {'n_' * (_by == 'severity') + s}" for s in hub.SEVERITIES) + f", count(*) as total from diagnostics where not resolved group by 1", "diagnostics")(lambda g, *_, by=_by: hub.diagnostics_summary(g.diagnostics, by).withColumnsRenamed({s: f"n_{s}" for s in hub.SEVERITIES} if by == "severity" else {}))
query("diagnostics_counts", "select count(*) as total, count(*) filter (where not resolved) as unresolved, " + ", ".join(f"count(*) filter (where not resolved and severity = '{s}') as {s}" for s in hub.SEVERITIES) + " from diagnostics", "diagnostics")(lambda g, *_: hub.diagnostics_counts(g.diagnostics))
query("validation_summary", "select file_path, count(*) filter (where severity in ('critical', 'error')) as errors, count(*) filter (where severity = 'warning') as warnings, count(*) as total from diagnostics group by 1", "diagnostics")(lambda g, *_: hub.validation_summary(g.diagnostics, "file_path"))
query("mark_resolved", "select source, count(*) filter (where resolved or severity = 'note') as resolved from diagnostics group by 1", "diagnostics")(lambda g, *_: hub.mark_resolved(g.diagnostics, g.diagnostics.filter("severity = 'note'")).groupBy("source").agg(F.count_if("resolved").alias("resolved")))
query("resolution_stats", "select source_file_path, count(*) as total, count(*) filter (where is_resolved) as resolved, cast(round(count(*) filter (where is_resolved) * 100.0 / count(*), 1) as double) as percent from external_refs group by 1", "external_refs")(lambda g, *_: hub.resolution_stats(g.external_refs))
query("evaluation", "with s as (select case when doc_id % 2 = 0 then 'baseline' else 'enhanced' end as mode, quality, toxic from labels), l as (select mode, 'quality' as dimension, quality as score from s union all select mode, 'toxic', toxic from s), n as (select dimension, coalesce(avg(score) filter (where mode = 'baseline'), 0) as b, coalesce(avg(score) filter (where mode = 'enhanced'), 0) as e from l group by 1) select dimension, round(b, 6) as baseline, round(e, 6) as enhanced, round(e - b, 6) as delta from n")(lambda g, spark, d: hub.evaluation(_table(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "baseline").otherwise("enhanced").alias("mode"), "quality", "toxic"), ["quality", "toxic"]))

# --- attribute rows, pages, free SQL, change streams

_DATOMS = "with datoms as (" + " union all ".join(f"select entity_id as e, ':node/{a}' as a, {a} as v from nodes where {a} is not null" for a in datoms.ATTRIBUTES) + ") "
query("datom_counts", _DATOMS + "select a, count(*) as datoms, count(distinct e) as entities from datoms group by 1", "nodes")(lambda g, *_: datoms.attribute_counts(datoms.node_datoms(g.nodes)))
query("datom_entity", _DATOMS + "select a, v from datoms where e = 'supply:catalog:function:11'", "nodes")(lambda g, *_: datoms.entity(datoms.node_datoms(g.nodes), "supply:catalog:function:11"))
query("datom_by_value", _DATOMS + "select distinct e from datoms where a = ':node/visibility' and v = 'private'", "nodes")(lambda g, *_: datoms.with_attribute(datoms.node_datoms(g.nodes), ":node/visibility", "private"))
query("datom_reverse_refs", "select distinct source_entity_id as e from edges where target_entity_id = 'supply:catalog:function:5'", "edges")(lambda g, *_: datoms.reverse_refs(datoms.edge_datoms(g.edges), "supply:catalog:function:5"))


#: The test pages break no rule: every page but each third has tags swapped for ones that do, by the same expression in both engines.
_SWAPS = (("<ul", "<dl"), ("<b>", '<img src="x">'), ("<br", "<h5"), ("<article", '<div role="article" onclick="x" tabindex="2"'), ("<nav", '<input id="q"'), ("<footer", '<th>a</th><th'), ("<h1", '<button aria-hidden="true" data-icon="i"></button><a href="/y"></a><p aria-labelledby="gone" onclick="y"></p><h1'))
_BROKEN = "html"
for _from, _to in _SWAPS:
    _BROKEN = f"replace({_BROKEN}, '{_from}', '{_to}')"
_BROKEN = f"case when page_id % 3 = 0 then html else {_BROKEN} end"


def _wcag_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    columns = ", ".join(f"case when regexp_matches(tag, '{quoted(wcag.attribute_pattern(a))}') then regexp_extract(tag, '{quoted(wcag.attribute_pattern(a))}', 1) end as {c}" for c, a in wcag.ATTRIBUTES.items())
    names = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    named = "(trim(coalesce(aria_label, '')) <> '' or coalesce(list_contains(page_ids, aria_labelledby), false))"
    labelled = "(coalesce(aria_label, '') <> '' or coalesce(aria_labelledby, '') <> '')"
    native = "name in ('a', 'button', 'label', 'input', 'select', 'textarea')"
    rules = {
        "wcag-keyboard-accessible": f"on_click is not null and on_key is null and not {native} and role is null",
        "wcag-accessible-name": f"on_click is not null and not {native} and coalesce(role, '') <> '' and not {named}",
        "wcag-valid-aria-reference": "coalesce(aria_labelledby, '') <> '' and not coalesce(list_contains(page_ids, aria_labelledby), false)",
        "wcag-no-positive-tabindex": "try_cast(tab_index as int) > 0",
        "wcag-button-has-text": f"(name = 'button' or role = 'button') and not {named} and not has_text and not {labelled} and icon <> ''",
        "wcag-form-label": f"name in {names(wcag.LABELABLE)} and coalesce(type, '') <> 'hidden' and not {labelled} and not (coalesce(element_id, '') <> '' and coalesce(list_contains(labelled_ids, element_id), false))",
        "wcag-heading-order": "level > heading_before + 1",
        "wcag-semantic-elements": f"name in ('div', 'span') and role in {names(wcag.SEMANTIC_ROLES)}",
        "wcag-aria-hidden-focus": f"(try_cast(tab_index as int) >= 0 or name in {names(wcag.FOCUSABLE)} or (name = 'a' and href is not null)) and aria_hidden = 'true'",
        "wcag-list-structure": "name = 'li' and lists_before = 0",
        "wcag-image-alt": f"name = 'img' and alt is null and not {labelled} and coalesce(role, '') not in ('presentation', 'none') and coalesce(aria_hidden, '') <> 'true'",
        "wcag-link-name": f"name = 'a' and href <> '' and not {named} and not has_text and coalesce(title, '') = ''",
        "wcag-table-headers": "name = 'th' and coalesce(scope, '') = '' and page_headers > 1",
    }
    info = ", ".join(f"('{r}', '{c}', '{v}')" for r, c, v in wcag.RULES)
    found = " union all ".join(f"select page_id, '{r}' as rule_id from c where {w}" for r, w in rules.items())
    return rf"""with t as (select page_id, generate_subscripts(m, 1) as pos, unnest(m) as piece from (select page_id, regexp_extract_all(html, '<[A-Za-z][^>]*>[^<]*') as m from (select page_id, {_BROKEN} as html from pages))),
g as (select page_id, pos, regexp_extract(piece, '^(<[^>]*>)', 1) as tag, lower(regexp_extract(piece, '^<([A-Za-z][A-Za-z0-9]*)', 1)) as name, regexp_matches(regexp_extract(piece, '^<[^>]*>([^<]*)', 1), '\S') as has_text from t),
e as (select *, {columns} from g), l as (select *, case when regexp_matches(name, '^h[1-6]$') then cast(substr(name, 2, 1) as int) end as level from e),
c as (select *, list(element_id) filter (where element_id is not null) over (partition by page_id) as page_ids, list(html_for) filter (where name = 'label' and html_for is not null) over (partition by page_id) as labelled_ids,
 count(*) filter (where name = 'th') over (partition by page_id) as page_headers, count(*) filter (where name in ('ul', 'ol', 'menu')) over (partition by page_id order by pos rows unbounded preceding) as lists_before,
 last_value(level ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding) as heading_before from l),
f as ({found}), k(rule_id, criterion, severity) as (values {info})
select f.rule_id, k.criterion, k.severity, count(*) as issues, count(distinct f.page_id) as pages from f join k on k.rule_id = f.rule_id group by 1, 2, 3"""


query("wcag_issues", _wcag_sql())(lambda g, spark, d: wcag.issues(_table(spark, d, "pages").select("page_id", F.expr(_BROKEN).alias("html"))))
query("raw_sql", "select kind, count(*) as n from nodes where is_async group by kind", "nodes")(lambda g, spark, _: seeds.query(spark, "select kind, count(*) as n from nodes@* where is_async group by kind", nodes=g.nodes))


def _file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"), kind.alias("event"), F.col("props").alias("hash"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("changed_content", "with f as (select 'src/f' || user_id || '.ts' as path, case event_type when 'signup' then 'add' when 'error' then 'unlink' else 'change' end as event, props as hash, ts from events), k as (select *, lag(case when event <> 'unlink' then hash end) over (partition by path order by ts, event) as known from f) select event, count(*) as events from k where event <> 'change' or hash is distinct from known group by 1")
def _changed(g: Graph, spark: SparkSession, d: str) -> DataFrame:
    return changes.changed_content(_file_events(spark, d)).groupBy("event").agg(F.count("*").alias("events"))


@query("debounced_bursts", "with f as (select 'src/f' || user_id || '.ts' as path, ts from events), k as (select *, case when ts < lag(ts) over (partition by path order by ts) + interval 6 hour then 0 else 1 end as fresh from f), b as (select path, sum(fresh) over (partition by path order by ts rows unbounded preceding) as burst from k), n as (select path, burst, count(*) as events from b group by 1, 2) select events, count(*) as bursts from n group by 1")
def _bursts(g: Graph, spark: SparkSession, d: str) -> DataFrame:
    return changes.debounced(_file_events(spark, d), "6 hours").groupBy("events").agg(F.count("*").alias("bursts"))


# --- resolution


#: What a name may be used as, and the kinds that it then resolves to.
_USED_AS = {"call": resolution.CALLABLE, "extends": ("class",), "implements": ("interface",)}
_USES = "with u as (select entity_id as use_id, name, case when visibility = 'private' then 'elsewhere.ts' else file_path end as file_path from nodes)"


def _resolved_sql(used: str, kinds: tuple[str, ...]) -> str:
    """The same-file symbol of each name, else the exported one, by the order of kinds and the least id."""
    best = lambda keys, more: f"select {keys}, arg_min(entity_id, (case kind when 'class' then 1 else 0 end, list_position({list(kinds)}, kind), entity_id)) as best from nodes where kind in ({', '.join(map(repr, kinds))}){more} group by {keys}"
    return f"select '{used}' as used_as, u.use_id, coalesce(l.best, x.best) as resolved_id, cast(case when l.best is not null then 1.0 when x.best is not null then 0.9 end as double) as confidence from u left join ({best('file_path, name', '')}) l on l.file_path = u.file_path and l.name = u.name left join ({best('name', ' and is_exported')}) x on x.name = u.name"


@query("resolve_names_all", _USES + " " + " union all ".join(_resolved_sql(u, k) for u, k in _USED_AS.items()), "nodes")
def _resolve_names_all(g: Graph, *_) -> DataFrame:
    uses = g.nodes.select(F.col("entity_id").alias("use_id"), "name", F.expr("case when visibility = 'private' then 'elsewhere.ts' else file_path end").alias("file_path"))
    parts = [resolution.resolve_names(uses, g.nodes, kinds).select(F.lit(u).alias("used_as"), "use_id", "resolved_id", "confidence") for u, kinds in _USED_AS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: All external references; relative specifiers stand beside their file. All nodes, named and filed so that references can mean them.
_REF_BASE = "case when module_specifier like './%' then regexp_replace(source_file_path, '[^/]*$', '') || substr(module_specifier, 3) else module_specifier end"
_REF_ID = "concat_ws('|', source_entity_id, module_specifier, imported_symbol, source_file_path, cast(source_line as string))"
_NODE_NAME = "'sym' || regexp_extract(entity_id, '([0-9]+)$', 1)"
_NODE_FILE = "'docs/src' || regexp_extract(entity_id, '([0-9])$', 1) || '.ts'"


@query("resolve_imports_all", f"""with r as (select {_REF_ID} as ref_id, {_REF_BASE} as base, imported_symbol as symbol from external_refs),
x as (select {_NODE_FILE} as file_path, {_NODE_NAME} as name, min(entity_id) as entity_id from nodes where is_exported group by 1, 2),
s as (select unnest({list(resolution.SUFFIXES)}) as suffix, unnest(range({len(resolution.SUFFIXES)})) as pos),
f as (select a.base, a.symbol, arg_min(x.entity_id, s.pos) as resolved_id from (select distinct base, symbol from r) a cross join s join x on x.file_path = a.base || s.suffix and x.name = a.symbol group by 1, 2)
select r.ref_id, f.resolved_id from r left join f on f.base = r.base and f.symbol = r.symbol""", "nodes", "external_refs")
def _resolve_imports_all(g: Graph, *_) -> DataFrame:
    refs = g.external_refs.selectExpr(f"{_REF_ID} as ref_id", f"{_REF_BASE} as base", "imported_symbol as symbol")
    nodes = g.nodes.select("entity_id", "is_exported", F.expr(_NODE_NAME).alias("name"), F.expr(_NODE_FILE).alias("file_path"))
    return resolution.resolve_imports(refs, nodes).select("ref_id", "resolved_id")


query("affected_files", "select source_file_path, count(distinct target_entity_id) as symbols from external_refs where is_resolved and target_entity_id in (select entity_id from nodes where is_exported) group by 1", "external_refs", "nodes")(lambda g, *_: resolution.affected_files(g.external_refs, g.nodes.filter("is_exported")))
query("match_routes", """with s as (select event_id as send_id, case event_id % 2 when 0 then 'get' else 'POST' end as method, '/Api/svc' || event_id % 7 || '/:id' || event_id % 3 || '/' as target from events where event_type = 'signup'),
q as (select event_id as request_id, case event_id % 3 when 0 then 'GET' else 'post' end as method, '/api/svc' || event_id % 9 || '/{key}' as route_pattern from events where event_type = 'error'),
n as (select min(request_id) as request_id, upper(method) as method, lower(regexp_replace(route_pattern, '[{].*[}]', '*')) as path from q group by 2, 3)
select send_id, request_id from s join n on n.method = upper(s.method) and n.path = '/api/svc' || send_id % 7 || '/*'""")(lambda g, spark, d: (lambda e: resolution.match_routes(
    e.filter("event_type = 'signup'").selectExpr("event_id as send_id", "case event_id % 2 when 0 then 'get' else 'POST' end as method", "concat('/Api/svc', event_id % 7, '/:id', event_id % 3, '/') as target"),
    e.filter("event_type = 'error'").selectExpr("event_id as request_id", "case event_id % 3 when 0 then 'GET' else 'post' end as method", "concat('/api/svc', event_id % 9, '/{key}') as route_pattern")))(_table(spark, d, "events")))
