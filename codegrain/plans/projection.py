"""The graph tables as projections of the star-schema test tables.

One text serves both engines; PIECES holds the few spellings that differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PIECES = {
    "spark": {"words": "split({0}, ' ')", "k": "cast(get_json_object(props, '$.k') as int)", "sha": "sha2({0}, 256)", "none": "cast(array() as array<string>)"},
    "duckdb": {"words": "string_split({0}, ' ')", "k": "cast(json_extract_string(props, '$.k') as int)", "sha": "sha256({0})", "none": "cast([] as varchar[])"},
}

CALLEES = (
    "dynamodb.client.put", "dynamoDb.table.query", "db.selectFrom", "trx.insertInto", "conn.execute", "repo.find",
    "prisma.user.create", "prisma.post.findMany", "stripe.charges.create", "stripe.refunds.create", "stripe.subscriptions.cancel",
    "jwt.sign", "jwt.verify", "bcrypt.hash", "bcrypt.compareSync", "cognitoClient.initiateAuth", "fetch", "axios.post",
    "protectedProcedure.mutation", "publicProcedure.query", "router.procedure", "sqsClient.sendMessage", "sqs.receiveMessage",
    "snsTopic.publish", "eventbridge.putEvents", "s3.putObject", "s3Client.getObject", "fs.writeFile", "fs.promises.readFile",
    "console.log", "datadog.increment", "helper.compute", "formatDate",
)

_NODE = """select {repo} || ':' || {package} || ':' || '{kind}' || ':' || cast({key} as string) as entity_id, {name} as name, '{kind}' as kind,
 {path} as file_path, {key} as key, {size} as span, {decor} as decorators from {table}"""

_NODES = [
    dict(repo="'geo'", package="'atlas'", kind="namespace", key="r_regionkey", name="r_name", path="'region/' || r_name || '.ts'", size="10", decor="{{none}}", table="region"),
    dict(repo="'geo'", package="'atlas'", kind="module", key="n_nationkey", name="n_name", path="'nation/' || n_name || '.ts'", size="20", decor="{{none}}", table="nation"),
    dict(repo="'supply'", package="'vendors'", kind="class", key="s_suppkey", name="s_name", path="'supplier/' || cast(s_nationkey as string) || '.ts'", size="30", decor="{{none}}", table="supplier"),
    dict(repo="'sales'", package="'accounts'", kind="interface", key="c_custkey", name="c_name", path="'customer/' || c_mktsegment || '.ts'", size="5", decor="{{none}}", table="customer"),
    dict(repo="'supply'", package="'catalog'", kind="function", key="p_partkey", name="p_name", path="p_brand || '/' || p_type || '.ts'", size="p_size", decor="{{words_p}}", table="part"),
    dict(repo="'sales'", package="'ledger'", kind="method", key="o_orderkey", name="'order_' || cast(o_orderkey as string)", path="'orders/' || o_orderpriority || '.ts'", size="7", decor="{{none}}", table="orders"),
    dict(repo="'web'", package="'clicks'", kind="hook", key="user_id", name="'use' || cast(user_id as string)", path="'hooks/' || cast(user_id % 10 as string) || '.tsx'", size="3", decor="{{none}}", table="(select distinct user_id from events) u"),
]


def _union() -> str:
    return " union all ".join(_NODE.format(**{**n, "decor": n["decor"][1:-1]}) for n in _NODES)


NODES = (
    """select entity_id, name, name as qualified_name, kind, file_path, cast(1 + key % 97 as int) as start_line, cast(1 + key % 97 + span as int) as end_line,
 0 as start_column, 50 as end_column, key % 3 = 0 as is_exported, key % 30 = 0 as is_default_export, case when key % 4 = 0 then 'private' else 'public' end as visibility,
 key % 7 = 0 as is_async, false as is_generator, key % 11 = 0 as is_static, key % 13 = 0 as is_abstract,
 case when key % 2 = 0 then '() => void' end as type_signature, case when key % 5 = 0 then null else 'doc of ' || name end as documentation,
 decorators, {none} as type_parameters, '{{"key": ' || cast(key as string) || '}}' as properties, {sha_path} as source_file_hash,
 'base' as branch, false as is_deleted, '2024-01-01T00:00:00Z' as updated_at from ("""
    + _union()
    + ") base_nodes"
)

_ID = {"r": "'geo:atlas:namespace:' || cast({0} as string)", "n": "'geo:atlas:module:' || cast({0} as string)", "s": "'supply:vendors:class:' || cast({0} as string)", "c": "'sales:accounts:interface:' || cast({0} as string)", "p": "'supply:catalog:function:' || cast({0} as string)", "o": "'sales:ledger:method:' || cast({0} as string)", "u": "'web:clicks:hook:' || cast({0} as string)"}


def _edge(source: str, a: str, target: str, b: str, kind: str, table: str, line: str) -> str:
    return f"select {_ID[source].format(a)} as source_entity_id, {_ID[target].format(b)} as target_entity_id, '{kind}' as edge_type, cast(1 + {line} % 89 as int) as source_line from {table}"


EDGES = (
    "select source_entity_id, target_entity_id, edge_type, 'src/' || edge_type || '.ts' as source_file_path, source_line, 0 as source_column, '{{}}' as properties, 'h' as source_file_hash, 'base' as branch, false as is_deleted, '2024-01-01T00:00:00Z' as updated_at from ("
    + " union all ".join([
        _edge("r", "n_regionkey", "n", "n_nationkey", "CONTAINS", "nation", "n_nationkey"),
        _edge("n", "s_nationkey", "s", "s_suppkey", "CONTAINS", "supplier", "s_suppkey"),
        _edge("n", "c_nationkey", "c", "c_custkey", "CONTAINS", "customer", "c_custkey"),
        _edge("c", "o_custkey", "o", "o_orderkey", "CALLS", "orders", "o_orderkey"),
        _edge("o", "l_orderkey", "p", "l_partkey", "CALLS", "lineitem", "l_linenumber"),
        _edge("s", "l_suppkey", "p", "l_partkey", "IMPORTS", "(select distinct l_suppkey, l_partkey from lineitem) li", "l_partkey"),
        _edge("o", "l_orderkey", "s", "l_suppkey", "REFERENCES", "(select distinct l_orderkey, l_suppkey from lineitem) lo", "l_suppkey"),
    ])
    + ") base_edges"
)

CLICKS = f"""select distinct {_ID['u'].format('user_id')} as source_entity_id, {_ID['u'].format('next_id')} as target_entity_id, 'CALLS' as edge_type from (
 select user_id, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) as next_id from events where event_type = 'click') c where next_id is not null and next_id <> user_id"""

EFFECTS = (
    "select cast(event_id as string) as effect_id, case event_type when 'click' then 'FunctionCall' when 'view' then 'Retrieve' when 'purchase' then 'Store' when 'signup' then 'Send' else 'Response' end as effect_type,"
    " ts as timestamp, " + _ID["u"].format("user_id") + " as source_entity_id, 'hooks/' || cast(user_id % 10 as string) || '.tsx' as source_file_path, cast(1 + event_id % 83 as int) as source_line,"
    " case when event_type = 'click' then case {{k}} % {n} {whens} end end as callee_name,"
    " case when event_type = 'click' then {{k}} % 2 = 0 end as is_external, case when event_type = 'click' then {{k}} % 3 = 0 end as is_async, case when event_type = 'click' then {{k}} % 5 = 0 end as is_method_call,"
    " case when event_type = 'click' and {{k}} % 2 = 0 then 'pkg' || cast({{k}} % 4 as string) end as external_module,"
    " case when event_type in ('view', 'purchase') then 'table' || cast({{k}} % 6 as string) end as target_resource, case when event_type = 'signup' then 'svc' || cast({{k}} % 5 as string) end as target, value from events"
).format(n=len(CALLEES), whens=" ".join(f"when {i} then '{c}'" for i, c in enumerate(CALLEES)))

REFS = (
    "select " + _ID["u"].format("d.doc_id % 10") + " as source_entity_id, case d.doc_id % 3 when 0 then './' || source when 1 then '@' || lang || '/' || source else source end as module_specifier,"
    " 'sym' || cast(d.doc_id % 50 as string) as imported_symbol, 'named' as import_style, d.doc_id % 4 = 0 as is_type_only, 'docs/' || source || '.ts' as source_file_path, cast(1 + d.doc_id % 71 as int) as source_line,"
    " case when l.doc_id is not null then " + _ID["p"].format("d.doc_id % 200") + " end as target_entity_id, l.doc_id is not null as is_resolved, d.doc_id % 9 = 0 as is_reexport from documents d left join labels l on d.doc_id = l.doc_id"
)

DIAGNOSTICS = """select cast(o_orderkey as string) as diagnostic_id, 'repo' || cast(o_custkey % 6 as string) as repo_id, case o_orderstatus when 'F' then 'tsc' when 'O' then 'eslint' else 'test' end as source,
 'src/f' || cast(o_custkey % 40 as string) || '.ts' as file_path, cast(o_orderkey % 300 as int) as line_number, cast(o_orderkey % 80 as int) as column_number,
 case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'error' when '3' then 'warning' when '4' then 'suggestion' else 'note' end as severity,
 case o_custkey % 4 when 0 then 'compilation' when 1 then 'linting' when 2 then 'testing' else 'security' end as category, 'order ' || cast(o_orderkey as string) as title, o_orderstatus = 'F' as resolved,
 o_orderkey % 2 = 0 as actionable, o_orderdate as updated_at from orders"""

VIEWS = {"nodes": NODES, "edges": EDGES, "clicks": CLICKS, "effects": EFFECTS, "external_refs": REFS, "diagnostics": DIAGNOSTICS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations")


def view_sql(name: str, dialect: str) -> str:
    p = PIECES[dialect]
    fill = {"none": p["none"], "k": p["k"], "sha_path": p["sha"].format("file_path"), "words_p": p["words"].format("p_name")}
    text = VIEWS[name]
    return text.format(**fill) if name in ("nodes", "edges", "effects") else text


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: the views that sql reads, as common table expressions before it."""
    ctes = ", ".join(f"{n} as ({view_sql(n, 'duckdb')})" for n in names)
    return f"with recursive {ctes}, {sql[5:]}" if sql[:5].lower() == "with " else f"with {ctes} {sql}"


class Graph:
    """The tables of one scope, each built when it is first asked for; every operator takes and returns DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._held = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._held:
            used = {t: self._spark.read.parquet(f"{self._dir}/{t}.parquet") for t in TABLES if f" {t}" in VIEWS[name]}
            self._held[name] = self._spark.sql(_bound(view_sql(name, "spark"), used), **used)
        return self._held[name]

    def replaced(self, **tables: DataFrame) -> Graph:
        """The same scope with some tables given."""
        out = Graph(self._spark, self._dir)
        out._held = {**self._held, **tables}
        return out


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """Graph tables over the star-schema tables in sf_dir; nothing is opened until a table is asked for."""
    return Graph(spark, sf_dir)


def _bound(sql: str, used: dict) -> str:
    """Table names become parameters, so no session view is registered."""
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return sql.replace("'{}'", "'{{}}'").replace("'{\"key\": '", "'{{\"key\": '").replace("|| '}'", "|| '}}'")
