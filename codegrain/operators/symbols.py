"""Symbol search, schema summaries and edge lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.sources.written import written

LEVELS = ("counts", "summary", "details")


def check_range(name: str, value: int, least: int, most: int) -> int:
    if not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{name} must be an integer from {least} to {most}, not {value!r}")
    return value


def glob(column: Column, pattern: str) -> Column:
    """* matches any run of characters; all else is literal.  Without a star this is equality."""
    if "*" not in pattern:
        return column == pattern
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return column.like(escaped)


def repo_of(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit(":"), F.lit(1))


def full_path(nodes: DataFrame) -> Column:
    return F.concat_ws("/", repo_of(nodes["entity_id"]), nodes["file_path"])


def at_level(nodes: DataFrame, level: str) -> DataFrame:
    """Symbol rows cut to a level: counts per kind, the summary columns, or all details."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if level == "counts":
        return nodes.groupBy("kind").agg(F.count("*").alias("count"))
    summary = [F.col("entity_id"), F.col("name"), F.col("kind"), full_path(nodes).alias("file"), F.col("start_line").alias("line")]
    if level == "summary":
        return nodes.select(*summary)
    return nodes.select(*summary, "end_line", "qualified_name", "is_exported", "visibility", "type_signature", "documentation")


def matching(nodes: DataFrame, name: str | None = None, kind: str | None = None, file: str | None = None, repo: str | None = None, exported: bool | None = None) -> DataFrame:
    for column, value in (("name", name), ("file_path", file)):
        if value is not None:
            nodes = nodes.filter(glob(F.col(column), value))
    if kind is not None:
        nodes = nodes.filter(F.col("kind") == kind)
    if repo is not None:
        nodes = nodes.filter(F.col("entity_id").startswith(f"{repo}:"))
    if exported is not None:
        nodes = nodes.filter(F.col("is_exported") == exported)
    return nodes


def symbol_find(nodes: DataFrame, level: str = "summary", limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    check_range("limit", limit, 1, 1000)
    found = matching(nodes, **filters)
    if level == "counts":
        return at_level(found, level)
    return at_level(found.orderBy("file_path", "start_line", "entity_id").offset(offset).limit(limit), level)


def symbol_get(nodes: DataFrame, entity_id: str, level: str = "details") -> DataFrame:
    return at_level(nodes.filter(F.col("entity_id") == entity_id), level)


def symbol_file(nodes: DataFrame, file: str, kind: str | None = None, level: str = "summary", limit: int = 100) -> DataFrame:
    check_range("limit", limit, 1, 1000)
    return at_level(matching(nodes, file=file, kind=kind).orderBy("start_line", "entity_id").limit(limit), level)


def schema_kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("count"), F.sum(F.when(F.col("is_exported"), 1).otherwise(0)).alias("exported_count"))


def schema_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("count"))


def schema_tables(**tables: DataFrame) -> DataFrame:
    """Rows and columns of every table, read off the schemas."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count", F.lit(",".join(df.columns)).alias("columns")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.split_part("entity_id", F.lit(":"), F.lit(2))).alias("packages"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def named_edges(edges: DataFrame, nodes: DataFrame, end: str = "target") -> DataFrame:
    """Edges with the name and kind of the node at one end; unknown nodes give nulls."""
    names = nodes.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_name"), F.col("kind").alias(f"{end}_kind"))
    return edges.join(names, f"{end}_entity_id", "left")


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes, both ends named."""
    ends = [nodes.select(F.col("entity_id").alias(f"{e}_entity_id"), F.col("name").alias(f"{e}_name"), F.col("kind").alias(f"{e}_kind")) for e in ("source", "target")]
    return edges.join(ends[0], "source_entity_id").join(ends[1], "target_entity_id")


def symbol_at_line(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(file_path, line) -> the innermost symbol around it: equal file, containing range, least span."""
    from pyspark.sql import Window

    n = nodes.select("entity_id", "file_path", "start_line", "end_line")
    inside = points.join(n, "file_path").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    first = Window.partitionBy("file_path", "line").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "entity_id")
    return inside.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("file_path", "line", "entity_id")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("entity_id").alias("source_entity_id")), "source_entity_id", "left_anti")


def unused_exports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.filter(F.col("edge_type") == "IMPORTS").select(F.col("target_entity_id").alias("entity_id"))
    return nodes.filter("is_exported").join(used, "entity_id", "left_anti").select("entity_id", "name", "kind")


def integrity(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: table counts, unresolved references, edges without a source node."""
    counts = [
        nodes.agg(F.count("*").alias("node_count"), F.countDistinct("file_path").alias("file_count")),
        edges.agg(F.count("*").alias("edge_count")),
        refs.agg(F.count("*").alias("ref_count"), F.count_if(~F.col("is_resolved")).alias("unresolved_count")),
        orphan_edges(edges, nodes).agg(F.count("*").alias("orphan_count")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def doc_coverage(nodes: DataFrame, least: int = 1) -> DataFrame:
    n = nodes.groupBy("file_path").agg(F.count("*").alias("symbols"), F.count("documentation").alias("documented")).filter(F.col("symbols") >= least)
    return n.withColumn("coverage", F.round(F.col("documented") * 100.0 / F.col("symbols"), 1).cast("double"))


def kind_shares(nodes: DataFrame) -> DataFrame:
    """Share of each kind in all nodes; the total is taken over the few aggregated rows."""
    from pyspark.sql import Window

    n = nodes.groupBy("kind").agg(F.count("*").alias("count"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.withColumn("percent", F.round(F.col("count") * 100.0 / F.sum("count").over(whole), 2).cast("double"))


def decorator_usage(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("decorators").alias("decorator")).groupBy("decorator").agg(F.count("*").alias("uses"))


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Names that several packages have."""
    n = nodes.groupBy("name").agg(F.count("*").alias("count"), F.countDistinct(F.split_part("entity_id", F.lit(":"), F.lit(2))).alias("packages"))
    return n.filter("packages > 1")


def most_called(edges: DataFrame, limit: int = 20) -> DataFrame:
    n = edges.filter(F.col("edge_type") == "CALLS").groupBy("target_entity_id").agg(F.count("*").alias("calls"))
    return n.orderBy(F.desc("calls"), "target_entity_id").limit(limit)


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Pairs that reach each other directly, each once: circular imports of length two."""
    e = edges.select("source_entity_id", "target_entity_id").distinct()
    back = e.select(F.col("target_entity_id").alias("source_entity_id"), F.col("source_entity_id").alias("target_entity_id"))
    return e.join(back, ["source_entity_id", "target_entity_id"], "left_semi").filter("source_entity_id < target_entity_id")


def paged(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with the total before it and has_more: whether the total exceeds the limit, whatever the offset."""
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(total).withColumn("has_more", F.col("total") > limit)  # one row


def effect_page(effects: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of effects, newest first, with the total and has_more: whether rows follow this page."""
    total = effects.agg(F.count("*").alias("total"))
    page = effects.orderBy(F.desc("timestamp"), "effect_id").offset(offset).limit(limit)
    return page.crossJoin(total).withColumn("has_more", F.col("total") > offset + limit)  # one row


def top_counts(rows: DataFrame, column: str, most: int = 5) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(most)


def theme_tokens(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Variables, constants and properties whose name speaks of themes, colors or tokens."""
    name = F.col("name")
    hit = nodes.filter((name.contains("theme") | name.contains("color") | name.contains("token")) & F.col("kind").isin("variable", "const", "property"))
    return hit.select("name", "file_path").orderBy("name", "file_path").limit(limit)


def usage_examples(nodes: DataFrame, file: str, ending: str = ".tsx", kind: str = "function", limit: int = 5) -> DataFrame:
    """Functions of other component files, each file and name once."""
    hit = nodes.filter((F.col("kind") == kind) & (F.col("file_path") != file) & F.col("file_path").endswith(ending))
    return hit.select("file_path", "name").distinct().orderBy("file_path", "name").limit(limit)


def fix_context(nodes: DataFrame, edges: DataFrame, file: str, limit: int = 50) -> DataFrame:
    """What the symbols of a file lead to: at most limit distinct targets, known ones with name, kind and file."""
    own = written(nodes.filter(F.col("file_path") == file).select(F.col("entity_id").alias("source_entity_id")))
    targets = written(edges.join(own, "source_entity_id", "left_semi").select("target_entity_id").distinct().orderBy("target_entity_id").limit(limit))
    known = nodes.select(F.col("entity_id").alias("target_entity_id"), "name", "kind", "file_path").join(F.broadcast(targets), "target_entity_id", "left_semi")  # at most limit ids
    return targets.join(known, "target_entity_id", "left")


def violations_where(effects: DataFrame, limit: int = 100, file: str | None = None, **wanted: str) -> DataFrame:
    """Accessibility violations among effects, read from their properties: rule_id, impact, wcag_level, detection_source and so on, with defaults for what is absent."""
    default = {"rule_id": "unknown", "impact": "moderate", "wcag_criterion": "", "wcag_level": "AA", "detection_source": "static", "platform": "web", "message": ""}
    if unknown := wanted.keys() - default.keys():
        raise ValueError(f"no such filters: {sorted(unknown)}")
    rows = effects.filter(F.col("effect_type") == "A11yViolation")
    if file is not None:
        rows = rows.filter(F.col("source_file_path").contains(file))
    read = {n: F.get_json_object("properties", f"$.{n}") for n in default}
    for n, v in wanted.items():
        rows = rows.filter(read[n] == v)
    confidence = F.coalesce(F.get_json_object("properties", "$.confidence").cast("double"), F.lit(1.0))
    named = [F.coalesce(F.nullif(read[n], F.lit("")), F.lit(d)).alias(n) for n, d in default.items()]
    return rows.select("effect_id", *named, confidence.alias("confidence"), F.col("source_file_path").alias("file_path"), F.col("source_line").alias("line")).orderBy("effect_id").limit(limit)
