"""Bounded graph traversal, one written level at a time.

The ends of the edges are written to the shared folder once, as levels would
build the edge table anew.  Every level joins the frontier with them once, is
written too and ends the walk when it is empty, so plans keep their size at any
depth.  Path traversals (dependencies, call graphs) follow simple paths; visited
traversals (reachable, affected, importers) keep each node once, at its least
depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.operators.symbols import LEVELS, check_range, named_edges, repo_of
from codegrain.sources.written import hashed, united, written

MAX_DEPTH = 10


def _oriented(edges: DataFrame, edge_types: list[str] | None, reverse: bool) -> DataFrame:
    if edge_types:
        edges = edges.filter(F.col("edge_type").isin(edge_types))
    a, b = ("target_entity_id", "source_entity_id") if reverse else ("source_entity_id", "target_entity_id")
    return edges.select(F.col(a).alias("here"), F.col(b).alias("there"), "edge_type")


def _onward(hop: DataFrame, frontier: DataFrame, how: str = "inner") -> DataFrame:
    """Hops from a frontier of here."""
    return hashed(hop, ["here"]).join(hashed(frontier, ["here"]), ["_h", "here"], how).drop("_h")


def _first(start: DataFrame | list[str], hop: DataFrame) -> DataFrame:
    """Hops from start; a list of ids filters the scan, a table of entity_id is joined."""
    return hop.filter(F.col("here").isin(start)) if isinstance(start, list) else hop.join(start.select(F.col("entity_id").alias("here")).distinct(), "here", "left_semi")


def _met(start: DataFrame | list[str], hop: DataFrame, depth: int) -> DataFrame:
    """(here, there, edge_type, depth) of every hop on a simple path from start, at its least depth.

    A path holds no node twice, but start may be entered again.  A hop is on one
    if a walk as short leads to its source and avoids its target, so per node it
    is enough to keep what all walks to it have in common: a set of no more nodes
    than levels, that only shrinks, where paths themselves would multiply.  Only
    nodes whose set has changed walk on.
    """
    first = _first(start, hop).select("here", "there", "edge_type", F.lit(1).alias("depth")).distinct()
    if depth == 1:
        return first
    found, hop = [written(first)], written(hop)
    fresh = found[0].select(F.col("there").alias("node"), F.array("there").alias("on")).distinct()
    begin = hop.sparkSession.createDataFrame([(s,) for s in start], "node string") if isinstance(start, list) else start.select(F.col("entity_id").alias("node"))
    common = fresh.unionByName(begin.withColumn("on", F.array().cast("array<string>"))).groupBy("node").agg(F.min_by("on", F.size("on")).alias("on"))
    for d in range(2, depth + 1):
        level = written(_onward(hop, fresh.select(F.col("node").alias("here"), "on")).filter(~F.array_contains("on", F.col("there"))))
        if level.isEmpty():
            break
        found.append(level.select("here", "there", "edge_type", F.lit(d).alias("depth")))
        if d == depth:
            break
        walks = level.select(F.col("there").alias("node"), F.array_append("on", F.col("there")).alias("on")).distinct()
        near = walks.groupBy("node").agg(F.collect_set("on").alias("sets")).select("node", F.aggregate("sets", F.get("sets", F.lit(0)), F.array_intersect).alias("new"))
        both = common.join(near, "node", "full_outer")
        now = F.when(F.col("on").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("on")).otherwise(F.array_intersect("on", "new"))
        state = written(both.select("node", now.alias("now"), (F.col("on").isNull() | (F.size("on") > F.size(now))).alias("changed")))
        common = state.select("node", F.col("now").alias("on"))
        fresh = state.filter("changed").select("node", F.col("now").alias("on"))
    return reduce(DataFrame.unionByName, found).groupBy("here", "there", "edge_type").agg(F.min("depth").alias("depth"))


def graph_deps(edges: DataFrame, start: DataFrame | list[str], depth: int = 1, edge_types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Edges met from start, each with its least depth; reverse gives dependents.  The start may be re-entered once.

    start: a list of ids, which filters the scan of the first level, or a table of entity_id.
    """
    check_range("depth", depth, 1, MAX_DEPTH)
    met = _met(start, _oriented(edges, edge_types, reverse), depth)
    a, b = ("there", "here") if reverse else ("here", "there")
    return met.select(F.col(a).alias("source_entity_id"), F.col(b).alias("target_entity_id"), "edge_type", "depth")


def graph_dependents(edges: DataFrame, start: DataFrame | list[str], depth: int = 1, edge_types: list[str] | None = None) -> DataFrame:
    return graph_deps(edges, start, depth, edge_types, reverse=True)


def edges_at_level(met: DataFrame, nodes: DataFrame, level: str = "summary", limit: int = 100) -> DataFrame:
    """Met edges in order of depth and ids, at most limit of them: counts per type (of these), names at both ends, or all columns."""
    check_range("limit", limit, 1, 1000)
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    some = met.orderBy("depth", "source_entity_id", "target_entity_id", "edge_type").limit(limit)
    if level == "counts":
        return some.groupBy("edge_type").agg(F.count("*").alias("count"))
    if level == "details":
        return some
    ends = named_edges(named_edges(some, nodes, "source"), nodes)  # at most limit rows look for their names
    return ends.select("source_entity_id", "target_entity_id", "edge_type", "depth", "source_name", "target_name")


def graph_calls(edges: DataFrame, start: DataFrame | list[str], direction: str = "both", depth: int = 3, limit: int = 100) -> DataFrame:
    """CALLS edges to callees, from callers or both, with the direction: each side at most limit, least depth first."""
    if direction not in ("callers", "callees", "both"):
        raise ValueError("direction must be callers, callees or both")
    sides = [d for d in ("callees", "callers") if direction in (d, "both")]
    parts = [graph_deps(edges, start, depth, ["CALLS"], d == "callers").orderBy("depth", "source_entity_id", "target_entity_id").limit(limit).withColumn("direction", F.lit(d)) for d in sides]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def call_graph(edges: DataFrame, nodes: DataFrame, start: DataFrame | list[str], depth: int = 3, callers: bool = False, limit: int = 100) -> DataFrame:
    """Known callees (or callers) per depth; a node may appear at several depths, the start never.

    Paths that end alike and hold the same nodes count once, and no level is
    walked that the limit leaves out.
    """
    check_range("depth", depth, 1, MAX_DEPTH)
    hop = _oriented(edges, ["CALLS"], callers).select("here", "there")
    known = nodes.select("entity_id", "name", "kind", "file_path")
    level = _first(start, hop).filter("here <> there").select("there", F.array("here", "there").alias("path")).distinct()
    found, rows = [], 0
    for d in range(1, depth + 1):
        level = written(level) if depth > 1 else level
        found.append(level.select(F.col("there").alias("entity_id"), F.lit(d).alias("depth")).distinct().join(known, "entity_id"))
        if d == depth or level.isEmpty():
            break
        rows += found[-1].count()
        if rows >= limit:
            break
        level = level.withColumnRenamed("there", "here").join(hop, "here").filter(~F.array_contains("path", F.col("there"))).select("there", F.array_sort(F.array_append("path", F.col("there"))).alias("path")).distinct()
    return reduce(DataFrame.unionByName, found).orderBy("depth", "name", "entity_id").limit(limit)


def graph_imports(edges: DataFrame, nodes: DataFrame, exports: bool = False, file: str | None = None, limit: int | None = None) -> DataFrame:
    """Imports and re-exports, or exports, of one file or all, with the target's name and kind; in order of ids where limited."""
    some = edges.filter(F.col("edge_type").isin(["EXPORTS"] if exports else ["IMPORTS", "RE_EXPORTS"]))
    if file is not None:
        some = some.filter(F.col("source_file_path") == file)
    if limit is not None:
        some = some.orderBy("source_entity_id", "target_entity_id", "edge_type").limit(limit)
    return named_edges(some, nodes)


def reachable(edges: DataFrame, start: DataFrame, depth: int = MAX_DEPTH, edge_types: list[str] | None = None, reverse: bool = False, keep: Column | None = None) -> DataFrame:
    """(entity_id, depth) of every node reached from start, itself left out, each once at its least depth.

    keep: a condition on entity_id; nodes outside it are not reached and not walked through.
    """
    check_range("depth", depth, 1, MAX_DEPTH)
    return _reached(_ends(edges, depth, edge_types, reverse), start, depth, keep)


def _ends(edges: DataFrame, depth: int, edge_types: list[str] | None, reverse: bool) -> DataFrame:
    hop = _oriented(edges, edge_types, reverse).select("here", "there")
    return written(hop) if depth > 1 else hop


def _reached(hop: DataFrame, start: DataFrame, depth: int, keep: Column | None = None) -> DataFrame:
    key = ["entity_id"]
    seen = [written(start.select("entity_id", F.lit(0).alias("depth")).distinct())]
    for d in range(1, depth + 1):
        near = _onward(hop, seen[-1].select(F.col("entity_id").alias("here")), "left_semi").select(F.col("there").alias("entity_id"))
        near = near.filter(keep) if keep is not None else near
        fresh = hashed(near, key).distinct().join(hashed(united(seen).select("entity_id"), key), ["_h", *key], "left_anti").select("entity_id", F.lit(d).alias("depth"))
        seen.append(written(fresh))
        if seen[-1].isEmpty():
            break
    return united(seen).filter("depth > 0")


def transitive(edges: DataFrame, nodes: DataFrame, start: DataFrame, depth: int = MAX_DEPTH, edge_types: list[str] | None = None) -> DataFrame:
    """Known nodes that start reaches, itself left out; unknown ones are walked through, not returned."""
    return reachable(edges, start, depth, edge_types).join(nodes.select("entity_id", "name", "kind", "file_path"), "entity_id")


def first_edges(edges: DataFrame, start: DataFrame, depth: int = MAX_DEPTH, edge_types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """For each node reached, the edge that reached it first: least depth, then least source and type; at most limit, least depth first."""
    levels = reachable(edges, start, depth, edge_types).unionByName(start.select("entity_id", F.lit(0).alias("depth")).distinct())
    hop = _oriented(edges, edge_types, False)
    ends = hop.join(levels.select(F.col("entity_id").alias("here"), F.col("depth").alias("from_depth")), "here").join(levels.select(F.col("entity_id").alias("there"), "depth"), "there").filter("from_depth = depth - 1")
    best = ends.groupBy("there", "depth").agg(F.min(F.struct("here", "edge_type")).alias("e"))
    return best.select(F.col("e.here").alias("source_entity_id"), F.col("there").alias("target_entity_id"), "e.edge_type", "depth").orderBy("depth", "source_entity_id", "target_entity_id").limit(limit)


def affected(edges: DataFrame, changed: DataFrame, depth: int = MAX_DEPTH, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Dependents of changed entities; direct at depth one.  Repos that are excluded, or not included, are not walked through either."""
    repo = repo_of(F.col("entity_id"))
    keep = F.lit(True)
    if include:
        keep = keep & repo.isin(include)
    if exclude:
        keep = keep & ~repo.isin(exclude)
    return _with_repo(reachable(edges, changed, depth, reverse=True, keep=keep if include or exclude else None))


def _with_repo(found: DataFrame) -> DataFrame:
    return found.withColumns({"repo": repo_of(F.col("entity_id")), "is_direct": F.col("depth") == 1})


def affected_repos(found: DataFrame) -> DataFrame:
    """Per repo: affected entities, and direct if one of them is at depth one."""
    return found.groupBy("repo").agg(F.count("*").alias("entities"), F.when(F.min("depth") == 1, "direct").otherwise("transitive").alias("impact"))


def affected_by_file(edges: DataFrame, nodes: DataFrame, file: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Dependents of the entities in a file that edges lead to."""
    check_range("depth", depth, 1, MAX_DEPTH)
    there = written(nodes.filter(F.col("file_path") == file).select(F.col("entity_id").alias("here")))
    hop = _ends(edges, depth, None, True)
    return _with_repo(_reached(hop, _onward(hop, there, "left_semi").select(F.col("here").alias("entity_id")).distinct(), depth))


def symbol_importers(refs: DataFrame, nodes: DataFrame, symbols: DataFrame, depth: int = 1) -> DataFrame:
    """(file_path, depth, entity_id) of files that import symbols, each file once at its least depth, files of the symbols left out.

    Over resolved references; a file is named with the least importing entity,
    and what the files of one level hold is what the next one imports.
    """
    check_range("depth", depth, 1, MAX_DEPTH)
    uses = refs.filter("is_resolved").select("target_entity_id", F.col("source_entity_id").alias("entity_id"), F.col("source_file_path").alias("file_path"))
    level = symbols.select("entity_id").distinct()
    own = nodes.join(level, "entity_id", "left_semi").select("file_path", F.lit(0).alias("depth"), F.lit("").alias("entity_id")).distinct()
    seen = [written(own)]
    for d in range(1, depth + 1):
        hit = uses.join(level.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi").groupBy("file_path").agg(F.min("entity_id").alias("entity_id"))
        seen.append(written(hit.join(united(seen).select("file_path").distinct(), "file_path", "left_anti").select("file_path", F.lit(d).alias("depth"), "entity_id")))
        if d == depth or seen[-1].isEmpty():
            break
        level = seen[-1].select("entity_id").distinct()
    return united(seen).filter("depth > 0")


def file_change_impact(old: DataFrame, new: DataFrame, refs: DataFrame, compared: list[str], depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(changed exports, files that import them) of files whose exported nodes are replaced by new ones."""
    from codegrain.operators.overlay import diff

    changes = diff(old.filter("is_exported"), new.filter("is_exported"), ["entity_id"], compared)
    return changes, symbol_importers(refs, old, changes, depth)
