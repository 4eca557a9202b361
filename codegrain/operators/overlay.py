"""Base and branch deltas, incremental merges, upserts and diffs over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.sources.written import hashed

KEYS = {
    "nodes": ["entity_id"],
    "edges": ["source_entity_id", "target_entity_id", "edge_type"],
    "external_refs": ["source_entity_id", "module_specifier", "imported_symbol"],
    "effects": ["effect_id"],
}


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key, with _h; one shuffle and one sort.

    lag instead of a row number, as Spark sorts the rows before the shuffle too where it sees a limit of one, which mostly distinct keys don't repay.
    """
    last = Window.partitionBy("_h", *keys).orderBy(*order)
    return hashed(rows, keys).withColumn("_before", F.lag(F.lit(1)).over(last)).filter("_before is null").drop("_before")


def overlay(base: DataFrame, branch: DataFrame, keys: list[str]) -> DataFrame:
    """Live branch rows and the live base rows that no branch row, tombstones included, replaces."""
    kept = hashed(base.filter(~F.col("is_deleted")), keys).join(hashed(branch.select(keys), keys), ["_h", *keys], "left_anti").drop("_h")
    return branch.filter(~F.col("is_deleted")).unionByName(kept, allowMissingColumns=True)


def merge_files(old: DataFrame, changed: DataFrame, new: DataFrame, file_column: str = "source_file_path") -> DataFrame:
    """Rows of changed files give way to the new ones."""
    return old.join(changed.select(file_column).distinct(), file_column, "left_anti").unionByName(new, allowMissingColumns=True)


def tombstones(base: DataFrame, files: DataFrame, file_column: str = "source_file_path") -> DataFrame:
    """Branch rows that hide a deleted file's base rows."""
    return base.join(files.select(file_column).distinct(), file_column, "left_semi").withColumns({"is_deleted": F.lit(True), "branch": F.lit("branch")})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """One row per key, the newest; on a tie the incoming one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_of(both, keys, newest.desc_nulls_last(), F.desc("_new")).drop("_h", "_new")


def resolve(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Fill target_entity_id and is_resolved from (keys, resolved_id); others stay as they are."""
    joined = rows.join(found.select(*keys, "resolved_id"), keys, "left")
    return joined.withColumns({"target_entity_id": F.coalesce("resolved_id", "target_entity_id"), "is_resolved": F.col("resolved_id").isNotNull() | F.col("is_resolved")}).drop("resolved_id")


def diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """(keys, change): added, removed or modified; unchanged rows are left out."""
    a = hashed(old, keys).select("_h", *keys, F.struct(*compared).alias("old_row"))
    b = hashed(new, keys).select("_h", *keys, F.struct(*compared).alias("new_row"))
    change = F.when(F.col("old_row").isNull(), "added").when(F.col("new_row").isNull(), "removed").when(~F.col("old_row").eqNullSafe(F.col("new_row")), "modified")
    return a.join(b, ["_h", *keys], "full_outer").select(*keys, change.alias("change")).filter("change is not null")


def by_precedence(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of least rank for every key: package over repo over workspace."""
    first = Window.partitionBy(*keys).orderBy(rank)
    return rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def deleted(base: DataFrame, files: DataFrame, file_column: str = "source_file_path") -> DataFrame:
    """Rows of the base that stay when files go."""
    return base.join(files.select(file_column).distinct(), file_column, "left_anti")


def lookup(base: DataFrame, branch: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Overlaid rows whose column has one of the values: by ids, source, target or kind.

    A branch row hides its base row whatever the branch row's column says, so only the base side is filtered before they meet.
    """
    return overlay(base.filter(F.col(column).isin(values)), branch, keys).filter(F.col(column).isin(values))


def lookup_file(base: DataFrame, branch: DataFrame, file: str, file_column: str = "file_path") -> DataFrame:
    """Live rows of one file: the branch's, if the branch has any row of it, else the base's."""
    mine, theirs = (df.filter(F.col(file_column) == file) for df in (branch, base))
    kept = theirs.join(mine.select(file_column).distinct(), file_column, "left_anti")
    return mine.filter(~F.col("is_deleted")).unionByName(kept.filter(~F.col("is_deleted")), allowMissingColumns=True)


def unresolved_refs(refs: DataFrame) -> DataFrame:
    return refs.filter(~F.col("is_resolved"))


def unresolved_edges(edges: DataFrame, edge_type: str) -> DataFrame:
    """(source_entity_id, target_entity_id, name, source_file_path, source_line) of edges to unresolved:name; a name in the properties counts before it."""
    hit = edges.filter((F.col("edge_type") == edge_type) & F.col("target_entity_id").startswith("unresolved:"))
    given = F.get_json_object("properties", "$.callee") if edge_type == "CALLS" else F.get_json_object("properties", "$.name")
    return hit.select("source_entity_id", "target_entity_id", F.coalesce(given, F.regexp_replace("target_entity_id", "^unresolved:", "")).alias("name"), "source_file_path", "source_line")


def resolve_edges(edges: DataFrame, found: DataFrame, edge_type: str) -> DataFrame:
    """Edges of one type with targets replaced where found (source_entity_id, target_entity_id, resolved_id) has one; all others stay."""
    keys = ["source_entity_id", "target_entity_id"]
    mine = F.coalesce(F.col("edge_type") == edge_type, F.lit(False))
    best = first_of(found.select(*keys, "resolved_id").filter("resolved_id is not null"), keys, F.asc("resolved_id")).withColumnRenamed("resolved_id", "_to")
    met = hashed(edges.filter(mine), keys).join(best, ["_h", *keys], "left").withColumn("target_entity_id", F.coalesce("_to", "target_entity_id")).drop("_h", "_to")
    return met.unionByName(edges.filter(~mine))
