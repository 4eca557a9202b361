"""Entity-attribute-value rows over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.operators.traversal import reachable
from codegrain.sources.written import partitions

ATTRIBUTES = ("name", "kind", "file_path", "visibility", "documentation", "type_signature")


def node_datoms(nodes: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(e, a, v): one row per non-null attribute."""
    long = nodes.select("entity_id", *attributes).unpivot(["entity_id"], list(attributes), "a", "v")
    return long.filter("v is not null").select(F.col("entity_id").alias("e"), F.concat(F.lit(":node/"), "a").alias("a"), "v")


def edge_datoms(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_entity_id").alias("e"), F.concat(F.lit(":edge/"), "edge_type").alias("a"), F.col("target_entity_id").alias("v"))


def _by_entity(datoms: DataFrame, *more: str) -> DataFrame:
    """(e, more, n): rows of each entity, dealt by entity to as many tasks as the input asks for.

    Ids compress to a few bytes, so tasks sized by their shuffled bytes would hold millions of them at once.
    """
    some = datoms.select("e", *more)
    return some.repartition(partitions(some), "e").groupBy("e", *more).agg(F.count("*").alias("n"))


def attribute_counts(datoms: DataFrame) -> DataFrame:
    return _by_entity(datoms, "a").groupBy("a").agg(F.sum("n").alias("datoms"), F.count("e").alias("entities"))


def entity(datoms: DataFrame, e: str) -> DataFrame:
    return datoms.filter(F.col("e") == e).select("a", "v")


def with_attribute(datoms: DataFrame, a: str, v: str | None = None) -> DataFrame:
    hit = datoms.filter(F.col("a") == a)
    return (hit if v is None else hit.filter(F.col("v") == v)).select("e").distinct()


def reverse_refs(datoms: DataFrame, target: str) -> DataFrame:
    return datoms.filter(F.col("a").startswith(":edge/") & (F.col("v") == target)).select("e").distinct()


def entity_views(datoms: DataFrame) -> DataFrame:
    """Entity -> attribute -> sorted values."""
    per = datoms.groupBy("e", "a").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return per.groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("a", "vs"))).alias("view"))


def ref_datoms(refs: DataFrame) -> DataFrame:
    """(e, a, v): one row per external reference, v its module and symbol."""
    return refs.select(F.col("source_entity_id").alias("e"), F.lit(":external-ref/import").alias("a"), F.concat_ws("#", "module_specifier", "imported_symbol").alias("v"))


def load_counts(**families: DataFrame) -> DataFrame:
    """(family, datoms, entities) of every family given."""
    parts = [_by_entity(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("datoms"), F.count("e").alias("entities")).select(F.lit(n).alias("family"), "datoms", "entities") for n, df in families.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stats(datoms: DataFrame) -> DataFrame:
    """One row: all datoms, repeated ones too, entities and attributes."""
    kinds = datoms.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("datoms"), F.count("a").alias("attributes"))
    return kinds.crossJoin(_by_entity(datoms).agg(F.count("e").alias("entities"))).select("datoms", "entities", "attributes")


def asserted(datoms: DataFrame, more: DataFrame) -> DataFrame:
    """Attributes have many values: new rows are added, nothing is replaced."""
    return datoms.unionByName(more.select(datoms.columns))


def callees(datoms: DataFrame, e: str, nodes: DataFrame) -> DataFrame:
    """Known targets of an entity's calls, one row for each call."""
    hit = datoms.filter((F.col("a") == ":edge/CALLS") & (F.col("e") == e)).select(F.col("v").alias("entity_id"))
    return hit.join(nodes.select("entity_id", "name", "kind"), "entity_id")


def callers(datoms: DataFrame, e: str, nodes: DataFrame) -> DataFrame:
    """Known sources of calls to an entity, each once."""
    hit = datoms.filter((F.col("a") == ":edge/CALLS") & (F.col("v") == e)).select(F.col("e").alias("entity_id")).distinct()
    return hit.join(nodes.select("entity_id", "name", "kind"), "entity_id")


def find_entities(nodes: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Template: entities by kind and by a part of their name."""
    hit = nodes if kind is None else nodes.filter(F.col("kind") == kind)
    hit = hit if name is None else hit.filter(F.col("name").contains(name))
    return hit.select("entity_id", "name", "kind")


def trace(edges: DataFrame, start: DataFrame, depth: int = 3, callers: bool = False) -> DataFrame:
    """Templates: what start calls, or what calls it, each entity once at its least depth."""
    return reachable(edges, start, depth, ["CALLS"], reverse=callers)


def blast_radius(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """Template: all that depends on start over any edge, and how much of it lies at each depth."""
    return reachable(edges, start, depth, reverse=True).groupBy("depth").agg(F.count("*").alias("entities"))


def external_deps(refs: DataFrame) -> DataFrame:
    """Template: modules outside the graph, with the entities and symbols that need them."""
    return refs.filter(~F.col("is_resolved")).groupBy("module_specifier").agg(F.countDistinct("source_entity_id").alias("entities"), F.countDistinct("imported_symbol").alias("symbols"))
