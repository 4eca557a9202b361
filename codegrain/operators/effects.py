"""Effect filters, statistics and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegrain.operators.symbols import repo_of


def effects_where(effects: DataFrame, types: list[str] | None = None, source: str | None = None, file: str | None = None, external: bool | None = None, callee: str | None = None, asynchronous: bool | None = None, target: str | None = None) -> DataFrame:
    for wanted, condition in (
        (types, lambda: F.col("effect_type").isin(types)),
        (source, lambda: F.col("source_entity_id") == source),
        (file, lambda: F.col("source_file_path").contains(file)),
        (external, lambda: F.col("is_external") == external),
        (callee, lambda: F.col("callee_name").contains(callee)),
        (asynchronous, lambda: F.col("is_async") == asynchronous),
        (target, lambda: F.coalesce("target_resource", "target") == target),
    ):
        if wanted is not None:
            effects = effects.filter(condition())
    return effects


def page(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    return rows.orderBy(F.desc("timestamp"), "effect_id").offset(offset).limit(limit)


def statistics(effects: DataFrame) -> DataFrame:
    kinds = ("FunctionCall", "Store", "Retrieve", "Send", "Request", "Response")
    target = F.coalesce("target_resource", "target")
    return effects.agg(F.count("*").alias("total"), *[F.count_if(F.col("effect_type") == k).alias(k.lower()) for k in kinds], F.count_if(F.coalesce("is_external", F.lit(False))).alias("external"), F.countDistinct("source_entity_id").alias("sources"), F.countDistinct(target).alias("targets"))


def summary(effects: DataFrame, by: str = "effect_type") -> DataFrame:
    return effects.groupBy(by).agg(F.count("*").alias("count"))


def summary_with_total(effects: DataFrame, by: str = "effect_type") -> DataFrame:
    """summary(), each row with the grand total, which is taken over the few groups."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return summary(effects, by).withColumn("total", F.sum("count").over(whole))


def package_patterns(effects: DataFrame) -> DataFrame:
    """Per callee: uses, the packages that use it, and whether these are several."""
    n = effects.filter("callee_name is not null").groupBy("callee_name", F.split_part("source_entity_id", F.lit(":"), F.lit(2)).alias("package")).agg(F.count("*").alias("n"))
    return n.groupBy("callee_name").agg(F.sum("n").alias("count"), F.array_join(F.sort_array(F.collect_list("package")), ",").alias("packages"), (F.count("*") > 1).alias("is_cross_package"))


def static_and_runtime(static: DataFrame, runtime: DataFrame, keys: list[str]) -> DataFrame:
    """Every static effect key with the number of runtime effects that have it, zero too."""
    n = runtime.groupBy(*keys).agg(F.count("*").alias("runtime"))
    return static.groupBy(*keys).agg(F.count("*").alias("static")).join(n, keys, "left").select(*keys, "static", F.coalesce("runtime", F.lit(0)).alias("runtime"))


def callee_patterns(effects: DataFrame, least: int = 1) -> DataFrame:
    keys = ["callee_name", "is_method_call", "is_async", "is_external", "external_module"]
    return effects.filter(F.col("effect_type") == "FunctionCall").groupBy(*keys).agg(F.count("*").alias("count")).filter(F.col("count") >= least)


def workspace_counts(effects: DataFrame) -> DataFrame:
    """Per repo: stores, retrieves, sends and externals, and all the rest."""
    kind = F.lower("effect_type")
    named = {"store": kind == "store", "retrieve": kind == "retrieve", "external": kind.isin("send", "external")}
    other = ~kind.isin("store", "retrieve", "send", "external")
    return effects.groupBy(repo_of(F.col("source_entity_id")).alias("repo")).agg(*[F.count_if(c).alias(n) for n, c in named.items()], F.count_if(other).alias("other"))


def cross_patterns(effects: DataFrame, group: str, top: int = 100, least_groups: int = 2) -> DataFrame:
    """Callees among a group's top ones that at least least_groups groups share."""
    n = effects.filter("callee_name is not null").groupBy(group, "callee_name").agg(F.count("*").alias("n"))
    ranked = n.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "callee_name"))).filter(F.col("rn") <= top)
    return ranked.groupBy("callee_name").agg(F.count("*").alias("groups"), F.sum("n").alias("total")).filter(F.col("groups") >= least_groups)


def async_by_file(effects: DataFrame) -> DataFrame:
    calls = effects.filter(F.col("effect_type") == "FunctionCall")
    return calls.groupBy("source_file_path").agg(F.count_if(F.col("is_async")).alias("async_calls"), F.count_if(~F.col("is_async")).alias("sync_calls"))


def enriched(effects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Effects with their source's name and kind; an unknown source keeps its id as name."""
    n = nodes.select(F.col("entity_id").alias("source_entity_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
    e = effects.join(n, "source_entity_id", "left")
    return e.withColumns({"source_name": F.coalesce("source_name", "source_entity_id"), "source_kind": F.coalesce("source_kind", F.lit("unknown"))})
