"""Resolution of calls, base classes and imports to symbols, and of sends to routes.

Candidates are reduced to the best one per key before any join, so joins are
one to one and a common name multiplies no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.functions.ids import route

LOCAL, INDEXED = 1.0, 0.9
CALLABLE = ("function", "method", "class")
#: What a relative module specifier may stand for, in order.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def _best(nodes: DataFrame, keys: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """(keys, best): the symbol of the first kind in kinds, then of the least id."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return nodes.filter(F.col("kind").isin(*kinds)).groupBy(*keys).agg(F.min(F.struct(F.when(F.col("kind") == "class", 1).otherwise(0).alias("late"), rank.alias("rank"), "entity_id"))["entity_id"].alias("best"))


def resolve_names(uses: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = CALLABLE) -> DataFrame:
    """(file_path, name, ...) -> adds resolved_id and confidence: a symbol of the same file (1.0), else an exported one of any file (0.9), else null.

    Functions and methods come before classes.  For base classes pass kinds=("class",) or ("interface",).
    """
    local = _best(nodes, ["file_path", "name"], kinds).withColumnRenamed("best", "_local")
    anywhere = _best(nodes.filter("is_exported"), ["name"], kinds).withColumnRenamed("best", "_anywhere")
    found = uses.join(local, ["file_path", "name"], "left").join(anywhere, "name", "left")
    confidence = F.when(F.col("_local").isNotNull(), F.lit(LOCAL)).when(F.col("_anywhere").isNotNull(), F.lit(INDEXED))
    return found.withColumns({"resolved_id": F.coalesce("_local", "_anywhere"), "confidence": confidence}).drop("_local", "_anywhere")


def resolve_imports(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, base, symbol) -> adds resolved_id: the exported symbol in the first file that base may stand for."""
    tried = refs.select("ref_id", F.col("symbol").alias("name"), F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.col("base"), s))).alias("at", "file_path"))
    exported = nodes.filter("is_exported").groupBy("file_path", "name").agg(F.min("entity_id").alias("entity_id"))
    first = tried.join(exported, ["file_path", "name"]).groupBy("ref_id").agg(F.min_by("entity_id", "at").alias("resolved_id"))
    return refs.join(first, "ref_id", "left")


def match_routes(sends: DataFrame, requests: DataFrame) -> DataFrame:
    """(send_id, method, target) x (request_id, method, route_pattern) -> (send_id, request_id): the least request of equal method and normalised route."""
    served = requests.groupBy(F.upper("method").alias("method"), route(F.col("route_pattern")).alias("path")).agg(F.min("request_id").alias("request_id"))
    asked = sends.select("send_id", F.upper("method").alias("method"), route(F.col("target")).alias("path"))
    return asked.join(served, ["method", "path"]).select("send_id", "request_id")


def match_services(sends: DataFrame, requests: DataFrame) -> DataFrame:
    """(send_id, repo_id, target, service_name) x (request_id, repo_id, route_pattern) -> (send_id, target_repo, request_id).

    A send's service is looked for in the other repos whose name contains it or
    is contained in it, in order of name; the first of their requests whose
    route the target contains or equals is met, else the first such repo alone.
    Repos and services are few: they meet by name before any send or request does.
    """
    services = sends.select("repo_id", F.lower("service_name").alias("service")).filter("service is not null").distinct()
    repos = requests.select(F.col("repo_id").alias("target_repo")).distinct()
    low = F.lower("target_repo")
    known = services.join(repos, (F.col("repo_id") != F.col("target_repo")) & (low.contains(F.col("service")) | F.col("service").contains(low)))
    asked = sends.withColumn("service", F.lower("service_name")).join(known, ["repo_id", "service"]).select("send_id", "target", "target_repo")
    first = asked.groupBy("send_id").agg(F.min("target_repo").alias("target_repo"), F.first("target").alias("target"))
    served = requests.groupBy(F.col("repo_id").alias("target_repo"), "route_pattern").agg(F.min("request_id").alias("request_id"))
    met = first.join(served, "target_repo").filter(F.col("target").contains(F.col("route_pattern")) | (route(F.col("target")) == route(F.col("route_pattern"))))
    return first.select("send_id", "target_repo").join(met.groupBy("send_id").agg(F.min("request_id").alias("request_id")), "send_id", "left")


def affected_files(refs: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that import a changed symbol (entity_id), each once, with how many of them it uses."""
    hit = refs.filter("is_resolved").join(changed.select(F.col("entity_id").alias("target_entity_id")).distinct(), "target_entity_id", "left_semi")
    return hit.groupBy("source_file_path").agg(F.countDistinct("target_entity_id").alias("symbols"))
