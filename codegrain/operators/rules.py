"""First-match rule engines, compiled to one CASE chain per row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.ids import wildcard
from codegrain.operators.rule_tables import DOMAIN_RULES, GROUPING_RULES, SIGNIFICANCE_RULES


@dataclass(frozen=True)
class Rule:
    """Conditions that are set must all hold.  callee limits function calls only, source retrieves only."""

    id: str
    domain: str
    action: str
    provider: str | None = None
    priority: int = 0
    effect_type: str | None = None
    callee: str | None = None
    target: str | None = None
    source: str | None = None
    external: bool | None = None
    asynchronous: bool | None = None
    predicate: Callable[[], Column] | None = field(default=None, compare=False)

    def condition(self) -> Column:
        """Regular expressions search; a null never matches.  A callee does not bind other effect types."""
        kind = F.col("effect_type")
        out = F.lit(True)
        if self.effect_type:
            out = out & (kind == self.effect_type)
        if self.callee:
            out = out & ((kind != "FunctionCall") | F.coalesce(F.col("callee_name").rlike(self.callee), F.lit(False)))
        if self.target:
            place = F.when(kind.isin("Store", "Retrieve"), F.col("target_resource")).when(kind == "Send", F.col("target"))
            out = out & F.coalesce(place.rlike(self.target), F.lit(False))
        if self.source:
            out = out & ((kind != "Retrieve") | F.coalesce(F.col("target_resource").rlike(self.source), F.lit(False)))
        if self.external is not None:
            out = out & F.coalesce(F.col("is_external") == self.external, F.lit(False))
        if self.asynchronous is not None:
            out = out & F.coalesce(F.col("is_async") == self.asynchronous, F.lit(False))
        return out & self.predicate() if self.predicate else out


BUILTIN = tuple(Rule(i, domain, action, provider, priority, "FunctionCall", callee, external=external) for i, domain, action, provider, priority, callee, external in DOMAIN_RULES)


def ordered(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: -r.priority)  # stable: ties keep their order


def of_domain(rules: tuple[Rule, ...], domain: str) -> list[Rule]:
    return [r for r in rules if r.domain.lower() == domain.lower()]


def of_provider(rules: tuple[Rule, ...], provider: str) -> list[Rule]:
    return [r for r in rules if r.provider == provider]


def first_rule(rules: list[tuple[Column, str]]) -> Column:
    """Id of the first rule whose condition holds, else null: one flat CASE."""
    chain = None
    for condition, i in rules:
        chain = F.when(condition, i) if chain is None else chain.when(condition, i)
    return F.lit(None).cast("string") if chain is None else chain


def run_rules(effects: DataFrame, rules: tuple[Rule, ...] = BUILTIN) -> DataFrame:
    """Adds rule_id, domain, action and provider of the first matching rule; effects that match none are left out."""
    chain = first_rule([(r.condition(), r.id) for r in ordered(rules)])
    by_id = lambda of: F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.id, of(r))]), F.col("rule_id"))
    # the row id keeps the filter above the chain: pushed below, it would evaluate the chain and all its inputs once more
    hit = effects.select("*", chain.alias("rule_id"), F.monotonically_increasing_id().alias("_row")).filter("rule_id is not null and _row >= 0").drop("_row")
    return hit.withColumns({"domain": by_id(lambda r: r.domain), "action": by_id(lambda r: r.action), "provider": by_id(lambda r: r.provider)})


def rule_stats(effects: DataFrame, rules: tuple[Rule, ...] = BUILTIN) -> DataFrame:
    """Matches per rule, rules without any included."""
    ids = effects.sparkSession.createDataFrame([(r.id,) for r in rules], "rule_id string")
    hits = run_rules(effects, rules).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return ids.join(hits, "rule_id", "left").select("rule_id", F.coalesce("hits", F.lit(0)).alias("matches"))


def first_of(pairs: list[tuple[Column, str]], default: str) -> Column:
    """CASE chain of (condition, result); the building block of grouping, significance and mapping rules."""
    out = F.lit(default)
    for condition, result in reversed(pairs):
        out = F.when(condition, result).otherwise(out)
    return out


def _looked_up(key: str, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


def grouped(domain_effects: DataFrame, rules: tuple = GROUPING_RULES, default: str = "Other", path: str = "source_file_path") -> DataFrame:
    """Adds grouping_rule, container, layer and tags of the first rule whose pattern the path holds; others get the default container."""
    order = sorted(rules, key=lambda r: -r[5])
    hit = domain_effects.withColumn("grouping_rule", first_rule([(F.col(path).rlike(f"(?i){r[1]}"), r[0]) for r in order]))
    tags = F.split(_looked_up("grouping_rule", {r[0]: ",".join(r[4]) for r in rules}), ",")
    return hit.withColumns({
        "container": F.coalesce(_looked_up("grouping_rule", {r[0]: r[2] for r in rules}), F.lit(default)),
        "layer": _looked_up("grouping_rule", {r[0]: r[3] for r in rules}),
        "tags": F.coalesce(tags, F.array().cast("array<string>")),
    })


def _significant(wanted: dict) -> Column:
    """Conditions of one significance rule; columns that a source lacks are null and match no name or kind."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & {
            "domain": lambda v: F.col("domain") == v,
            "action": lambda v: F.col("action") == v,
            "console": lambda v: F.col("provider") == "console",
            "file": lambda v: F.col("source_file_path").rlike(f"(?i){v}"),
            "name": lambda v: F.col("source_name").rlike(f"(?i){v}"),
            "kinds": lambda v: F.col("source_kind").isin(*v),
            "exported": lambda v: F.coalesce(F.col("source_exported"), F.lit(False)) == v,
            "min_dependents": lambda v: F.coalesce(F.col("dependents"), F.lit(0)) >= v,
        }[key](value)
    return out


def significance(domain_effects: DataFrame, dependents: DataFrame, nodes: DataFrame | None = None, rules: tuple = SIGNIFICANCE_RULES, default: str = "minor") -> DataFrame:
    """Adds significance_rule and significance: critical, important, minor or hidden.

    dependents: (source_entity_id, dependents).  nodes give the source's name,
    kind and export flag; without them rules on these match nothing, and no
    source counts as exported.
    """
    d = domain_effects.join(dependents.select("source_entity_id", "dependents"), "source_entity_id", "left")
    if nodes is None:
        d = d.withColumns({n: F.lit(None).cast(t) for n, t in (("source_name", "string"), ("source_kind", "string"), ("source_exported", "boolean"))})
    else:
        d = d.join(nodes.select(F.col("entity_id").alias("source_entity_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"), F.col("is_exported").alias("source_exported")), "source_entity_id", "left")
    order = sorted(rules, key=lambda r: -r[2])
    hit = d.withColumn("significance_rule", first_rule([(_significant(r[3]), r[0]) for r in order]))
    return hit.withColumn("significance", F.coalesce(_looked_up("significance_rule", {r[0]: r[1] for r in rules}), F.lit(default)))


def shown(significant: DataFrame, least: str = "minor", include_hidden: bool = False) -> DataFrame:
    """Effects of at least a level; hidden ones only on request."""
    rank = {"critical": 3, "important": 2, "minor": 1, "hidden": 0}
    wanted = [k for k, v in rank.items() if v >= rank[least] and k != "hidden"] + ["hidden"] * include_hidden
    return significant.filter(F.col("significance").isin(wanted))


#: Families of mappings in the order that they are tried, levels from the most specific one.
FAMILIES, LEVELS = {"store": "Store", "retrieve": "Retrieve", "send": "Send"}, ("package", "repo", "workspace")


@dataclass(frozen=True)
class Mapping:
    """What calls that match a pattern stand for; a star matches one character or more.  kind: store, retrieve or send type."""

    family: str
    pattern: str
    kind: str
    level: str = "workspace"
    operation: str | None = None
    provider: str | None = None
    target: str | None = None
    service: str | None = None
    third_party: bool | None = None


def resolved(mappings: tuple[Mapping, ...]) -> list[Mapping]:
    """Mappings in the order that they are tried: of one family and pattern the most specific level's stays, at the place where the pattern came first from the least specific level on."""
    placed: dict[tuple[str, str], Mapping] = {}
    for level in reversed(LEVELS):
        for m in mappings:
            if m.level == level:
                placed[m.family, m.pattern] = m
    return sorted(placed.values(), key=lambda m: list(FAMILIES).index(m.family))


def mapped(effects: DataFrame, mappings: tuple[Mapping, ...]) -> DataFrame:
    """Adds mapped_type, mapped_kind, operation, provider, resource, service and mapping of the first mapping that a function call's callee matches; other effects and calls keep their type.

    A target defaults to the callee; the send type external counts as http.
    """
    order = resolved(mappings)
    chain = first_rule([((F.col("effect_type") == "FunctionCall") & wildcard(F.col("callee_name"), m.pattern), str(i)) for i, m in enumerate(order)])
    hit = effects.select("*", chain.alias("_mapping"), F.monotonically_increasing_id().alias("_row")).filter("_row >= 0")

    def of(value: Callable[[Mapping], str | None]) -> Column:
        known = {str(i): value(m) for i, m in enumerate(order) if value(m) is not None}
        return _looked_up("_mapping", known) if known else F.lit(None).cast("string")

    resource = F.when(F.col("_mapping").isNotNull(), F.coalesce(of(lambda m: m.target if m.family != "send" else None), F.col("callee_name")))
    return hit.withColumns({
        "mapped_type": F.coalesce(of(lambda m: FAMILIES[m.family]), F.col("effect_type")),
        "mapped_kind": of(lambda m: "http" if m.family == "send" and m.kind == "external" else m.kind),
        "operation": of(lambda m: m.operation), "provider": of(lambda m: m.provider), "resource": resource, "service": of(lambda m: m.service), "mapping": of(lambda m: m.pattern),
    }).drop("_mapping", "_row")
