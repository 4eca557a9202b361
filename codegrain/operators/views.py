"""Architecture aggregates and gap scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.functions.infer import provider_name
from codegrain.sources.written import written


def joined_set(column: Column | str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(column)), ",")


def domain_summary(domain_effects: DataFrame) -> DataFrame:
    return domain_effects.groupBy("domain").agg(joined_set("action").alias("actions"), F.count("*").alias("count"))


def containers(domain_effects: DataFrame) -> DataFrame:
    """Per container: components (source entities), effects and domains."""
    return domain_effects.groupBy("container").agg(F.countDistinct("source_entity_id").alias("components"), F.count("*").alias("effects"), joined_set("domain").alias("domains"))


def external_systems(domain_effects: DataFrame) -> DataFrame:
    return domain_effects.filter(F.coalesce("is_external", F.lit(False)) & F.col("provider").isNotNull()).groupBy("domain", "provider").agg(F.count("*").alias("count"))


def external_id(domain: Column, provider: Column) -> Column:
    return F.concat_ws("_", F.lit("external"), domain, F.coalesce(provider, F.lit("external")))


def relationships(domain_effects: DataFrame, labels: int = 3) -> DataFrame:
    """(container, target): calls to each external system, labelled "domain:action" for a single call, else "action, action (n calls)" with the first labels actions."""
    outward = domain_effects.filter(F.coalesce("is_external", F.lit(False)))
    n = outward.groupBy("container", external_id(F.col("domain"), F.col("provider")).alias("target")).agg(F.count("*").alias("count"), F.sort_array(F.collect_set("action")).alias("actions"), F.min(F.concat_ws(":", "domain", "action")).alias("single"))
    several = F.concat(F.array_join(F.slice("actions", 1, labels), ", "), F.lit(" ("), F.col("count").cast("string"), F.lit(" calls)"))
    return n.select("container", "target", "count", F.when(F.col("count") == 1, F.col("single")).otherwise(several).alias("label"))


def container_entities(domain_effects: DataFrame) -> DataFrame:
    """(container, source_entity_id, effects): the distinct "domain:action" of every component."""
    return domain_effects.groupBy("container", "source_entity_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "domain", "action"))), ",").alias("effects"))


def internal_relationships(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Calls between different containers; placed maps entity_id to container."""
    ends = [placed.select(F.col("entity_id").alias(f"{e}_entity_id"), F.col("container").alias(e)) for e in ("source", "target")]
    calls = edges.filter(F.col("edge_type") == "CALLS").join(ends[0], "source_entity_id").join(ends[1], "target_entity_id")
    return calls.filter(F.col("source") != F.col("target")).groupBy("source", "target").agg(F.count("*").alias("calls"))


def boundaries(domain_effects: DataFrame) -> DataFrame:
    """Per domain: files, components, actions, external systems, and cohesion: components over twice the files, one at most."""
    provider = F.when(F.coalesce("is_external", F.lit(False)), F.col("provider"))
    d = domain_effects.groupBy("domain").agg(F.countDistinct("source_file_path").alias("files"), F.countDistinct("source_entity_id").alias("components"), joined_set("action").alias("actions"), joined_set(provider).alias("externals"))
    return d.withColumn("cohesion", F.round(F.least(F.lit(1.0), F.col("components") / F.greatest(F.lit(1), F.col("files") * 2)), 6))


def effect_chains(domain_effects: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(chains, members): the most telling flows of effects.

    Every domain has a flow for each provider of its external effects: of each
    (entity, action) in it one effect, its own (least order) before those of the
    domain that share a file or an entity with it.  Domains with three or more
    effects and no external ones have one flow of all, of which ten are members.
    Scores: 10 for an external effect, 5, 4, 2 or 1 by domain, and the length
    from three on.  domain_effects need a column order that ranks them.
    """
    key = ["source_entity_id", "action"]
    external = F.coalesce("is_external", F.lit(False))
    d = domain_effects.withColumns({"external": external, "via": F.when(external, F.coalesce("provider", F.lit("external")))})
    points = F.when(F.col("domain") == "Payment", 5).when(F.col("domain") == "Auth", 4).when(F.col("domain") == "Database", 2).otherwise(1) + F.when(F.col("external"), 10).otherwise(0)
    # domains and providers are few: anchors are reduced to distinct files and entities before they meet the domain's effects
    anchors = d.filter("external").select("domain", F.col("via").alias("flow"), "source_file_path", "source_entity_id")
    files = anchors.select("domain", "flow", "source_file_path").distinct()
    entities = anchors.select("domain", "flow", "source_entity_id").distinct()
    own = d.filter("external").select("domain", F.col("via").alias("flow"), *key, "order", "effect_id", "external", F.lit(0).alias("late"))
    near = [d.join(a, ["domain", on]).select("domain", "flow", *key, "order", "effect_id", "external", F.lit(1).alias("late")) for a, on in ((files, "source_file_path"), (entities, "source_entity_id"))]
    related = own.unionByName(near[0]).unionByName(near[1]).groupBy("domain", "flow", *key).agg(F.min(F.struct("late", "order", "effect_id", "external")).alias("e"))
    flows = related.select("domain", "flow", *key, "e.effect_id", "e.external", F.col("e.late").alias("late"), F.col("e.order").alias("order"))
    without = d.groupBy("domain").agg(F.count("*").alias("n"), F.max("external").alias("any")).filter("n >= 3 and not any").select("domain")
    plain = d.join(without, "domain").select("domain", F.lit("").alias("flow"), *key, "effect_id", "external", F.lit(0).alias("late"), "order")
    every = flows.unionByName(plain)
    scored = every.groupBy("domain", "flow").agg(F.sum(points).alias("points"), F.count("*").alias("length"))
    name = F.concat_ws("_", F.lower("domain"), F.nullif("flow", F.lit("")), F.lit("flow")).alias("chain_id")
    chains = scored.select(name, "domain", "flow", "length", (F.col("points") + F.when(F.col("length") >= 3, F.col("length")).otherwise(0)).alias("score")).orderBy(F.desc("score"), "chain_id").limit(most)
    rank = Window.partitionBy("domain", "flow").orderBy("late", "order", "effect_id")
    members = every.join(chains.select("chain_id", "domain", "flow"), ["domain", "flow"]).withColumn("place", F.row_number().over(rank)).filter((F.col("flow") != "") | (F.col("place") <= 10))
    return chains, members.select("chain_id", "domain", "effect_id", "place")


def flow_rank(domain: Column, action: Column) -> Column:
    """Entry points, then checks, business calls, data and messages."""
    entry = (domain == "API") | F.lower(action).contains("request")
    return F.when(entry, 0).when(domain == "Auth", 1).when(domain.isin("Payment", "HTTP"), 2).when(domain == "Database", 3).when(domain == "Messaging", 4).otherwise(5)


def flow_steps(members: DataFrame, domain_effects: DataFrame, steps: int = 8) -> DataFrame:
    """(chain_id, step, source_entity_id, target, target_name, label) of each chain's first effects in flow order; ties keep the chain's order."""
    d = members.join(domain_effects.drop("domain"), "effect_id")
    rank = Window.partitionBy("chain_id").orderBy(flow_rank(F.col("domain"), F.col("action")), "place")
    d = d.withColumn("step", F.row_number().over(rank)).filter(F.col("step") <= steps)
    outward = F.coalesce("is_external", F.lit(False))
    provider = F.coalesce("provider", F.lit("external"))
    target = F.when(outward, external_id(F.col("domain"), provider)).otherwise(F.concat(F.lower("domain"), F.lit("_service")))
    name = F.when(outward, provider_name(provider)).otherwise(F.concat("domain", F.lit(" Service")))
    label = F.coalesce(F.element_at(F.split("callee_name", r"\."), -1), F.concat_ws(":", "domain", "action"))
    return d.select("chain_id", "step", "effect_id", "source_entity_id", target.alias("target"), name.alias("target_name"), label.alias("label"))


def significance_context(domain_effects: DataFrame) -> DataFrame:
    """(scope, name, count): all effects, effects per domain and per action, in one pass."""
    kinds = F.array(F.struct(F.lit("total").alias("scope"), F.lit("").alias("name")), F.struct(F.lit("domain").alias("scope"), F.col("domain").alias("name")), F.struct(F.lit("action").alias("scope"), F.col("action").alias("name")))
    return domain_effects.select(F.explode(kinds).alias("k")).groupBy("k.scope", "k.name").agg(F.count("*").alias("count"))


#: Lower-case kinds of model elements.
EXTERNAL_KINDS, CONTAINER_KINDS = ("external", "database", "queue", "storage"), ("container", "system", "layer")


def classified(elements: DataFrame, external: tuple[str, ...] = EXTERNAL_KINDS, containers: tuple[str, ...] = CONTAINER_KINDS) -> DataFrame:
    """(id, kind, parent, tags) -> adds role: external by kind or tag, container by kind or for want of a parent, else component."""
    kind, tagged = F.lower("kind"), F.coalesce(F.array_contains("tags", "external"), F.lit(False))
    return elements.withColumn("role", F.when(kind.isin(*external) | tagged, "external").when(kind.isin(*containers) | (F.coalesce("parent", F.lit("")) == ""), "container").otherwise("component"))


def containers_of(elements: DataFrame, depth: int = 10) -> DataFrame:
    """(id, container) of classified elements: itself, or the nearest ancestor that is a container, null where there is none within depth."""
    up = elements.select(F.col("id").alias("above"), F.col("role").alias("above_role"), F.col("parent").alias("next"))
    found = elements.select("id", F.when(F.col("role") == "container", F.col("id")).alias("container"), F.col("parent").alias("above"))
    done, open_ = [found.filter("container is not null").select("id", "container")], found.filter("container is null")
    for _ in range(depth):
        step = written(open_.join(up, "above", "left").select("id", F.when(F.col("above_role") == "container", F.col("above")).alias("container"), F.col("next").alias("above")))
        done.append(step.filter("container is not null or above is null").select("id", "container"))
        open_ = step.filter("container is null and above is not null")
        if open_.isEmpty():
            break
    else:
        done.append(open_.select("id", F.lit(None).cast("string").alias("container")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def layer_coverage(named: DataFrame, rules: list[tuple[Column, str, str]], default: str) -> DataFrame:
    """(result, rule_id, count): how many named elements each rule is the first to match; rules: (condition, rule id, result)."""
    chain = F.lit(None).cast("struct<result:string,rule_id:string>")
    for condition, rule, result in reversed(rules):
        chain = F.when(condition, F.struct(F.lit(result).alias("result"), F.lit(rule).alias("rule_id"))).otherwise(chain)
    hit = named.select(chain.alias("hit"), F.monotonically_increasing_id().alias("_row")).filter("_row >= 0")  # the chain is evaluated once
    return hit.groupBy(F.coalesce("hit.result", F.lit(default)).alias("result"), F.col("hit.rule_id").alias("rule_id")).agg(F.count("*").alias("count"))


def coverage(hits: DataFrame) -> DataFrame:
    """(file, measure, hits) -> (file, measure, percent): the share of places hit, in tenths; a file without places has no row and counts as 100."""
    n = hits.groupBy("file", "measure").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count("*").alias("places"))
    return n.select("file", "measure", (F.floor(F.col("covered") * 1000 / F.col("places") + 0.5) / 10).alias("percent"))


def coverage_summary(files: DataFrame, measures: tuple[str, ...] = ("lines", "branches", "functions", "statements")) -> DataFrame:
    """One row: the unweighted mean of every measure over files, 100 for files without it, 0 with no files."""
    per = files.groupBy("file").agg(*[F.coalesce(F.max(F.when(F.col("measure") == m, F.col("percent"))), F.lit(100.0)).alias(m) for m in measures])
    return per.agg(*[F.coalesce(F.floor(F.avg(m) * 10 + 0.5) / 10, F.lit(0.0)).alias(m) for m in measures])


def normalized(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[-_ ]", ""), "layer$", "")


def f1(actual: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of two sets; empty sides give zero."""
    a, p = actual.select(key).distinct().withColumn("a", F.lit(1)), predicted.select(key).distinct().withColumn("p", F.lit(1))
    n = a.join(p, key, "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def signal_to_noise(generated: Column, validated: Column) -> Column:
    ratio = generated / validated
    score = F.when((ratio >= 0.5) & (ratio <= 2.0), 1 - F.abs(1 - ratio) * 0.5).when(ratio > 2.0, F.greatest(F.lit(0.0), 1 - (ratio - 2) * 0.2)).otherwise(ratio)
    return F.when(validated == 0, F.when(generated > 0, 0.5).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def gap_score(container_f1: Column, signal: Column, relationship_f1: Column, external_f1: Column) -> Column:
    return 0.25 * container_f1 + 0.45 * signal + 0.15 * relationship_f1 + 0.15 * external_f1
