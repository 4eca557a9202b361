"""Entity ids, paths, routes and hashes as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope_hash(file: Column, scoped_name: Column, kind: Column) -> Column:
    """First eight hex digits of the SHA-256 of the three parts, joined by NUL; backslashes in paths become slashes."""
    path = F.regexp_replace(F.trim(file), r"\\", "/")
    return F.substring(F.sha2(F.concat_ws("\u0000", path, F.trim(scoped_name), kind), 256), 1, 8)


def entity_id(repo: Column, package: Column, kind: Column, digest: Column) -> Column:
    return F.concat_ws(":", repo, package, kind, digest)


def parsed_id(e: Column) -> Column:
    """struct(repo, package, kind, hash): first, middle, last but one and last part."""
    parts = F.split(e, ":")
    n = F.size(parts)
    return F.struct(parts[0].alias("repo"), F.array_join(F.slice(parts, 2, n - 3), ":").alias("package"), F.element_at(parts, -2).alias("kind"), F.element_at(parts, -1).alias("hash"))


def route(path: Column) -> Column:
    """Routes compare without parameters' names, trailing slashes and case."""
    named = F.regexp_replace(F.lower(path), r"(:\w+|\{[^}]*\}|\$\{[^}]*\}|\[[^\]]*\])", "*")
    return F.regexp_replace(named, "/+$", "")


def wildcard(name: Column, pattern: str) -> Column:
    """foo.* style patterns: a star is one character or more, all else is literal."""
    return name.rlike("(?s)^" + ".+".join(re.sub(r"([^\w\s])", r"\\\1", part) for part in pattern.split("*")) + r"\z")


def relationship_key(source: Column, target: Column) -> Column:
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    return F.lower(F.concat(last(source), F.lit("->"), last(target)))
