"""Names inferred from callees, modules and paths, and links to entities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first row with a keyword that the lower-cased text contains decides.
STORE_OPERATIONS = ((("insert", "create", "add"), "insert"), (("update", "upsert"), "update"), (("delete", "remove"), "delete"), (("set", "put", "write"), "write"))
RETRIEVE_OPERATIONS = ((("findmany", "findall", "query", "select"), "query"), (("get", "find", "read"), "get"), (("scan",), "scan"))
SERVICES = ((("stripe",), "stripe"), (("sendgrid",), "sendgrid"), (("aws-sdk", "@aws-sdk"), "aws"), (("axios", "fetch"), "http"), (("redis",), "redis"), (("prisma",), "prisma"))
CATEGORIES = (
    (("log", "console", "debug"), "logging"), (("error", "throw", "exception"), "error-handling"), (("validate", "check", "assert"), "validation"),
    (("parse", "stringify", "serialize"), "serialization"), (("path", "file", "fs."), "filesystem"), (("date", "time"), "datetime"), (("push", "pop", "map", "filter"), "array-ops"),
)
#: Path parts that stand before a user, a workspace and a project, and folders that hold sources.
ABOVE_PROJECTS, SOURCE_FOLDERS = ("Users", "home", "var", "tmp", "opt"), ("src", "lib", "dist", "build", "packages")


def first_keyword(text: Column, table: tuple, default: Column) -> Column:
    """The result of the first row of a keyword table that the text, in lower case, contains a word of."""
    low, chain = F.lower(text), None
    for words, result in table:
        condition = F.lit(False)
        for w in words:
            condition = condition | low.contains(w)
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    return chain.otherwise(default)


def operation(pattern: Column, family: str) -> Column:
    """What a store or retrieve does, by its callee."""
    table, default = {"store": (STORE_OPERATIONS, "write"), "retrieve": (RETRIEVE_OPERATIONS, "get")}[family]
    return first_keyword(pattern, table, F.lit(default))


def service(module: Column) -> Column:
    """Service of a module path: a known one, else its last segment."""
    last = F.nullif(F.element_at(F.split(module, "/"), -1), F.lit(""))
    return first_keyword(F.coalesce(module, F.lit("")), SERVICES, F.coalesce(last, F.lit("unknown")))


def category(pattern: Column) -> Column:
    return first_keyword(pattern, CATEGORIES, F.lit("-"))


def container_of(path: Column, grouping: str = "directory") -> Column:
    """Folder, package or single container that a path belongs to.

    Paths that begin above a project lose four parts each time they do (twice at
    most: a project within a project), then a leading source folder.
    """
    if grouping == "package":
        return F.coalesce(F.nullif(F.regexp_extract(path, "packages?/([^/]+)", 1), F.lit("")), F.lit("main"))
    if grouping != "directory":
        return F.lit("main")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    for _ in range(2):
        parts = F.when(F.coalesce(F.get(parts, F.lit(0)).isin(*ABOVE_PROJECTS), F.lit(False)), F.slice(parts, 5, F.greatest(F.lit(0), F.size(parts)))).otherwise(parts)
    head, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.coalesce(F.when(head.isin(*SOURCE_FOLDERS), F.coalesce(second, head)).otherwise(head), F.lit("root"))


def provider_name(provider: Column) -> Column:
    """A provider as titles spell it: without the cloud's prefix, words capitalised."""
    words = F.split(F.regexp_replace(provider, "^aws-", ""), "[-_]")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


#: The scheme of links; any other may be passed.
SCHEME = "code://"
#: What tells a file from a package in a link's path: endings of file names, and folders that files begin with.
FILE_ENDINGS, FILE_FOLDERS = (".ts", ".tsx", ".js", ".jsx", ".py", ".cs", ".go", ".rs", ".java"), ("src", "lib", "test", "tests", "__tests__", "dist")
PARAMETERS = ("version", "line", "col", "endLine", "endCol")


def uri(repo: Column, package: Column, file: Column, symbol: Column, version: Column | None = None, line: Column | None = None, scheme: str = SCHEME) -> Column:
    """scheme repo/package/file#symbol?version=..&line=..; the root package, ".", is spelled only before a file, absent parts are left out."""
    root = F.coalesce(package, F.lit(".")) == "."
    place = F.when(~root, F.concat(F.lit("/"), package)).when(file.isNotNull(), F.lit("/.")).otherwise("")
    given = [F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in (("version", version), ("line", line)) if c is not None]
    query = F.array_join(F.array_compact(F.array(*given)), "&") if given else F.lit("")
    return F.concat(F.lit(scheme), repo, place, F.coalesce(F.concat(F.lit("/"), file), F.lit("")), F.coalesce(F.concat(F.lit("#"), symbol), F.lit("")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def parsed_uri(link: Column, scheme: str = SCHEME) -> Column:
    """struct(repo, package, file, symbol, version, line, col, endLine, endCol) of a link, null where it is none.

    A file begins at the first part that ends like one, or that files begin with; what lies before is the package.
    """
    rest = F.substring(link, len(scheme) + 1, 1 << 20)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    body = F.regexp_replace(rest, r"\?.*$", "")
    symbol = F.nullif(F.regexp_extract(body, "#(.*)$", 1), F.lit(""))
    parts = F.filter(F.split(F.regexp_replace(body, "#.*$", ""), "/"), lambda p: p != "")
    path = F.slice(parts, 2, F.size(parts))
    ends = lambda p: F.exists(F.array(*map(F.lit, FILE_ENDINGS)), lambda e: p.endswith(e))
    opens = F.array_position(F.transform(path, lambda p: F.when(ends(p) | p.isin(*FILE_FOLDERS), 1).otherwise(0)), 1).cast("int") - 1
    rooted = F.coalesce(F.get(path, F.lit(0)) == ".", F.lit(False))
    begin = F.when(rooted, 1).when(opens < 0, F.size(path)).otherwise(opens)
    package = F.when(rooted | (begin == 0), ".").otherwise(F.array_join(F.slice(path, F.lit(1), begin), "/"))
    file = F.when(begin < F.size(path), F.array_join(F.slice(path, begin + 1, F.size(path)), "/"))
    value = lambda n: F.nullif(F.regexp_extract(query, f"(?:^|&){n}=([^&]*)", 1), F.lit(""))
    given = [F.url_decode(value("version")).alias("version"), *(value(n).try_cast("int").alias(n) for n in PARAMETERS[1:])]
    return F.when(link.startswith(scheme) & (F.size(parts) > 0), F.struct(F.get(parts, F.lit(0)).alias("repo"), package.alias("package"), file.alias("file"), symbol.alias("symbol"), *given))


def resolve_uris(links: DataFrame, index: DataFrame, scheme: str = SCHEME) -> DataFrame:
    """(link) x (entity_id, repo, package, file, symbol) -> (link, entity_id): the least entity at that place, null where there is none."""
    keys = ["repo", "package", "file", "symbol"]
    known = index.groupBy(*keys).agg(F.min("entity_id").alias("entity_id"))
    asked = links.select("link", parsed_uri(F.col("link"), scheme).alias("p")).select("link", *[F.col(f"p.{k}") for k in keys])
    return asked.join(known, [asked[k].eqNullSafe(known[k]) for k in keys], "left").select("link", "entity_id")
