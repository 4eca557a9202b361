"""Reading and writing graph tables kept as Parquet, per package or across packages."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TABLE = re.compile(r"\b(nodes|edges|effects|external_refs)@(\*|[\w./-]+)")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, paths: list[str], schema: T.StructType, filename: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows of the paths that exist, columns by name, and a warning for those that do not."""
    there = [p for p in paths if exists(spark, p)]
    warnings = [] if len(there) == len(paths) else [f"{len(paths) - len(there)} of {len(paths)} packages have no data"]
    if not there:
        return spark.createDataFrame([], schema), warnings
    df = spark.read.schema(schema).parquet(*there)
    return (df.withColumn("filename", F.col("_metadata.file_path")) if filename else df), warnings


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write(df: DataFrame, path: str, row_group_mb: int = 128, meta: dict | None = None) -> None:
    """Write a version beside those before it, then name it in one step; readers see the version before or this one, whole.

    path holds folders v-... and the file CURRENT, which names one of them and
    is replaced by a single rename; meta is kept in it.  The version before the
    one replaced goes, the replaced one stays for readers that opened it.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", row_group_mb << 20).parquet(f"{path}/{version}")
    before = current(spark, path)
    temp, fs = _fs(spark, f"{path}/.{version}")
    stream = fs.create(temp, True)
    stream.write(bytearray(json.dumps({"version": version, "before": before and before["version"], "meta": meta or {}}).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    where.rename(temp, _fs(spark, f"{path}/CURRENT")[0], options)
    if before and before["before"]:
        fs.delete(_fs(spark, f"{path}/{before['before']}")[0], True)


def current(spark: SparkSession, path: str) -> dict | None:
    """What CURRENT says of a written table: version, before and meta; None where there is none."""
    p, fs = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(p):
        return None
    reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(p)))
    try:
        return json.loads(reader.readLine())
    finally:
        reader.close()


def load(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that write() wrote."""
    found = current(spark, path)
    if found is None:
        raise SeedError("NO_SEEDS", f"no table at {path}")
    return spark.read.parquet(f"{path}/{found['version']}")


class SeedError(ValueError):
    """An error of this layer with its code: NO_PACKAGES, NO_SEEDS, INVALID_QUERY or LOCKED."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


#: Folders that no package lies in.
SKIPPED = ("node_modules", ".git", "dist", "build", "coverage")


def discover(spark: SparkSession, root: str, marker: str = "nodes.parquet", skip: tuple[str, ...] = SKIPPED, depth: int = 8) -> dict[str, str]:
    """Package path below root -> folder that holds the marker table, in order of path; listed on the driver, a folder at a time."""
    out: dict[str, str] = {}
    open_ = [("", root, 0)]
    while open_:
        name, folder, level = open_.pop()
        p, fs = _fs(spark, folder)
        if not fs.exists(p):
            continue
        inside = list(fs.listStatus(p))
        if any(x.getPath().getName() == marker for x in inside):
            out[name or "."] = folder
            continue
        if level < depth:
            open_ += [(f"{name}/{n}".lstrip("/"), f"{folder}/{n}", level + 1) for x in inside if x.isDirectory() and (n := x.getPath().getName()) not in skip and not n.startswith(".")]
    return dict(sorted(out.items()))


def is_ready(spark: SparkSession, root: str) -> bool:
    """Whether any package below root has tables."""
    return bool(discover(spark, root))


def package_tables(spark: SparkSession, packages: dict[str, str], tables: tuple[str, ...] = ("nodes", "edges", "external_refs", "effects")) -> dict[str, DataFrame]:
    """table_package -> rows of one package, for query(); table -> rows of all of them, columns by name."""
    if not packages:
        raise SeedError("NO_PACKAGES", "no package has tables")
    out: dict[str, DataFrame] = {}
    for t in tables:
        there = {n: f"{folder}/{t}.parquet" for n, folder in packages.items() if exists(spark, f"{folder}/{t}.parquet")}
        out |= {f"{t}_{re.sub(r'[^A-Za-z0-9]', '_', n)}": spark.read.parquet(p) for n, p in there.items()}
        if there:
            out[t] = spark.read.option("mergeSchema", True).parquet(*there.values())
    return out


def tables_hash(spark: SparkSession, packages: dict[str, str], tables: tuple[str, ...] = ("nodes", "edges", "external_refs", "effects")) -> str:
    """One SHA-256 over all packages' table files, in order of name: changes when a file does.  Files are told by name, length and time, so none is read."""
    out = hashlib.sha256()
    for name, folder in sorted(packages.items()):
        for t in tables:
            p, fs = _fs(spark, f"{folder}/{t}.parquet")
            if fs.exists(p):
                files = fs.listStatus(p)
                out.update(repr([name, t, sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files)]).encode())
    return out.hexdigest()


@contextlib.contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """One writer at a time: a lock file that only one can create, removed at the end."""
    p, fs = _fs(spark, f"{path}.lock")
    try:
        fs.create(p, False).close()
    except Exception as x:
        raise SeedError("LOCKED", f"{path} is being written") from x
    try:
        yield
    finally:
        fs.delete(p, False)


def ascii_table(df: DataFrame, limit: int = 100) -> str:
    """The first rows as text in columns of equal width, with a line under the names; limit bounds what reaches the driver."""
    rows = [[*df.columns], *[["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def expand(sql: str) -> str:
    """table@package, table@* and {table} -> view names."""
    sql = re.sub(r"\{(nodes|edges|effects|external_refs)\}", r"\1", sql)
    return _TABLE.sub(lambda m: m[1] if m[2] == "*" else f"{m[1]}_{re.sub(r'[^A-Za-z0-9]', '_', m[2])}", sql)


def select_only(sql: str) -> str:
    """The statement, if its first word is SELECT."""
    if not re.match(r"\s*select\b", sql, re.IGNORECASE):
        raise SeedError("INVALID_QUERY", "only SELECT statements can be run")
    return sql


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A SELECT over the given tables; names are bound as parameters, so concurrent callers do not share views."""
    text = expand(select_only(sql))
    used = {n: df for n, df in tables.items() if re.search(rf"\b(from|join)\s+{n}\b", text, re.IGNORECASE)}
    text = text.replace("{", "{{").replace("}", "}}")
    for n in used:
        text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text, flags=re.IGNORECASE)
    return spark.sql(text, **used)
