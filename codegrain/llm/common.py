"""Shared helpers: table access, lineage cuts, worker-side caches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of a word: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"

_WRITTEN: list[tuple[SparkSession, str, str]] = []
_SCOPE = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is configured, a temporary one serves a local session; a cluster has to name its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codegrain-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs nothing twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codegrain-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path, _SCOPE[-1]))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables that cut() writes inside belong to name, for drop_cuts(name)."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def drop_cuts(name: str | None = None, unless: DataFrame | None = None) -> None:
    """Delete the tables that cut() wrote, of one scope or all, but not those that unless still reads.  Runs at exit; call it earlier once results are written."""
    read = {part for f in (unless.inputFiles() if unless is not None else []) for part in f.split("/")}
    gone = [x for x in _WRITTEN if (name is None or x[2] == name) and x[1].rsplit("/", 1)[-1] not in read]
    for x in gone:
        spark, path, _ = x
        _WRITTEN.remove(x)
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may have gone at interpreter exit
            return


def trim_jvm(spark: SparkSession) -> str:
    """jcmd's System.trim_native_heap on the driver's JVM.  By reflection, since the server's own class is not exported to callers."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    named = jvm.java.lang.Class.forName
    kinds = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    return invoke.invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver's garbage is collected.

    What the driver's JVM and Python have freed outside the heap goes back to the system: planning leaves it scattered over the allocator's arenas.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    for trim in (lambda: ctypes.CDLL(None).malloc_trim(0), lambda: trim_jvm(spark)):
        with contextlib.suppress(Exception):  # not every C library and JVM can
            trim()


atexit.register(drop_cuts)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def worker_cache(name: str) -> dict:
    """A dict that outlives tasks within one Python worker; a worker holds that of one name at a time, so memory stays bounded over stages.

    Functions come to workers by value, with globals of their own, so the dict hangs on a module that the worker keeps.
    """
    held = vars(sys.modules.setdefault("codegrain_worker_cache", types.ModuleType("codegrain_worker_cache"))).setdefault("held", {})
    if name not in held:
        held.clear()
    return held.setdefault(name, {})


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, folds: int, held: int, rows: int) -> DataFrame:
    """(text, label) of at most rows labelled documents outside the held fold, by least hash of the id.

    Null and other labels are left out, an id's repeated labels count as their
    largest, and each distinct text counts once.
    """
    known = labels.filter(F.col(name).isin(0, 1)).filter(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(few), "doc_id")  # rows is the bound
    return got.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def sigmoid_fit(x, y, steps: int = 200) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a x + b))) by Newton steps with smoothed targets."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()]), np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
