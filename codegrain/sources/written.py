"""Intermediate tables in the folder that driver and executors share.

Loops write each round's rows and read them back, so plans do not grow with the
rounds and a lost executor costs one round at most.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder serves a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codegrain-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df's rows, written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codegrain-round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def united(parts: list[DataFrame]) -> DataFrame:
    """Tables of one schema as one scan, however many rounds wrote them."""
    spark = parts[0].sparkSession
    paths = [path for df in parts for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}]
    return spark.read.schema(parts[0].schema).parquet(*paths) if paths else parts[0]


def hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with _h, a hash of the keys, unless they have it.

    Ids share long prefixes, so sorts compare them slowly; led by _h, sorts and merge joins decide by one number and read the keys only where it is equal.
    """
    return rows if "_h" in rows.columns else rows.withColumn("_h", F.xxhash64(*keys))


def partitions(df: DataFrame, mb: int = 16) -> int:
    """Tasks for df's rows: one for so many MB of its plan's estimated size, the session's count at least; a count that is given is not coalesced."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (mb << 20), 10_000))


def drop_written() -> None:
    """Delete what was written; runs at exit."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may have gone at interpreter exit
            return


atexit.register(drop_written)
