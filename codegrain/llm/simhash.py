"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits that differ in at most two share at least two of four
16-bit blocks, so each distinct fingerprint is keyed by its six block pairs;
a bucket's fingerprints are joined and verified by Hamming distance.  Buckets
over BUCKET_CAP go another exact way: two fingerprints at most two bits apart
have a common point at most one bit from both, so members are keyed by
themselves and their 64 one-bit neighbours, and those that meet (65 at most)
are all linked.  Copies collapse to one fingerprint before any join.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows each get a row; a null doc_id never names a component
unless no other id is reachable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import cut, table, text_bytes
from codegrain.llm.components import components

SHINGLE = 3
DISTANCE = 2
BUCKET_CAP = 256
STEP = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    flat, n = b" ".join(words), max(1, len(words) - k + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        some = np.array([h(flat[a:b], 42) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP], strict=True)], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document, fp signed."""
    return docs.select("doc_id", text_bytes()).mapInArrow(_fingerprints, "doc_id long, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def links(distinct: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """(u, v), u < v, over distinct fp values: enough of the pairs within DISTANCE to connect all of them."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))
    keys = F.array(*[F.struct(F.lit(16 * i + j).alias("which"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("key")) for i, j in combinations(range(4), 2)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.which", "k.key")
    buckets = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = cut(keyed.join(buckets, ["which", "key"]), "blocks")
    small = keyed.filter(F.col("n") <= cap).drop("n")
    pairs = small.withColumnRenamed("fp", "u").join(small.withColumnRenamed("fp", "v"), ["which", "key"]).filter("u < v").filter(_near(F.col("u"), F.col("v"))).select("u", "v")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    large = keyed.filter(F.col("n") > cap).select("fp").distinct().select("fp", F.explode(flips).alias("point"))
    met = large.groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", 2, 65)).alias("v"))
    return pairs.unionByName(stars).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    fps = cut(fingerprints(docs), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE: dict[str, str] = {}
