"""Exact top-k inner products by a pivot-distance index.

Vectors of integers are lifted by one coordinate to a common norm, where a
larger inner product with a query is a smaller distance to it.  Each is keyed
by its nearest pivot and its distance to that pivot; sorted by both and packed
into blocks, the vectors form sorted annuli.  A query's own annulus gives it a
first bound on its k-th score.  It then expands in rounds: first to the annuli
nearest to its own distance from their pivot, which tightens the bound, and then
to all that the triangle inequality cannot exclude at the tighter one, and stops
there.  Queries travel in chunks of one block; chunks and annuli meet by
(pivot, bucket of distance), so pairs out of reach are never made.

Pivots, as many as a fraction of the root of the rows, are fitted on at most
SAMPLE vectors by farthest-first choice; every vector is indexed, so the result
is exact.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; shorter vectors count as padded with zeros; only the
query's own row is left out, so repeated rows of its id are candidates and ask
for themselves; ties go to the smaller vec_id; with fewer candidates than k all
are returned; extra columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import cut, table

K = 10
SCALE = 1024.0
QUERY_EVERY = 100
#: Pivots: the root of the rows over PIVOT_SHARE, within limits.
PIVOT_SHARE, PIVOTS = 8, (16, 1024)
#: Annuli that a chunk of queries visits to tighten its bounds.
PROBES = 4
SAMPLE = 4096
BLOCK = 2048
CHUNK = 64


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of a sample."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lift(v: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(square - (v * v).sum(1), 0.0))])


def distances(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (lifted * lifted).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * lifted @ pivots.T
    return np.sqrt(np.maximum(d, 0.0))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through floats where these hold every sum exactly."""
    most = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(v).max(initial=0))) * q.shape[1]
    return np.rint(q.astype(float) @ v.astype(float).T).astype(np.int64) if most < 1 << 53 else q.astype(np.int64) @ v.astype(np.int64).T


def packed(square: float) -> str:
    """The least integer type that holds every component of vectors whose squared norm is at most square."""
    most = square**0.5 + 1
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def _assign(pivots: np.ndarray, square: float, dims: int):
    kind = packed(square)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _padded(b.column(1), dims)
            d = distances(lift(v.astype(float), square), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())], ["vec_id", "pivot", "dist", "v"])

    return run


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = np.floor(SCALE * np.array(x, float))
    return out


def _blocks(dims: int, size: int):
    def pack(pivot: int, rows: list, n: int) -> dict:
        ids, dist, v = zip(*rows, strict=True)
        return {"block": (TaskContext.get().partitionId() << 32) | n, "pivot": pivot, "near": min(dist), "far": max(dist), "ids": np.array(ids, "<i8").tobytes(), "v": b"".join(v)}

    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, rows, n = None, [], 0
        for b in batches:
            for i, p, d, v in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if rows and (p != pivot or len(rows) == size):
                    yield pa.RecordBatch.from_pylist([pack(pivot, rows, n)], schema)
                    rows, n = [], n + 1
                pivot = p
                rows.append((i, d, v))
        if rows:
            yield pa.RecordBatch.from_pylist([pack(pivot, rows, n)], schema)

    return run


def _queries(square: float, dims: int, k: int, every: int):
    """Chunks of a block's queries with their k-th score in their own block."""
    kind = packed(square)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, v in zip(*(b.column(n).to_pylist() for n in ("block", "ids", "v")), strict=True):
                ids, v = np.frombuffer(ids, "<i8"), np.frombuffer(v, kind).reshape(-1, dims)
                at = np.flatnonzero(ids % every == 0)
                rows = []
                for n, own in enumerate(np.split(at, range(CHUNK, len(at), CHUNK)) if len(at) else []):
                    s = products(v[own], v).astype(float)
                    s[np.arange(len(own)), own] = -np.inf
                    kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(own), -np.inf)
                    rows.append((block * 64 + n, block, ids[own].astype("<i8").tobytes(), own.astype("<i8").tobytes(), v[own].tobytes(), kth.tolist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())), strict=True)], ["chunk", "own", "q_ids", "q_at", "q", "bounds"])

    return run


def _ranges(pivots: np.ndarray, square: float, dims: int):
    """Per chunk and pivot: the distances that the bounds leave open, and those of the queries themselves."""
    kind = packed(square)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, q, bounds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                q = np.frombuffer(q, kind).reshape(-1, dims).astype(float)
                radius = np.sqrt(np.maximum((q * q).sum(1) + square - 2 * np.array(bounds), 0.0))
                d = distances(np.column_stack([q, np.zeros(len(q))]), pivots)
                slack = 1e-6 * (1.0 + np.sqrt(square) + d)
                n = len(pivots)
                most = 2 * square**0.5 + 1
                lo, hi = (d - radius[:, None] - slack).min(0).clip(0, most), (d + radius[:, None] + slack).max(0).clip(0, most)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), pa.array(lo), pa.array(hi), pa.array(d.min(0)), pa.array(d.max(0))], ["chunk", "pivot", "lo", "hi", "nearest", "farthest"])

    return run


def _meet(dims: int, k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros((0, 5), np.int64)]
            for block, ids, v, chunk, own, q_ids, q_at, q, bounds in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), b.column(6), b.column(7), b.column(8).to_pylist(), strict=True):
                ids, v = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(v.as_py(), kind).reshape(-1, dims)
                q_ids, q_at = np.frombuffer(q_ids.as_py(), "<i8"), np.frombuffer(q_at.as_py(), "<i8")
                scores = products(np.frombuffer(q.as_py(), kind).reshape(-1, dims), v)
                for i, kth in enumerate(bounds):
                    s = scores[i]
                    may = np.flatnonzero(s >= kth) if np.isfinite(kth) else np.arange(len(s))
                    if own == block:
                        may = may[may != q_at[i]]
                    best = may[np.lexsort((ids[may], -s[may]))[:k]]
                    out.append(np.column_stack([np.full(len(best), chunk), np.full(len(best), i), np.full(len(best), q_ids[i]), ids[best], s[best]]))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], ["chunk", "i", "query_id", "vec_id", "score"])

    return run


FOUND = "chunk long, i long, query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("chunk", "i").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, n_pivots: int | None = None, block: int = BLOCK, probes: int = PROBES) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score) for every row whose id is divisible by every."""
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * SCALE), 2))
    rows, dims, square = whole.agg(F.count("*"), F.max(F.size("embedding")), F.max(norm)).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = float(square) * (1 + 1e-9)
    few = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.zeros((len(few), dims))
    for i, r in enumerate(few):
        sample[i, : len(r["embedding"])] = np.floor(SCALE * np.array(r["embedding"]))
    pivots = pick_pivots(lift(sample, square), n_pivots or min(PIVOTS[1], max(PIVOTS[0], round(rows**0.5 / PIVOT_SHARE))))
    # written before it is dealt out by ranges, which reads it twice
    keyed = cut(whole.mapInArrow(_assign(pivots, square, dims), "vec_id long, pivot int, dist double, v binary"), "pivots")
    keyed = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    index = cut(keyed.mapInArrow(_blocks(dims, block), "block long, pivot int, near double, far double, ids binary, v binary"), "annuli")
    asked = cut(index.select("block", "ids", "v").mapInArrow(_queries(square, dims, k, every), "chunk long, own long, q_ids binary, q_at binary, q binary, bounds array<double>"), "asked")

    n_blocks, near, far = index.agg(F.count("*"), F.min("near"), F.max("far")).first()
    width = max((far - near) / max(1.0, n_blocks / len(pivots)), square**0.5 / 1024, 1e-9)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    annuli = index.select("block", "pivot", "near", "far", bucket("near").alias("first")).withColumn("bucket", F.explode(F.sequence("first", bucket("far"))))

    def reached(chunks: DataFrame) -> DataFrame:
        """(chunk, block, own, gap) of all annuli that the chunks' bounds leave open, each pair once: in the first bucket that both have."""
        open_ = chunks.select("chunk", "q", "bounds").mapInArrow(_ranges(pivots, square, dims), "chunk long, pivot int, lo double, hi double, nearest double, farthest double")
        open_ = open_.withColumn("from", bucket("lo")).withColumn("bucket", F.explode(F.sequence("from", bucket("hi"))))
        met = open_.join(annuli, ["pivot", "bucket"]).filter((F.col("near") <= F.col("hi")) & (F.col("far") >= F.col("lo")) & (F.col("bucket") == F.greatest("from", "first")))
        return met.select("chunk", "block", F.greatest(F.lit(0.0), F.col("near") - F.col("farthest"), F.col("nearest") - F.col("far")).alias("gap"))

    def visited(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
        told = pairs.select("chunk", "block").join(chunks, "chunk")
        return told.join(index.select("block", "ids", "v"), "block").select("block", "ids", "v", "chunk", "own", "q_ids", "q_at", "q", "bounds").mapInArrow(_meet(dims, k, packed(square)), FOUND)

    nearest = Window.partitionBy("chunk").orderBy((F.col("block") != F.col("own")), "gap", "block")
    probed = cut(reached(asked).join(asked.select("chunk", "own"), "chunk").withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= probes).select("chunk", "block"), "probes")
    own = asked.select("chunk", F.col("own").alias("block"))
    probed = probed.unionByName(own).distinct()
    first = cut(_best(visited(probed, asked), k).drop("rank"), "found")
    kth = first.groupBy("chunk", "i").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
    tighter = kth.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("score").cast("double")))).alias("kth"))  # CHUNK entries at most
    bounds = F.transform("bounds", lambda x, i: F.greatest(x, F.coalesce(F.element_at("kth", i.cast("long")), x)))
    asked = cut(asked.join(tighter, "chunk", "left").withColumn("bounds", F.when(F.col("kth").isNull(), F.col("bounds")).otherwise(bounds)).drop("kth"), "tighter")
    rest = reached(asked).join(probed, ["chunk", "block"], "left_anti")
    return _best(first.unionByName(visited(rest, asked)), k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_topk": op2_topk}
ORACLE = {
    "op2_topk": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.rid <> q.rid)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
}
