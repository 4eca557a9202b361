"""Near copies at a stated similarity of word shingles, around SimHash.

Fingerprints of five-word shingle sets link through pigeonhole blocks at two
bits (simhash.links).  Texts whose sets have a Jaccard similarity of 0.8 differ
in 5 to 14 of 64 bits, where pigeonhole blocks would be four bits wide and join
everything with everything.  Pairs further apart than two bits therefore share
a block of ROWS min-hashes in one of BANDS instead (0.99997 of pairs at 0.8,
more above), and every link is verified on the whole shingle sets.

Equal sets collapse to one text before any join.  A block's members are dealt
into pieces of bounded size; a task compares two pieces by matrix products and
emits a spanning forest of the links it finds, so a block of thousands of near
copies gives no pair list and meets in no single task.  Blocks with the same
members are compared once.

Defined results: null and empty texts are copies of each other; fewer words
than SHINGLE count as one shingle; repeated rows are copies; every id gets one
row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm import simhash
from codegrain.llm.common import cut, release, text_bytes
from codegrain.llm.components import components
from codegrain.llm.suffix import word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
PIECE = 512
PIECE_SHINGLES = 1 << 21
COLUMNS = 4096
_C = np.uint64(0x9E3779B97F4A7C15)
_A = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a lower-cased text."""
    words = word_hashes(text.lower().split())
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(len(words), k), np.uint64)
    for j in range(min(k, len(words))):
        h = h * _C + words[j : n + j]
    return np.unique(mixed(h))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of ROWS min-hashes."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _A).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = keys * _C + least[r::ROWS]
    return mixed(keys)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rid", "k1", "k2", "fp", "n", "bands", "shingles"]
    for b in batches:
        rows = []
        for t in b.column(1):
            h = shingle_hashes(t.as_py())
            key = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8")
            ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            fp = int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])
            some = np.unique((h >> np.uint64(32)).astype("<u4"))
            rows.append((int(key[0]), int(key[1]), fp, len(some), band_keys(h).view(np.int64), some.tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)


def described(docs: DataFrame) -> DataFrame:
    """(rid, text) -> (rid, k1, k2, fp, n, bands, shingles): k1 and k2 name the shingle set."""
    return docs.select("rid", text_bytes()).mapInArrow(_describe, "rid long, k1 long, k2 long, fp long, n long, bands array<long>, shingles binary")


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between sets of at least this Jaccard similarity, as many as connect all that such links connect."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    values, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(uses > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    keep = np.flatnonzero(column >= 0)
    keep = keep[np.argsort(column[keep], kind="stable")]
    owner, column = owner[keep], column[keep]
    common = np.zeros((m, m), np.float32)
    for at in range(0, len(shared), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((m, min(COLUMNS, len(shared) - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    both = sizes[:, None] + sizes[None, :]
    for i, j in zip(*np.nonzero(np.triu(common * (1 + similarity) >= similarity * both - 1e-3, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def links(rids: list[int], sets: list[bytes]) -> pa.RecordBatch:
        found = forest([np.frombuffer(s, "<u4") for s in sets]) if len(rids) > 1 else []
        u, v = [rids[i] for i, _ in found], [rids[j] for _, j in found]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    cell, rids, sets = None, [], []
    for b in batches:
        for key, rid, s in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True), b.column(4).to_pylist(), b.column(5), strict=True):
            if key != cell:
                if len(rids) > 1:
                    yield links(rids, sets)
                cell, rids, sets = key, [], []
            rids.append(rid)
            sets.append(s.as_py())
    if len(rids) > 1:
        yield links(rids, sets)


def set_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) between texts (rid, n, bands, one per shingle set); rows holds their shingles."""
    keyed = texts.select("rid", "n", F.posexplode("bands").alias("band", "key"))
    size = F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("n") / PIECE_SHINGLES)).cast("int")
    buckets = keyed.groupBy("band", "key").agg(F.count("*").alias("m"), size.alias("pieces"), F.bit_xor(F.xxhash64("rid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("x2")).filter("m > 1")
    picked = buckets.groupBy("m", "pieces", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*", "pieces")
    member = keyed.join(picked, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "rid"), F.col("pieces")).cast("int"))
    cells = member.withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    cells = cells.select("band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "rid")
    held = cells.join(rows.select("rid", "shingles"), "rid").select("band", "key", "a", "b", "rid", "shingles")
    return held.repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b").mapInArrow(_compare, "u long, v long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(rid, text), rid unique -> (rid, component_id), the least rid of the group."""
    rows = cut(described(docs), "shingles")
    first = rows.groupBy("k1", "k2").agg(F.min(F.struct("rid", "fp", "n", "bands")).alias("r"))
    texts = cut(first.select("k1", "k2", "r.*"), "texts")
    by_print = texts.groupBy("fp").agg(F.min("rid").alias("least"))
    near = simhash.links(by_print.select("fp"))
    ends = near.join(by_print.withColumnRenamed("fp", "u"), "u").select("v", F.col("least").alias("a")).join(by_print.withColumnRenamed("fp", "v"), "v").select(F.col("a").alias("u"), F.col("least").alias("v"))
    same = texts.join(by_print, "fp").select(F.col("least").alias("u"), F.col("rid").alias("v")).filter("u <> v")
    roots = components(ends.unionByName(same).unionByName(set_links(rows, texts)))
    release(docs.sparkSession)
    named = texts.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("k1", "k2", F.coalesce("root", "rid").alias("component_id"))
    return rows.select("rid", "k1", "k2").join(named, ["k1", "k2"]).select("rid", "component_id")
