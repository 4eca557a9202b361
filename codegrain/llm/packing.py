"""Mixture-controlled packing by deficit round-robin.

Documents queue up per source.  Round by round each queue earns credit in
proportion to its target (its own tokens, unless targets are given) and sends
QUANTUM tokens whenever the credit covers them; what is left over is carried to
the next window.  A queue's chunk c then leaves at virtual time
c * QUANTUM / target(queue), so its place in the packed stream is a closed form
over the queues' totals and targets: deficits carry across windows and across
partitions with no sequential pass, and every window holds each source's share
to within one quantum, for as long as its queue lasts; the rest of the stream
is shared by the queues that are left.  The stream is cut every WINDOW tokens.

Every source has a queue of its own.  More than FAN queues are dealt into groups
of FAN; each group merges its own queues by the same rule, and groups merge
again by the sums of their targets, to within one quantum more.

Texts are tokenized once; ids are written to the shared folder with running
offsets per (partition, source), which a prefix sum turns into queue offsets.

Defined results: null and empty texts give the end token alone; very long texts
are packed whole, in pieces; a null source is a source of its own; repeated rows
are documents of their own; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import cut, table, worker_cache

WINDOW = 2048
QUANTUM = 256
END_ID = 1
#: Queues that merge at once: a chunk's place takes one step for each.
FAN = 256
VOCABULARY = "byte_bpe_50k"
#: Rows that a worker holds as Python objects at once, and sends back in one batch.
SLICE = 1000
#: What the largest given target counts as.
RATE = 1 << 24


def tokenizer(name: str = VOCABULARY, folder: str | None = None) -> Callable[[str], bytes]:
    """text -> little-endian uint16 ids of a byte-level BPE vocabulary.

    Texts go whole to the vocabulary's rank coder, which holds nothing from one
    text to the next: most words of a corpus are rare, so ids kept by word cost
    more time than they save, and memory besides.  Texts that spell a special
    token go to the reference coder, which recognises it.
    """
    held = worker_cache(f"bpe:{folder}:{name}")
    if "encode" in held:
        return held["encode"]
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    where = (lambda f: f"{folder}/{f}") if folder else public_tokenizers.path
    with open(where(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    specials = tuple(t.content for t in Tokenizer.from_file(where(f"{name}.json")).get_added_tokens_decoder().values())
    pack = lambda ids: np.array(ids, "<u2").tobytes()

    def encode(text: str) -> bytes:
        if any(s in text for s in specials):
            if "full" not in held:  # rarely needed, and large
                held["full"] = Tokenizer.from_file(where(f"{name}.json"))
            return pack(held["full"].encode(text, add_special_tokens=False).ids)
        return pack(fast.encode_ordinary(text))

    held["encode"] = encode
    return encode


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, task, at = tokenizer(), TaskContext.get().partitionId(), {}
    end = np.array([END_ID], "<u2").tobytes()
    for b in _slices(batches):
        ids = [encode(t.as_py() or "") + end for t in b.column(1)]
        ns, starts = [len(x) // 2 for x in ids], []
        for s, n in zip(b.column(2).to_pylist(), ns, strict=True):
            starts.append(at.get(s, 0))
            at[s] = starts[-1] + n
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([task] * len(ns), pa.int32()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "task", "local_start", "n", "ids"])


TOKENS = "doc_id long, source string, task int, local_start long, n long, ids binary"


def _places(chunks: np.ndarray, q: int, totals: np.ndarray, rates: np.ndarray, quantum: int) -> np.ndarray:
    """Where each chunk of queue q begins in the merged stream."""
    big = int(rates.max()) * (int(totals.max()) // quantum + 1) >= 1 << 62
    c, t, r = (chunks.astype(object), totals.astype(object), rates.astype(object)) if big else (chunks, totals, rates)
    before = np.zeros(len(c), c.dtype)
    for p in range(len(t)):
        if p == q:
            n = c
        elif p < q:
            n = c * r[p] // r[q] + 1
        else:
            n = -(-c * r[p] // r[q])
        before = before + np.minimum(t[p], n * quantum)
    return before.astype(np.int64)


def merged(start: int, n: int, q: int, totals: np.ndarray, rates: np.ndarray, quantum: int = QUANTUM) -> tuple[np.ndarray, np.ndarray]:
    """Parts of n tokens from start on in queue q: first token and place in the merged stream; each runs to the next one's first."""
    chunks = np.arange(start // quantum, (start + n - 1) // quantum + 1)
    lo = np.maximum(chunks * quantum, start)
    return lo - start, _places(chunks, q, totals, rates, quantum) + lo - chunks * quantum


def cuts(start: int, n: int, path: list[int], levels: list[list[tuple[np.ndarray, np.ndarray]]], window: int = WINDOW, quantum: int = QUANTUM) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a document that lies at start in its queue: first id and place in the packed stream; each runs to the next one's first id.

    path: the number of its queue, of its queue's group and so on; levels: the
    totals and rates of all merges, from queues to the stream.
    """
    first, place = np.zeros(1, np.int64), np.array([start])
    for node, groups in zip(path, levels, strict=True):
        parts = [merged(int(s), int(m), node % FAN, *groups[node // FAN], quantum) for s, m in zip(place, np.diff(np.append(first, n)), strict=True)]
        first = np.concatenate([f + a for f, (a, _) in zip(first, parts, strict=True)])
        place = np.concatenate([b for _, b in parts])
    length = np.diff(np.append(first, n))
    inside = window - place % window
    split = np.flatnonzero(inside < length)  # a part never spans three windows, as quantum <= window
    first, place = np.concatenate([first, first[split] + inside[split]]), np.concatenate([place, place[split] + inside[split]])
    order = np.argsort(first, kind="stable")
    first, place = first[order], place[order]
    keep = np.append(True, (place[1:] - place[:-1] != first[1:] - first[:-1]) | (place[1:] % window == 0))
    return first[keep], place[keep]


def merges(totals: list[int], rates: list[int]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Totals and rates of every group of FAN queues, of every group of FAN groups, up to one."""
    levels = []
    while not levels or len(totals) > 1:
        groups = [(np.array(totals[i : i + FAN], np.int64), np.array(rates[i : i + FAN], np.int64)) for i in range(0, max(1, len(totals)), FAN)]
        levels.append(groups)
        totals, rates = [int(t.sum()) for t, _ in groups], [int(r.sum()) for _, r in groups]
    return levels


def _pieces(totals: list[int], rates: list[int], window: int, quantum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = merges(totals, rates)
        for b in _slices(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            nulls = []
            for doc, q, start, n, ids in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                first, place = cuts(start, n, [q // FAN**i for i in range(len(levels))], levels, window, quantum)
                words = np.frombuffer(ids.as_py(), "<u2").astype("<u4")
                ends = np.append(first[1:], n)
                crc = [zlib.crc32(words[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
                nulls.append(np.full(len(first), doc is None))
                for col, x in zip(cols, (np.full(len(first), -1 if doc is None else doc), first, ends - first, np.array(crc, np.int64), np.full(len(first), n), place // window, place % window), strict=True):
                    col.append(x)
            if nulls:
                ids, *rest = (np.concatenate(c).astype(np.int64) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.concatenate(nulls)), *map(pa.array, rest)], NAMES)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, targets: dict[str | None, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: relative token proportions by source, positive; each source's own
    tokens where none are given.  Sources, with a total each, are the only list
    that reaches the driver and the tasks.
    """
    if not 0 < quantum <= window:
        raise ValueError("quantum must lie between 1 and window")
    if targets is not None and not all(x > 0 for x in targets.values()):
        raise ValueError("targets must be positive")
    tokens = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source").mapInArrow(_tokenize, TOKENS), "tokens")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    local = tokens.groupBy(key.alias("skey"), "task").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    per = local.groupBy("skey").agg(F.sum("n").alias("n"), F.first("source").alias("source")).orderBy(F.col("source").asc_nulls_last()).collect()
    if targets is not None and (missing := {r["source"] for r in per} - targets.keys()):
        raise ValueError(f"no target for sources {sorted(missing, key=str)[:5]}")
    totals = [r["n"] for r in per]
    rates = totals if targets is None else [max(1, round(targets[r["source"]] / max(targets.values()) * RATE)) for r in per]
    queues = docs.sparkSession.createDataFrame([(r["skey"], i) for i, r in enumerate(per)], "skey string, queue int")
    before = Window.partitionBy("skey").orderBy("task")
    bases = local.select("skey", "task", (F.sum("n").over(before) - F.col("n")).alias("base")).join(queues, "skey")
    placed = tokens.withColumn("skey", key).join(bases, ["skey", "task"])
    rows = placed.select("doc_id", "queue", (F.col("base") + F.col("local_start")).alias("start"), "n", "ids")
    return rows.mapInArrow(_pieces(totals, rates, window, quantum), ", ".join(f"{n} long" for n in NAMES))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
