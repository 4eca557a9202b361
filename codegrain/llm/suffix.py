"""Repeated passages by a sparse suffix array.

Of each text's suffixes only those at minimiser positions are kept: the
position of the least hash among every WINDOW consecutive GRAM-word grams.
Every window of MIN_WORDS words has one minimiser, which depends on the
window's words alone, so a passage that two texts share has the same one in
both, and at least RUN words match from there.  Suffixes are keyed by the hash
of these words and carry the words on either side that their own windows
reach.  Suffixes of a key come sorted by the words after it; the agreement of
neighbours bounds intervals that match to the right, the same in the order of
the words before gives those to the left, and suffixes of two documents in one
interval of both, MIN_WORDS words together, hold the same window.  No window is
left out, so the regions are exact (words are compared by 32-bit hashes).

Suffixes of one batch with equal key and context travel as one row with many
members, so groups of copies shrink before the shuffle.  Keys with more than
CROWD rows, found in a sample of documents or else when they are met, are
compared window by window instead: each window's hash is a key of its own,
counted before any shuffle, so no large key meets in one task.  The sample
changes the way, never the result.

Defined results: null and empty texts and those under MIN_WORDS words have no
row; repeats inside one doc_id alone do not count, so repeated rows of one id
do not match each other; rows with a null doc_id count as one document; a very
long text is cut into no pieces; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import cut, table, text_bytes, worker_cache

MIN_WORDS = 50
GRAM = 6
WINDOW = 25
RUN = MIN_WORDS - WINDOW + 1
SIDE = WINDOW - 1
#: Words of texts that one batch of rows is made of.
FLUSH = 300_000
#: Rows of one key, and members of these, that are compared in memory: some 50 MB each.
CROWD, CROWD_MEMBERS = 100_000, 2_000_000
#: Members of one row.
PIECE = 128
MEMO = 150_000
#: One document in SAMPLE is looked at for keys of more rows than CROWD; the HOT largest of them are compared by windows from the start.
SAMPLE, HOT = 32, 2000
NO_ID = -(1 << 63)
_C = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = np.random.default_rng(17).integers(1, 1 << 63, (2, SIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = worker_cache("words")
    if len(memo) > MEMO:
        memo.clear()
    out = [memo.get(w) for w in words]
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                out[i] = memo[words[i]] = xxhash.xxh64_intdigest(words[i], 9)
    return np.array(out, np.uint64)


def suffixes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, keys, lo, hi) of the suffixes kept of a text's word hashes; its windows begin lo to hi words before a suffix."""
    n = len(h)
    if n < MIN_WORDS:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = grams * _C + h[j : n - GRAM + 1 + j]
    windows = np.lib.stride_tricks.sliding_window_view(_mix(grams), WINDOW)[: n - MIN_WORDS + 1]
    at, first, many = np.unique(windows.argmin(axis=1) + np.arange(len(windows)), return_index=True, return_counts=True)
    keys = np.zeros(len(at), np.uint64)
    for j in range(RUN):
        keys = keys * _C + h[at + j]
    return at, _mix(keys), at - (first + many - 1), at - first


def leaves(keys: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, hash) of all windows of suffixes with these words on either side: a words before the suffix."""
    before = np.zeros((len(keys), SIDE + 1), np.uint64)
    np.cumsum(left.astype(np.uint64) * _LEFT, axis=1, out=before[:, 1:])
    after = np.zeros((len(keys), SIDE + 1), np.uint64)
    np.cumsum(right.astype(np.uint64) * _RIGHT, axis=1, out=after[:, 1:])
    a = np.arange(SIDE + 1)
    row, at = np.nonzero((a >= lo[:, None]) & (a <= hi[:, None]))
    return row, at, _mix(_mix(keys[row] + before[row, at]) * _C + after[row, SIDE - at])


def ragged(starts: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """starts[i], starts[i] + step, ... lengths[i] times, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts, lengths) + step * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths))


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An array of binaries of these byte lengths over data."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], np.diff(offsets)


ROWS = "k long, salt int, before binary, after binary, members binary"
NAMES = ["k", "salt", "before", "after", "members"]


def _gathered(kept: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(first of every equal value, the members of each as one binary); of more than PIECE members there are several rows, so none grows large."""
    order = np.argsort(kept, kind="stable")
    n = len(order)
    begins = np.flatnonzero(np.append(True, kept[order][1:] != kept[order][:-1])) if n else np.zeros(0, np.int64)
    within = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    fresh = np.flatnonzero(within % PIECE == 0)
    return order[fresh], binary(members[order].astype("<i8"), np.diff(np.append(fresh, n)) * 16)


def _leaf_rows(hashes: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    """One row for each window, dealt out at random: windows are counted before they meet."""
    first, held = _gathered(hashes, members)
    nothing = binary(np.zeros(0, np.uint8), np.zeros(len(first), np.int64))
    salt = (members[first, 1] * 7919 + members[first, 0]) % 65_521 + 1
    return pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(salt.astype(np.int32)), nothing, nothing, held], NAMES)


def _suffix_rows(hot: list[int]):
    """One row for each context of a suffix (salt 0), and for suffixes of hot keys one for each window (salt over 0)."""
    crowded = np.sort(np.array(hot, np.int64))

    def made(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, texts, at, keys, lo, hi = zip(*parts, strict=True)
        shift = np.cumsum([0, *map(len, texts)])
        many = [len(x) for x in at]
        words = np.concatenate(texts)
        doc, base = np.repeat(np.array(docs, np.int64), many), np.repeat(shift[:-1], many)
        at, keys, lo, hi = np.concatenate(at), np.concatenate(keys), np.concatenate(lo), np.concatenate(hi)
        members = np.column_stack([doc, at])
        place = at + base
        slow = np.isin(keys.view(np.int64), crowded)
        if slow.any():
            side = np.arange(SIDE)
            left = words[np.maximum(place[slow, None] - 1 - side, 0)]  # beyond a text's ends lie no windows
            right = words[np.minimum(place[slow, None] + RUN + side, len(words) - 1)]
            row, a, hashes = leaves(keys[slow], left, right, lo[slow], hi[slow])
            windows = members[slow][row]
            windows[:, 1] -= a
            yield _leaf_rows(hashes, windows)
            at, keys, lo, hi, members, place = (x[~slow] for x in (at, keys, lo, hi, members, place))
        left = words[ragged(place - 1, hi, -1)]
        right = words[ragged(place + RUN, SIDE - lo, 1)]
        sums = np.zeros(len(at), np.uint64)
        for data, lengths, factors in ((left, hi, _LEFT), (right, SIDE - lo, _RIGHT)):
            total = np.append(np.uint64(0), np.cumsum(data.astype(np.uint64) * factors[ragged(np.zeros(len(at), np.int64), lengths, 1)]))
            ends = np.cumsum(lengths)
            sums = _mix(sums + total[ends] - total[ends - lengths] + lengths.astype(np.uint64))
        first, held = _gathered(_mix(sums + keys), members)
        before, after = words[ragged(place[first] - 1, hi[first], -1)], words[ragged(place[first] + RUN, SIDE - lo[first], 1)]
        sides = [binary(before.astype(">u4"), hi[first] * 4), binary(after.astype(">u4"), (SIDE - lo[first]) * 4)]
        yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.zeros(len(first), np.int32)), *sides, held], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = t.as_py().split()
                if len(words) < MIN_WORDS:
                    continue
                h = word_hashes(words)
                parts.append((NO_ID if doc is None else doc, (h >> np.uint64(32)).astype(np.uint32), *suffixes(h)))
                size += len(words)
                if size >= FLUSH:
                    yield from made(parts)
                    parts, size = [], 0
        if parts:
            yield from made(parts)

    return run


class Rows:
    """Suffix rows as arrays: keys, words on either side and members of each."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.k = b.column(0).to_numpy()
        self.salt = b.column(1).to_numpy()
        data, lengths = bytes_of(b.column(2))
        self.left, self.hi = self._matrix(data, lengths), lengths // 4
        data, lengths = bytes_of(b.column(3))
        self.right, self.lo = self._matrix(data, lengths), SIDE - lengths // 4
        data, lengths = bytes_of(b.column(4))
        self.members, self.many = data.view("<i8").reshape(-1, 2), lengths // 16

    @staticmethod
    def _matrix(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lengths), SIDE), np.uint32)
        out[np.arange(SIDE) < lengths[:, None] // 4] = data.view(">u4")
        return out

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest document of each row."""
        starts = np.cumsum(self.many) - self.many
        return np.minimum.reduceat(self.members[:, 0], starts), np.maximum.reduceat(self.members[:, 0], starts)


def agreement(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words that each row shares with the row before, from the first on."""
    same = (words[1:] == words[:-1]) & (np.arange(words.shape[1]) < np.minimum(lengths[1:], lengths[:-1])[:, None])
    return np.logical_and.accumulate(same, axis=1).sum(1)


def shared_windows(group: np.ndarray, left: np.ndarray, hi: np.ndarray, right: np.ndarray, lo: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows in the order of (group, right): (first, last, least, most), the windows that rows of other documents hold too and those documents' ends; first > last where none."""
    n = len(group)
    new = np.append(True, group[1:] != group[:-1])
    after = np.append(-1, agreement(right, SIDE - lo))
    after[new] = -1
    packed = np.column_stack([group.astype(">u4").view(np.uint8).reshape(-1, 4), left.astype(">u4").view(np.uint8).reshape(n, -1)])
    order = np.argsort(np.ascontiguousarray(packed).view(f"S{packed.shape[1]}").ravel(), kind="stable")
    before = np.append(-1, agreement(left[order], hi[order]))
    before[np.append(True, group[order][1:] != group[order][:-1])] = -1
    first, last = np.full(n, SIDE + 1), np.full(n, -1)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    interval = np.zeros(n, np.int64)
    for a in range(SIDE + 1):
        rows = np.flatnonzero((lo <= a) & (hi >= a))
        if len(rows) < 1:
            continue
        interval[order] = np.cumsum(before < a)
        pair = np.cumsum(after < SIDE - a)[rows] * (n + 1) + interval[rows]
        by = np.argsort(pair, kind="stable")
        fresh = np.append(True, pair[by][1:] != pair[by][:-1])
        starts, where = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        small, large = np.minimum.reduceat(least[rows][by], starts), np.maximum.reduceat(most[rows][by], starts)
        hit = (small < large)[where]
        rows, where = rows[by][hit], where[hit]
        first[rows], last[rows] = np.minimum(first[rows], a), a
        low[rows], high[rows] = np.minimum(low[rows], small[where]), np.maximum(high[rows], large[where])
    return first, last, low, high


FOUND = "doc_id long, start_word long, end_word long, partner_id long, k long, members binary"
FOUND_NAMES = ["doc_id", "start_word", "end_word", "partner_id", "k", "members"]


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
    ids = [pa.array(x, pa.int64(), mask=x == NO_ID) for x in (doc, partner)]
    n = len(doc)
    return pa.RecordBatch.from_arrays([ids[0], pa.array(start), pa.array(end), ids[1], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], FOUND_NAMES)


def _passed(hashes: pa.Array, members: pa.Array) -> pa.RecordBatch:
    """Windows as they go to be counted: in start_word and end_word stand the ends of each row's documents."""
    n = len(hashes)
    data, lengths = bytes_of(members)
    docs, starts = data.view("<i8")[::2], np.cumsum(lengths) // 16 - lengths // 16
    ends = [pa.array(f.reduceat(docs, starts) if n else np.zeros(0, np.int64)) for f in (np.minimum, np.maximum)]
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *ends, pa.nulls(n, pa.int64()), hashes, members], FOUND_NAMES)


def _matched(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Spans of whole keys' rows, sorted by key and the words after."""
    k = b.column(0).to_numpy()
    new = np.append(True, k[1:] != k[:-1])
    starts = np.flatnonzero(new)
    data, lengths = bytes_of(b.column(4))
    docs, at = data.view("<i8")[::2], np.cumsum(lengths) // 16 - lengths // 16
    small, large = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
    shared = (np.minimum.reduceat(small, starts) < np.maximum.reduceat(large, starts))[np.cumsum(new) - 1]
    if not shared.any():
        return
    rows = Rows(b.filter(pa.array(shared)))
    group = np.cumsum(np.append(True, rows.k[1:] != rows.k[:-1]))
    first, last, low, high = shared_windows(group, rows.left, rows.hi, rows.right, rows.lo, small[shared], large[shared])
    each = np.repeat(np.arange(len(group)), rows.many)
    held = first[each] <= last[each]
    each, members = each[held], rows.members[held]
    partner = np.where(low[each] != members[:, 0], low[each], high[each])
    yield _spans(members[:, 0], members[:, 1] - last[each], members[:, 1] - first[each] + MIN_WORDS, partner)


def _crowded(b: pa.RecordBatch) -> pa.RecordBatch:
    """All windows of rows whose key has too many of them."""
    rows = Rows(b)
    row, a, hashes = leaves(rows.k.view(np.uint64), rows.left, rows.right, rows.lo, rows.hi)
    at = ragged((np.cumsum(rows.many) - rows.many)[row], rows.many[row], 1)
    members = rows.members[at].copy()
    members[:, 1] -= np.repeat(a, rows.many[row])
    made = _leaf_rows(np.repeat(hashes, rows.many[row]), members)
    return _passed(made.column(0), made.column(4))


def _match(crowd: int):
    """Rows sorted by (key, words after) -> spans; windows of crowded keys pass for another way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key met
        size, inside, over = 0, 0, None
        many = lambda x: pc.sum(pc.binary_length(x.column(4))).as_py() or 0
        for b in batches:
            single = b.filter(pc.equal(b.column(1), 0))
            if single.num_rows < b.num_rows:
                some = b.filter(pc.greater(b.column(1), 0))
                yield _passed(some.column(0), some.column(4))
            if not single.num_rows:
                continue
            b = single
            k = b.column(0).to_numpy()
            if over is not None:
                go_on = int(np.searchsorted(k != over, True))
                if go_on:
                    yield _crowded(b.slice(0, go_on))
                b, k = b.slice(go_on), k[go_on:]
                if not len(k):
                    continue
                over = None
            tail = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
            if held and (tail or held[-1].column(0)[-1].as_py() != k[0]):
                whole = pa.concat_batches([*held, b.slice(0, tail)]) if tail else pa.concat_batches(held)
                yield from _matched(whole)
                held, size, inside = [b.slice(tail)], len(k) - tail, many(b.slice(tail))
            else:
                if tail:
                    yield from _matched(b.slice(0, tail))
                held.append(b.slice(tail))
                size += len(k) - tail
                inside += many(b.slice(tail))
            if size > crowd or inside > 16 * CROWD_MEMBERS:
                for x in held:
                    yield _crowded(x)
                held, size, inside, over = [], 0, 0, k[-1]
        if held:
            yield from _matched(pa.concat_batches(held))

    return run


def hot_keys(docs: DataFrame, sample: int = SAMPLE, crowd: int = CROWD) -> list[int]:
    """The keys, at most HOT, that by a sample of the documents have more than crowd contexts, or CROWD_MEMBERS suffixes."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0)
    rows = some.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(_suffix_rows([]), ROWS)
    contexts = rows.groupBy("k", "before", "after").agg(F.sum(F.length("members") / 16).alias("n"))
    keys = contexts.groupBy("k").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    large = keys.filter((F.col("rows") * sample > crowd) | (F.col("n") * sample > CROWD_MEMBERS))
    return [r["k"] for r in large.orderBy(F.desc("n"), "k").limit(HOT).select("k").collect()]


def repeated_passages(docs: DataFrame, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, partner_id): regions of a document's words, all in runs of MIN_WORDS or more that another document holds too; end exclusive."""
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(_suffix_rows(hot_keys(docs.select("doc_id", "text"), sample, crowd)), ROWS)
    sorted_rows = rows.repartition("k", "salt").sortWithinPartitions("k", "after")
    found = cut(sorted_rows.mapInArrow(_match(crowd), FOUND), "passages")
    windows = found.filter("k is not null").select("k", F.col("start_word").alias("low"), F.col("end_word").alias("high"), "members")
    ends = windows.groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    more = windows.select("k", "members").join(ends, "k").select("low", "high", "members").mapInArrow(_members, "doc_id long, start_word long, end_word long, partner_id long")
    spans = found.filter("k is null").select("doc_id", "start_word", "end_word", "partner_id").unionByName(more)
    w = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"))
    far = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(far >= F.col("start_word"), 0).otherwise(1))
    region = marked.withColumn("region", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = region.groupBy("doc_id", "region").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("partner_id").alias("partner_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(least document, largest, members) of windows that two documents hold -> a span for each member."""
    for b in batches:
        data, lengths = bytes_of(b.column(2))
        members = data.view("<i8").reshape(-1, 2)
        low, high = (np.repeat(b.column(i).to_numpy(), lengths // 16) for i in range(2))
        found = _spans(members[:, 0], members[:, 1], members[:, 1] + MIN_WORDS, np.where(low == members[:, 0], high, low))
        yield pa.RecordBatch.from_arrays(found.columns[:4], FOUND_NAMES[:4])


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix": op8_suffix}
ORACLE: dict[str, str] = {}
