"""Toxicity by maximum-scoring segments.

A token's log-odds between toxic and other documents come from balanced
document counts under nested Dirichlet priors: a word leans on its first eight
letters, these on its first seven and so on to four, these on even odds; words
never counted score by the longest prefix that was.  A linear-time scan over the token
scores finds every maximal segment that no extension improves; all negative
tokens lie between the few positive ones, so the scan visits only these.  A segment's score S in a text of n tokens has E-value
K n exp(-lambda S); the significant ones' normalised scores add up to the
document's evidence, which a sigmoid fitted on unseen rows maps to (0, 1).

Counts use at most FIT_ROWS labelled documents outside the held-out fold, a
bounded sample by least id hash; the vocabulary sent to executors is bounded
by it.  Scoring covers every document and its whole text.

Defined results: null and empty texts have no segment and score by the
intercept; a very long text is scanned whole; repeated rows each get a row;
labels that differ for one id count as their largest; with no labels or one
class every score is the class share (0 with none); extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import cut, fold, labelled_sample, sigmoid_fit, table, text_bytes, worker_cache

FIT_ROWS = 16_000
PRIOR = 4.0
#: Lengths of the prefixes that a word leans on, one after the other; of one digit.
PREFIXES = (4, 5, 6, 7, 8)
DRIFT = 0.2
LEAST = 1.0
E_MAX = 1.0
MEMO = 150_000
EULER = 0.5772
FOLDS, HELD = 4, 2
STRIP = ".,!?;:\"'()[]{}*#%&$"


def token(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(STRIP).lower()


def levels(w: str) -> list[str]:
    """Keys of a token from the widest to itself: its prefixes of PREFIXES letters, each marked by its length, then the word."""
    return [*(f"{n}{w[:n]}" for n in PREFIXES if n < len(w)), f"w{w}"]


def wider(key: str) -> str | None:
    """The key that a key leans on."""
    text = key[1:]
    shorter = [n for n in PREFIXES if n < len(text)]
    return f"{shorter[-1]}{text[: shorter[-1]]}" if shorter else None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            totals[y].update({k for w in {token(x) for x in set(t.as_py().split())} if w for k in levels(w)})
    keys = sorted(totals[0].keys() | totals[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([totals[1][k] for k in keys], pa.int64()), pa.array([totals[0][k] for k in keys], pa.int64())], ["k", "c1", "c0"])


def weight(log_odds: float) -> float:
    """What log-odds count: weak evidence for toxicity counts as none."""
    return log_odds if log_odds >= LEAST else min(log_odds, 0.0)


def log_odds(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, float]:
    """Key -> log-odds, where they weigh other than its wider key's; counts are of documents.

    Prefixes stay in the table for tokens that were never counted, so an unseen
    inflection scores by its first letters.
    """
    balance, share = n1 / n0, {}

    def of(k: str | None) -> float:
        if k is None:
            return 0.5
        if k not in share:
            c1, c0 = counts.get(k, (0, 0))
            share[k] = (c1 + PRIOR * of(wider(k))) / (c1 + c0 * balance + PRIOR)
        return share[k]

    logit = lambda x: math.log(x / (1 - x))
    odds = {k: logit(of(k)) for k in counts}
    return {k: lo for k, lo in odds.items() if abs(weight(lo) - weight(logit(of(wider(k))))) > 1e-9}


def token_scores(words: list[bytes], odds: dict[str, float], memo: dict[bytes, float]) -> np.ndarray:
    """Scores with the drift that makes their mean negative; weak evidence for toxicity counts as none."""
    if len(memo) > MEMO:
        memo.clear()
    get = memo.get
    out = [get(w) for w in words]
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                lo = 0.0
                for k in reversed(levels(token(words[i]))):
                    if k in odds:
                        lo = odds[k]
                        break
                out[i] = memo[words[i]] = weight(lo) - DRIFT
    return np.array(out, float)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in time linear in the positive scores.

    Each segment found so far links to the nearest one before it whose left sum
    is smaller.  A new one follows these links: what it passes over has a left
    sum no smaller than its own and is never looked at again.
    """
    cum = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum at its end, link
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(cum[i]), float(cum[i + 1]), i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            start, _, left, _, link = found[j]
            del found[j:]
            j = link
        found.append((start, i + 1, left, right, j))
    return [(s, e, r - x) for s, e, x, r, _ in found]


def evidence(scores: np.ndarray, lam: float, log_k: float) -> tuple[float, int, float]:
    """(sum of normalised scores of significant segments, their number, best score)."""
    found = segments(scores)
    if not found:
        return 0.0, 0, 0.0
    offset = log_k + math.log(len(scores))
    normal = [x for _, _, s in found if (x := lam * s - offset) > -math.log(E_MAX)]
    return sum(normal), len(normal), max(s for _, _, s in found)


def solve_lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of mean(exp(lambda s)) = 1 over scores that occur so often; 1 where no score is positive."""
    if not len(values) or not (values > 0).any() or (values * counts).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    mean = lambda x: float((np.exp(np.minimum(x * values, 60)) * counts).sum() / counts.sum())
    while mean(hi) < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return min(lo, 2.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """The model: log-odds per key, extreme-value parameters and the sigmoid.

    To the driver come the keys of the sample's words that occur often enough,
    one histogram of scores in steps of a hundredth, and two numbers for each
    row that calibrates.
    """
    sample = cut(labelled_sample(docs, labels, "toxic", FOLDS, HELD, rows), "toxic")
    check = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(4)) == 0
    n = {r["label"]: r["count"] for r in sample.filter(~check).groupBy("label").count().collect()}
    if len(n) < 2:
        got = sample.agg(F.avg("label")).first()[0]
        return {"odds": {}, "prior": float(got or 0.0)}
    counted = sample.filter(~check).mapInArrow(_count, "k string, c1 long, c0 long").groupBy("k").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    strong = counted.filter((F.col("c1") >= 3) | (F.col("c0") >= 20))
    odds = log_odds({r["k"]: (r["c1"], r["c0"]) for r in strong.toLocalIterator()}, n[1], n[0])
    clean = sample.filter(check & (F.col("label") == 0))
    hist = clean.mapInArrow(_histogram(odds), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    lam = solve_lambda(np.array([r["bin"] / 100 for r in hist]), np.array([r["n"] for r in hist], float))
    best = [r for r in clean.mapInArrow(_evidence(odds, lam, 0.0), PROBE).collect() if r["n"]]
    log_k = float(np.mean([lam * r["best"] - EULER - math.log(r["n"]) for r in best])) if best else 0.0
    probe = sample.filter(check).mapInArrow(_evidence(odds, lam, log_k), PROBE).collect()
    model = {"odds": odds, "prior": None, "lam": lam, "log_k": log_k, "a": 1.0, "b": -3.0}
    if len({r["label"] for r in probe}) == 2:
        model["a"], model["b"] = sigmoid_fit([r["evidence"] for r in probe], [r["label"] for r in probe])
    return model


def _histogram(odds: dict[str, float]):
    """Scores of all words, rounded to a hundredth, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for b in batches:
            scores = np.concatenate([np.zeros(0), *[token_scores(t.as_py().split(), odds, memo) for t in b.column(0)]])
            bins, counts = np.unique(np.rint(scores * 100).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(counts)], ["bin", "n"])

    return run


PROBE = "label int, n int, best double, evidence double"


def _evidence(odds: dict[str, float], lam: float, log_k: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for b in batches:
            scores = [token_scores(t.as_py().split(), odds, memo) for t in b.column(0)]
            got = [evidence(s, lam, log_k) if len(s) else (0.0, 0, 0.0) for s in scores]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([len(s) for s in scores], pa.int32()), pa.array([g[2] for g in got], pa.float64()), pa.array([float(g[0]) for g in got], pa.float64())], ["label", "n", "best", "evidence"])

    return run


def _scorer(model: dict, shared):
    rest = {k: v for k, v in model.items() if k != "odds"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, memo = shared.value, worker_cache(f"toxic:{shared.id if hasattr(shared, 'id') else id(shared)}")
        for b in batches:
            rows = []
            for t in b.column(1):
                words = t.as_py().split()
                if rest["prior"] is not None:
                    rows.append((rest["prior"], 0, 0.0))
                    continue
                total, n, best = evidence(token_scores(words, odds, memo), rest["lam"], rest["log_k"]) if words else (0.0, 0, 0.0)
                rows.append((1 / (1 + math.exp(-max(-30.0, min(30.0, rest["a"] * total + rest["b"])))), n, best))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["doc_id", "score", "n_passages", "best_passage"])
        memo.clear()

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model["odds"])
    return docs.select("doc_id", text_bytes()).mapInArrow(_scorer(model, shared), "doc_id long, score double, n_passages int, best_passage double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "best_passage")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
