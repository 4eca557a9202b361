"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words, and one- to two-grams of
word shapes (case and punctuation outline; a word equal to the one before it
has a shape of its own) at the octave of their share of the document.  Each
indicator is scaled by its class log-count ratio, rows are normalised, and a
linear hinge-loss model is fitted by dual coordinate descent.  Margins are
calibrated on a part of the sample that the fit does not see.

The fit uses at most FIT_ROWS labelled documents outside the held-out fold, a
bounded sample by least id hash; scoring covers every document.  Weights have
a fixed size of DIMS floats.

Defined results: null and empty texts score by the intercept; very long texts
and words count whole; repeated rows each get a row; labels that differ for one
id count as their largest; with no labels or one class every score is the class
share (0.5 with none); extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import fold, labelled_sample, sigmoid_fit, table, text_bytes, worker_cache

DIMS = 1 << 18
FIT_ROWS = 6000
COST = 1.0
EPOCHS = 12
SMOOTH = 1.0
MEMO = 150_000
FOLDS, HELD = 3, 1

_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_TABLE = bytes(85 if 65 <= c <= 90 else 100 if 48 <= c <= 57 else 108 if 97 <= c <= 122 or c >= 128 else c for c in range(256))


def _ids(words: list[bytes]) -> np.ndarray:
    """Word hash in the upper half, shape hash in the lower."""
    memo = worker_cache("shapes")
    if len(memo) > MEMO:
        memo.clear()
    get = memo.get
    out = [get(w) for w in words]
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                shape = zlib.crc32(_RUN.sub(rb"\1", w.translate(_TABLE)))
                out[i] = memo[w] = (zlib.crc32(w) << 32) | (shape | 1)
    return np.array(out, np.uint64)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct indicator positions."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    ids = _ids(words)
    shape = ids & np.uint64(0xFFFFFFFF)
    shape[1:][ids[1:] == ids[:-1]] = 2
    mix = np.uint64(0x9E3779B97F4A7C15)
    found = [ids >> np.uint64(32)]
    for salt, grams in ((1, shape), (2, shape[:-1] * np.uint64(31) + shape[1:] * mix)):
        values, counts = np.unique(grams, return_counts=True)
        if len(values):
            octave = np.floor(-np.log2(counts / len(grams))).clip(0, 7).astype(np.uint64)
            found.append((values * np.uint64(16) + octave) * np.uint64(4) + np.uint64(salt))
    every = np.concatenate(found) * mix
    return np.unique((every >> np.uint64(46)).astype(np.int64))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights over DIMS + 1 (intercept last) of the class-balanced hinge loss; ratio is folded into them."""
    rng = np.random.default_rng(7)
    norms = [float(np.sqrt((ratio[r] ** 2).sum())) or 1.0 for r in rows]
    values = [ratio[r] / n for r, n in zip(rows, norms, strict=True)]
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    sign = np.where(y > 0, 1.0, -1.0)
    upper = cost * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y == 0).sum()))
    w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(len(y))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            grad = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return np.append(w, bias)


def fit(sample: list[tuple[np.ndarray, int]]) -> dict:
    """{weights, ratio, a, b} of (features, label) rows; weights is None where there are not two classes."""
    y = np.array([s[1] for s in sample])
    if len(set(y.tolist())) < 2:
        return {"weights": None, "prior": float(y.mean()) if len(y) else 0.5}
    rows = [s[0] for s in sample]
    counts = np.zeros((2, DIMS))
    for r, c in zip(rows, y, strict=True):
        counts[c, r] += 1
    share = np.log((counts + SMOOTH) / (np.bincount(y, minlength=2)[:, None] + 2 * SMOOTH))
    ratio = share[1] - share[0]
    check = np.arange(len(y)) % 5 == 0
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check[:] = True
    train = np.flatnonzero(~check) if not check.all() else np.arange(len(y))
    first = descend([rows[i] for i in train], y[train], ratio)
    a, b = sigmoid_fit([margin(rows[i], first, ratio) for i in np.flatnonzero(check)], y[check])
    return {"weights": descend(rows, y, ratio), "ratio": ratio, "a": a, "b": b}


def margin(r: np.ndarray, w: np.ndarray, ratio: np.ndarray) -> float:
    v = ratio[r]
    return float(w[r] @ v) / (float(np.sqrt((v * v).sum())) or 1.0) + float(w[-1])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).astype("<i4").tobytes() for t in b.column(0)], pa.binary()), b.column(1)], ["f", "label"])


def _scorer(model: dict):
    weights = None if model["weights"] is None else (model["weights"].astype(np.float32), model["ratio"].astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if weights is None:
                scores = np.full(b.num_rows, model["prior"])
            else:
                m = np.array([margin(features(t.as_py()), *weights) for t in b.column(b.num_columns - 1)], float)
                scores = 1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, rows).mapInArrow(_featurize, "f binary, label int")
    got = sorted((bytes(r["f"]), r["label"]) for r in sample.collect())
    order = np.random.default_rng(3).permutation(len(got))
    return fit([(np.frombuffer(got[i][0], "<i4").astype(np.int64), got[i][1]) for i in order])


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """keep columns and score; the text goes to Python and does not come back."""
    kinds = dict(docs.dtypes)
    return docs.select(*keep, text_bytes().alias("_bytes")).mapInArrow(_scorer(model), ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, model_docs: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """documents whose quality score is at least least."""
    model = train(model_docs or docs, labels)
    return score(docs, model, ["doc_id", "text", "lang", "source", "n_chars"]).filter(F.col("score") >= least).drop("score")


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
