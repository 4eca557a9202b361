"""Quality rules with robust multivariate outliers.

Per document, word and line statistics are taken in one pass.  Base rules drop
very short and very repetitive documents.  Of the rest, transformed statistic
vectors are compared with minimum-covariance-determinant estimates of their
(lang, source) group, of their language and of the table.  For these, vectors
fall into cells of a grid, GRID steps of the group's robust scale a side in
each dimension, which keep count, sums and products: all documents count, and a
group has at most GRID ** p cells, however many documents it holds.  From
several deterministic starts, concentration steps move to the half of the
documents nearest by Mahalanobis distance until that half stays; the start that
ends at the least determinant gives the estimate, scaled to be consistent for
normal data.  A group's estimate leans on its language's, and that on the
table's, as if it had LEAN documents more of these, so there is no least size.

Squared distances are scaled so that their upper quartile is chi-squared's: the
scale follows the tail that clean texts have, while up to a quarter of the
documents may be outliers.  A document is kept unless its scaled distance lies
beyond the quantile that one in 1 / TAIL normal vectors passes.

Defined results: null and empty texts have zero words and fail the base rules;
very long texts are measured whole; null lang and null source are values of
their own; repeated rows each get a row; a constant statistic has a floor under
its variance; extra columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import cut, table, text_bytes

SYMBOLS = b"#*$%&|<>"
SPAN = 8
MIN_WORDS = 20
MAX_REPEAT = 30
#: Cells a side, in steps of half a robust standard deviation; the outermost hold all beyond.
GRID, STEP = 10, 0.5
#: Documents of the language's estimate that a group's counts as well.
LEAN = 100.0
#: Chance of a normal vector to be rejected.
TAIL = 1e-7
ROUNDS = 50
SUBSETS = 24
BINS_PER_UNIT = 200
#: Scale floor per statistic: what counts as no spread at all.
FLOOR = 0.02
#: Groups of under 1 KB each that are broadcast; more are joined by key.
BROADCAST_GROUPS = 10_000

_LINE = re.compile(rb"[^\x20\x09-\x0D]")


def _repeats(ids: np.ndarray, span: int = SPAN) -> int:
    """Words inside span-word windows that occur at least twice, first ones included."""
    n = len(ids) - span + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(span):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        h ^= h >> np.uint64(29)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    twice = counts[inverse] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + span, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_upper, n_punct)."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * 8
    blanks = sum(text.count(c) for c in b" \t\n\x0b\x0c\r")
    chars = len(text) - blanks if text.isascii() else len(text.decode("utf-8", "replace")) - blanks
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    lines = [x for x in text.split(b"\n") if _LINE.search(x)]
    letters = np.frombuffer(text, np.uint8)
    hist = np.bincount(letters, minlength=128)
    return (n, chars, int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), _repeats(ids), len(seen), int(hist[65:91].sum()), int(hist[[33, 44, 46, 58, 59, 63]].sum()))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_punct"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([statistics(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c) for c in rows.T)], ["doc_id", "lang", "source", *NAMES])


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", text_bytes()).mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in NAMES))


def vector() -> list[Column]:
    """Transformed statistics; rates are square roots scaled by the noise that a document of this length has."""
    n, c = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    noise = F.sqrt(F.least(n, F.lit(400.0)) / 400.0)
    return [
        F.log(c / n) * noise,
        F.sqrt(F.col("n_symbols") / c) * noise,
        F.sqrt(F.col("n_upper") / c) * noise,
        F.sqrt(F.col("n_punct") / n) * noise,
        F.log(F.col("n_distinct") / n) / F.log(n + 1) * noise,
    ]


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def chi_squared(x: float, df: int) -> float:
    """Chance that a chi-squared variable of df degrees is at most x, by the series of the incomplete gamma function."""
    a, half = df / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    k = 1
    while term > 1e-16 * total:
        term *= half / (a + k)
        total += term
        k += 1
    return min(1.0, total)


def chi_quantile(share: float, df: int) -> float:
    lo, hi = 0.0, 100.0 + 10.0 * df
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_squared(mid, df) < share else (lo, mid)
    return lo


def consistency(p: int) -> float:
    """By how much the covariance of the inner half of normal data falls short."""
    return 0.5 / chi_squared(chi_quantile(0.5, p), p + 2)


def starts(p: int, count: np.ndarray, at: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Deterministic first estimates (mean, covariance): robust scales alone; correlations of bounded, of signed and of ranked values; small subsets drawn with a fixed seed."""
    yield centre, np.diag(scale**2)
    z = (at - centre) / scale
    ranks = np.column_stack([np.interp(z[:, i], np.sort(z[:, i]), np.cumsum(count[np.argsort(z[:, i], kind="stable")]) / count.sum()) - 0.5 for i in range(p)])
    for y in (np.tanh(z), z / (1e-9 + np.linalg.norm(z, axis=1, keepdims=True)), ranks):
        m = (y * count[:, None]).sum(0) / count.sum()
        c = ((y - m) * count[:, None]).T @ (y - m) / count.sum()
        d = np.sqrt(np.maximum(np.diag(c), 1e-9))
        yield centre, c / d / d[:, None] * scale * scale[:, None]
    rng = np.random.default_rng(p)
    for _ in range(SUBSETS):
        some = at[rng.choice(len(at), min(len(at), p + 2), p=count / count.sum())]
        yield some.mean(0), np.cov(some.T, bias=True).reshape(p, p)


def smallest_determinant(count: np.ndarray, sums: np.ndarray, products: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the half of all points with the least determinant that concentration steps reach, over cells with count, sums and products."""
    p = len(centre)
    at, half, best = sums / count[:, None], count.sum() / 2, None
    full = np.zeros((len(count), p, p))
    full[:, *np.triu_indices(p)] = products
    full = full + np.triu(full, 1).transpose(0, 2, 1)
    for mean, cov in starts(p, count, at, centre, scale):
        before = None
        for _ in range(ROUNDS):
            d = at - mean
            away = ((d @ np.linalg.inv(cov + FLOOR**2 * np.eye(p))) * d).sum(1)
            order = np.argsort(away, kind="stable")
            inner = order[: int(np.searchsorted(np.cumsum(count[order]), half)) + 1]
            n = count[inner].sum()
            mean = sums[inner].sum(0) / n
            cov = full[inner].sum(0) / n - np.outer(mean, mean)
            now = np.sort(inner).tobytes()
            if now == before:
                break
            before = now
        size = np.linalg.det(cov + FLOOR**2 * np.eye(p))
        if best is None or size < best[0] * (1 - 1e-9):
            best = size, mean, cov
    return best[1], best[2] * consistency(p)


def _estimate(p: int):
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell")
        stack = lambda c: np.array(cells[c].tolist(), float)
        mean, cov = smallest_determinant(cells["n"].to_numpy(float), stack("sums"), stack("products"), np.array(cells["centre"].iloc[0]), np.array(cells["scale"].iloc[0]))
        return pd.DataFrame([(*key, int(cells["n"].sum()), mean.tolist(), cov[np.triu_indices(p)].tolist())], columns=[*KEYS, "n", "mean", "cov"])

    return run


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper triangles of covariances -> of their inverses."""
    for b in batches:
        out = []
        for row in b.column("cov").to_pylist():
            p = int((2 * len(row)) ** 0.5)
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = row
            cov = np.triu(cov) + np.triu(cov, 1).T + FLOOR**2 * np.eye(p)
            out.append(np.linalg.inv(cov)[np.triu_indices(p)].tolist())
        keep = [n for n in b.schema.names if n != "cov"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(out, pa.list_(pa.float64()))], [*keep, "inv"])


def _away(rows: DataFrame, p: int) -> DataFrame:
    """Adds dist, the squared Mahalanobis distance to the model that rows carry."""
    rows = rows.withColumns({f"d{i}": F.col(f"x{i}") - F.col("mean")[i] for i in range(p)})
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_upper(p)):
        total = total + F.col(f"d{i}") * F.col(f"d{j}") * F.col("inv")[k] * (1 if i == j else 2)
    return rows.withColumn("dist", total).drop(*[f"d{i}" for i in range(p)])


KEYS = ["level", "gl", "gs"]


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with the written values of their group: broadcast up to BROADCAST_GROUPS groups, so that no group's rows meet in one task; else a join on the keys."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, on, how)


def fit(rows: DataFrame, p: int) -> DataFrame:
    """(level, gl, gs, x0..) rows -> (level, gl, gs, n, mean, cov): the estimate of every group, its cov an upper triangle."""
    xs = [F.col(f"x{i}") for i in range(p)]
    quartiles = rows.groupBy(*KEYS).agg(*[F.percentile_approx(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.lit(10_000)).alias(f"q{i}") for i, x in enumerate(xs)])
    frame = quartiles.select(*KEYS, F.array(*[F.col(f"q{i}")[1] for i in range(p)]).alias("centre"), F.array(*[F.greatest(F.lit(FLOOR), (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) for i in range(p)]).alias("scale"))
    frame = cut(frame, "mcd")
    side = lambda i: F.least(F.lit(GRID - 1), F.greatest(F.lit(0), F.floor((xs[i] - F.col("centre")[i]) / (F.col("scale")[i] * STEP)).cast("int") + GRID // 2))
    cell = sum((side(i) * GRID**i for i in range(1, p)), side(0))
    sums, products = F.array(*[F.sum(x) for x in xs]), F.array(*[F.sum(xs[i] * xs[j]) for i, j in _upper(p)])
    cells = _with_groups(rows, frame, KEYS).groupBy(*KEYS, cell.cast("long").alias("cell")).agg(F.count("*").alias("n"), sums.alias("sums"), products.alias("products"), F.first("centre").alias("centre"), F.first("scale").alias("scale"))
    return cut(cells.groupBy(*KEYS).applyInPandas(_estimate(p), "level int, gl string, gs string, n long, mean array<double>, cov array<double>"), "mcd")


def leaning(model: DataFrame) -> DataFrame:
    """Estimates of groups, each leaning on the wider one's: (gl, gs, mean, inv)."""
    wide = model.filter("level = 2").select(F.col("mean").alias("wide_mean"), F.col("cov").alias("wide_cov"))
    share = F.col("n") / (F.col("n") + F.lit(LEAN))
    mixed = lambda a, b: F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y)
    lean = lambda on: [mixed("mean", "wide_mean").alias("mean"), mixed("cov", "wide_cov").alias("cov"), *on]
    langs = model.filter("level = 1").crossJoin(wide).select(*lean(["gl"]))  # one row
    below = langs.select("gl", F.col("mean").alias("wide_mean"), F.col("cov").alias("wide_cov"))
    return model.filter("level = 0").join(below, "gl").select(*lean(["gl", "gs"])).mapInArrow(_invert, "mean array<double>, gl string, gs string, inv array<double>")


def fence(distances: DataFrame, p: int) -> DataFrame:
    """One row, cutoff: the distance beyond which documents go, from the histogram of the distances' logarithms."""
    bins = distances.filter("distance is not null").groupBy(F.floor(F.log(F.greatest("distance", F.lit(1e-9))) * BINS_PER_UNIT).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    per = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("m"))  # a few thousand bins at most
    step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & ((a["seen"] + x["n"]) * 4 >= F.col("m") * 3), x["bin"]).otherwise(a["at"]).alias("at"))
    quartile = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), step)["at"]
    return per.select((F.exp((quartile + 1) / BINS_PER_UNIT) * (chi_quantile(1 - TAIL, p) / chi_quantile(0.75, p))).alias("cutoff"))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics of every document with base_failed, distance (null where base_failed) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    stats = cut(measured(docs).withColumn("base_failed", failed), "stats")
    vec = vector()
    p = len(vec)
    group = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))
    keyed = stats.select("*", group("lang").alias("gl"), group("source").alias("gs"), *[F.when(~F.col("base_failed"), v).alias(f"x{i}") for i, v in enumerate(vec)])
    levels = F.array(F.struct(F.lit(0).alias("level"), "gl", "gs"), F.struct(F.lit(1).alias("level"), "gl", F.lit("").alias("gs")), F.struct(F.lit(2).alias("level"), F.lit("").alias("gl"), F.lit("").alias("gs")))
    xs = [f"x{i}" for i in range(p)]
    model = cut(leaning(fit(keyed.filter(~F.col("base_failed")).select(F.explode(levels).alias("k"), *xs).select("k.*", *xs), p)), "mcd")
    scored = cut(_away(_with_groups(keyed, model, ["gl", "gs"], "left"), p).select("doc_id", *NAMES, "base_failed", F.col("dist").alias("distance")), "mcd")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > F.col("cutoff"), F.lit(False))
    return scored.join(F.broadcast(fence(scored, p)), F.lit(True), "left").select("doc_id", *NAMES, "base_failed", "distance", kept.alias("kept"))  # one row


def op10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *NAMES[:5], "base_failed", "kept", "distance")


QUERIES = {"op10_outliers": op10_outliers}
ORACLE: dict[str, str] = {}
