"""Secret scans: fixed patterns plus a randomness test battery.

Candidates are long runs of encoding characters, without what the fixed
patterns hold.  For each, the narrowest encoding that holds it is inferred
(hex, base32, letters and digits, base64) and three tests ask whether it could
be drawn uniformly from that alphabet: chi-squared over character classes and
over the alphabet, Wald-Wolfowitz runs about the alphabet's middle, and lag-one
serial correlation.  The least p-value, corrected for their number, is the
candidate's grade: near one for keys, tiny for words.

Every document also gives identifiers of its own words, joined as in names and
paths, to as many lengths; their grades are the null of ordinary text, by
length band.  A candidate's p-value is the share of these that look as random
as it does, and Benjamini-Hochberg control of these p-values within each band,
over all documents, decides which candidates are secrets of kind "random": of
the spans reported as random, at most a share of FDR is expected to be text.
Where short strings cannot be told from words, none is reported.  Base pattern
matches always stay.

Defined results: null and empty texts have no spans; very long texts are
scanned whole; repeated rows each get a row; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import mul, ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import cut, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LONG = re.compile(r"[!-~]{16}")
WORDS = re.compile(r"[A-Za-z]{2,}")
MIN_RANDOM = 16
FDR = 0.05
BINS_PER_DECADE, MAX_BIN = 8, 400
#: Least length of each band; within one, grades of words are compared.
BANDS = (16, 20, 24, 32, 48)
#: Identifiers that each document gives to the null, and what joins their words.
NULLS, JOINTS = 2, ("", "_", "-", "/")

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", _UPPER + "234567", _DIGIT + _LOWER, _UPPER + _DIGIT, _DIGIT + _UPPER + _LOWER, _UPPER + _LOWER + _DIGIT + "+/", _UPPER + _LOWER + _DIGIT + "-_")

_SETS = {a: set(a) for a in ALPHABETS}
_PLACES = {a: [a.find(chr(c)) for c in range(128)] for a in ALPHABETS}
_CLASSES = (set(_DIGIT), set(_LOWER), set(_UPPER))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if LONG.search(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _chi(x: float, df: int) -> float:
    """Upper tail of chi-squared, Wilson-Hilferty."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniform_p(word: str) -> float:
    """Least of the battery's p-values times their number, under uniform draws from the inferred alphabet."""
    body = word.rstrip("=")
    n, used = len(body), set(body)
    # letters or digits alone are no encoding: such a string is judged as one of letters and digits
    alphabet = next((a for a in (ALPHABETS[5:] if body.isalpha() or body.isdigit() else ALPHABETS) if used <= _SETS[a]), None)
    if n < MIN_RANDOM or alphabet is None:
        return 0.0
    k = len(alphabet)
    place = _PLACES[alphabet]
    at = [place[c] for c in body.encode()]
    wide = alphabet if k > 36 else ALPHABETS[5]  # letters of one case alone are as unlikely as the full alphabet makes them
    if not used <= _SETS[wide]:
        wide = ALPHABETS[6] if used <= _SETS[ALPHABETS[6]] else ALPHABETS[7]
    tests = []
    if k > 32:
        digits, lower, upper = (sum(map(body.count, used & c)) for c in _CLASSES)
        if k == 36:  # one case and digits: two classes
            sizes, seen = (26, 10), (lower + upper, digits)
        else:
            sizes, seen = ((26, 26, 10, 2), (lower, upper, digits, n - lower - upper - digits)) if len(wide) > 62 else ((26, 26, 10), (lower, upper, digits))
        total = sum(sizes)
        tests.append(_chi(sum((o - n * s / total) ** 2 / (n * s / total) for o, s in zip(seen, sizes, strict=True)), len(sizes) - 1))
    x = sum(c * c for c in Counter(at).values()) * k / n - n
    z = (x - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    tests.append(0.5 * math.erfc(z / math.sqrt(2)))
    above = [a >= k / 2 for a in at]
    up = sum(above)
    if 0 < up < n:
        mean, runs = 1 + 2 * up * (n - up) / n, 1 + sum(map(ne, above[1:], above))
        var = (mean - 1) * (mean - 2) / (n - 1)
        tests.append(math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0)
    else:
        tests.append(2.0 ** (1 - n))
    centre = sum(at) / n
    d = [a - centre for a in at]
    if (s := sum(v * v for v in d)) > 1e-9:
        tests.append(math.erfc(abs(sum(map(mul, d[1:], d)) / s + 1 / n) * math.sqrt(n / 2)))
    else:
        tests.append(0.0)
    return min(1.0, min(tests) * len(tests))


def grade(word: str) -> int:
    """-log10 of the battery's p-value in BINS_PER_DECADE steps."""
    return min(MAX_BIN, int(-math.log10(max(uniform_p(word), 1e-60)) * BINS_PER_DECADE))


def band(n: int) -> int:
    return max(b for b in BANDS if b <= n)


def blocks(base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans with overlapping ones joined, of the first's kind."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in base:
        if out and s < out[-1][2]:
            out[-1] = (*out[-1][:2], max(out[-1][2], e))
        else:
            out.append((s, k, e))
    return out


def random_candidates(text: str, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, band, grade) of what candidates leave beside held spans, disjoint and in order, in one pass over both lists."""
    if not LONG.search(text):
        return []
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        while at < len(held) and held[at][2] <= begin:
            at += 1
        rest, i = [], at
        while i < len(held) and held[i][0] < end:
            rest.append((begin, held[i][0]))
            begin, i = max(begin, held[i][2]), i + 1
        out += [(b, e, band(e - b), grade(text[b:e])) for b, e in (*rest, (begin, end)) if e - b >= MIN_RANDOM]
    return out


def identifiers(text: str, n: int = NULLS) -> Iterator[str]:
    """Names made of the text's own words: letters, lower or mixed case, now and then a number, over all bands."""
    words = [w for w in WORDS.findall(text) if w.isalpha()]
    if not words:
        return
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    for i in range(n):
        seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
        low = BANDS[(seed >> 16) % len(BANDS)]
        length, joint, at = low + seed % max(4, low // 2), JOINTS[(seed >> 8) % 4], (seed >> 10) % len(words)
        name = ""
        while len(name) < length:
            w = words[at % len(words)]
            name += (joint if name else "") + (w.capitalize() if seed >> 5 & 1 else w) + (str(seed >> 12 & 0xFF) if seed >> 6 & 7 == 0 and len(name) + len(w) >= length else "")
            at += 1
        yield name[:length]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_CAND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("grade", pa.int32())]))
_FOUND = "base array<struct<start:long,kind:int,end:long>>, blocks array<struct<start:long,kind:int,end:long>>, cand array<struct<start:long,end:long,band:int,grade:int>>, nulls array<struct<start:long,end:long,band:int,grade:int>>"


def _scan(keep: bool):
    """Columns, the text last -> the same columns (without the text unless keep) and what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = lambda rows: [{"start": s, "kind": k, "end": e} for s, k, e in rows]
        for b in batches:
            base, held, cand, nulls = [], [], [], []
            for t in b.column(b.num_columns - 1):
                text = t.as_py() or ""
                got = base_spans(text)
                joined = blocks(got)
                base.append(spans(got))
                held.append(spans(joined))
                cand.append([{"start": s, "end": e, "band": n, "grade": p} for s, e, n, p in random_candidates(text, joined)])
                nulls.append([{"start": 0, "end": 0, "band": band(len(w)), "grade": grade(w)} for w in identifiers(text)])
            columns = b.num_columns - (not keep)
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(base, _SPAN), pa.array(held, _SPAN), pa.array(cand, _CAND), pa.array(nulls, _CAND)], [*b.schema.names[:columns], "base", "blocks", "cand", "nulls"])

    return run


def accepted_grades(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Per band the largest grade that Benjamini-Hochberg control accepts as a secret; one histogram of at most MAX_BIN grades a band reaches the driver."""
    told = lambda name, null: F.transform(name, lambda x: F.struct(F.lit(null).alias("null"), x["band"].alias("band"), x["grade"].alias("grade")))
    both = found.select(F.explode(F.concat(told("cand", False), told("nulls", True))).alias("c"))
    hist = both.groupBy("c.null", "c.band", "c.grade").count().collect()
    out = {}
    for n in BANDS:
        words, cands = ({r["grade"]: r["count"] for r in hist if r["band"] == n and r["null"] == of} for of in (True, False))
        total, seen = sum(cands.values()), 0
        for g in sorted(cands):
            seen += cands[g]
            p = (1 + sum(c for x, c in words.items() if x <= g)) / (1 + sum(words.values()))
            if p <= fdr * seen / total:
                out[n] = g
    return out


def _accepted(limits: dict[int, int]) -> Column:
    """Accepted candidates of a row as spans of kind random."""
    if not limits:
        return F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    kept = F.filter("cand", lambda c: c["grade"] <= F.coalesce(most[c["band"]], F.lit(-1)))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): spans array<struct<start, kind, end>> sorted by start, then kind, with random ones added."""
    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(False), f"doc_id long, {_FOUND}"), "secrets")
    return found.select("doc_id", "base", F.array_sort(F.concat("base", _accepted(accepted_grades(found)))).alias("spans"))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """documents with every secret replaced by its kind in angle brackets; overlapping spans count as one of the first's kind.

    Texts are written once beside what was found in them, so no row looks for its spans elsewhere.
    """
    names = ["doc_id", "lang", "source", "n_chars", "text"]
    found = cut(docs.select(*names).mapInArrow(_scan(True), f"doc_id long, lang string, source string, n_chars long, text string, {_FOUND}"), "redact")
    spans = F.array_sort(F.concat("blocks", _accepted(accepted_grades(found))))
    told = found.select(*names, spans.alias("spans"))
    kinds = F.array(*map(F.lit, KINDS))
    piece = lambda s, i: F.concat(F.substring(F.col("text"), _end(i - 1) + 1, (s["start"] - _end(i - 1)).cast("int")), F.lit("<"), F.element_at(kinds, s["kind"] + 1), F.lit(">"))
    rest = F.substring(F.col("text"), _end(F.size("spans") - 1) + 1, F.length("text"))
    fresh = told.withColumn("fresh", F.concat(F.array_join(F.transform("spans", piece), ""), rest))
    changed = F.size("spans") > 0
    return fresh.select("doc_id", F.when(changed, F.col("fresh")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("fresh").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def _end(i: Column) -> Column:
    """Where span i of a row ends; 0 before the first."""
    return F.when(i < 0, F.lit(0)).otherwise(F.get(F.col("spans"), i)["end"].cast("int"))


QUERIES = {"op3_secrets": op3_secrets}
ORACLE: dict[str, str] = {}
