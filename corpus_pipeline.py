"""Documents to packed sequences: quality, near duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm import copies, mixing, nbsvm, packing, secret_scan
from codegrain.llm.common import cut, drop_cuts, release, scope, table

SCOPE, RESULTS = "pipeline", "pipeline results"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts score by its intercept, repeated rows each for itself, and with no labels all stay."""
    return nbsvm.accepted(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id (null last, ties to the first read); null and empty texts are one group."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), *COLUMNS), "dedup")
    ranked = copies.near_copies(rows).join(rows.select("rid", "doc_id"), "rid")
    stay = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("m")).select("m.rid")
    return rows.join(stay, "rid", "left_semi").select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind; null and empty texts stay as they are, repeated rows stay."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document rows that the mix takes, repeats included; texts without words are never taken, a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; a null text is packed as an empty one, repeated rows each for itself."""
    return packing.pack(docs)


def _stage(name: str, f: Callable) -> tuple[str, Callable]:
    """What earlier stages wrote for themselves goes, unless docs still reads it, and so does memory that the driver no longer uses; extra columns of docs are ignored, and an empty table gives an empty result."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_cuts(SCOPE, docs)
        release(spark)
        with scope(SCOPE):
            return f(spark, docs, sf_dir)

    return name, run_stage


STAGES = [_stage(f.__name__, f) for f in (quality, near_duplicates, secrets, mix, pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus.  Each stage's result is written, and goes once the next one is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        with scope(RESULTS):
            docs = cut(done, name)
        drop_cuts(RESULTS, docs)
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    drop_cuts(RESULTS, pieces)
    return pieces


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
