"""Sizes at which an operator goes another way: the results stay the same."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from codegrain.llm import copies, outliers, packing
from codegrain.llm.components import components

SMALL = "/root/testdata/sf0.01"


def test_long_chains_settle(spark):
    n = 600
    order = np.random.default_rng(1).permutation(n).tolist()
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001), (1001, None), (1000, 1001)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}


def test_blocks_in_small_pieces(spark, monkeypatch):
    """Blocks dealt into pieces by rows and by shingles link the same texts as whole ones."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > 0.01 else f"x{rng.integers(1 << 30)}" for w in base) for _ in range(60)] + [f"other {i} " * 20 for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    want = sorted(tuple(r) for r in copies.near_copies(docs).collect())
    monkeypatch.setattr(copies, "PIECE", 8)
    assert sorted(tuple(r) for r in copies.near_copies(docs).collect()) == want
    monkeypatch.setattr(copies, "PIECE", 512)
    monkeypatch.setattr(copies, "PIECE_SHINGLES", 700)
    assert sorted(tuple(r) for r in copies.near_copies(docs).collect()) == want


def test_many_groups_join_by_key(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = lambda: sorted((r["doc_id"], r["kept"]) for r in outliers.judge(docs).collect())
    want = told()
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 0)
    assert told() == want


def test_large_totals_place_exactly():
    """Products beyond 64 bits are taken with Python's integers."""
    small = np.array([700, 300]), np.array([7, 3])
    huge = np.array([700, 300]) << 50, np.array([7, 3]) << 50
    chunks = np.array([0, 1, 2])
    assert packing._places(chunks, 0, huge[0], huge[1], 256).tolist() == packing._places(chunks, 0, small[0] << 20, small[1], 256).tolist()


def test_hot_source_is_split(spark):
    """One source with all rows and one id goes to as many buckets as its rows need."""
    from codegrain.llm import mixing

    docs = spark.range(3 * mixing.BUCKET_ROWS).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(mixing.sized_documents(docs))[0]
    assert rows.agg(F.sum("taken")).first()[0] == round(1.5 * 9 * mixing.BUCKET_ROWS)


def test_tokenizer_keeps_nothing_of_a_text():
    """Words that come once cost a worker no memory after their text."""
    encode = packing.tokenizer()
    encode("a first text")
    tracemalloc.start()
    try:
        for i in range(40):
            encode(" ".join(f"w{i}x{j}" for j in range(500)))
        assert tracemalloc.get_traced_memory()[0] < 1 << 18
    finally:
        tracemalloc.stop()


def test_mix_plans_its_targets_once(spark):
    """The targets' windows are no part of the plan of the mix, which would hold them once for each branch that reads them."""
    from codegrain.llm import mixing

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (mixing.mixed_documents(docs), mixing.op5_mixing(spark, SMALL)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 4


def test_release_gives_memory_back(spark):
    """Freed blocks between used ones go back to the system, in the driver's Python and in its JVM."""
    import gc

    from codegrain.llm.common import release, trim_jvm

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous")) / 1024

    blocks = [bytes(8000) for _ in range(20_000)]
    kept = blocks[::100]
    del blocks
    gc.collect()
    before = held()
    release(spark)
    assert len(kept) == 200
    assert before - held() > 100
    assert "Trim native heap" in trim_jvm(spark)
