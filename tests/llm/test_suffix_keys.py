"""Suffix keys that very many documents hold."""

from pyspark.sql import functions as F

from codegrain.llm import suffix

DOCS, PAIRS = 75_000, 40


def test_pairs_within_a_crowded_key(spark):
    """Documents of 14 words, a 40-word line that all hold and 10 words: only pairs that also share the 14 hold a passage, of 54 words."""
    line = " ".join(f"licence{i}" for i in range(40))
    words = lambda prefix, of, n: F.concat_ws(" ", *[F.concat(F.lit(prefix), F.xxhash64(of, F.lit(i)).cast("string")) for i in range(n)])
    own = F.when(F.col("id") < 2 * PAIRS, F.floor(F.col("id") / 2) - PAIRS).otherwise(F.col("id"))
    docs = spark.range(0, DOCS, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words("a", own, 14), F.lit(line), words("b", F.col("id"), 10)).alias("text"))
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["partner_id"]) for r in suffix.repeated_passages(docs).collect()}
    assert got == {(i, 0, 54, i ^ 1) for i in range(2 * PAIRS)}
