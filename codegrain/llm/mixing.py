"""Mixing sources to target token weights, in DataFrame functions only.

Each source is one stream of words (documents in a hashed order), packed into
blocks of BLOCK words.  A source gives as many slots as its target needs; the
slots' output shards are a multinomial draw, so every shard has a count of
slots per source (``shard_counts``), while the number of slots, and so the words
a source gives, stays exact.  A shard's slots of a source are numbered on from
those of the shards before it; a per-source, per-epoch pseudorandom permutation
maps slot to block index, and slots join blocks by (source, index).  The last
slots are cut so that a source gives round(target) words.

Stream offsets come from two-level prefix sums over (source, bucket), so a
source that holds a third of all rows never meets in one task, and slots are
made from one row for each (source, shard).

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, ordered last; repeated rows are documents of their own; a
very long text is cut at block ends, between words; extra columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import WORD, cut, table

BLOCK = 256
SHARD_WORDS = 1 << 20
THROWS = 1 << 16
BUCKET_ROWS = 4096
ROUNDS = 12
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SEED = 20240607


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) rows -> (skey, source, source_size, target).

    Water level: sources sorted by cap/weight are capped as long as the level
    that the rest would have lies above their cap; this is where repeated
    resharing of the excess by weight ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before, whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    per = per.withColumn("first", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("level").alias("level")))).over(whole))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("first.level"), F.lit(0.0)))
    return per.select(source_key(F.col("source")).alias("skey"), "source", "source_size", target.alias("target"))


def permute(x: Column, n: Column, skey: Column, epoch: Column, inverse: bool = False, seed: int = SEED) -> Column:
    """Swap-or-not shuffle of 0..n-1: every round is an involution, so the inverse runs the rounds backwards."""
    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])

    def step(v: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), skey, epoch, r), n) - v, n)
        swap = F.xxhash64(F.lit(seed + 1), skey, epoch, r, F.greatest(v, partner)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, partner).otherwise(v)

    return F.aggregate(rounds, x.cast("long"), step)


def planned(per_source: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sources that give words: n blocks, goal words in all, full epochs and rest words of the last, k slots; the last block has tail words and lies at tail_slot of the last epoch."""
    p = per_source.filter((F.col("source_size") > 0) & (F.col("target") > 0)).withColumns({"n": F.ceil(F.col("source_size") / block).cast("long"), "goal": F.round("target").cast("long")})
    p = p.withColumns({"full": F.expr("goal div source_size"), "rest": F.expr("goal % source_size"), "tail": F.expr(f"source_size - (n - 1) * {block}")})
    p = p.withColumn("tail_slot", permute(F.col("n") - 1, F.col("n"), F.col("skey"), F.col("full"), inverse=True))
    return p.withColumn("k", F.col("full") * F.col("n") + F.least(F.col("n"), F.ceil((F.col("rest") + block - F.col("tail")) / block))).filter("k > 0")


def shard_counts(plan: DataFrame, n_shards: int) -> DataFrame:
    """(skey, shard, count, first): the multinomial draw, each of a source's k slots thrown into one of n_shards, and the number of its first slot there."""
    throws = plan.select("skey", "k").withColumn("c", F.explode(F.expr(f"sequence(0L, (k - 1) div {THROWS})"))).repartition(n_shards, "skey", "c")
    ticket = throws.select("skey", F.explode(F.expr(f"sequence(c * {THROWS}, least(k, (c + 1) * {THROWS}) - 1)")).alias("ticket"))
    drawn = ticket.groupBy("skey", F.pmod(F.xxhash64(F.lit(SEED + 2), "skey", "ticket"), F.lit(n_shards)).alias("shard")).agg(F.count("*").alias("count"))
    return drawn.withColumn("first", F.sum("count").over(Window.partitionBy("skey").orderBy("shard")) - F.col("count"))


def slots(per_source: DataFrame, block: int = BLOCK, n_shards: int = 1) -> DataFrame:
    """(skey, shard, slot, epoch, blk, take): take words from the start of block blk of the source's stream."""
    plan = cut(planned(per_source, block), "plan")
    # a stated number of partitions: a merge by the small input's size would make all slots in one task
    p = shard_counts(plan, n_shards).join(plan.hint("merge"), "skey").repartition(n_shards, "shard", "skey")
    s = p.withColumn("slot", F.explode(F.expr("sequence(first, first + count - 1)")))
    s = s.withColumns({"epoch": F.expr("slot div n"), "j": F.expr("slot % n")})
    s = s.withColumn("blk", permute(F.col("j"), F.col("n"), F.col("skey"), F.col("epoch")))
    s = s.withColumn("len", F.when(F.col("blk") == F.col("n") - 1, F.col("tail")).otherwise(block))
    begin = F.col("j") * block - F.when(F.col("j") > F.col("tail_slot"), F.lit(block) - F.col("tail")).otherwise(0)
    s = s.withColumn("take", F.when(F.col("epoch") < F.col("full"), F.col("len")).otherwise(F.greatest(F.lit(0), F.least(F.col("len"), F.col("rest") - begin))))
    return s.filter("take > 0").select("skey", "shard", "slot", "epoch", "blk", F.col("take").cast("long").alias("take"))


def shards_of(n_words: int, share: float = SHARE) -> int:
    """Output shards of about SHARD_WORDS words."""
    return max(1, round(share * n_words / SHARD_WORDS))


def mix(sized: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, source, size) rows, written before -> (segments with their slots, per-source targets).

    One row for each segment (a document's words in one block) and slot that
    takes words of it, or with null take where none does: seg_from is the
    segment's first word in the document, taken the words it gives.
    """
    n_docs, n_words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets, n_shards = max(1, -(-n_docs // BUCKET_ROWS)), shards_of(n_words)
    per_source = cut(targets(sized), "targets")  # read by three branches below: each would plan its windows anew
    d = sized.withColumns({"skey": source_key(F.col("source")), "bucket": F.pmod(F.xxhash64("doc_id", "rid"), F.lit(n_buckets))})
    sums = d.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    base = F.sum("bucket_size").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("bucket_size")
    bases = sums.select("skey", "bucket", base.alias("base")).join(per_source.drop("source"), "skey")
    within = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = d.withColumn("within", within).join(bases, ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
    seg = placed.withColumn("blk", F.explode_outer(F.expr(f"CASE WHEN size > 0 THEN sequence(start div {block}, (start + size - 1) div {block}) END")))
    seg = seg.withColumns({"lo": F.greatest(F.col("start"), F.col("blk") * block), "hi": F.least(F.col("start") + F.col("size"), (F.col("blk") + 1) * block)})
    seg = seg.select("rid", "doc_id", "size", "skey", "source_size", "target", "blk", (F.col("lo") - F.col("start")).alias("seg_from"), (F.col("hi") - F.col("lo")).alias("seg_len"), (F.col("lo") - F.col("blk") * block).alias("seg_at"))
    # slots are generated from few rows and grow with the input: without the hint they would pass for small and be broadcast
    joined = seg.join(slots(per_source, block, n_shards).hint("merge"), ["skey", "blk"], "left")
    taken = F.greatest(F.lit(0), F.least(F.col("seg_len"), F.coalesce("take", F.lit(0)) - F.col("seg_at")))
    return joined.withColumn("taken", taken.cast("long")), per_source


def sized_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """Documents with their word counts and a row id, written to the shared folder: texts are read once."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", size.alias("size"), *keep), "sized")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(table(spark, sf_dir, "documents"))
    segments, _ = mix(sized)
    return segments.groupBy("rid", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("rid")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as document rows, dealt out by output shard.

    A document taken whole in an epoch keeps its text and lies in the shard that
    takes its first word; else each taken segment is a row, the text from its
    first word up to the next segment's.
    """
    sized = sized_documents(docs, "text", "lang")
    segments, _ = mix(sized.select("rid", "doc_id", "source", "size"))
    took = segments.filter("taken > 0").withColumn("whole", F.sum("taken").over(Window.partitionBy("rid", "epoch")) == F.col("size"))
    kept = took.filter(~F.col("whole") | (F.col("seg_from") == 0))
    part = F.struct("whole", "seg_from", F.when(F.col("whole"), F.col("size")).otherwise(F.col("taken")).alias("n"), "shard")
    parts = kept.groupBy("rid").agg(F.collect_list(part).alias("parts"))
    pieces = F.regexp_extract_all("text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    rows = sized.drop("size").join(parts, "rid").withColumn("words", F.when(F.exists("parts", lambda p: ~p["whole"]), pieces))
    text = lambda p: F.when(p["whole"], F.col("text")).otherwise(F.array_join(F.slice(F.col("words"), (p["seg_from"] + 1).cast("int"), p["n"].cast("int")), ""))
    rows = rows.select("doc_id", "lang", "source", F.explode(F.transform("parts", lambda p: F.struct(text(p).alias("text"), p["shard"].alias("shard")))).alias("p"))
    return rows.select("doc_id", "p.text", "lang", "source", F.length("p.text").cast("long").alias("n_chars"), "p.shard").repartition("shard").drop("shard")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE: dict[str, str] = {}
