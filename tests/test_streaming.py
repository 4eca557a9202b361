"""The change-stream functions on running streams give what they give on whole tables."""

import datetime as dt

from pyspark.sql import functions as F

from codegrain.streaming import changes

SCHEMA = "path string, event string, hash string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)
at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
ROWS = [
    ("a.ts", "add", "h1", at(0)), ("a.ts", "change", "h1", at(20)), ("a.ts", "change", "h2", at(5000)), ("b.ts", "add", "h9", at(10)),
    ("b.ts", "unlink", None, at(6000)), ("c.ts", "add", "h9", at(6400)), ("d.d.ts", "add", "h5", at(7000)), ("a.ts", "change", "h2", at(8000)),
]


def stream(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


def run(df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in df.sparkSession.table(name).collect()}


def test_changed_content(spark, tmp_path):
    rows = changes.source_events(stream(spark, tmp_path / "in", ROWS))
    got = run(changes.changed_content(rows).select("path", "event", "hash"), "changed", tmp_path / "cp")
    static = changes.changed_content(changes.source_events(spark.createDataFrame(ROWS, SCHEMA))).select("path", "event", "hash")
    assert got == {tuple(r) for r in static.collect()}
    assert ("a.ts", "change", "h1") not in got and not any(r[0] == "d.d.ts" for r in got)


def test_debounce(spark, tmp_path):
    static = {(r["path"], r["event"], r["events"]) for r in changes.debounced(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {("a.ts", "change", 2), ("a.ts", "change", 1), ("b.ts", "add", 1), ("b.ts", "unlink", 1)} <= static
    late = ROWS + [("z.ts", "add", "hz", at(60_000))]  # moves the watermark past every burst
    streamed = run(changes.debounced(stream(spark, tmp_path / "in", late)).select("path", "event", "events"), "bursts", tmp_path / "cp")
    assert streamed == static


def test_renames(spark, tmp_path):
    moved = {("b.ts", "c.ts", "h9")}
    dels = spark.createDataFrame([("b.ts", "unlink", "h9", at(6000)), ("x.ts", "unlink", "h8", at(0))], SCHEMA)
    adds = spark.createDataFrame([("c.ts", "add", "h9", at(6400)), ("y.ts", "add", "h8", at(4000))], SCHEMA)
    assert {tuple(r)[:3] for r in changes.renames(dels, adds).collect()} == moved
    dels.write.parquet(str(tmp_path / "d"))
    adds.write.parquet(str(tmp_path / "a"))
    s = lambda p: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / p))
    assert {r[:3] for r in run(changes.renames(s("d"), s("a")).select("from_path", "to_path", "hash"), "moved", tmp_path / "cp")} == moved


def test_merging_sink(spark, tmp_path):
    table = [spark.createDataFrame([("a.ts", "old"), ("b.ts", "old"), ("k.ts", "old")], "source_file_path string, name string")]
    sink = changes.merging(lambda: table[0], lambda df: table.__setitem__(0, spark.createDataFrame(df.collect(), df.schema)), lambda b: b.select(F.col("path").alias("source_file_path"), F.lit("new").alias("name")).distinct())
    q = stream(spark, tmp_path / "in", [ROWS[2], ROWS[4]]).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in table[0].collect()} == {("a.ts", "new"), ("k.ts", "old")}


def test_renames_consume_both_sides(spark):
    from codegrain.streaming import changes

    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    frame = lambda rows: spark.createDataFrame(rows, "path string, hash string, t string").selectExpr("path", "hash", "cast(t as timestamp) as ts")
    deleted = frame([("a", "h", at(1)), ("b", "h", at(1.2)), ("c", "g", at(1)), ("d", "k", at(5))])
    added = frame([("x", "h", at(1.5)), ("y", "h", at(1.6)), ("z", "h", at(1.7)), ("late", "g", at(2.5)), ("early", "k", at(4.9))])
    got = sorted((r["from_path"], r["to_path"]) for r in changes.renames(deleted, added).collect())
    assert got == [("a", "x"), ("b", "y")]
