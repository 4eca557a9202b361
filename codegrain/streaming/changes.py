"""File-change streams: debounce, unchanged-content skip, renames and merges.

Every function takes a streaming or a static DataFrame of
(path, event, hash, ts) with event add, change or unlink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.operators.overlay import merge_files


def source_events(events: DataFrame, extensions: tuple[str, ...] = (".ts", ".tsx", ".py")) -> DataFrame:
    """Events of source files; declaration files are left out."""
    wanted = F.lit(False)
    for x in extensions:
        wanted = wanted | F.col("path").endswith(x)
    return events.filter(wanted & ~F.col("path").endswith(".d.ts"))


def debounced(events: DataFrame, quiet: str = "100 milliseconds", late: str = "1 second") -> DataFrame:
    """The last event of each path in every burst that a quiet period ends."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    burst = events.groupBy("path", F.session_window("ts", quiet).alias("burst"))
    return burst.agg(F.max_by(F.struct("event", "hash", "ts"), F.struct("ts", "event")).alias("last"), F.count("*").alias("events")).select("path", "last.event", "last.hash", "last.ts", "events")


def _skip(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = state.get[0] if state.exists else None
    for pdf in frames:
        keep = []
        for r in pdf.sort_values(["ts", "event"]).itertuples(index=False):
            keep.append(r.event != "change" or r.hash != known)
            known = None if r.event == "unlink" else r.hash
        yield pdf.sort_values(["ts", "event"])[keep]
    if known is None:
        if state.exists:
            state.remove()
    else:
        state.update((known,))


def changed_content(events: DataFrame) -> DataFrame:
    """Changes whose hash the path already had are left out; adds and unlinks never are."""
    schema = "path string, event string, hash string, ts timestamp"
    rows = events.select("path", "event", "hash", "ts")
    if events.isStreaming:
        return rows.groupBy("path").applyInPandasWithState(_skip, schema, "hash string", "append", "NoTimeout")
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ts", "event")
    before = F.lag(F.when(F.col("event") != "unlink", F.col("hash"))).over(w)
    return rows.withColumn("known", before).filter((F.col("event") != "change") | ~F.col("hash").eqNullSafe(F.col("known"))).drop("known")


def renames(deleted: DataFrame, added: DataFrame, within: str = "1 second", late: str = "1 second") -> DataFrame:
    """Adds with the hash of a file deleted shortly before: (from_path, to_path, hash, ts); each add and each delete counts once.

    Deletes wait in order of time; an add takes the first one of its hash that
    waits and is not over.  Events of one hash meet in one group, whose rows are
    the copies of one content.
    """
    d = deleted.select(F.lit("unlink").alias("event"), "path", "hash", "ts")
    events = d.unionByName(added.select(F.lit("add").alias("event"), "path", "hash", "ts"))
    limit = pd.Timedelta(within)
    schema = "from_path string, to_path string, hash string, ts timestamp"
    if events.isStreaming:
        events = events.withWatermark("ts", late)
        return events.groupBy("hash").applyInPandasWithState(_rename(limit), schema, "paths array<string>, times array<long>", "append", "NoTimeout")
    return events.groupBy("hash").applyInPandas(lambda key, pdf: _paired(key, pdf, [], limit)[0], schema)


def _paired(key: tuple, pdf: pd.DataFrame, waiting: list[tuple[str, pd.Timestamp]], limit: pd.Timedelta) -> tuple[pd.DataFrame, list]:
    """(renames, deletes that still wait) of events of one hash; a delete comes before an add of the same time."""
    out = []
    for r in pdf.assign(late=pdf["event"] == "add").sort_values(["ts", "late", "path"]).itertuples(index=False):
        waiting = [w for w in waiting if r.ts - w[1] <= limit]
        if r.event == "unlink":
            waiting.append((r.path, r.ts))
        elif waiting:
            out.append((waiting.pop(0)[0], r.path, key[0], r.ts))
    return pd.DataFrame(out, columns=["from_path", "to_path", "hash", "ts"]), waiting


def _rename(limit: pd.Timedelta):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = [(p, pd.Timestamp(t)) for p, t in zip(*state.get, strict=True)] if state.exists else []
        for pdf in frames:
            found, waiting = _paired(key, pdf, waiting, limit)
            yield found
        if waiting:
            state.update(([p for p, _ in waiting], [t.value for _, t in waiting]))
        elif state.exists:
            state.remove()

    return run


def merging(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], parse: Callable[[DataFrame], DataFrame], report: Callable[[dict[str, int]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows of every path in the batch give way to what parse gives for paths still there.

    report gets the batch's counts: success (paths with rows), skipped (paths
    that parse gave no rows for), deleted.
    """

    def apply(batch: DataFrame, _: int) -> None:
        paths = batch.select(F.col("path").alias("source_file_path")).distinct()
        rows = parse(batch.filter(F.col("event") != "unlink"))
        if report is not None:
            rows = rows.persist()
            done = rows.select(F.col("source_file_path").alias("path")).distinct().withColumn("parsed", F.lit(True))
            last = batch.groupBy("path").agg(F.max_by("event", "ts").alias("event")).join(done, "path", "left")
            gone, parsed = F.col("event") == "unlink", F.coalesce("parsed", F.lit(False))
            counts = last.agg(F.count_if(~gone & parsed).alias("success"), F.count_if(~gone & ~parsed).alias("skipped"), F.count_if(gone).alias("deleted")).first()
            report(counts.asDict())
        write(merge_files(read(), paths, rows))
        if report is not None:
            rows.unpersist()

    return apply


def refreshing(refresh: Callable[[list[str]], None], most: int = 1000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink over changes of tables: refresh gets the distinct packages of the batch, once a batch; over most of them an empty list, for all."""

    def apply(batch: DataFrame, _: int) -> None:
        packages = [r["package"] for r in batch.select("package").distinct().limit(most + 1).collect()]
        if packages:
            refresh(sorted(packages) if len(packages) <= most else [])

    return apply
