"""Commit activity as a stream: period axes, complete periods, last activity, duplicates and sessions.

stream(repo, commit_id, author, ts, is_fix, lines)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata.operators.clean import shared_folder
from strata.sources.ledger import KeyLedger

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def activity(events: DataFrame, author: Column | None = None) -> DataFrame:
    """The test tables' events as commit activity, by one of eight authors or by `author`."""
    return events.select(
        F.concat(F.lit("repo"), (F.col("user_id") % 4).cast("string")).alias("repo"),
        F.col("event_id").alias("commit_id"),
        (F.concat(F.lit("dev"), (F.col("user_id") % 8).cast("string")) if author is None else author).alias("author"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").alias("is_fix"),
        F.coalesce(F.col("value"), F.lit(0.0)).cast("long").alias("lines"),
    )


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of sf_dir as a stream. All files there are make one batch: files come by modification time, and a second
    batch would drop what is older than the first one's watermark; timed_activity() deals them by event time instead."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return activity(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*"))


def deal_by_time(events: DataFrame, folder: str, batches: int, at: str = "ts") -> None:
    """Writes events as files that a stream reads in order of event time: `batches` ranges of it, one after the other,
    so that no range starts before the last one ends and none is late. Each range is a job of its own tasks."""
    cuts = events.select(F.percentile_approx(F.unix_micros(F.col(at).cast("timestamp")), [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = [None, *sorted(set(cuts or ())), None]
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = events
        part = part.where(micros >= low) if low is not None else part
        part = part.where(micros < high) if high is not None else part
        part.write.mode("append").parquet(f"{folder}/range={k:06}")


def timed_activity(spark: SparkSession, sf_dir: str, batches: int = 4, author: Column | None = None) -> DataFrame:
    """events of sf_dir as a stream of several batches in order of event time, dealt in the shared folder. Runs jobs."""
    events, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), f"{shared_folder(spark)}/events"
    deal_by_time(events, folder, batches)
    files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return activity(files.parquet(folder), author)


def period_axes(stream: DataFrame, span: str = "7 days", delay: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """Lines, commits and fixes for each author and tumbling period; works on batches and streams alike."""
    rows = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    out = rows.groupBy(F.window("ts", span), *by, "author").agg(F.sum("lines").alias("production"), F.count("*").alias("commits"), F.count_if("is_fix").alias("fixes"))
    return out.select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), *by, "author", "production", "commits", (100 - F.col("fixes") / F.col("commits") * 100).alias("quality"))


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """A commit seen on several refs counts once."""
    if stream.isStreaming:
        return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["repo", "commit_id"])
    return stream.dropDuplicates(["repo", "commit_id"])


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    rows = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window("ts", gap), "author").agg(F.count("*").alias("commits"))
    return out.select("author", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "commits")


def write_complete_periods(axes: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("period_start",)):
    """Writes each period (by keys: the period, and what else is completed by itself, such as a domain) once, when the
    watermark has passed its end, into the ledger at path; a batch that runs again, or a run with a fresh checkpoint,
    adds nothing that is there. Returns the started query; KeyLedger(spark, path, keys).read() gives the rows."""
    ledger = KeyLedger(axes.sparkSession, path, keys)

    def batch(df: DataFrame, epoch: int) -> None:
        ledger.add(df)

    return axes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


class LastSeen(StatefulProcessor):
    """The latest activity of an author; inactive once event time has passed it by the timeout."""

    def __init__(self, active_days: float):
        self.timeout = int(active_days * 86400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ms = max(r["ts"].max().value // 1_000_000 for r in rows)
        if self.last.exists():
            ms = max(ms, self.last.get()[0])
        self.last.update((ms,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms + self.timeout)
        yield pd.DataFrame({"author": [key[0]], "last_ms": [ms], "active": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"author": [key[0]], "last_ms": [self.last.get()[0]], "active": [False]})

    def close(self) -> None:
        pass


def last_seen(stream: DataFrame, active_days: float = 30.0, delay: str = "1 day") -> DataFrame:
    """(author, last_ms, active): updates of each author's last activity, and one row when it grows too old.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as all stateful processors do."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy("author")
        .transformWithStateInPandas(LastSeen(active_days), "author string, last_ms long, active boolean", "Update", "EventTime")
    )


def latest_seen(spark: SparkSession, stream: DataFrame, active_days: float, delay: str = "1 day") -> DataFrame:
    """(author, last_ms, active) at the end of a stream, drained over the RocksDB state store: an author's last update,
    which for equal times is that of its timer."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        updates = drain(last_seen(stream, active_days, delay), "update", "last-seen")
    finally:
        spark.conf.set(provider, before)
    last = updates.groupBy("author").agg(F.max(F.struct("last_ms", (~F.col("active")).alias("gone"))).alias("x"))
    return last.select("author", "x.last_ms", (~F.col("x.gone")).alias("active"))


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what there is and returns its result as a table in the shared folder (for tests and queries)."""
    spark, at = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{at}/rows")
    else:  # a batch that runs again writes its rows anew
        writer = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/rows/epoch={epoch}"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", str(mode != "append").lower()).parquet(f"{at}/rows")
