"""Change feeds (path, kind, event_ts): the same functions serve batch and streaming frames, with a trigger for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.store import numbered

KINDS = ("create", "modify", "remove")


def relevant(changes: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Without kinds that aren't changes: those named in ``drop``, or else all but create, modify and remove."""
    return changes.where(~F.col("kind").isin(drop)) if drop else changes.where(F.col("kind").isin(*KINDS))


def changed_paths(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.count(F.lit(1)).alias("changes"), F.max("event_ts").alias("last_ts"))


def classify(changes: DataFrame, present: DataFrame) -> DataFrame:
    """Each changed path with ``present`` or ``deleted``, by what is there now."""
    there = present.select("path").distinct().withColumn("there", F.lit(True))
    return changes.select("path").distinct().join(there, "path", "left").select("path", F.when(F.col("there"), "present").otherwise("deleted").alias("state"))


def batches(changes: DataFrame, size: int) -> DataFrame:
    """(path, batch): paths in the order of their first change, ``size`` to a batch; a burst of changes is dealt to many tasks."""
    first = changes.groupBy("path").agg(F.min("event_ts").alias("first_ts"))
    return numbered(first, "first_ts", "path").select("path", F.call_function("div", F.col("place"), F.lit(size).cast("long")).alias("batch"))


def windowed(changes: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Extension: changes and distinct paths in event-time windows."""
    w = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    distinct = F.approx_count_distinct("path") if changes.isStreaming else F.countDistinct("path")
    return changes.groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("changes"), distinct.alias("paths")).select(F.col("w.start").alias("start"), "kind", "changes", "paths")


def sessions(changes: DataFrame, gap: str) -> DataFrame:
    """Extension: a path's changes with less than ``gap`` between them are one session."""
    return changes.groupBy(F.session_window("event_ts", gap).alias("w"), "path").agg(F.count(F.lit(1)).alias("changes")).select("path", F.col("w.start").alias("start"), "changes")


def source(spark: SparkSession, path: str, schema: str = "path string, kind string, event_ts timestamp", files_per_trigger: int = 100) -> DataFrame:
    """A stream of change records from Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_changes(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A path's first change in each span of ``late``; state is dropped behind the watermark."""
    return stream.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["path"])


def triggered(stream: DataFrame, size: int = 5, idle_ms: int = 300_000, lanes: int = 64) -> DataFrame:
    """(lane, paths, reason): a lane's distinct paths are handed on once there are ``size``, or ``idle_ms`` after the first.

    Paths are dealt to lanes by hash, so state and work are spread; state is in the checkpoint and survives failures.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"lane": [key[0]], "paths": [held], "reason": ["idle"]})
            return
        for part in rows:
            held = list(dict.fromkeys(held + part["path"].tolist()))
        if len(held) >= size:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"lane": [key[0]], "paths": [held], "reason": ["count"]})
        else:
            state.update((held,))
            state.setTimeoutDuration(idle_ms)

    lane = F.pmod(F.xxhash64("path"), F.lit(lanes)).cast("int")
    return stream.select(lane.alias("lane"), F.col("path").cast("string").alias("path")).groupBy("lane").applyInPandasWithState(step, "lane int, paths array<string>, reason string", "paths array<string>", "append", "ProcessingTimeTimeout")


def run_batches(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 5, once: bool = False):
    """Hands each micro-batch to ``commit(frame, number)``, which must be idempotent by number; a failed batch comes again."""
    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
