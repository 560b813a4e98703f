"""Structured Streaming over arriving nodes and events.

These go beyond a store's own questions: a timeline that follows late rows up to a watermark, the first
node of each content, and blocks that were opened and never finished.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timeline(nodes: DataFrame, late: str = "3 days") -> DataFrame:
    """(day, ok, failed) per UTC day; rows later than ``late`` are dropped by the watermark."""
    at = F.timestamp_seconds(F.col("created_epoch_seconds"))
    timed = nodes.withColumn("at", at).withWatermark("at", late)
    windows = timed.groupBy(F.window("at", "1 day")).agg(F.count_if("healthy").alias("ok"), F.count_if(~F.col("healthy")).alias("failed"))
    return windows.select(F.col("window.start").cast("date").alias("day"), "ok", "failed")


def first_of_content(nodes: DataFrame, within: str = "7 days") -> DataFrame:
    """The first node of each content hash; state is kept for ``within``."""
    timed = nodes.withColumn("at", F.timestamp_seconds(F.col("created_epoch_seconds"))).withWatermark("at", within)
    return timed.where("content_hash is not null").dropDuplicatesWithinWatermark(["content_hash"]).drop("at")


def abandoned(events: DataFrame, after_seconds: int = 300) -> DataFrame:
    """(node_id, opened): blocks with an ``open`` event and no ``close`` within ``after_seconds``, from
    events (node_id, kind, at)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (opened,) = state.get
            state.remove()
            yield pd.DataFrame({"node_id": [key[0]], "opened": [pd.Timestamp(opened, unit="ms")]})
            return
        for batch in batches:
            for kind, at in zip(batch["kind"], batch["at"], strict=True):
                if kind == "close":
                    if state.exists:
                        state.remove()
                elif kind == "open":
                    state.update((int(at.timestamp() * 1000),))
        if state.exists:
            (opened,) = state.get
            state.setTimeoutTimestamp(max(opened + after_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("at", "0 seconds")
    return timed.groupBy("node_id").applyInPandasWithState(step, "node_id string, opened timestamp", "opened long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and give its rows as a table; for tests and backfills."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
