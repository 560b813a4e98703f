"""Streams over the events table, run over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootline.session import prepare, stage_path, table
from rootline.streaming import live

QUERIES = {}
ORACLES = {}


def stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily timeline kept by a stream, over the nodes in order of arrival."""
    prepare(spark)
    source = stage_path(spark, "nodes")
    nodes = table(spark, sf_dir, "node").select("created_epoch_seconds", "healthy").where("created_epoch_seconds is not null and not isnan(created_epoch_seconds)")
    nodes.write.parquet(source)
    stream = live.timeline(live.read(spark, source, nodes.schema), "10000 days")
    return live.drain(stream, f"t{uuid.uuid4().hex[:8]}", "complete", stage_path(spark, "stream")).select("day", F.col("ok"), F.col("failed"))


QUERIES["stream_timeline"] = stream_timeline
ORACLES["stream_timeline"] = "select cast(to_timestamp(created_epoch_seconds) at time zone 'UTC' as date) as day, count(*) filter (healthy) as ok, count(*) filter (not healthy) as failed from node where created_epoch_seconds is not null and not isnan(created_epoch_seconds) group by 1"
