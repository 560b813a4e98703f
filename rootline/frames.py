"""The tables of a lineage store as DataFrames; every query operator takes a ``LineageFrames``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootline.functions.labels import label, strip
from rootline.schema import DDL
from rootline.session import prepare, table


@dataclass
class LineageFrames:
    """Node, edge, metadata and artifact tables, clean and without duplicate keys."""

    node: DataFrame
    edge: DataFrame
    metadata: DataFrame
    artifact: DataFrame
    other: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.node.sparkSession

    def table(self, name: str) -> DataFrame:
        """Any of the eight tables; those that weren't given are empty."""
        if name in ("node", "edge", "metadata", "artifact"):
            return getattr(self, name)
        return self.other[name] if name in self.other else self.spark.createDataFrame([], DDL[name])


def _number(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))


def clean(node: DataFrame, edge: DataFrame, metadata: DataFrame, artifact: DataFrame) -> LineageFrames:
    """Frames from tables as they arrive.

    Ids and labels are brought to one spelling, rows that agree on their key become one (the largest
    of each column, which for repeated rows is the row itself), NaN becomes null, paths get forward
    slashes and hashes lower case.  Rows without a key are left out.
    """
    texts = ["created_utc", "content_hash", "prov_user", "prov_python", "prov_platform", "prov_git_commit", "prov_git_branch"]
    nodes = (
        node.select(label(F.col("node_id")).alias("node_id"), label(F.col("step_type")).alias("step_type"), "generation", _number("created_epoch_seconds").alias("created_epoch_seconds"), "healthy", _number("duration_seconds").alias("duration_seconds"), "size_bytes", "prov_git_dirty", *texts)
        .where("node_id is not null")
        .groupBy("node_id")
        .agg(*[F.max(c).alias(c) for c in DDL["node"].replace(",", " ").split()[2::2]])
    )
    edges = (
        edge.select(label(F.col("child_id")).alias("child_id"), label(F.col("parent_id")).alias("parent_id"), "ordinal")
        .where("child_id is not null and parent_id is not null")
        .groupBy("child_id", "parent_id")
        .agg(F.min("ordinal").alias("ordinal"))
    )
    values = (
        metadata.select(label(F.col("node_id")).alias("node_id"), label(F.col("key")).alias("key"), "value", "data_type", "grp", "searchable", _number("num_value").alias("num_value"))
        .where("node_id is not null and key is not null")
        .groupBy("node_id", "key")
        .agg(*[F.max(c).alias(c) for c in ("value", "data_type", "grp", "searchable", "num_value")])
    )
    files = (
        artifact.select(label(F.col("node_id")).alias("node_id"), F.replace(strip(F.col("relpath")), F.lit("\\"), F.lit("/")).alias("relpath"), "size", F.lower(strip(F.col("sha256"))).alias("sha256"))
        .where("node_id is not null and relpath is not null")
        .groupBy("node_id", "relpath")
        .agg(F.max("size").alias("size"), F.max("sha256").alias("sha256"))
    )
    return LineageFrames(nodes, edges, values, files)


def load(spark: SparkSession, sf_dir: str) -> LineageFrames:
    """The clean frames of a data folder."""
    prepare(spark)
    frames = clean(*[table(spark, sf_dir, t) for t in ("node", "edge", "metadata", "artifact")])
    frames.other["config"] = table(spark, sf_dir, "config")
    return frames
