"""Aggregates and tables over nodes: statistics, runs, rankings, timelines, comparisons, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rootline.frames import LineageFrames
from rootline.schema import PROVENANCE

#: Metric columns of a runs table, which become its schema.
MAX_METRICS = 20_000

#: Text of stored values that are JSON booleans, and so no numbers.
BOOLEANS = ("true", "false")


def stats(frames: LineageFrames) -> DataFrame:
    """One row: nodes, artifacts and their bytes, chunks, their plain and stored bytes, and how many
    times over the artifacts are stored (null without chunks)."""
    nodes = frames.node.agg(F.count("*").alias("nodes"))
    files = frames.artifact.agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("size"), F.lit(0)).alias("artifact_bytes"))
    chunks = frames.table("chunk").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("chunk_bytes"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("stored_bytes"))
    one = nodes.join(F.broadcast(files)).join(F.broadcast(chunks))
    return one.withColumn("dedup_ratio", F.when(F.col("stored_bytes") > 0, F.round(F.col("artifact_bytes") / F.col("stored_bytes"), 3)))


def metrics(frames: LineageFrames) -> DataFrame:
    """(node_id, key, num_value): searchable numbers that aren't booleans."""
    return frames.metadata.where(F.col("searchable") & F.col("num_value").isNotNull() & ~F.coalesce(F.col("value").isin(*BOOLEANS), F.lit(False))).select("node_id", "key", "num_value")


def metric_keys(frames: LineageFrames) -> DataFrame:
    """(key, runs): the metric keys and how many nodes have each."""
    return metrics(frames).groupBy("key").agg(F.count("*").alias("runs"))


def runs_table(frames: LineageFrames, keys: list[str] | None = None) -> DataFrame:
    """One row per node with a column for each metric key (all keys unless named)."""
    if keys is None:
        rows = metric_keys(frames).orderBy("key").limit(MAX_METRICS + 1).collect()
        if len(rows) > MAX_METRICS:
            raise ValueError(f"more than {MAX_METRICS} metrics; name those to show")
        keys = [r.key for r in rows]
    wide = metrics(frames).where(F.col("key").isin(keys)).groupBy("node_id").pivot("key", keys).agg(F.first("num_value"))
    return frames.node.select("node_id", "step_type", "generation", "healthy", "created_epoch_seconds", "duration_seconds").join(wide, "node_id", "left")


def sorted_runs(runs: DataFrame, by: str = "created_epoch_seconds", descending: bool = True) -> DataFrame:
    """Runs by a column; those without it come last either way."""
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return runs.orderBy(first, "node_id")


def metric_range(frames: LineageFrames, key: str, nodes: DataFrame | None = None) -> DataFrame:
    """One row: the least, middle and largest value of a metric among the nodes."""
    values = metrics(frames).where(F.col("key") == key)
    if nodes is not None:
        values = values.join(nodes.select("node_id"), "node_id", "left_semi")
    return values.agg(F.min("num_value").alias("low"), F.max("num_value").alias("high")).withColumn("mid", (F.col("low") + F.col("high")) / 2)


def normalise(frames: LineageFrames, key: str) -> DataFrame:
    """(node_id, num_value, share): where each value lies between the least (0) and the largest (1);
    0.5 where all are equal."""
    span = F.col("high") - F.col("low")
    share = F.when(span > 0, (F.col("num_value") - F.col("low")) / span).otherwise(F.lit(0.5))
    return metrics(frames).where(F.col("key") == key).join(F.broadcast(metric_range(frames, key))).select("node_id", "num_value", share.alias("share"))


def ranking(frames: LineageFrames, key: str, n: int = 5, best: bool = True) -> DataFrame:
    """(rank_no, node_id, num_value): the n largest (or least) values of a metric, ties by id."""
    order = F.desc("num_value") if best else F.asc("num_value")
    top = metrics(frames).where(F.col("key") == key).orderBy(order, "node_id").limit(n)
    return top.withColumn("rank_no", F.row_number().over(Window.orderBy(order, "node_id"))).select("rank_no", "node_id", "num_value")


def status_counts(frames: LineageFrames) -> DataFrame:
    """One row: all nodes, those that failed, and those run from a dirty working tree."""
    return frames.node.agg(F.count("*").alias("runs"), F.count_if(~F.col("healthy")).alias("failed"), F.count_if("prov_git_dirty").alias("dirty"))


def timeline(frames: LineageFrames, zone: str = "UTC") -> DataFrame:
    """(day, ok, failed) of each day of a zone with runs."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("created_epoch_seconds"), zone))
    return frames.node.where("created_epoch_seconds is not null").groupBy(day.alias("day")).agg(F.count_if("healthy").alias("ok"), F.count_if(~F.col("healthy")).alias("failed"))


def step_types(frames: LineageFrames) -> DataFrame:
    """(step_type, first_seen, runs) of each step type."""
    return frames.node.groupBy("step_type").agg(F.min("created_epoch_seconds").alias("first_seen"), F.count("*").alias("runs"))


def focus(frames: LineageFrames, day: str | None = None, healthy: bool | None = None, types: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """Nodes of a UTC day, a status, some step types and a search result, all where given."""
    nodes = frames.node
    if day is not None:
        nodes = nodes.where(F.to_date(F.timestamp_seconds("created_epoch_seconds")) == F.lit(day).cast("date"))
    if healthy is not None:
        nodes = nodes.where(F.col("healthy") == healthy)
    if types is not None:
        nodes = nodes.where(F.col("step_type").isin(types))
    return nodes if found is None else nodes.join(found.select("node_id"), "node_id", "left_semi")


#: What a comparison of two nodes shows beside their metadata, in this order.
COMPARED = ("step_type", "generation", "healthy", "duration_seconds", "size_bytes", "created_display")


def display_time(seconds: Column, zone: str = "UTC") -> Column:
    """A time since the epoch as a reader in a zone sees it."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "yyyy-MM-dd HH:mm:ss")


def diff(frames: LineageFrames, a: str, b: str, zone: str = "UTC") -> DataFrame:
    """(section, key, a, b, same, delta): two nodes compared, as text: what they are (section
    ``node``) and their metadata key by key; the difference of numbers, rounded to 6 places."""

    def side(node_id: str, name: str) -> DataFrame:
        number = F.when(~F.coalesce(F.col("value").isin(*BOOLEANS), F.lit(False)), F.col("num_value"))
        held = frames.metadata.where(F.col("node_id") == node_id).select(F.lit("metadata").alias("section"), "key", F.col("value").alias(name), number.alias(f"_{name}"))
        shown = {c: F.col(c) for c in COMPARED[:-1]} | {"created_display": display_time(F.col("created_epoch_seconds"), zone)}
        numeric = ("generation", "duration_seconds", "size_bytes")
        pairs = [F.struct(F.lit(c).alias("key"), v.cast("string").alias("value"), (v if c in numeric else F.lit(None)).cast("double").alias("number")) for c, v in shown.items()]
        own = frames.node.where(F.col("node_id") == node_id).select(F.explode(F.array(*pairs)).alias("x")).select(F.lit("node").alias("section"), "x.key", F.col("x.value").alias(name), F.col("x.number").alias(f"_{name}"))
        return own.unionByName(held)

    both = side(a, "a").join(side(b, "b"), ["section", "key"], "full_outer")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.col("a").eqNullSafe(F.col("b")))
    return both.select("section", "key", "a", "b", same.alias("same"), F.round(F.col("_b") - F.col("_a"), 6).alias("delta"))


def entries(frames: LineageFrames) -> DataFrame:
    """(node_id, section, name, value): everything known of each node as named texts: its own columns,
    provenance, metadata and artifacts.  An image or link that names an artifact of its node becomes
    a path to it."""
    own = ["step_type", "generation", "created_utc", "healthy", "duration_seconds", "size_bytes", "content_hash"]
    listed = [*[("Node", c, c) for c in own], *[("Provenance", c[5:], c) for c in PROVENANCE]]
    columns = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for s, n, c in listed]))
    structural = frames.node.select("node_id", columns.alias("x")).select("node_id", "x.section", "x.name", "x.value").where("value is not null")
    named = frames.metadata.withColumn("relpath", F.when(F.col("data_type").isin("image", "link"), F.get_json_object("value", "$")))
    files = frames.artifact.select("node_id", "relpath", F.lit(True).alias("held"))
    shown = named.join(files, ["node_id", "relpath"], "left")
    value = F.when(F.col("held"), F.concat_ws("/", "node_id", "relpath")).otherwise(F.col("value"))
    told = shown.select("node_id", F.coalesce("grp", F.lit("General")).alias("section"), F.col("key").alias("name"), value.alias("value"))
    held = frames.artifact.select("node_id", F.lit("Artifacts").alias("section"), F.col("relpath").alias("name"), F.col("size").cast("string").alias("value"))
    return structural.unionByName(told).unionByName(held)


def detail(frames: LineageFrames, node_id: str) -> DataFrame:
    """``entries`` of one node, section by section, provenance last."""
    one = LineageFrames(*[t.where(F.col("node_id") == node_id) if "node_id" in t.columns else t for t in (frames.node, frames.edge, frames.metadata, frames.artifact)])
    return entries(one).orderBy(F.col("section") == "Provenance", "section", "name")


def envelopes(frames: LineageFrames) -> DataFrame:
    """(node_id, entries): the metadata of each node as a map of structs; an empty one for none."""
    pair = F.struct("key", F.struct("value", "data_type", F.col("grp").alias("group"), "searchable").alias("entry"))
    held = frames.metadata.groupBy("node_id").agg(F.map_from_entries(F.collect_list(pair)).alias("entries"))
    empty = F.map_from_entries(F.filter(F.array(F.struct(F.lit("").alias("key"), F.struct(F.lit("").alias("value"), F.lit("").alias("data_type"), F.lit("").alias("group"), F.lit(True).alias("searchable")).alias("entry"))), lambda x: F.lit(False)))
    return frames.node.select("node_id").join(held, "node_id", "left").select("node_id", F.coalesce("entries", empty).alias("entries"))


def manifest(frames: LineageFrames) -> DataFrame:
    """(node_id, relpath, size, sha256, digests): artifacts with their ordered chunks, none for an
    empty file."""
    recipe = F.array_sort(F.collect_list(F.struct("ordinal", "digest")))
    held = frames.table("artifact_chunk").groupBy("node_id", "relpath").agg(F.transform(recipe, lambda x: x["digest"]).alias("digests"))
    return frames.artifact.join(held, ["node_id", "relpath"], "left").withColumn("digests", F.coalesce("digests", F.array().cast("array<string>")))


def duplicates(frames: LineageFrames) -> DataFrame:
    """(content_hash, first_node, runs): contents that several nodes share, with the oldest node."""
    first = F.min(F.struct("created_epoch_seconds", "node_id"))["node_id"]
    return frames.node.where("content_hash is not null").groupBy("content_hash").agg(first.alias("first_node"), F.count("*").alias("runs")).where("runs > 1")


def chunk_kinds(frames: LineageFrames) -> DataFrame:
    """(kind, chunks, stored_bytes) of the chunk pool."""
    return frames.table("chunk").groupBy("kind").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).alias("stored_bytes"))
