"""The rules of a pipeline, checked in bulk: which step may follow which, and generations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootline.frames import LineageFrames
from rootline.operators import graph
from rootline.operators.graph import TASK_EDGES
from rootline.session import materialize


def policy(frames: LineageFrames) -> dict:
    """The policy of a store: rules, gen_triggers, reuse_identical, delta."""
    row = frames.table("config").where("key = 'policy'").select("value").first()
    return json.loads(row.value) if row else {}


def violations(frames: LineageFrames, rules: dict[str, list[str | None]]) -> DataFrame:
    """(node_id, step_type, parent_id, parent_type): transitions that the rules don't allow.

    A step that the rules don't name may follow anything.  A root has the parent type null, which a
    named step needs in its list to be a root.
    """
    flat = [(step, parent) for step, allowed in rules.items() for parent in allowed]
    named = frames.spark.createDataFrame([(s,) for s in rules], "step_type string")
    allowed = frames.spark.createDataFrame(flat, "step_type string, parent_type string").withColumn("ok", F.lit(True))
    ruled = frames.node.select("node_id", "step_type").join(F.broadcast(named), "step_type")
    types = frames.node.select(F.col("node_id").alias("parent_id"), F.col("step_type").alias("parent_type"))
    used = frames.edge.select(F.col("child_id").alias("node_id"), "parent_id").join(types, "parent_id")
    pairs = ruled.join(used, "node_id", "left")
    broken = pairs.join(F.broadcast(allowed), (pairs.step_type == allowed.step_type) & pairs.parent_type.eqNullSafe(allowed.parent_type), "left").where("ok is null")
    return broken.select("node_id", pairs.step_type, "parent_id", pairs.parent_type)


def generations(frames: LineageFrames, triggers: list[str], task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, generation, recorded): the generation of each node by rule, beside the recorded one.

    A root has 0; other nodes the largest of their parents, one more if their step is a trigger.  Nodes
    on or below a cycle have none.  Generations settle in the order of levels: along longest paths of
    trigger steps, which one task folds for small graphs and joins fold level by level for large ones.
    """
    known = frames.node.select("node_id", "step_type", "generation")
    edges = materialize(
        frames.edge.join(known.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").join(known.select(F.col("node_id").alias("child_id"), F.col("step_type").isin(triggers).alias("bump")), "child_id").select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"), F.coalesce("bump", F.lit(False)).alias("bump")),
        "edges",
    )
    if edges.count() + known.count() <= task_edges:
        plus = edges.select("a", F.when(F.col("bump"), F.concat(F.lit("+"), F.col("b"))).otherwise(F.concat(F.lit("="), F.col("b"))).alias("b"))
        every = plus.union(known.select(F.lit(None).cast("string"), F.concat(F.lit("="), F.col("node_id"))))

        def fold(a: list, b: list):
            from collections import defaultdict, deque

            out, waiting, value = defaultdict(list), defaultdict(int), {}
            for x, y in zip(a, b, strict=True):
                value.setdefault(y[1:], 0)
                if x is not None:
                    out[x].append((y[1:], y[0] == "+"))
                    waiting[y[1:]] += 1
            queue = deque(n for n in value if not waiting[n])
            done = set()
            while queue:
                at = queue.popleft()
                done.add(at)
                for y, bump in out[at]:
                    value[y] = max(value[y], value[at] + bump)
                    waiting[y] -= 1
                    if not waiting[y]:
                        queue.append(y)
            for n in done:
                yield n, value[n]

        found = graph._in_one_task(every, fold, "node string, value int")
    else:
        order = materialize(graph.levels(known.select(F.col("node_id").alias("node")), edges, task_edges).where("settled"), "order")
        found = materialize(order.where("level = 0").select("node", F.lit(0).alias("value")), "value")
        for level in range(1, (order.agg(F.max("level")).first()[0] or 0) + 1):
            here = order.where(F.col("level") == level).select(F.col("node").alias("b"))
            step = edges.join(here, "b", "left_semi").join(found.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max(F.col("value") + F.col("bump").cast("int")).alias("value"))
            found = materialize(found.union(step), "value")
    return known.join(found.select(F.col("node").alias("node_id"), F.col("value").alias("_value")), "node_id", "left").select("node_id", F.col("_value").alias("generation"), F.col("generation").alias("recorded"))


def dangling(frames: LineageFrames) -> DataFrame:
    """(table_name, node_id): ids that rows of other tables refer to and no node has."""
    known = frames.node.select("node_id")
    parts = [frames.edge.select(F.lit("edge").alias("table_name"), F.col(c).alias("node_id")) for c in ("child_id", "parent_id")]
    parts += [frames.table(t).select(F.lit(t).alias("table_name"), "node_id") for t in ("metadata", "artifact")]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.distinct().join(known, "node_id", "left_anti").select("table_name", "node_id")


def size_mismatch(frames: LineageFrames) -> DataFrame:
    """(node_id, size_bytes, artifact_bytes): nodes whose size isn't the sum of their artifacts."""
    sums = frames.artifact.groupBy("node_id").agg(F.sum("size").alias("artifact_bytes"))
    both = frames.node.select("node_id", "size_bytes").join(sums, "node_id", "left").withColumn("artifact_bytes", F.coalesce("artifact_bytes", F.lit(0)))
    return both.where(~F.col("size_bytes").eqNullSafe(F.col("artifact_bytes")))
