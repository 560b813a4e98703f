"""Questions about the graph of nodes: closures, order, levels, what a deletion takes along.

Edges of up to ``TASK_EDGES`` are walked in one task, which costs one job whatever the depth; larger
graphs are walked by frontiers, one join per level, each level written to the shared folder.  Both
give the same rows.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootline.frames import LineageFrames
from rootline.operators.find import ORDER
from rootline.schema import IntegrityError
from rootline.session import materialize, release

#: Edges, and nodes or seeds beside them, that one task walks (some 100 bytes each).
TASK_EDGES = 1_000_000


def children(frames: LineageFrames, node_id: str) -> DataFrame:
    """The direct children of a node."""
    return frames.node.join(frames.edge.where(F.col("parent_id") == node_id).select(F.col("child_id").alias("node_id")), "node_id", "left_semi")


def _pairs(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], list[str]]:
    held = [b for b in batches if b.num_rows]
    return [x for b in held for x in b.column(0).to_pylist()], [x for b in held for x in b.column(1).to_pylist()]


def _in_one_task(edges: DataFrame, work, schema: str) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    out = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(work(*_pairs(batches)))
        for i in range(0, len(rows), 50_000):
            part = zip(*rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, out, strict=True)], schema=out)

    return edges.coalesce(1).mapInArrow(run, schema)


def closure(edges: DataFrame, seeds: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, distance): the nodes reached over edges (a, b) from a to b, from seeds (node), by their
    least distance; a seed is at 0.  Cycles end where they close."""
    edges, seeds = materialize(edges.select("a", "b"), "edges"), materialize(seeds.select("node").distinct(), "seeds")
    if edges.count() + seeds.count() <= task_edges:
        marked = edges.union(seeds.select(F.lit(None).cast("string"), F.col("node")))

        def walk(a: list, b: list) -> Iterator[tuple[str, int]]:
            out = defaultdict(list)
            queue = deque()
            for x, y in zip(a, b, strict=True):
                if x is None:
                    queue.append((y, 0))
                else:
                    out[x].append(y)
            seen = set()
            while queue:
                at, far = queue.popleft()
                if at in seen:
                    continue
                seen.add(at)
                yield at, far
                queue.extend((y, far + 1) for y in out[at] if y not in seen)

        return _in_one_task(marked, walk, "node string, distance int")
    reached = materialize(seeds.withColumn("distance", F.lit(0)), "reached")
    front, step = reached, 0
    while not front.isEmpty():
        step += 1
        found = edges.join(front.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        front = materialize(found.join(reached, "node", "left_anti").withColumn("distance", F.lit(step)), "front")
        old, reached = reached, materialize(reached.union(front), "reached")
        release(old)
    return reached


def _up(frames: LineageFrames) -> DataFrame:
    return frames.edge.select(F.col("child_id").alias("a"), F.col("parent_id").alias("b"))


def _down(frames: LineageFrames) -> DataFrame:
    return frames.edge.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"))


def _seed(frames: LineageFrames, node_id: str) -> DataFrame:
    return frames.spark.createDataFrame([(node_id,)], "node string")


def ancestors(frames: LineageFrames, node_id: str) -> DataFrame:
    """(node, distance) of a node and all above it."""
    return closure(_up(frames), _seed(frames, node_id))


def descendants(frames: LineageFrames, node_id: str) -> DataFrame:
    """(node, distance) of a node and all below it."""
    return closure(_down(frames), _seed(frames, node_id))


def related(frames: LineageFrames, node_id: str) -> DataFrame:
    """(node): a node, all above and all below it; siblings aren't related."""
    return ancestors(frames, node_id).select("node").union(descendants(frames, node_id).select("node")).distinct()


def parents_first(parents: dict[str, list[str]], node_id: str) -> list[str]:
    """A node and all above it, each after all its parents, the last parent's line first; a cycle
    raises ``IntegrityError``."""
    placed: dict[str, None] = {}  # in order
    trail: dict[str, Iterator[str]] = {node_id: reversed(parents.get(node_id, []))}  # from the node upwards, with the parents still to see
    while trail:
        at = next(reversed(trail))
        above_at = next((p for p in trail[at] if p not in placed), None)
        if above_at is None:
            trail.pop(at)
            placed[at] = None
        elif above_at in trail:
            raise IntegrityError(f"a cycle leads through {above_at}")
        else:
            trail[above_at] = reversed(parents.get(above_at, []))
    return list(placed)


def lineage_order(frames: LineageFrames, node_id: str, most: int = TASK_EDGES) -> list[str]:
    """A node and all above it, each after all its parents, the last parent's line first.

    The order is a walk of the edges above one node, which come to the driver, at most ``most``.
    A cycle raises ``IntegrityError``.
    """
    above = ancestors(frames, node_id).select(F.col("node").alias("child_id"))
    rows = frames.edge.join(above, "child_id", "left_semi").orderBy("child_id", "ordinal", "parent_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges above {node_id}")
    parents = defaultdict(list)
    for r in rows:
        parents[r.child_id].append(r.parent_id)
    return parents_first(parents, node_id)


def levels(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, level, settled): the longest path from a root, roots at 0, over edges (a, b) from parent
    to child.  Nodes on a cycle or below one aren't settled: their level counts only the paths that
    come from roots past settled nodes."""
    edges, nodes = materialize(edges.select("a", "b"), "edges"), materialize(nodes.select("node").distinct(), "nodes")
    loops = None
    if edges.count() + nodes.count() <= task_edges:

        def work(a: list, b: list) -> Iterator[tuple[str, int, bool]]:
            out, waiting, level = defaultdict(list), defaultdict(int), {}
            for x, y in zip(a, b, strict=True):
                level.setdefault(y, 0)
                if x is not None:
                    level.setdefault(x, 0)
                    out[x].append(y)
                    waiting[y] += 1
            queue = deque(n for n in level if not waiting[n])
            settled = set()
            while queue:
                at = queue.popleft()
                settled.add(at)
                for y in out[at]:
                    level[y] = max(level[y], level[at] + 1)
                    waiting[y] -= 1
                    if not waiting[y]:
                        queue.append(y)
            for n, v in level.items():
                yield n, v, n in settled

        return _in_one_task(edges.union(nodes.select(F.lit(None).cast("string"), F.col("node"))), work, "node string, level int, settled boolean")
    every = materialize(nodes.union(edges.select("a")).union(edges.select("b")).where("node is not null").distinct(), "nodes")
    waiting = materialize(every.join(edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("left")), "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).alias("level")), "waiting")
    done = None
    while True:
        ready = materialize(waiting.where("left = 0").select("node", "level"), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        sent = edges.join(ready.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("_n"), (F.max("level") + 1).alias("_level"))
        rest = waiting.where("left > 0").join(sent, "node", "left")
        waiting = materialize(rest.select("node", (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left"), F.greatest("level", F.coalesce("_level", F.lit(0))).alias("level")), "waiting")
    loops = waiting.select("node", "level", F.lit(False).alias("settled"))
    return loops if done is None else done.withColumn("settled", F.lit(True)).union(loops)


def node_levels(frames: LineageFrames) -> DataFrame:
    """``levels`` of all nodes, over edges whose ends both exist."""
    known = frames.node.select("node_id")
    inner = frames.edge.join(known.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi").join(known.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi")
    return levels(known.withColumnRenamed("node_id", "node"), inner.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")))


def _doomed(target: str, a: list[str | None], b: list[str]) -> Iterator[tuple[str, int]]:
    known = {y for x, y in zip(a, b, strict=True) if x is None}
    if target not in known:
        return
    below, parents = defaultdict(list), defaultdict(set)
    for x, y in zip(a, b, strict=True):
        if x is not None and y in known:
            below[x].append(y)
            parents[y].add(x)
    region, queue = {target}, deque([target])
    while queue:
        for y in below[queue.popleft()]:
            if y not in region:
                region.add(y)
                queue.append(y)
    if parents[target] & region:
        return
    waiting = {n: len(parents[n] & region) for n in region}
    level, queue = {target: 0}, deque([target])
    while queue:
        at = queue.popleft()
        for y in below[at]:
            waiting[y] -= 1
            if not waiting[y]:
                if parents[y] <= level.keys():
                    level[y] = 1 + max(level[p] for p in parents[y])
                queue.append(y)
    yield from level.items()


def prune_plan(frames: LineageFrames, node_id: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, level): the nodes that go when a node goes, and their level below it: itself and every
    descendant all of whose parents go.  Deleting by level, the deepest first, never leaves a child
    behind.

    A node that doesn't exist, or lies on a cycle, goes with nothing (an empty plan).  Rows of edges
    whose child doesn't exist don't count; a parent that doesn't exist never goes, so its children
    stay.  Nodes on and below a cycle stay.
    """
    known = materialize(frames.node.select(F.col("node_id").alias("node")).distinct(), "nodes")
    every = materialize(_down(frames), "edges")
    if every.count() + known.count() <= task_edges:
        return _in_one_task(every.union(known.select(F.lit(None).cast("string"), "node")), lambda a, b: _doomed(node_id, a, b), "node string, level int")
    edges = materialize(every.join(known.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"), "edges")
    target = known.where(F.col("node") == node_id)
    region = materialize(closure(edges, target, task_edges).select("node"), "region")
    inner = materialize(edges.join(region.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"), "edges")
    within = inner.join(region.withColumnRenamed("node", "a"), "a", "left_semi")
    if not within.where(F.col("b") == node_id).isEmpty():
        return region.select("node", F.lit(0).alias("level")).limit(0)
    doomed, size = region, region.count()
    while True:
        kept = inner.where(F.col("b") != node_id).join(doomed.withColumnRenamed("node", "a"), "a", "left_anti").select(F.col("b").alias("node")).distinct()
        doomed = materialize(doomed.join(kept, "node", "left_anti"), "doomed")
        before, size = size, doomed.count()
        if size == before:
            break
    left = inner.join(doomed.withColumnRenamed("node", "a"), "a", "left_semi").join(doomed.withColumnRenamed("node", "b"), "b", "left_semi").where(F.col("b") != node_id)
    return levels(doomed, left, task_edges).where("settled").select("node", "level")


def edge_list(frames: LineageFrames) -> DataFrame:
    """(from, to, ordinal): one row per parent of each existing node, with the child's time."""
    return frames.edge.join(frames.node.select(F.col("node_id").alias("child_id"), "created_epoch_seconds"), "child_id").select(F.col("parent_id").alias("from"), F.col("child_id").alias("to"), "ordinal", "created_epoch_seconds")


def skeleton(frames: LineageFrames) -> DataFrame:
    """(node_id, label, step_type, healthy, level) of each node for drawing."""
    level = node_levels(frames).select(F.col("node").alias("node_id"), "level")
    return frames.node.join(level, "node_id").select("node_id", F.concat_ws("\n", "step_type", "node_id").alias("label"), "step_type", "healthy", "level", *ORDER[:1])


def focus_edges(frames: LineageFrames, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are among the nodes."""
    ids = nodes.select("node_id")
    return frames.edge.join(ids.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi").join(ids.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi")
