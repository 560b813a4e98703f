"""Parent-child rows into full hierarchies: roots, depths, paths, descendants and cycles.

The core is a weighted disjoint-set forest over links (node, parent, weight), where each node has at
most one link.  Every partition first unites its own links: a node then points at the topmost node
that its partition knows, with its offset from there.  Only the links of nodes at which other
partitions stop go on to the next level, which unites them again in fewer partitions, until the rest
fits one bounded task; results flow back down level by level.  A node that never meets a top leads
to a cycle.

Nodes with several parents take part in cycles along any of them.  ``cycle_nodes`` contracts every
chain of single-parent nodes into one weighted link by the forest above, which leaves only nodes
with several parents, and repeats on those; what a contraction can't shrink any more is solved by
Tarjan's algorithm in one task while it is small, else by colouring.

Defined results: null or blank ids make no edge; repeated edges, whatever their spelling, are one
edge, the lowest ordinal counting; a null ordinal sorts last; an edge of a node to itself is a
cycle; ids that only occur as parents are nodes; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootline.functions.labels import label
from rootline.session import materialize, release

#: Links that one task unites at the last level (some 100 bytes each).
TASK_LINKS = 500_000

UNITED = "node string, top string, offset long, looped boolean, on_cycle boolean"


def edges(edge: DataFrame, child: str = "child_id", parent: str = "parent_id", ordinal: str | None = "ordinal") -> DataFrame:
    """(child, parent, ordinal): the distinct edges, each with its lowest ordinal."""
    rank = F.col(ordinal).cast("int") if ordinal else F.lit(0)
    named = edge.select(label(F.col(child)).alias("child"), label(F.col(parent)).alias("parent"), F.coalesce(rank, F.lit(2**31 - 1)).alias("ordinal"))
    return named.where("child is not null and parent is not null").groupBy("child", "parent").agg(F.min("ordinal").alias("ordinal"))


def first_links(edges: DataFrame) -> DataFrame:
    """(node, parent, weight): the edge of each node to its first parent, ties by id."""
    first = F.min(F.struct("ordinal", "parent"))["parent"]
    return edges.groupBy(F.col("child").alias("node")).agg(first.alias("parent")).withColumn("weight", F.lit(1).cast("long"))


def unite(nodes: np.ndarray, parents: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    """A disjoint-set forest over links, by pointer doubling: for each node its top and offset.

    ``looped`` nodes have no top: they lie on a cycle (``on_cycle``) or lead to one.
    """
    codes, names = pd.factorize(np.concatenate([nodes, parents]))
    n, size = len(nodes), len(names)
    up, off = np.arange(size), np.zeros(size, dtype=np.int64)
    linked = np.zeros(size, dtype=bool)
    up[codes[:n]], off[codes[:n]], linked[codes[:n]] = codes[n:], weights, True
    for _ in range(max(1, int(size).bit_length())):
        off = off + off[up]
        up = up[up]
    looped = linked[up]
    on_cycle = np.zeros(size, dtype=bool)
    on_cycle[up[looped]] = True  # after as many steps as there are nodes, all that loop are on their cycle
    at = codes[:n]
    # top of a looped node: the least code on its cycle isn't needed, its landing point is as good
    return pd.DataFrame({"node": nodes, "top": names[up[at]], "offset": np.where(looped[at], 0, off[at]), "looped": looped[at], "on_cycle": on_cycle[at]})


def _unite_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = pa.Table.from_batches(list(batches))
    out = unite(held["node"].to_numpy(), held["parent"].to_numpy(), held["weight"].to_numpy())
    yield from pa.Table.from_pandas(out, preserve_index=False).to_batches(max_chunksize=50_000)


def _skip_empty(work):
    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if kept:
            yield from work(iter(kept))

    return run


def _united(links: DataFrame) -> DataFrame:
    return links.select("node", "parent", "weight").mapInArrow(_skip_empty(_unite_partition), UNITED)


def resolve(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root, depth, looped): where the links (node, parent, weight) of each node end.

    ``node`` is unique.  A looped node, whose links end in a cycle, has neither root nor depth.
    """
    local = materialize(_united(links), "united")
    tops = local.where("not looped").select(F.col("top").alias("node")).distinct()
    boundary = local.join(tops, "node", "left_semi").select("node", F.when(F.col("looped"), F.col("node")).otherwise(F.col("top")).alias("parent"), F.col("offset").alias("weight"))
    boundary = materialize(boundary, "boundary")
    count = boundary.count()
    if count == 0:
        return local.select("node", F.when(~F.col("looped"), F.col("top")).alias("root"), F.when(~F.col("looped"), F.col("offset")).alias("depth"), "looped")
    if count <= task_links:
        upper = _united(boundary.coalesce(1)).select("node", F.when(~F.col("looped"), F.col("top")).alias("root"), F.when(~F.col("looped"), F.col("offset")).alias("depth"), "looped")
    else:
        # halve every boundary path once, so that each level shrinks whatever the partitions hold
        nxt = boundary.select(F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("weight").alias("_w"))
        halved = boundary.join(nxt, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), (F.col("weight") + F.coalesce("_w", F.lit(0))).alias("weight"))
        upper = resolve(halved.repartitionByRange(max(1, -(-count // task_links)), "node"), task_links)
    upper = upper.select(F.col("node").alias("top"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("looped").alias("_looped"))
    joined = local.join(upper, "top", "left")
    looped = F.col("looped") | F.coalesce("_looped", F.lit(False))
    return joined.select("node", F.when(~looped, F.coalesce("_root", "top")).alias("root"), F.when(~looped, F.col("offset") + F.coalesce("_depth", F.lit(0))).alias("depth"), looped.alias("looped"))


def _tarjan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strongly connected components with a cycle, of all edges (node, parent) of one task."""
    held = pa.Table.from_batches(list(batches))
    codes, names = pd.factorize(np.concatenate([held["node"].to_numpy(), held["parent"].to_numpy()]))
    n = held.num_rows
    order = np.argsort(codes[:n], kind="stable")
    heads, tails = codes[:n][order], codes[n:][order]
    start = np.searchsorted(heads, np.arange(len(names) + 1))
    index, low, component = np.full(len(names), -1), np.zeros(len(names), dtype=np.int64), np.full(len(names), -1)
    position = start[:-1].copy()
    selfish = set(heads[heads == tails].tolist())
    stack, on_stack, found, clock = [], np.zeros(len(names), dtype=bool), [], 0
    for source in range(len(names)):
        if index[source] >= 0:
            continue
        work = [source]
        while work:
            v = work[-1]
            if index[v] < 0:
                index[v] = low[v] = clock
                clock += 1
                stack.append(v)
                on_stack[v] = True
            if position[v] < start[v + 1]:
                w = int(tails[position[v]])
                position[v] += 1
                if index[w] < 0:
                    work.append(w)
                elif on_stack[w]:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1]] = min(low[work[-1]], low[v])
            if low[v] == index[v]:
                members = []
                while True:
                    w = stack.pop()
                    on_stack[w] = False
                    members.append(w)
                    if w == v:
                        break
                if len(members) > 1 or v in selfish:
                    least = min(names[m] for m in members)
                    found += [(names[m], least) for m in members]
    if found:
        yield from pa.Table.from_pydict({"node": [a for a, _ in found], "scc": [b for _, b in found]}).to_batches(max_chunksize=50_000)


def _trimmed(graph: DataFrame, task_links: int) -> tuple[DataFrame, int]:
    """(edges, number) of a graph (node, parent) without edges that can't be part of a cycle, as the node
    has no child or the parent has no parent; repeated while a round takes a twentieth of the edges."""
    size = graph.count()
    while size > task_links:
        kept = graph.join(graph.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
        kept = kept.join(graph.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent")
        kept = materialize(kept, "trimmed")
        before, size = size, kept.count()
        graph = kept
        if size > 0.95 * before:
            break
    return graph, size


def _in_task(graph: DataFrame) -> DataFrame:
    return graph.select("node", "parent").coalesce(1).mapInArrow(_skip_empty(_tarjan), "node string, scc string")


def _colouring(graph: DataFrame, task_links: int = 0) -> DataFrame:
    """(node, scc) of the nodes on cycles by trimming and forward-backward colouring, for graphs of any
    size.

    What can't be part of a cycle is trimmed before each round.  A round gives every node the largest
    id among itself and the nodes above it (its colour), many pivots at once; nodes of a colour that
    its owner reaches upwards are one component and leave the graph, and so do edges between colours.
    A rest of up to ``task_links`` edges is solved in one task.  The rounds within a colour are as many
    as its longest shortest way.
    """
    graph = materialize(graph.select("node", "parent"), "graph")
    found: list[DataFrame] = []
    while True:
        graph, size = _trimmed(graph, task_links)
        if size == 0:
            break
        if size <= task_links:
            found.append(materialize(_in_task(graph), "found"))
            break
        colour = materialize(graph.select("node").union(graph.select("parent")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            above = graph.join(colour.withColumnRenamed("node", "parent"), "parent").groupBy("node").agg(F.max("colour").alias("_c"))
            joined = colour.join(above, "node", "left")
            new = materialize(joined.select("node", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), (F.coalesce("_c", "colour") > F.col("colour")).alias("risen")), "colour")
            same = new.where("risen").isEmpty()
            colour = new.drop("risen")
            if same:
                break
        own = colour.withColumnRenamed("node", "parent").withColumnRenamed("colour", "_p")
        inner = materialize(graph.join(colour, "node").join(own, "parent").where("colour = _p").select("node", "parent", "colour"), "inner")
        front = reached = materialize(colour.where("node = colour").join(inner.select("node"), "node", "left_semi"), "reached")
        while not front.isEmpty():  # from the owner of a colour up along its parents
            up = inner.join(front, ["node", "colour"]).select(F.col("parent").alias("node"), "colour").distinct()
            front = materialize(up.join(reached, ["node", "colour"], "left_anti"), "front")
            reached = reached.union(front)
        reached = materialize(reached, "reached")
        several = reached.groupBy("colour").count().where("count > 1").select("colour")
        loops = inner.where("node = parent").select("node")
        cyclic = reached.join(several, "colour", "left_semi").union(reached.join(loops, "node", "left_semi")).distinct()
        found.append(materialize(cyclic.select("node", F.col("colour").alias("scc")), "found"))
        gone = reached.select("node")
        graph = materialize(inner.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "parent"), "graph")
    return reduce(DataFrame.union, found) if found else graph.select("node", F.col("parent").alias("scc"))


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_chains`` of one task: links (node, up) and starts, whose ``scc`` is set and ``up`` their top."""
    held = pa.Table.from_batches(list(batches))
    rows = list(zip(*[held[c].to_pylist() for c in ("node", "up", "scc")], strict=True))
    link = {n: u for n, u, s in rows if s is None}
    seen: dict[tuple[str, str], None] = {}
    for at, top, scc in rows:
        while scc is not None and at != top and (at, scc) not in seen:
            seen[at, scc] = None
            at = link[at]
    if seen:
        yield from pa.Table.from_pydict({"node": [n for n, _ in seen], "scc": [s for _, s in seen]}).to_batches(max_chunksize=50_000)


def _chains(links: DataFrame, starts: DataFrame, task_links: int) -> DataFrame:
    """(node, scc): every node on the chains of links from starts (node, scc, top) to below top."""
    jump = materialize(links.select("node", F.col("parent").alias("up")), "jump")
    marked = materialize(starts.where("node <> top").select("node", "scc", "top").distinct(), "marked")
    size = marked.count()
    if jump.count() + size <= task_links:
        both = jump.withColumn("scc", F.lit(None).cast("string")).unionByName(marked.select("node", F.col("top").alias("up"), "scc"))
        return both.coalesce(1).mapInArrow(_skip_empty(_climb), "node string, scc string")
    while True:
        more = marked.join(jump, "node").where("up <> top").select(F.col("up").alias("node"), "scc", "top")
        marked = materialize(marked.union(more).distinct(), "marked")
        before, size = size, marked.count()
        if size == before:
            return marked.select("node", "scc")
        jump = materialize(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("_up")), "up").select("node", F.col("_up").alias("up")), "jump")


def _components(graph: DataFrame, task_links: int, size: int | None = None) -> DataFrame:
    """(node, scc) of the nodes on cycles of a graph (node, parent) of distinct edges, ``size`` of them."""
    ways = graph.groupBy("node").agg(F.count("*").alias("ways"), F.min("parent").alias("parent"))
    single = materialize(ways.where("ways = 1").select("node", "parent", F.lit(1).cast("long").alias("weight")), "single")
    several = ways.where("ways > 1").select("node")
    ends = materialize(resolve(single, task_links), "ends")
    # loops of single-parent nodes alone
    loop = ends.where("looped").select("node")
    loops = _rings(single.join(loop, "node", "left_semi"), task_links)
    # edges of nodes with several parents, moved up to where their chains end
    moved = (
        graph.join(several, "node", "left_semi")
        .join(ends.withColumnRenamed("node", "parent"), "parent", "left")
        .where("not coalesce(looped, false)")
        .select("node", F.col("parent").alias("via"), F.coalesce("root", "parent").alias("top"))
    )
    moved = materialize(moved.join(several.withColumnRenamed("node", "top"), "top", "left_semi").select("node", "via", "top"), "moved")
    upper = materialize(moved.select("node", F.col("top").alias("parent")).distinct(), "upper")
    rest = upper.count()
    if rest == 0:
        return loops
    if rest <= task_links:
        core = _in_task(upper)
    elif rest < 0.7 * (size or graph.count()):  # contracting is worth another round
        core = _components(upper, task_links, rest)
    else:
        core = _colouring(upper, task_links)
    core = materialize(core, "core")
    tops = core.select(F.col("node").alias("top"), F.col("scc").alias("_scc"))
    starts = moved.join(core, "node").join(tops, "top").where("scc = _scc").select(F.col("via").alias("node"), "scc", "top")
    near = single.join(ends.join(tops, ends.root == tops.top, "left_semi"), "node", "left_semi")
    return loops.unionByName(core).unionByName(_chains(near, starts, task_links))


def _rings(links: DataFrame, task_links: int) -> DataFrame:
    """(node, scc): the nodes on the cycles of links of which none has an end.

    Dropping the nodes that are nobody's parent leaves the cycles; while many are left it goes on
    over the whole table, by doubling the reach of each link.
    """
    links = materialize(links.select("node", "parent"), "ring")
    count = links.count()
    if count == 0:
        return links.select("node", F.col("parent").alias("scc"))
    if count <= task_links:
        return _in_task(links)
    jump, rounds = links.withColumn("least", F.least("node", "parent")), max(1, int(count).bit_length())
    for _ in range(rounds):
        far = jump.select(F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("least").alias("_least"))
        jump = materialize(jump.join(far, "parent").select("node", F.col("_up").alias("parent"), F.least("least", "_least").alias("least")), "ring")
    on_cycle = jump.select(F.col("parent").alias("node")).distinct()
    return jump.join(on_cycle, "node", "left_semi").select("node", F.col("least").alias("scc"))


def cycle_nodes(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, scc): the nodes reached again from themselves over edges (child, parent), with the
    least id of their strongly connected component."""
    graph = materialize(edges.select(F.col("child").alias("node"), "parent"), "edges")
    return _components(graph, task_links).distinct()


def paths(edges: DataFrame, nodes: DataFrame | None = None, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root, depth, path, looped): where each node stands by first parents.

    ``path`` lists the ids from the root to the node, depth + 1 of them.  Nodes that lead to a cycle
    of first parents are ``looped`` and have no root, depth or path.  ``nodes`` (node) adds nodes
    without edges.  Paths grow by doubling: a round looks the partial path of each node's highest
    known ancestor up by its id and puts it in front.
    """
    links = materialize(first_links(edges), "links")
    ends = materialize(resolve(links, task_links), "ends")
    known = edges.select(F.col("child").alias("node")).union(edges.select("parent"))
    if nodes is not None:
        known = known.union(nodes.select("node"))
    roots = known.distinct().join(links, "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.array("node").alias("path"), F.lit(False).alias("looped"))
    looped = ends.where("looped").select("node", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path"), "looped")
    whole = ends.where("not looped")
    open_ = materialize(links.join(whole, "node").select("node", "root", "depth", F.col("parent").alias("up"), F.array("node").alias("part")), "open")
    done = open_.where("up = root")
    while not (left := open_.where("up <> root")).isEmpty():
        step = done.union(left).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("part").alias("_part"))
        open_ = materialize(left.join(step, "up").select("node", "root", "depth", F.col("_up").alias("up"), F.concat("_part", "part").alias("part")), "open")
        done = done.union(open_.where("up = root"))
    done = done.select("node", "root", "depth", F.concat(F.array("root"), F.col("part")).alias("path"))
    return done.withColumn("looped", F.lit(False)).unionByName(roots).unionByName(looped)


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, distance): the pairs that the whole paths of ``paths`` hold.  Nodes on or
    below a loop of first parents have no path; ``all_descendants`` has every pair."""
    every = paths.where("path is not null").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return every.where("node <> descendant").select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def all_descendants(edges: DataFrame) -> DataFrame:
    """(node, descendant, distance): all pairs of a node and another below it along any parents, by
    the least number of edges between them.  Nodes on and below loops are like any others, but no
    node is its own descendant.

    The reach doubles: of two nodes further apart than it, one lies exactly that far below the upper
    one on a shortest way, and within reach of the lower one.
    """
    pairs = materialize(edges.where("child <> parent").select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance")), "pairs")
    reach = 1
    while not (far := pairs.where(F.col("distance") == reach)).isEmpty():
        near = pairs.select(F.col("node").alias("via"), "descendant", F.col("distance").alias("rest"))
        more = far.select("node", F.col("descendant").alias("via")).join(near, "via").where("node <> descendant").select("node", "descendant", (F.col("rest") + reach).alias("distance"))
        grown = materialize(pairs.unionByName(more).groupBy("node", "descendant").agg(F.min("distance").alias("distance")), "pairs")
        release(pairs)
        pairs, reach = grown, 2 * reach
    return pairs
