import math
import random

import pytest
from pyspark.sql import functions as F

from rootline.frames import LineageFrames, clean
from rootline.functions.encode import Entry, canonical, fingerprint, number, storable
from rootline.operators import audit, find, graph, search, views
from rootline.schema import DDL, IntegrityError


def frames(spark, nodes, edges=(), metadata=(), artifacts=()):
    node = [(i, s, g, None, float(t), h, None, 0, None, None, None, None, None, None, None) for i, s, g, t, h in nodes]
    meta = [(i, k, canonical(v), "text", "General", True, number(v)) for i, k, v in metadata]
    return LineageFrames(spark.createDataFrame(node, DDL["node"]), spark.createDataFrame(list(edges), DDL["edge"]), spark.createDataFrame(meta, DDL["metadata"]), spark.createDataFrame(list(artifacts), DDL["artifact"]))


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("a", "ingest", 0, 1, True), ("b", "train", 1, 2, True), ("c", "train", 1, 3, False), ("d", "evaluate", 1, 4, True), ("e", "report", 1, 5, True)]
    edges = [("b", "a", 0), ("c", "a", 0), ("d", "b", 1), ("d", "c", 0), ("e", "d", 0)]
    metadata = [("b", "accuracy", 0.9), ("c", "accuracy", 0.5), ("b", "ok", True), ("c", "ok", "true"), ("d", "note", "Größe 50%"), ("e", "accuracy", 7)]
    artifacts = [("b", "out/Model.BIN", 5, "x"), ("d", "figs/a.png", 7, "y"), ("d", "deep/figs/b.png", 7, "z")]
    return frames(spark, nodes, edges, metadata, artifacts)


def ids(df, column="node_id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_find(small):
    assert ids(find.find(small)) == list("abcde")
    assert ids(find.find(small, step_type="train", healthy=True)) == ["b"]
    assert ids(find.find(small, accuracy=0.9)) == ["b"]
    assert ids(find.find(small, accuracy=7.0)) == ["e"]
    assert ids(find.find(small, ok=True)) == ["b"]
    assert ids(find.find(small, ok="true")) == ["c"]
    assert ids(find.find(small, accuracy=math.nan)) == []
    assert ids(find.find(small, accuracy=0.9, ok=True, healthy=True)) == ["b"]
    assert ids(find.find(small, duration_seconds=None)) == list("abcde")
    assert ids(find.find(small, parent_id=["c", "b"])) == ["d"]
    assert ids(find.find(small, parent_id=["b", "c"])) == []
    assert ids(find.find(small, parent_id="a")) == ["b", "c"]
    assert ids(find.find(small, parent_id=[])) == ["a"]
    assert ids(find.find(small, accuracy=lambda v: v is None)) == ["a", "d"]
    assert ids(find.find(small, accuracy=lambda v: v > 0.6)) == ["b", "e"]
    assert ids(find.find(small, generation=lambda g: g == 0)) == ["a"]
    with pytest.raises(TypeError):
        find.find(small, parent_id=None)


def test_order_and_latest(small):
    assert [r.node_id for r in find.ordered(find.find(small)).collect()] == list("abcde")
    assert find.latest(find.find(small, step_type="train")).first().node_id == "c"
    assert find.latest(find.find(small, step_type="none")).first() is None


def test_names(small):
    assert ids(find.artifacts(small, "*.png"), "relpath") == ["deep/figs/b.png", "figs/a.png"]
    assert ids(find.artifacts(small, "figs/*.png"), "relpath") == ["deep/figs/b.png", "figs/a.png"]
    assert ids(find.artifacts(small, "model"), "relpath") == ["out/Model.BIN"]
    assert ids(find.artifacts(small, "*.bin"), "relpath") == []
    assert ids(find.parent_artifacts(small, "*.png"), "node_id") == ["e", "e"]


def test_search(small):
    assert ids(search.search(small, "")) == list("abcde")
    assert ids(search.search(small, "accuracy>0.6")) == ["b", "e"]
    assert ids(search.search(small, "accuracy>=0.5 step_type=train")) == ["b", "c"]
    assert ids(search.search(small, "healthy=false")) == ["c"]
    assert ids(search.search(small, "TRAIN")) == ["b", "c"]
    assert ids(search.search(small, "accuracy>x")) == []
    assert ids(search.search(small, "created_epoch_seconds<2.5")) == ["a", "b"]
    assert ids(search.search(small, "50%")) == ["d"]
    assert ids(search.search_page(small, "acc:0.9, ok:TRUE")) == ["b"]


def test_graph(small):
    assert ids(graph.children(small, "a")) == ["b", "c"]
    assert ids(graph.ancestors(small, "d"), "node") == list("abcd")
    assert ids(graph.related(small, "b"), "node") == list("abde")
    assert graph.lineage_order(small, "d") == ["a", "b", "c", "d"]
    assert {r.node: r.level for r in graph.node_levels(small).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


@pytest.mark.parametrize("limit", [1000, 0])
def test_closures_and_levels_both_ways(spark, small, limit):
    down = small.edge.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"))
    seed = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.closure(down, seed, limit).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    loop = down.union(spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z")], "a string, b string"))
    nodes = spark.createDataFrame([("alone",)], "node string")
    got = {r.node: (r.level, r.settled) for r in graph.levels(nodes, loop, limit).collect()}
    assert got["e"] == (3, True) and got["alone"] == (0, True)
    assert not got["x"][1] and not got["z"][1]


@pytest.mark.parametrize("limit", [1000, 0])
def test_prune(small, limit):
    def plan(node):
        return {r.node for r in graph.prune_plan(small, node, limit).collect()}

    assert plan("b") == {"b"}
    assert plan("a") == set("abcde")
    assert plan("d") == {"d", "e"}


def pruned(nodes, edges, target):
    """What goes with a node, by removing what has nothing left above it."""
    below, parents = {}, {}
    for c, p in edges:
        if c in nodes:
            below.setdefault(p, set()).add(c)
            parents.setdefault(c, set()).add(p)
    seen, work = set(), [target]
    while work:
        for c in below.get(work.pop(), ()):
            if c not in seen:
                seen.add(c)
                work.append(c)
    if target not in nodes or target in seen:
        return {}
    gone, level = {target}, {target: 0}
    while more := {n for n in nodes - gone if parents.get(n) and parents[n] <= gone}:
        level |= {n: 1 + max(level[p] for p in parents[n]) for n in more}
        gone |= more
    return level


@pytest.mark.parametrize("limit", [100_000, 0])
def test_prune_one_answer(spark, limit):
    """Unknown targets, absent parents and children, loops, a hub: the same rows either way."""
    rng = random.Random(4)
    nodes = {f"n{i}" for i in range(12)}
    edges = {(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}") for _ in range(14)} | {(f"k{i}", "n0") for i in range(6)} | {("k5", "gone"), ("b", "a"), ("c", "b"), ("l", "k0"), ("l", "m"), ("m", "l")}
    nodes |= {f"k{i}" for i in range(6)} | {"a", "c", "l", "m"}
    f = frames(spark, [(i, "s", 0, 0.0, True) for i in sorted(nodes)], [(c, p, 0) for c, p in sorted(edges)])
    for target in ("n0", "a", "gone", "b", "l", "nowhere"):
        assert {r.node: r.level for r in graph.prune_plan(f, target, limit).collect()} == pruned(nodes, edges, target), target
    assert pruned(nodes, edges, "a") == {"a": 0} and len(pruned(nodes, edges, "n0")) >= 5


def test_order_puts_parents_first(spark):
    """The order of a walk that takes the last parent's line first, and cycles."""
    f = frames(spark, [], [("d", "b", 0), ("d", "c", 1), ("b", "a", 0), ("c", "a", 0), ("c", "x", 1), ("p", "q", 0), ("q", "p", 0), ("r", "p", 0)])
    assert graph.lineage_order(f, "d") == ["x", "a", "c", "b", "d"]
    assert graph.lineage_order(f, "a") == ["a"]
    with pytest.raises(IntegrityError):
        graph.lineage_order(f, "r")


def test_prune_on_cycle(spark):
    f = frames(spark, [(i, "s", 0, 0, True) for i in "xyz"], [("x", "y", 0), ("y", "x", 0), ("z", "x", 0)])
    assert graph.prune_plan(f, "x").count() == 0
    with pytest.raises(IntegrityError):
        graph.lineage_order(f, "z")


def test_views(small):
    assert views.status_counts(small).first().asDict() == {"runs": 5, "failed": 1, "dirty": 0}
    assert {r.key for r in views.metric_keys(small).collect()} == {"accuracy"}
    runs = views.sorted_runs(views.runs_table(small), "accuracy").select("node_id", "accuracy").collect()
    assert [r.node_id for r in runs[:3]] == ["e", "b", "c"] and runs[-1].accuracy is None
    assert [(r.rank_no, r.node_id) for r in views.ranking(small, "accuracy", 2).collect()] == [(1, "e"), (2, "b")]
    assert {r.node_id: r.share for r in views.normalise(small, "accuracy").collect()}["c"] == 0
    diff = {r.key: r for r in views.diff(small, "b", "c").collect()}
    assert diff["accuracy"].delta == -0.4 and not diff["ok"].same
    assert {r["name"] for r in views.detail(small, "b").collect()} >= {"accuracy", "step_type", "out/Model.BIN"}
    assert len(views.envelopes(small).where("node_id = 'b'").first().entries) == 2
    assert views.envelopes(small).where("node_id = 'a'").first().entries == {}


def test_rules_and_generations(small):
    rules = {"train": ["ingest"], "evaluate": ["ingest"], "ingest": ["train"]}
    got = {(r.node_id, r.parent_id) for r in audit.violations(small, rules).collect()}
    assert got == {("d", "b"), ("d", "c"), ("a", None)}
    for limit in (1000, 0):
        assert {r.node_id: r.generation for r in audit.generations(small, ["train", "evaluate"], limit).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}


def test_clean(spark):
    node = spark.createDataFrame([(" A", "Train\t", 0, None, 1.0, True, math.nan, 5, None, None, None, None, None, None, None), ("a", "train", 0, None, 1.0, True, None, 5, None, None, None, None, None, None, None), (None, "x", 0, None, 1.0, True, None, 5, None, None, None, None, None, None, None)], DDL["node"])
    edge = spark.createDataFrame([("B", "A", 1), ("b ", "a", 0), ("b", None, 0)], DDL["edge"])
    meta = spark.createDataFrame([("a", "K ", "1", "text", None, True, math.nan)], DDL["metadata"])
    art = spark.createDataFrame([("a", "x\\y.csv", 1, "AB")], DDL["artifact"])
    f = clean(node, edge, meta, art)
    assert [(r.node_id, r.step_type, r.duration_seconds) for r in f.node.collect()] == [("a", "train", None)]
    assert [tuple(r) for r in f.edge.collect()] == [("b", "a", 0)]
    assert f.metadata.first().num_value is None
    assert tuple(f.artifact.first())[1::2] == ("x/y.csv", "ab")


def test_encoding():
    assert canonical({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    assert (number(True), number(math.nan), number(3)) == (None, None, 3.0)
    assert storable({1: (2, {3})}) == {"1": [2, [3]]}
    with pytest.raises(TypeError):
        storable(object())
    assert not Entry.make("k", {"a": 1}).searchable
    assert Entry.make("k", "https://x").data_type == "link"
    a = fingerprint("s", ["y", "x"], [Entry.make("k", 1)], {"f": "h"})
    assert a == fingerprint("s", ["x", "y"], [Entry.make("k", 1)], {"f": "h"}) != fingerprint("s", ["x"], [], {})
