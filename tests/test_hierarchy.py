import random
import tempfile

import numpy as np
import pytest

from rootline.operators import hierarchy as h
from rootline.plans import reshape

SCHEMA = "child_id string, parent_id string, ordinal int"


def cyclic(pairs):
    """Nodes that reach themselves, by walking from each."""
    out = {}
    for c, p in pairs:
        out.setdefault(c, set()).add(p)
    found = set()
    for start in out:
        seen, work = set(), list(out[start])
        while work:
            at = work.pop()
            if at == start:
                found.add(start)
                break
            if at not in seen:
                seen.add(at)
                work.extend(out.get(at, ()))
    return found


def table(spark, rows):
    return h.edges(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.mark.parametrize(("seed", "limit"), [(1, 500_000), (2, 6), (3, 0)])
def test_cycles_against_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    n = 60 if limit else 25
    rows = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", i) for i in range(int(n * 1.1))]
    rows += [(f"c{i}", f"c{i + 1}", 0) for i in range(20)] + [("c20", "c5", 0), ("s", "s", 0), ("q0", "q1", 0), ("q1", "q0", 0)]
    got = {r.node for r in h.cycle_nodes(table(spark, rows), limit).collect()}
    assert got == cyclic([(c, p) for c, p, _ in rows])


def test_colouring_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(20)]
    graph = spark.createDataFrame(sorted(set(rows)), "node string, parent string")
    assert {r.node for r in h._colouring(graph).collect()} == cyclic(rows)


def test_colouring_of_a_deep_chain_and_a_wide_graph(spark):
    """Long ways without cycles are trimmed away or contracted, not walked id by id; limit 0 keeps all of it
    out of single tasks."""
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", 0) for i in range(200)]
    assert h.cycle_nodes(table(spark, chain), 0).count() == 0
    layers = [(f"w{k}x{i}", f"w{k + 1}x{(i + j) % 8}", j) for k in range(4) for i in range(8) for j in range(2)]
    got = {r.node for r in h.cycle_nodes(table(spark, layers + [("w4x0", "w2x0", 0), ("w4x3", "w4x3", 0)]), 0).collect()}
    assert got == cyclic([(c, p) for c, p, _ in layers] + [("w4x0", "w2x0"), ("w4x3", "w4x3")])


@pytest.mark.parametrize("limit", [500_000, 3])
def test_paths(spark, limit):
    rows = [(f"c{i}", f"c{i - 1}", 0) for i in range(1, 40)] + [("x", "c3", 1), ("x", "c9", 0), ("l1", "l2", 0), ("l2", "l1", 0), ("below", "l1", 0)]
    rows += [(" X ", "C9", 0), ("y", None, 0), (None, "c1", 0)]
    got = {r.node: r for r in h.paths(table(spark, rows), spark.createDataFrame([("alone",)], "node string"), limit).collect()}
    assert got["c39"].path == [f"c{i}" for i in range(40)]
    assert (got["x"].root, got["x"].depth, got["x"].path[-2:]) == ("c0", 10, ["c9", "x"])
    assert got["c0"].depth == got["alone"].depth == 0
    assert all(got[n].looped and got[n].path is None for n in ("l1", "l2", "below"))
    assert "y" not in got and len(got) == 45


def test_descendants(spark):
    rows = [("b", "a", 0), ("c", "b", 0), ("d", "a", 0)]
    got = {tuple(r) for r in h.descendants(h.paths(table(spark, rows))).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


def test_all_descendants_of_loops_and_further_parents(spark):
    """The query against walks from each node."""
    rng = random.Random(8)
    rows = [("y", "l", 0), ("z", "y", 0), ("l", "l", 0), ("a", "b", 0), ("b", "a", 0), ("t", "a", 0), ("u", "t", 1), ("u", "z", 0)]
    rows += [(f"c{i}", f"c{i - 1}", 0) for i in range(1, 40)] + [("c9", "c2", 1)]
    rows += [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", i) for i in range(44)]
    below = {}
    for c, p, _ in rows:
        below.setdefault(p, set()).add(c)
    expected = set()
    for start in below:
        far, front, step = {start: 0}, [start], 0
        while front:
            step += 1
            front = list({c for p in front for c in below.get(p, ())} - far.keys())
            far |= dict.fromkeys(front, step)
        expected |= {(start, n, d) for n, d in far.items() if d}
    assert {("l", "y", 1), ("l", "z", 2), ("y", "z", 1), ("a", "b", 1), ("a", "u", 2), ("l", "u", 3)} <= expected
    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/edge.parquet")
        spark.createDataFrame([], "node_id string").write.parquet(f"{folder}/node.parquet")
        got = [tuple(r) for r in reshape.p2_descendants(spark, folder).collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert h.all_descendants(table(spark, [])).count() == 0


def test_empty_and_extra_columns(spark):
    empty = table(spark, [])
    assert h.cycle_nodes(empty).count() == 0
    assert h.paths(empty).count() == 0
    rows = spark.createDataFrame([("b", "a", 0, "q", "r")], SCHEMA + ", node string, child string")
    assert h.paths(h.edges(rows)).count() == 2


def test_one_parent_of_many(spark):
    rows = [(f"k{i}", "hub", 0) for i in range(3000)]
    got = h.paths(table(spark, rows)).where("depth = 1").count()
    assert got == 3000


def test_union_keeps_weights():
    out = h.unite(np.array(["a", "b", "x"]), np.array(["b", "c", "x"]), np.array([2, 5, 1]))
    assert out.set_index("node").loc["a", ["top", "offset"]].tolist() == ["c", 7]
    assert out.set_index("node").loc["x", "on_cycle"]
