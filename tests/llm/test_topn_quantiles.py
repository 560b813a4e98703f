import math
import random

import numpy as np
import pytest
from oracle import DATA, connection, same

from rootline.llm import quantiles, queries, topn
from rootline.session import materialize

SCHEMA = "g string, item string, score double"


def ranked(spark, rows, n, extra=""):
    df = spark.createDataFrame(rows, SCHEMA + extra)
    return sorted((r.g, r.rank_no, r.item) for r in topn.top_n(df, ["g"], "item", "score", n).collect())


def expected(rows, n):
    best = {}
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    out = []
    for group in {g for g, _ in best}:
        order = sorted(((-s, i) for (g, i), s in best.items() if g == group))[:n]
        out += [(group, k + 1, i) for k, (_, i) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    scores = [0.0, -0.0, 1.0, 1.0000001, -1.0, -1e300, 1e300, 5e-324, -5e-324, math.inf, -math.inf, math.nan, None, 0.5, 0.499]
    rows = [(rng.choice(["a", "b", "c", None]), f"i{rng.randrange(40)}" if rng.random() > 0.05 else None, rng.choice(scores)) for _ in range(600)]
    rows += [("hot", f"i{i:05d}", 7.0) for i in range(5000)]
    assert ranked(spark, rows, n) == expected(rows, n)


def test_many_groups_meet_by_salt(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    rows = [(f"g{i % 3}", f"i{i}", float(i % 11)) for i in range(300)]
    assert ranked(spark, rows, 4) == expected(rows, 4)


def test_buckets_keep_the_order(spark):
    rng = random.Random(0)
    values = sorted([rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(3000)] + [0.0, math.inf, -math.inf, 5e-324, 2.0**52, 1.0, 2.0])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1)
    from pyspark.sql import functions as F

    buckets = [r.b for r in df.select("i", topn.bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_empty_and_clashing(spark):
    assert ranked(spark, [], 3) == []
    rows = [("a", "x", 1.0, 5, "q"), ("a", "y", 2.0, 6, "q")]
    assert ranked(spark, rows, 1, ", bucket int, least string") == [("a", 1, "y")]
    with pytest.raises(ValueError):
        ranked(spark, [], 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], connection())


def merged(parts):
    total = quantiles.RelativeSketch()
    for p in parts:
        s = quantiles.RelativeSketch()
        s.update(p)
        total.merge(s)
    return total


@pytest.mark.parametrize("shape", ["lognormal", "constant", "sorted", "reversed"])
def test_error_is_relative_to_the_tail(shape):
    rng = np.random.default_rng(1)
    x = {"lognormal": rng.lognormal(0, 3, 200_000), "constant": np.full(200_000, 3.0), "sorted": np.arange(200_000.0), "reversed": np.arange(200_000.0)[::-1]}[shape]
    s = merged(np.array_split(x, 50))
    assert s.n == len(x) and sum(map(len, s.levels)) < 20_000
    ordered = np.sort(x)
    for share in (0.5, 0.9, 0.99, 0.999, 0.9999):
        v = s.quantiles([share])[0]
        low, high = np.searchsorted(ordered, v, "left") / len(x), np.searchsorted(ordered, v, "right") / len(x)
        gap = max(0, low - share, share - high)
        assert gap <= 0.05 * (1 - share) + 1 / len(x)


def test_small_sketches_are_exact():
    s = merged([np.array([5.0, 1.0]), np.array([3.0])])
    assert s.quantiles([0, 0.34, 0.5, 1]) == [1.0, 3.0, 3.0, 5.0]
    assert quantiles.RelativeSketch.of(*s.row()).quantiles([0.5]) == [3.0]


def test_sketches_combine(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else None, int(i % 7), float(v)) for i, v in enumerate(rng.lognormal(0, 2, 20_000))] + [("b", 1, math.nan), ("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(5)
    daily = materialize(quantiles.merge(quantiles.sketch(df, ["g", "day"], "v"), ["g", "day"]))
    assert daily.count() == 14
    total = quantiles.merge(daily.drop("day"), ["g"])
    got = {r.g: (r.n, r.value) for r in quantiles.percentiles(total, ["g"], [0.9]).collect()}
    for g in ("a", None):
        own = sorted(v for k, _, v in rows if k == g)
        assert got[g][0] == len(own)
        assert abs(np.searchsorted(own, got[g][1]) / len(own) - 0.9) < 0.01


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.percentiles(quantiles.merge(quantiles.sketch(df, ["g"], "v"), ["g"]), ["g"], [0.5]).count() == 0


def test_more_items_than_the_window_limit(spark):
    """A large n over one group, most of whose scores are equal, ranked in parts first."""
    rows = spark.range(5000).selectExpr("'g' as g", "concat('i', id) as item", "cast(if(id < 50, id, 7) as double) as score")
    got = [r.item for r in topn.top_n(rows, ["g"], "item", "score", 1500).orderBy("rank_no").collect()]
    expected = sorted(((-(float(i) if i < 50 else 7.0), f"i{i}") for i in range(5000)))[:1500]
    assert got == [i for _, i in expected]


def test_sketches_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "TASK_SKETCHES", 3)
    rows = spark.range(1000).selectExpr("cast(id % 20 as string) as g", "cast(id as double) as v").coalesce(2)
    total = quantiles.merge(quantiles.sketch(rows, ["g"], "v"), ["g"])
    assert {r.g: r.n for r in total.collect()} == {str(i): 50 for i in range(20)}
