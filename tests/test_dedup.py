import random

import pytest
from pyspark.sql import functions as F

from rootline.dedup import chunker, pool


def slow_cuts(data, cuts):
    """The rolling hash byte by byte."""
    out, start = [], 0
    while len(data) - start > cuts.least:
        running, end = 0, min(start + cuts.most, len(data))
        for i in range(start + cuts.least, end):
            running = ((running << 1) + int(chunker.GEAR[data[i]])) & 0xFFFF
            bits = cuts.strict_bits if i < start + cuts.average else cuts.loose_bits
            if running & ((1 << bits) - 1) == 0:
                end = i + 1
                break
        out.append(end)
        start = end
    return [*out, len(data)] if start < len(data) else out


@pytest.mark.parametrize("cuts", [chunker.Cuts(), chunker.Cuts(64, 256, 1024, 9, 6), chunker.Cuts(8, 12, 40, 4, 2)])
def test_cuts_equal_the_rolling_hash(cuts):
    rng = random.Random(3)
    for size in (0, 1, 7, 8, 9, 50, 5000, 200_000):
        for data in (rng.randbytes(size), bytes(size), b"abcd" * (size // 4)):
            assert chunker.cut_points(data, cuts) == slow_cuts(data, cuts)
            assert b"".join(chunker.chunks_of(data, cuts)) == data


def test_insertion_moves_few_chunks():
    data = random.Random(1).randbytes(2_000_000)
    a, b = set(chunker.chunks_of(data)), set(chunker.chunks_of(data[:1000] + b"x" + data[1000:]))
    assert len(b - a) <= 3


def files(spark, contents):
    return spark.createDataFrame([(f"n{i}", "f", bytearray(c)) for i, c in enumerate(contents)], "node_id string, relpath string, content binary")


def test_pool_round_trip(spark):
    rng = random.Random(2)
    base = rng.randbytes(30_000)
    near = bytearray(base)
    near[500] ^= 1
    contents = [base, base, bytes(near), b"", b"a" * 50_000, rng.randbytes(10)]
    source = files(spark, contents)
    chunks = chunker.chunk_files(source)
    rows, features = pool.store(chunks)
    kinds = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds.get(pool.DELTA) and kinds.get(pool.DEFLATED) and kinds.get(pool.VERBATIM)
    art = source.select("node_id", "relpath", F.sha2("content", 256).alias("sha256"))
    back = pool.reassemble(pool.recipes(chunks), rows, art).collect()
    assert all(r.ok for r in back)
    assert {r.node_id: bytes(r.content) for r in back} == {f"n{i}": c for i, c in enumerate(contents)}
    assert pool.verify(pool.recipes(chunks), rows).count() == 0
    bases = rows.where("base_digest is not null").join(rows.select(F.col("digest").alias("base_digest"), F.col("kind").alias("k")), "base_digest")
    assert bases.where(F.col("k") == pool.DELTA).count() == 0
    more, _ = pool.store(chunks, rows, features)
    assert more.count() == 0


def test_later_batches_use_the_pool(spark):
    base = random.Random(4).randbytes(9_000)
    first = chunker.chunk_files(files(spark, [base]))
    rows, features = pool.store(first)
    second = chunker.chunk_files(files(spark, [base[:4000] + b"?" + base[4001:]]))
    more, _ = pool.store(second, rows, features)
    assert more.first().kind == pool.DELTA
    plain, none = pool.store(second, rows, features, delta=False)
    assert plain.first().kind == pool.VERBATIM and none.count() == 0
    whole = rows.unionByName(more)
    recipe = pool.recipes(second)
    assert pool.garbage(recipe, whole).count() == 0
    assert {r.digest for r in pool.garbage(pool.recipes(first), whole).collect()} == {more.first().digest}
    broken = whole.withColumn("data", F.when(F.col("kind") == pool.VERBATIM, F.encode(F.lit("bad"), "UTF-8")).otherwise(F.col("data")))
    assert {r.problem for r in pool.verify(recipe, broken).collect()} == {"corrupt"}
    assert pool.verify(recipe, rows).first().problem == "missing"


def test_fixed(spark):
    got = chunker.fixed_chunks(files(spark, [b"x" * 2500, b""]), 1000).collect()
    assert [(r.ordinal, len(r.data)) for r in got] == [(0, 1000), (1, 1000), (2, 500)]


def test_features():
    data = random.Random(5).randbytes(5000)
    assert len(pool.super_features(data)) == pool.FEATURES
    assert pool.super_features(b"short") == []
    samples = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data) - 7, 64)]
    assert pool.super_features(data)[0] == min(s * pool.MULTIPLIERS[0] % 2**64 for s in samples) % 2**63


def test_bases_share_most_features(spark):
    """A hot feature held by many, and one old chunk that shares more: against brute force over all holders."""
    rng = random.Random(2)
    old = {f"p{i:02d}": (float(i), {1, *rng.sample(range(2, 12), 3)}) for i in range(30)}
    new = {f"c{i:02d}": {1, *rng.sample(range(2, 12), 3)} for i in range(20)}
    rows = spark.createDataFrame([(d, b"x", ("n", "f", i)) for i, d in enumerate(sorted(new))], "digest string, data binary, place struct<node_id string, relpath string, ordinal int>")
    marks = lambda sets: spark.createDataFrame([(f, d) for d, s in sets.items() for f in s], "feature long, digest string")
    stored = spark.createDataFrame([(d, pool.DELTA if d == "p00" else 0, t) for d, (t, _) in old.items()], "digest string, kind int, created_epoch_seconds double")
    got = {r.digest: r.base_digest for r in pool.nominate(rows, marks(new), stored, marks({d: s for d, (_, s) in old.items()})).collect()}
    age = lambda x: f'"ordinal":{sorted(new).index(x)}}}'  # noqa: E731  ages compare as texts
    for digest, own in new.items():
        best = max((len(own & s), -t, d) for d, (t, s) in old.items() if d != "p00")
        near = max((len(own & s) for d, s in new.items() if age(d) < age(digest)), default=0)
        assert got[digest] == best[2] if best[0] >= near else len(own & new[got[digest]]) == near
    alone = {r.digest: r.base_digest for r in pool.nominate(rows, marks(new), None, None).collect()}
    first = sorted(new)[0]
    assert first not in alone and set(alone) == set(new) - {first}
    assert all(len(new[d] & new[b]) == max(len(new[d] & new[o]) for o in new if age(o) < age(d)) for d, b in alone.items())
