"""The pool of chunks: exact and near-duplicate elimination in bulk, reassembly, checks, collection.

A chunk is stored once under its digest, deflated, as it is where that isn't smaller, or as a delta
against a similar chunk.  Similar chunks share super-features: minima of multiplied samples.  The base
of a chunk is the one that shares most features with it, of earlier commits or before it in the batch;
a delta is never a base, so any chunk is read with at most one other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootline.session import materialize

DEFLATED, DELTA, VERBATIM = 0, 1, 2

# Fixed values of the resemblance index and the delta format.
FEATURES = 4
SAMPLE_STRIDE = 64
SAMPLE_WIDTH = 8
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
DICTIONARY_BYTES = 32_256
DELTA_FROM = 2048
DELTA_WIN = 0.8

def super_features(data: bytes) -> list[int]:
    """The features of a chunk: per multiplier the least product of its samples, 63 bits."""
    samples = np.frombuffer(data, dtype="<u8", count=len(data) // SAMPLE_WIDTH)[:: SAMPLE_STRIDE // SAMPLE_WIDTH]
    if not len(samples):
        return []
    with np.errstate(over="ignore"):
        return [int((samples * np.uint64(m)).min() & np.uint64(2**63 - 1)) for m in MULTIPLIERS]


def encode(data: bytes) -> tuple[int, bytes]:
    """A chunk by itself: deflated, or as it is where that isn't smaller."""
    packed = zlib.compress(data)
    return (DEFLATED, packed) if len(packed) < len(data) else (VERBATIM, data)


def delta_encode(data: bytes, base: bytes) -> bytes:
    """A chunk deflated with the start of a base as dictionary."""
    c = zlib.compressobj(zdict=base[:DICTIONARY_BYTES])
    return c.compress(data) + c.flush()


def decode(kind: int, data: bytes, base: bytes | None = None) -> bytes:
    """The plain bytes of a stored chunk."""
    if kind == DEFLATED:
        return zlib.decompress(data)
    if kind == VERBATIM:
        return data
    if kind == DELTA and base is not None:
        d = zlib.decompressobj(zdict=base[:DICTIONARY_BYTES])
        return d.decompress(data) + d.flush()
    raise ValueError(f"can't decode chunk kind {kind}")


def digests(chunks: DataFrame) -> DataFrame:
    """Chunks (…, data) with their digest."""
    return chunks.withColumn("digest", F.sha2("data", 256))


def distinct_chunks(chunks: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """(digest, data, place): one row per content that the pool doesn't hold; ``place`` is the first
    place it occurs at.  Only digests are grouped; bytes move once."""
    place = F.struct("node_id", "relpath", "ordinal")
    keyed = digests(chunks).withColumn("place", place)
    first = keyed.groupBy("digest").agg(F.min("place").alias("place"))
    if pool is not None:
        first = first.join(pool.select("digest"), "digest", "left_anti")
    return keyed.select("digest", "data", "place").join(first, ["digest", "place"])


def features(chunks: DataFrame) -> DataFrame:
    """(feature, digest) of chunks (digest, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, d) for d, data in zip(batch["digest"], batch["data"], strict=True) for f in sorted(set(super_features(bytes(data))))]
            yield pd.DataFrame(rows, columns=["feature", "digest"])

    return chunks.select("digest", "data").mapInPandas(run, "feature long, digest string")


def _groups(found: DataFrame) -> DataFrame:
    """(digest, shared, marks): every group of features that a chunk has (at most 15), with its size."""
    held = found.groupBy("digest").agg(F.array_sort(F.collect_set("feature")).alias("held"))
    masks = held.select("digest", "held", F.expr("explode(sequence(1, shiftleft(1, size(held)) - 1))").alias("mask"))
    return masks.select("digest", F.expr("filter(held, (x, i) -> (mask & shiftleft(1, i)) > 0)").alias("marks")).withColumn("shared", F.size("marks"))


def nominate(new: DataFrame, new_features: DataFrame, pool: DataFrame | None, pool_features: DataFrame | None) -> DataFrame:
    """(digest, base_digest): for each new chunk the chunk that shares most features with it, the
    oldest among equals.  Bases come from the pool (no deltas) or stand before it in the batch.

    Whoever shares k features with a chunk has one of its groups of k features, so the oldest holder
    of every group is all there is to look at: one row per group, however many chunks hold it.
    """
    age = new.select("digest", F.lit(1).alias("fresh"), F.to_json(F.struct("place")).alias("age"))
    asked = _groups(new_features).join(age, "digest")
    held = asked.select("marks", F.struct("fresh", "age", F.col("digest").alias("base_digest")).alias("holder"))
    if pool is not None and pool_features is not None:
        old = pool.where(F.col("kind") != DELTA).select("digest", F.struct(F.lit(0).alias("fresh"), F.format_string("%020.6f", "created_epoch_seconds").alias("age"), F.col("digest").alias("base_digest")).alias("holder"))
        held = held.unionByName(_groups(pool_features).join(old, "digest").select("marks", "holder"))
    oldest = held.groupBy("marks").agg(F.min("holder").alias("holder"))
    met = asked.join(oldest, "marks").where((F.col("holder.fresh") == 0) | (F.col("holder.age") < F.col("age"))).where("holder.base_digest <> digest")
    best = F.min(F.struct((-F.col("shared")).alias("few"), "holder"))["holder"]["base_digest"]
    return met.groupBy("digest").agg(best.alias("base_digest"))


def store(chunks: DataFrame, pool: DataFrame | None = None, pool_features: DataFrame | None = None, delta: bool = True, now: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, feature rows) that a batch of chunks (node_id, relpath, ordinal, data) adds.

    A delta is kept where it is clearly smaller than the chunk by itself.  A chunk that another of the
    batch is stored against stays whole.
    """
    new = materialize(distinct_chunks(chunks, pool), "new-chunks")
    spark = new.sparkSession
    if not delta:
        pairs = new.select("digest", "data", F.lit(None).cast("string").alias("base_digest"), F.lit(None).cast("binary").alias("base_data"), F.lit(None).cast("int").alias("base_kind"))
        found = None
    else:
        long = new.where(F.octet_length("data") >= DELTA_FROM)
        found = materialize(features(long), "features")
        chosen = materialize(nominate(new, found, pool, pool_features), "nominated")
        bases = chosen.select(F.col("base_digest").alias("digest")).distinct()
        chosen = chosen.join(bases, "digest", "left_anti")  # a base is no delta
        plain = new.join(bases, "digest", "left_semi").select(F.col("digest").alias("base_digest"), F.col("data").alias("base_data"), F.lit(VERBATIM).alias("base_kind"))
        if pool is not None:
            plain = plain.unionByName(pool.join(bases, "digest", "left_semi").select(F.col("digest").alias("base_digest"), F.col("data").alias("base_data"), F.col("kind").alias("base_kind")))
        pairs = new.select("digest", "data").join(chosen, "digest", "left").join(plain, "base_digest", "left").select("digest", "data", "base_digest", "base_data", "base_kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                data = bytes(r.data)
                kind, packed = encode(data)
                base = None
                if isinstance(r.base_digest, str) and r.base_data is not None:
                    trial = delta_encode(data, decode(int(r.base_kind), bytes(r.base_data)))
                    if len(trial) < DELTA_WIN * min(len(packed), len(data)):
                        kind, packed, base = DELTA, trial, r.base_digest
                rows.append((r.digest, kind, base, packed, len(data), now))
            yield pd.DataFrame(rows, columns=["digest", "kind", "base_digest", "data", "length", "created_epoch_seconds"])

    rows = materialize(pairs.mapInPandas(run, "digest string, kind int, base_digest string, data binary, length long, created_epoch_seconds double"), "chunks")
    if found is None:
        return rows, spark.createDataFrame([], "feature long, digest string")
    return rows, found.join(rows.where(F.col("kind") != DELTA).select("digest"), "digest", "left_semi").select("feature", "digest")


def recipes(chunks: DataFrame) -> DataFrame:
    """(node_id, relpath, ordinal, digest): what each file is made of."""
    return digests(chunks).select("node_id", "relpath", "ordinal", "digest")


def plain_chunks(pool: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(digest, data, ok): the plain bytes of chunks, and whether they have the digest they should."""
    rows = pool if wanted is None else pool.join(wanted.select("digest").distinct(), "digest", "left_semi")
    bases = pool.where(F.col("kind") != DELTA).select(F.col("digest").alias("base_digest"), F.col("kind").alias("base_kind"), F.col("data").alias("base_data"))
    joined = rows.select("digest", "kind", "base_digest", "data").join(bases, "base_digest", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    base = None if r.base_data is None else decode(int(r.base_kind), bytes(r.base_data))
                    plain = decode(int(r.kind), bytes(r.data), base)
                    out.append((r.digest, plain, hashlib.sha256(plain).hexdigest() == r.digest))
                except (ValueError, zlib.error):
                    out.append((r.digest, None, False))
            yield pd.DataFrame(out, columns=["digest", "data", "ok"])

    return joined.mapInPandas(run, "digest string, data binary, ok boolean")


def pieces(recipe: DataFrame, pool: DataFrame) -> DataFrame:
    """(node_id, relpath, ordinal, data): the plain chunks of files, those of a file together and in
    order: for files of any size."""
    parts = recipe.join(plain_chunks(pool, recipe), "digest").select("node_id", "relpath", "ordinal", "data")
    return parts.repartition("node_id", "relpath").sortWithinPartitions("node_id", "relpath", "ordinal")


def check_files(recipe: DataFrame, pool: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(node_id, relpath, size, ok): whether the chunks of each file, one after the other, have the
    digest of the file; no file is put together in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, size, out = None, None, 0, []
        for batch in batches:
            for node_id, relpath, data in zip(batch["node_id"], batch["relpath"], batch["data"], strict=True):
                if (node_id, relpath) != key:
                    if key is not None:
                        out.append((*key, size, total.hexdigest()))
                    key, total, size = (node_id, relpath), hashlib.sha256(), 0
                total.update(bytes(data))
                size += len(data)
            yield pd.DataFrame(out, columns=["node_id", "relpath", "size", "found"])
            out = []
        if key is not None:
            yield pd.DataFrame([(*key, size, total.hexdigest())], columns=["node_id", "relpath", "size", "found"])

    found = pieces(recipe, pool).mapInPandas(run, "node_id string, relpath string, size long, found string")
    whole = artifacts.select("node_id", "relpath", "sha256").join(found, ["node_id", "relpath"], "left")
    empty = hashlib.sha256().hexdigest()
    return whole.select("node_id", "relpath", F.coalesce("size", F.lit(0).cast("long")).alias("size"), (F.coalesce("found", F.lit(empty)) == F.col("sha256")).alias("ok"))


def reassemble(recipe: DataFrame, pool: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(node_id, relpath, content[, ok]): files that fit a cell, from their chunks in order; ``ok``
    compares the digest of the whole with that of ``artifacts``.  ``pieces`` is for larger files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out = []
            for node_id, relpath, data in zip(batch["node_id"], batch["relpath"], batch["data"], strict=True):
                if (node_id, relpath) != key:
                    if key is not None:
                        out.append((*key, b"".join(held)))
                    key, held = (node_id, relpath), []
                held.append(bytes(data))
            yield pd.DataFrame(out, columns=["node_id", "relpath", "content"])
        if key is not None:
            yield pd.DataFrame([(*key, b"".join(held))], columns=["node_id", "relpath", "content"])

    files = pieces(recipe, pool).mapInPandas(run, "node_id string, relpath string, content binary")
    if artifacts is None:
        return files
    whole = artifacts.select("node_id", "relpath", "sha256").join(files, ["node_id", "relpath"], "left").withColumn("content", F.coalesce("content", F.lit(b"").cast("binary")))
    return whole.select("node_id", "relpath", "content", (F.sha2("content", 256) == F.col("sha256")).alias("ok"))


def live(recipe: DataFrame, pool: DataFrame) -> DataFrame:
    """(digest): chunks that recipes use, and the bases of those."""
    used = recipe.select("digest").distinct()
    bases = pool.join(used, "digest", "left_semi").where("base_digest is not null").select(F.col("base_digest").alias("digest"))
    return used.union(bases).distinct()


def garbage(recipe: DataFrame, pool: DataFrame) -> DataFrame:
    """(digest): chunks that nothing refers to."""
    return pool.select("digest").join(live(recipe, pool), "digest", "left_anti")


def verify(recipe: DataFrame, pool: DataFrame) -> DataFrame:
    """(digest, problem): chunks that are missing, whose base is missing or a delta, or whose bytes
    don't have their digest."""
    missing = recipe.select("digest").distinct().join(pool.select("digest"), "digest", "left_anti").withColumn("problem", F.lit("missing"))
    base = pool.select(F.col("digest").alias("base_digest"), F.col("kind").alias("base_kind"))
    bases = pool.where("base_digest is not null").join(base, "base_digest", "left").where(F.col("base_kind").isNull() | (F.col("base_kind") == DELTA))
    broken = plain_chunks(pool).where(~F.col("ok")).select("digest", F.lit("corrupt").alias("problem"))
    return missing.unionByName(bases.select("digest", F.lit("base").alias("problem"))).unionByName(broken).distinct()
