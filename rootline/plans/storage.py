"""Queries of chunk storage, over the texts of the corpus as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootline.dedup import chunker, pool
from rootline.session import materialize, prepare, table
from rootline.sources import files

#: Cuts for texts of a few KB; the production sizes would leave most of them whole.
SMALL = chunker.Cuts(256, 1024, 4096, 11, 8)

QUERIES = {}
ORACLES = {}


def _register(f):
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return files.texts(table(spark, sf_dir, "documents"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(chunker.chunk_files(_files(spark, sf_dir), SMALL), "chunked")


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = _chunks(spark, sf_dir)
    return (chunks, *pool.store(chunks))


@_register
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at fixed distances, per file."""
    fixed = chunker.fixed_chunks(_files(spark, sf_dir), 1000)
    return fixed.groupBy("node_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).alias("bytes"))


ORACLES["chunk_fixed"] = "select cast(doc_id as varchar) as node_id, ceil(octet_length(encode(text)) / 1000)::bigint as chunks, octet_length(encode(text))::bigint as bytes from documents where text <> ''"


@_register
def chunk_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks by the production sizes: their number and bytes per file."""
    cut = chunker.chunk_files(_files(spark, sf_dir))
    return cut.groupBy("node_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).alias("bytes"))


@_register
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and hash of each file."""
    return files.listing(_files(spark, sf_dir))


ORACLES["file_listing"] = "select cast(doc_id as varchar) as node_id, 'text.txt' as relpath, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as sha256 from documents"


@_register
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents of whole files and how often each occurs."""
    return _files(spark, sf_dir).groupBy(F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("copies"))


ORACLES["chunk_dedup"] = "select sha256(coalesce(text, '')) as digest, count(*) as copies from documents group by 1"


@_register
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the corpus takes in chunks: kinds, plain and stored bytes."""
    _, rows, _ = _pool(spark, sf_dir)
    return rows.groupBy("kind").agg(F.count("*").alias("chunks"), F.sum("length").alias("plain_bytes"), F.sum(F.octet_length("data")).alias("stored_bytes"))


@_register
def super_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that several chunks share."""
    found = pool.features(pool.distinct_chunks(_chunks(spark, sf_dir)))
    return found.groupBy("feature").agg(F.count("*").alias("chunks")).where("chunks > 1")


@_register
def reassemble_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files put together again from chunks, and whether each is what was stored."""
    chunks, rows, _ = _pool(spark, sf_dir)
    return pool.check_files(pool.recipes(chunks), rows, files.listing(_files(spark, sf_dir))).select("node_id", "size", "ok")


ORACLES["reassemble_verify"] = "select cast(doc_id as varchar) as node_id, octet_length(encode(coalesce(text, '')))::bigint as size, true as ok from documents"


@_register
def gc_live_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that would go if the English notebooks went."""
    chunks, rows, _ = _pool(spark, sf_dir)
    others = table(spark, sf_dir, "documents").where("lang is null or lang not like 'en%'").select(F.col("doc_id").cast("string").alias("node_id"))
    return pool.garbage(pool.recipes(chunks).join(others, "node_id", "left_semi"), rows)


@_register
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the pool; there should be none."""
    chunks, rows, _ = _pool(spark, sf_dir)
    return pool.verify(pool.recipes(chunks), rows)


ORACLES["integrity_check"] = "select '' as digest, '' as problem where false"
