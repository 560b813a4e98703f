"""Files as artifacts: folders read in bulk, and texts of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, path: str, node_id: str) -> DataFrame:
    """(node_id, relpath, content) of all files below a folder."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.element_at(F.split("path", F.lit("\\Q" + root.split("://")[-1] + "/\\E")), -1), "^/", "")
    return files.select(F.lit(node_id).alias("node_id"), relative.alias("relpath"), "content")


def texts(rows: DataFrame, key: str = "doc_id", text: str = "text", relpath: str = "text.txt") -> DataFrame:
    """(node_id, relpath, content): each text of a table as a file of its row."""
    return rows.select(F.col(key).cast("string").alias("node_id"), F.lit(relpath).alias("relpath"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("content"))


def listing(files: DataFrame) -> DataFrame:
    """(node_id, relpath, size, sha256): the artifact rows of files."""
    return files.select("node_id", "relpath", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
