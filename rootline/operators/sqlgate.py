"""Read-only SQL over the tables of a store."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from rootline.frames import LineageFrames
from rootline.schema import DDL, StoreError


class ReadOnlyError(StoreError):
    """A statement that is more than a query."""


#: Nodes of a parsed plan that only read.
COMMANDS = re.compile(r"Command|InsertInto|Create|Drop|Alter|Replace|Merge|Update|Delete|Truncate|SetCatalog|AddPartition|Load|Cache|Refresh|Analyze|Unresolved(?:Identifier|DirectoryRelation)|CallStatement|Execute", re.I)

VIEWS = list(DDL)

#: Functions that reach beyond the rows they are given: code of the JVM, files, the session.
BARRED = re.compile(r"\b(reflect|java_method|try_reflect|input_file_name|input_file_block_\w+|from_csv_file|read_files|raise_error|current_catalog|session_user|current_user|user|python_worker\w*|spark_partition_id)\s*\(", re.I)


def _guard(frames: LineageFrames, text: str) -> None:
    """Refuse anything that is no query over the tables of the store, before any of it is analysed or
    run."""
    parser = frames.spark._jsparkSession.sessionState().sqlParser()
    plan = parser.parsePlan(text).toString()
    for line in plan.split("\n"):
        name = re.match(r"[\s:+\-'!]*([A-Za-z]+)", line)
        if name and COMMANDS.search(name.group(1)):
            raise ReadOnlyError(f"only queries are allowed, not {name.group(1)}")
    own = {n.lower() for n in re.findall(r"CTE \[([^\]]*)\]", plan) for n in re.split(r",\s*", n)}
    for m in re.finditer(r"UnresolvedRelation \[([^\]]*)\]", plan):
        parts = [p.strip().lower() for p in m.group(1).split(",")]
        if len(parts) > 1 or (parts[0] not in VIEWS and parts[0] not in own):
            raise ReadOnlyError(f"only the tables of the store can be read, not {'.'.join(parts)}")
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text).replace("`", "")
    called = [m.group(1) for m in BARRED.finditer(bare)]
    if called or "UnresolvedTableValuedFunction" in plan and not re.search(r"UnresolvedTableValuedFunction \[?(range|explode|posexplode|inline|variant_explode|json_tuple|stack)\b", plan):
        raise ReadOnlyError(f"{(called or ['a table function'])[0]} isn't allowed")


def sql(frames: LineageFrames, text: str, params: list | tuple = ()) -> DataFrame:
    """A query over config, node, edge, metadata, chunk, chunk_feature, artifact and artifact_chunk;
    ``?`` stands for the parameters in turn.  Views of the session that have one of these names are
    back in place afterwards."""
    _guard(frames, text)
    spark, kept = frames.spark, {}
    for name in VIEWS:
        if spark.catalog.tableExists(name):
            kept[name] = spark.table(name)
        frames.table(name).createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=list(params) or None)
    finally:
        for name in VIEWS:
            spark.catalog.dropTempView(name)
        for name, view in kept.items():
            view.createOrReplaceTempView(name)
