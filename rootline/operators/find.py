"""Filters over nodes: structural columns, metadata, parents, predicates, artifact names.

Matches are ids in order of creation.  Numbers compare by ``num_value``, everything else by canonical
JSON text; only searchable metadata is compared.  All metadata equalities of a call are answered by
one pass and one shuffle over the metadata table.
"""

from __future__ import annotations

import fnmatch
import json
import re
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootline.frames import LineageFrames
from rootline.functions.encode import canonical, number
from rootline.schema import STRUCTURAL
from rootline.session import materialize

ORDER = ["created_epoch_seconds", "node_id"]


def as_id(node) -> str | None:
    """The id of a node, a handle or an id; None and the word none give None."""
    found = getattr(node, "node_id", node)
    return None if found is None or str(found).lower() == "none" else str(found)


def _column_equals(name: str, value) -> Column:
    column, kind = F.col(name), STRUCTURAL[name]
    if value is None:
        return column.isNull()
    if kind is str:
        return column == (str(int(value)) if isinstance(value, bool) else str(value)) if not isinstance(value, float) else F.lit(False)
    try:
        wanted = float(value)
    except (TypeError, ValueError):
        return F.lit(False)
    if wanted != wanted:
        return F.lit(False)
    return (column.cast("int") if kind is bool else column) == F.lit(wanted)


def _metadata_equals(key: str, value) -> Column:
    here = F.col("searchable") & (F.col("key") == key)
    found = number(value)
    if found is not None:
        return here & (F.col("num_value") == found)
    if isinstance(value, float):  # NaN equals nothing
        return F.lit(False)
    return here & (F.col("value") == canonical(value))


def parents(frames: LineageFrames) -> DataFrame:
    """(node_id, parents): the ordered parents of each node that has any."""
    held = F.array_sort(F.collect_list(F.struct("ordinal", "parent_id")))
    return frames.edge.groupBy(F.col("child_id").alias("node_id")).agg(F.transform(held, lambda x: x["parent_id"]).alias("parents"))


def find(frames: LineageFrames, _errors: list[DataFrame] | None = None, **filters) -> DataFrame:
    """The nodes that pass all filters, as rows of ``node``, unordered; see ``ordered``.

    A filter names a column or a metadata key (or ``parent_id``); its value is a value to equal, or a
    callable that gets the stored value.  Callables run last, on what the other filters leave; what
    they raise is added to ``_errors`` as a table (node_id, error, name), see ``warn_of``.
    """
    nodes, equal, calls = frames.node, {}, []
    for name, value in filters.items():
        if callable(value):
            calls.append((name, value))
        elif name == "parent_id":
            if value is None:
                raise TypeError("parent_id is an id, a node or a list of them; [] finds roots")
            wanted = [as_id(v) for v in (value if isinstance(value, list | tuple) else [value])]
            listed = F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<string>")
            nodes = nodes.join(parents(frames), "node_id", "left").where(F.coalesce("parents", F.array().cast("array<string>")) == listed).drop("parents")
        elif name in STRUCTURAL:
            nodes = nodes.where(_column_equals(name, value))
        else:
            equal[name] = _metadata_equals(name, value)
    if equal:
        any_of = F.lit(False)
        for condition in equal.values():
            any_of = any_of | condition
        hits = frames.metadata.where(any_of)
        if len(equal) > 1:
            hits = hits.groupBy("node_id").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(equal))
        nodes = nodes.join(hits.select("node_id"), "node_id", "left_semi")
    for name, call in calls:
        nodes = _predicate(frames, nodes, name, call, _errors)
    return nodes


def _predicate(frames: LineageFrames, nodes: DataFrame, name: str, call: Callable, errors: list[DataFrame] | None = None) -> DataFrame:
    """Nodes whose stored value a Python callable accepts, evaluated in Arrow batches.

    A node without the key, or whose value isn't searchable, is asked with None.  Where the callable
    raises, the node doesn't match.
    """
    if name == "parent_id":
        asked = nodes.join(parents(frames), "node_id", "left").select("node_id", F.to_json(F.coalesce("parents", F.array().cast("array<string>"))).alias("v"))
    elif name in STRUCTURAL:
        asked = nodes.select("node_id", F.to_json(F.struct(F.col(name).alias("v"))).alias("v"))
    else:
        values = frames.metadata.where(F.col("searchable") & (F.col("key") == name)).select("node_id", F.col("value").alias("v"))
        asked = nodes.select("node_id").join(values, "node_id", "left")
    wrapped = name in STRUCTURAL

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["v"]:
                value = json.loads(text) if isinstance(text, str) else None
                try:
                    out.append((bool(call(value.get("v") if wrapped else value)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((False, repr(e)[:200]))
            yield pd.DataFrame({"node_id": batch["node_id"], "hit": [h for h, _ in out], "error": [e for _, e in out]})

    judged = asked.mapInPandas(run, "node_id string, hit boolean, error string")
    if errors is not None:
        judged = materialize(judged.where("hit or error is not null"), "judged")  # asked once
        errors.append(judged.where("error is not null").select("node_id", "error", F.lit(name).alias("name")))
    return nodes.join(judged.where("hit").select("node_id"), "node_id", "left_semi")


def warn_of(errors: list[DataFrame]) -> None:
    """Warn once for each predicate that raised, with the error on the node of the least id."""
    for table in errors:
        if (r := table.orderBy("node_id").first()) is not None:
            warnings.warn(f"the predicate for {r['name']!r} failed on node {r.node_id}: {r.error}", UserWarning, stacklevel=3)


def ordered(nodes: DataFrame) -> DataFrame:
    """In order of creation, ties by id."""
    return nodes.orderBy(*ORDER)


def latest(nodes: DataFrame) -> DataFrame:
    """The newest of the nodes, the largest id among ties; at most one row."""
    return nodes.orderBy(*[F.desc_nulls_last(c) for c in ORDER]).limit(1)


def _name_pattern(name: str) -> str:
    pattern = name if any(c in name for c in "*?[") else f"*{name}*"
    regex = "/".join(fnmatch.translate(p)[len("(?s:") : -len(")\\Z")] for p in pattern.strip("/").split("/"))
    regex = regex.replace(".*", "[^/]*").replace("(?>[^/]*", "(?:[^/]*")
    return f"(^|/){regex}$"


def name_matches(name: str) -> Column:
    """Whether ``relpath`` answers a name: a pattern with wildcards matches from the right, path part
    by path part; a plain text anywhere in the file name; in either case the text may also be part
    of the file name in any case."""
    base = F.lower(F.element_at(F.split("relpath", "/"), -1))
    return F.contains(base, F.lit(name.lower())) | F.col("relpath").rlike(_name_pattern(name))


def name_matcher(name: str) -> Callable[[str], bool]:
    """``name_matches`` for single paths."""
    regex, part = re.compile(_name_pattern(name)), name.lower()
    return lambda relpath: part in relpath.rsplit("/", 1)[-1].lower() or regex.search(relpath) is not None


def artifacts(frames: LineageFrames, name: str = "*", nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, relpath, size, sha256) of the artifacts that answer a name."""
    files = frames.artifact.where(name_matches(name))
    return files if nodes is None else files.join(nodes.select("node_id"), "node_id", "left_semi")


def parent_artifacts(frames: LineageFrames, name: str = "*") -> DataFrame:
    """(node_id, parent_no, parent_id, relpath, size): what each node's parents hold under a name."""
    edge = frames.edge.select(F.col("child_id").alias("node_id"), "parent_id", F.col("ordinal").alias("parent_no"))
    held = artifacts(frames, name).withColumnRenamed("node_id", "parent_id")
    return edge.join(held, "parent_id").select("node_id", "parent_no", "parent_id", "relpath", "size")


def records(frames: LineageFrames, nodes: DataFrame) -> DataFrame:
    """Nodes with their ordered parents and a provenance struct."""
    provenance = F.struct(*[F.col(f"prov_{p}").alias(p) for p in ("user", "python", "platform", "git_commit", "git_branch", "git_dirty")])
    held = nodes.join(parents(frames), "node_id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    return held.select("node_id", "step_type", "generation", "parents", "created_utc", "created_epoch_seconds", "healthy", "duration_seconds", "size_bytes", "content_hash", provenance.alias("provenance"))
