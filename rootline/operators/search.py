"""The search bar: terms split at white space, all of which a node has to meet.

``key=value`` compares as ``find`` does, the value read as true, false, a number or text.  ``key>v``
and the like compare numbers only, columns and metadata alike.  Anything else is looked for in the
id, the step type and the JSON text of searchable metadata, ASCII letters in any case; ``%`` and ``_``
are wildcards.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootline.frames import LineageFrames
from rootline.operators.find import find
from rootline.schema import STRUCTURAL

TERM = re.compile(r"([A-Za-z_]\w*)(<=|>=|=|<|>)(.+)")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def parse_value(text: str):
    """The value that a typed text stands for."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def like(column: Column, term: str) -> Column:
    """``column`` contains ``term`` but for the case of ASCII letters; % and _ are wildcards."""
    pattern = re.escape(term.translate(str.maketrans(UPPER, LOWER))).replace("%", ".*").replace("_", ".")
    return F.translate(column, UPPER, LOWER).rlike(f"(?s){pattern}")


def term_ids(frames: LineageFrames, term: str) -> DataFrame:
    """(node_id) of the nodes that meet one term."""
    if not (m := TERM.fullmatch(term)):
        nodes = frames.node.where(like(F.col("node_id"), term) | like(F.col("step_type"), term)).select("node_id")
        told = frames.metadata.where(F.col("searchable") & like(F.col("value"), term)).select("node_id")
        return nodes.union(told).distinct()
    key, sign, text = m.groups()
    if sign == "=":
        return find(frames, **{key: parse_value(text)}).select("node_id")
    bound = parse_value(text)
    if isinstance(bound, bool | str):
        return frames.node.where(F.lit(False)).select("node_id")
    if key in STRUCTURAL:
        if STRUCTURAL[key] not in (int, float):
            return frames.node.where(F.lit(False)).select("node_id")
        return frames.node.where(COMPARE[sign](F.col(key), F.lit(float(bound)))).select("node_id")
    return frames.metadata.where(F.col("searchable") & (F.col("key") == key) & COMPARE[sign](F.col("num_value"), F.lit(float(bound)))).select("node_id")


def search(frames: LineageFrames, query: str) -> DataFrame:
    """The nodes that meet every term of a query; all nodes for an empty one."""
    return reduce(lambda nodes, term: nodes.join(term_ids(frames, term), "node_id", "left_semi"), query.split(), frames.node)


def search_page(frames: LineageFrames, query: str) -> DataFrame:
    """The page's own grammar: lower case, terms split at commas too, ``:`` for ``=``, and fields and
    values that need only contain what is typed."""
    nodes = frames.node
    text = F.lower(F.coalesce(F.nullif(F.get_json_object("value", "$"), F.lit("null")), F.lit("null")))
    told = frames.metadata.where("searchable").select("node_id", F.lower("key").alias("key"), text.alias("text"))
    for term in re.split(r"[\s,]+", query.lower().strip()):
        if not term:
            continue
        if m := re.fullmatch(r"([^=:<>]+)(<=|>=|=|:|<|>)(.+)", term):
            key, sign, value = m.groups()
            named = told.where(F.contains("key", F.lit(key)))
            if sign in "=:":
                hits = named.where(F.contains("text", F.lit(value)))
            else:
                head = F.regexp_extract("text", r"^\s*([-+]?\d*\.?\d+(?:e[-+]?\d+)?)", 1).try_cast("double")
                bound = parse_value(value)
                hits = named.where(COMPARE[sign](head, F.lit(float(bound)))) if isinstance(bound, int | float) else named.where(F.lit(False))
            nodes = nodes.join(hits.select("node_id"), "node_id", "left_semi")
        else:
            hits = told.where(F.contains("key", F.lit(term)) | F.contains("text", F.lit(term))).select("node_id")
            own = frames.node.where(F.contains(F.lower("node_id"), F.lit(term)) | F.contains(F.lower("step_type"), F.lit(term))).select("node_id")
            nodes = nodes.join(hits.union(own).distinct(), "node_id", "left_semi")
    return nodes
