"""Deeply nested JSON into flat related tables.

1. ``infer`` merges what all rows hold into one schema: a tree of members and array levels, with the
   levels that hold objects marked.  Every task merges its own rows, tasks are merged in stages.
2. ``shred`` explodes the array levels of that schema, each level from the rows of the one above:
   an element of an array becomes a row of the table of its level, with ``path`` as its surrogate key
   within the source row, ``parent_path`` as the key of the nearest enclosing object that is itself
   such a row, and ``ordinal`` as its place in its array.  Branches that the schema shows to hold no
   array are not entered.  All levels of a value are exploded while it is parsed, so the data is read
   once and nothing is shuffled, however many levels there are.
3. ``schema`` and ``tables`` type the columns of each table (a column of several types is JSON text).

Nothing is lost: objects, scalars and arrays that are elements all are rows (``kind`` object, value or
array).  Members that are objects belong to the row of the object around them, as columns named
``outer.inner``, dots and backslashes within a name being escaped by a backslash; a member that is an
array, or an empty object, is marked by ``[]`` or ``{}``, its elements being rows of their own.

A path is ``$``, then ``.name`` for a member (name as written) and ``[i]`` for an element.  Levels name
arrays in the same way with ``[]`` for any element, dots, brackets and backslashes of names escaped.

Defined results: a value that is a JSON string holding the JSON of an object or array is read as
that; bare NaN is allowed; null, scalars and anything that is not valid JSON (trailing text,
Infinity, single quotes, cut off) make no row; neither depth nor the length of a number is limited;
of a name that an object holds twice the last counts; equal rows of the source give equal rows here,
which ``distinct`` unites.  Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootline.functions.labels import label

#: Tables and columns that a merged schema may have; ``tables`` refuses a larger one, as names that are
#: data (ids as member names) do not make a schema.
MAX_COLUMNS = 100_000

#: Places that an inferred schema may have to be sent to every task.  A larger one guides nothing: all
#: branches are entered then, which gives the same rows.
MAX_PLACES = 200_000

#: Tasks that merge the schemas of all others before the driver does.
MERGERS = 16

#: Rows and characters of paths that a batch of results holds.
BATCH_ROWS, BATCH_CHARS = 20_000, 32_000_000

#: Digits up to which an integer is read as one; Python refuses to convert more than 4,300.
INT_DIGITS = 4_000


def _refuse(name: str):
    if name != "NaN":
        raise ValueError(name)
    return float("nan")


class _Digits(str):
    """An integer of too many digits to convert, as written."""


def _integer(digits: str):
    return int(digits) if len(digits) <= INT_DIGITS else _Digits(digits)


_decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=_integer)
_spaces = re.compile(r"[ \t\n\r]*").match


def _decode_deep(text: str):
    """What the decoder reads, with a stack of its own in place of recursion."""

    def skip(at: int) -> int:
        return _spaces(text, at).end()

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no name at {at}")
        found, at = json.decoder.scanstring(text, at + 1, True)
        if text[(at := skip(at)) : at + 1] != ":":
            raise ValueError(f"no value at {at}")
        return found, skip(at + 1)

    at, around = skip(0), []  # the open containers, each with the name that its next value gets
    while True:
        if (c := text[at : at + 1]) in ("{", "["):
            value = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                member = None
                if c == "{":
                    member, at = name(at)
                around.append((value, member))
                continue
            at += 1
        else:
            try:
                value, at = _decoder.scan_once(text, at)
            except StopIteration:
                raise ValueError(f"no value at {at}") from None
        while around:
            holder, member = around.pop()
            if member is None:
                holder.append(value)
            else:
                holder[member] = value
            at = skip(at)
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = skip(at)
                if member is not None:
                    member, at = name(at)
                around.append((holder, member))
                break
            if c != ("]" if member is None else "}"):
                raise ValueError(f"not closed at {at}")
            value = holder
        else:
            if skip(at) != len(text):
                raise ValueError(f"more text at {at}")
            return value


def _decode(text: str):
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _decode_deep(text)


def parse(value: str | None):
    """The object or array that a value holds, None where it holds none."""
    try:
        found = _decode(value) if value else None
        if isinstance(found, str):
            found = _decode(found)
    except ValueError:
        return None
    return found if isinstance(found, dict | list) else None


def _text(scalar) -> str:
    return str(scalar) if isinstance(scalar, _Digits) else json.dumps(scalar)


def _escaped(name: str) -> str:
    return re.sub(r"([\\.\[\]])", r"\\\1", name) if not name.replace("_", "a").isalnum() else name


def _members(row: dict) -> dict[str, str]:
    """The columns of a row: scalars as JSON text, member objects flattened, marks for arrays and empty
    objects."""
    out, work = {}, [("", row)]
    while work:
        before, level = work.pop()
        for name, item in level.items():
            here = before + _escaped(name)
            if isinstance(item, dict):
                if item:
                    work.append((f"{here}.", item))
                else:
                    out[here] = "{}"
            else:
                out[here] = "[]" if isinstance(item, list) else _text(item)
    return out


class Schema:
    """A tree of places: ``children[place]`` leads on by ``.name`` or ``[]``; place 0 is the value.

    ``objects`` are the array places that have objects for elements, ``arrays`` all of them.
    """

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.up: list[tuple[int, str]] = [(-1, "")]
        self.objects: set[int] = set()

    def place(self, at: int, step: str) -> int:
        """The place that a step leads to, made if need be."""
        found = self.children[at].get(step)
        if found is None:
            found = self.children[at][step] = len(self.up)
            self.children.append({})
            self.up.append((at, step))
        return found

    def add(self, value) -> None:
        """Merge what a value holds."""
        work = [(value, 0)]
        while work:
            at, here = work.pop()
            if isinstance(at, dict):
                work += [(item, self.place(here, "." + name)) for name, item in at.items() if isinstance(item, dict | list)]
            else:
                inner = self.place(here, "[]")
                for item in at:
                    if isinstance(item, dict):
                        self.objects.add(inner)
                        work.append((item, inner))
                    elif isinstance(item, list):
                        work.append((item, inner))

    def rows(self) -> tuple[list[int], list[str], list[bool]]:
        """The places but the first: where each hangs, its step, whether it has objects for elements."""
        return [u for u, _ in self.up[1:]], [s for _, s in self.up[1:]], [i in self.objects for i in range(1, len(self.up))]

    def merge(self, ups: list[int], steps: list[str], objects: list[bool]) -> None:
        """Add the rows of another schema."""
        own = [0]
        for up, step, held in zip(ups, steps, objects, strict=True):
            own.append(here := self.place(own[up], step))
            if held:
                self.objects.add(here)

    def guide(self, full: bool) -> list[dict[str, int]]:
        """``children`` without branches that lead to no array (of objects, unless ``full``)."""
        leads = [i in self.objects or (full and step == "[]") for i, (_, step) in enumerate(self.up)]
        for i in range(len(self.up) - 1, 0, -1):
            if leads[i]:
                leads[self.up[i][0]] = True
        return [{s: c for s, c in held.items() if leads[c]} for held in self.children]


def walk(value, guide: list[dict[str, int]] | None = None, full: bool = True) -> Iterator[tuple[str, str, str | None, str, int | None, object]]:
    """(kind, path, parent_path, level, ordinal, item) of the elements of all arrays, level below
    level; only objects unless ``full``.  The outermost object, or in full the outermost array, comes
    first.  ``guide`` says where arrays lie; without it all branches are entered."""
    if isinstance(value, dict) or full:
        yield "object" if isinstance(value, dict) else "array", "$", None, "$", None, value
    # below the owner's row, the steps to a container are linked and joined only where rows need them
    work = [(value, "$", "$", None, 0)]
    while work:
        at, owner, level, steps, place = work.pop()
        onward = guide[place] if guide else None
        if isinstance(at, dict):
            if onward is None:
                work += [(item, owner, level, (steps, f".{name}", f".{_escaped(name)}"), 0) for name, item in at.items() if isinstance(item, dict | list)]
            else:
                for step, below in onward.items():
                    if step[0] == "." and isinstance(item := at.get(name := step[1:]), dict | list):
                        work.append((item, owner, level, (steps, step, f".{_escaped(name)}"), below))
            continue
        below = 0
        if onward is not None and (below := onward.get("[]", -1)) < 0:
            continue
        before = None
        for i, item in enumerate(at):
            kind = "object" if isinstance(item, dict) else "array" if isinstance(item, list) else "value"
            if kind == "object" or full:
                if before is None:
                    parts, back = [], steps
                    while back:
                        parts.append(back)
                        back = back[0]
                    before = owner + "".join(p[1] for p in reversed(parts))
                    inner = f"{level}{''.join(p[2] for p in reversed(parts))}[]"
                here = f"{before}[{i}]"
                yield kind, here, owner, inner, i, item
            if kind == "object":
                work.append((item, here, inner, None, below))
            elif kind == "array":
                work.append((item, owner, level, (steps, f"[{i}]", "[]"), below))


TREE = "ups array<int>, steps array<string>, objects array<boolean>"


def _tree_batch(found: Schema) -> pa.RecordBatch:
    columns = [pa.array([x], t) for x, t in zip(found.rows(), (pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_())), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["ups", "steps", "objects"])


def _nested(rows: DataFrame, value: str) -> DataFrame:
    """The rows that may hold an object or array."""
    text = F.col(value)
    held = text.rlike(r"^\s*[\[{]") | (text.rlike(r'^\s*"') & (F.contains(text, F.lit("{")) | F.contains(text, F.lit("[")) | F.contains(text, F.lit("\\u"))))
    return rows.where(held)


def infer(rows: DataFrame, value: str = "value") -> Schema | None:
    """The merged schema of all values; None if it has more than ``MAX_PLACES`` places."""
    most = MAX_PLACES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Schema()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (found := parse(text)) is not None and len(own.up) <= most:
                    own.add(found)
        yield _tree_batch(own)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Schema()
        for batch in batches:
            for r in batch.to_pylist():
                if len(own.up) <= most:
                    own.merge(r["ups"], r["steps"], r["objects"])
        yield _tree_batch(own)

    whole = Schema()
    for r in _nested(rows, value).select(F.col(value)).mapInArrow(build, TREE).repartition(MERGERS).mapInArrow(merge, TREE).collect():
        if len(whole.up) <= most:
            whole.merge(r.ups, r.steps, r.objects)
    return whole if len(whole.up) <= most else None


def _shredder(n_keys: int, columns: bool, schema: pa.Schema, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guide = None
        if shared is not None:
            tree = Schema()
            tree.merge(*shared.value)
            guide = tree.guide(columns)
        out: list[list] = [[] for _ in schema]
        chars = 0
        for batch in batches:
            for *keys, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = parse(value)
                if found is None:
                    continue
                for kind, path, parent, level, ordinal, item in walk(found, guide, columns):
                    if columns:
                        members = _members(item) if kind == "object" else {"": _text(item)} if kind == "value" else {}
                        made = (*keys, path, parent, level, ordinal, kind, list(members.items()))
                    else:
                        made = (*keys, path, parent)
                    for held, x in zip(out, made, strict=True):
                        held.append(x)
                    chars += len(path) + len(level)
                    if len(out[0]) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
                        out, chars = [[] for _ in schema], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def shred(rows: DataFrame, keys: tuple[str, ...] = ("node_id", "key"), value: str = "value", columns: bool = True) -> DataFrame:
    """(*keys, path, parent_path, level, ordinal, kind, members): all rows of all tables.

    ``members`` maps column names to JSON texts; an element that is a scalar has it under the empty
    name.  The row of the value itself has the path ``$`` and no parent.  Without ``columns`` only
    (*keys, path, parent_path) of objects is made.
    """
    found = infer(rows, value)
    shared = rows.sparkSession.sparkContext.broadcast(found.rows()) if found is not None else None
    named = _nested(rows, value).select(*[label(F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("value"))
    fields = [pa.field(f"k{i}", pa.string()) for i in range(len(keys))] + [pa.field("path", pa.string()), pa.field("parent_path", pa.string())]
    ddl = ", ".join([*[f"k{i} string" for i in range(len(keys))], "path string, parent_path string"])
    if columns:
        fields += [pa.field("level", pa.string()), pa.field("ordinal", pa.int32()), pa.field("kind", pa.string()), pa.field("members", pa.map_(pa.string(), pa.string()))]
        ddl += ", level string, ordinal int, kind string, members map<string,string>"
    out = named.mapInArrow(_shredder(len(keys), columns, pa.schema(fields), shared), ddl)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[f.name for f in fields[len(keys) :]])


def schema(shredded: DataFrame) -> DataFrame:
    """(level, name, col_type, n_rows): the columns of each table.  Types are boolean, long, double,
    string, array and object (marks only) and json; an empty name stands for elements that are
    scalars; null members don't count for the type; long and double merge to double, all else that
    differs to json."""
    text = F.col("text")
    kind = (
        F.when(text == "null", None)
        .when(text.isin("true", "false"), "boolean")
        .when(text.rlike(r"^-?\d{1,18}$"), "long")
        .when(text.rlike(r"^-?\d") | (text == "NaN"), "double")
        .when(text.startswith('"'), "string")
        .when(text == "[]", "array")
        .when(text == "{}", "object")
        .otherwise("json")
    )
    each = shredded.select("level", F.explode("members").alias("name", "text")).select("level", "name", kind.alias("kind"))
    merged = each.groupBy("level", "name").agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    kinds = F.col("kinds")
    col_type = F.when(F.size(kinds) == 0, "string").when(F.size(kinds) == 1, kinds[0]).when(kinds == F.array(F.lit("double"), F.lit("long")), "double").otherwise("json")
    return merged.select("level", "name", col_type.alias("col_type"), "n_rows")


def tables(shredded: DataFrame, keys: tuple[str, ...] = ("node_id", "key")) -> dict[str, DataFrame]:
    """{level: table} with columns *keys, path, parent_path, ordinal, kind and the typed members.

    The merged schema (names only, at most ``MAX_COLUMNS``) is read to the driver, since it defines
    the tables; a larger one is refused.  Members are named ``m.<name>`` so that they can't clash with
    the keys; elements that are scalars stand in ``element``.
    """
    merged = schema(shredded).limit(MAX_COLUMNS + 1).collect()
    held = shredded.select("level").distinct().limit(MAX_COLUMNS + 1).collect()
    if max(len(merged), len(held)) > MAX_COLUMNS:
        raise ValueError(f"the merged schema has more than {MAX_COLUMNS} tables or columns")
    levels: dict[str, list] = {r.level: [] for r in held}
    for r in sorted(merged, key=lambda r: (r.level, r.name)):
        text = F.col("members")[r.name]
        text = F.nullif(text, F.lit("null"))
        value = {
            "boolean": text.cast("boolean"),
            "long": text.try_cast("bigint"),
            "double": text.try_cast("double"),
            "string": F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"),
        }.get(r.col_type, text)
        levels[r.level].append(value.alias(f"m.{r.name}" if r.name else "element"))
    return {level: shredded.where(F.col("level") == level).select(*keys, "path", "parent_path", "ordinal", "kind", *values) for level, values in sorted(levels.items())}


def elements(rows: DataFrame, keys: tuple[str, ...] = ("node_id", "key"), value: str = "value") -> DataFrame:
    """(*keys, path, parent_path): the distinct objects that are elements of an array."""
    return shred(rows, keys, value, columns=False).where("parent_path is not null").select(*keys, "path", "parent_path").distinct()
