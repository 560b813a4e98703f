"""Attribute-value rows into one wide row per entity.

The reshaping is log structured.  A batch of (entity, attribute, value) rows becomes a *delta*: one
sparse wide row per entity, each cell holding the version it was written at and what is needed to
tell whether its rows agree.  Deltas are sorted runs; ``compact`` merges any number of runs, the
latest version of each cell winning.  Merging is associative and commutative, so batches may be
folded in any order, run by run or all at once, and late rows need no special care.

A row *gives* the JSON text in ``value``, or ``num_value`` where ``value`` is null.  JSON null, bare
NaN and blank text give nothing.  What a given value reads as depends on the column type:

* ``double``, ``long``: a JSON number, or text that is one decimal number; for long a whole one
  within the type's range.
* ``boolean``: true/false, yes/no, 1/0, as JSON or as text in any case.
* ``timestamp``: ISO 8601 text (a blank may stand for T; no zone means UTC) or epoch seconds.
* ``string``: a JSON string.

White space around text doesn't count.  Anything else is given but unreadable.

Defined results: rows whose entity or attribute is null or blank, or whose attribute the catalog
lacks, are left out; repeated rows change nothing; an empty batch is an empty run; other columns of
the input are ignored, whatever their names.  Two rows of the same version are ordered by value.
"""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootline.functions.labels import label, strip

#: A catalog becomes columns, so it has to fit a schema; a larger one is refused.
MAX_ATTRIBUTES = 10_000

#: Rows of a batch, when files are read in order of arrival.
BATCH_ROWS = 100_000

#: Files whose numbers are sent to every task (some 100 bytes each).
BROADCAST_FILES = 100_000

COLUMN_TYPES = {"double": T.DoubleType(), "long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType(), "timestamp": T.TimestampType()}

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Texts that need no parser: JSON numbers and strings without escapes, short whole numbers, and
#: instants in the one form that a cast reads.
PLAIN_NUMBER = r"^[ \t\n\r]*-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?[ \t\n\r]*$"
PLAIN_STRING = r'^[ \t\n\r]*"[^"\\\x00-\x1f]*"[ \t\n\r]*$'
PLAIN_WHOLE = r"^-?\d{1,18}$"
PLAIN_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"
DIGITS = r"^[+-]?(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$"
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
#: Name of the end mark, see ``given``.
END = "endOfGivenValue"


def read_catalog(catalog: DataFrame, attr: str = "attr", col_type: str = "col_type") -> dict[str, str]:
    """The catalog as {attribute: type}.  It defines the schema, so it is read to the driver, at
    most ``MAX_ATTRIBUTES`` rows of it."""
    rows = catalog.select(label(F.col(attr)).alias("a"), label(F.col(col_type)).alias("t")).where("a is not null").distinct().limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"a catalog of more than {MAX_ATTRIBUTES} attributes does not make a table")
    found: dict[str, str] = {}
    for r in rows:
        if r.t not in COLUMN_TYPES:
            raise ValueError(f"{r.a}: no column type {r.t!r}")
        if found.setdefault(r.a, r.t) != r.t:
            raise ValueError(f"{r.a}: two column types")
    return dict(sorted(found.items()))


def arrivals(rows: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Rows read from files, with ``version`` and ``batch`` (long) by order of arrival: the number of
    the file by its path, then the position in it.  A batch is at most ``batch_rows`` rows of a file.

    File numbers reach the rows by a join, a broadcast of up to ``BROADCAST_FILES`` of them.
    """
    spark = rows.sparkSession
    files = spark.createDataFrame([(i, re.sub("^([a-z0-9]+):/+", r"\1:/", f)) for i, f in enumerate(sorted(rows.inputFiles()))], "_file long, _path string")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")
    files = F.broadcast(files) if len(rows.inputFiles()) <= BROADCAST_FILES else files
    placed = rows.withColumns({"_path": path, "_row": F.col("_metadata.row_index")}).join(files, "_path", "left")
    placed = placed.withColumn("_file", F.coalesce("_file", F.raise_error(F.concat(F.lit("no number for "), F.col("_path"))).cast("long")))
    # 2**40 rows of one file, 2**23 files
    return placed.withColumns({"version": F.shiftleft(F.col("_file"), 40) + F.col("_row"), "batch": F.shiftleft(F.col("_file"), 40) + F.floor(F.col("_row") / batch_rows)}).drop("_file", "_path", "_row")


def _instant(text: Column) -> Column:
    """Microseconds since the epoch of an ISO 8601 text, as text; null for anything else."""
    day, clock, zone = (F.regexp_extract(text, ISO, i) for i in (1, 2, 3))
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(F.replace(clock, F.lit(","), F.lit(".")))
    hours, minutes = F.regexp_extract(zone, r"^([+-]\d{2})", 1), F.regexp_extract(zone, r"(\d{2})$", 1)
    zone = F.when(zone.isin("", "Z"), "Z").when(F.length(zone) == 3, F.concat(zone, F.lit(":00"))).otherwise(F.concat(hours, F.lit(":"), minutes))
    at = F.try_to_timestamp(F.concat(day, F.lit("T"), clock, zone))
    return F.unix_micros(at).cast("string")


def _whole(number: Column) -> Column:
    """Whether a decimal number as text is whole, by its digits: none but zeros after the point, once
    the exponent has moved it."""
    before, after, exponent = (F.regexp_extract(number, DIGITS, i) for i in (1, 2, 3))
    held = F.length(F.rtrim(F.concat(before, after), F.lit("0")))
    moved = F.when(exponent == "", 0).otherwise(F.coalesce(exponent.try_cast("int"), F.lit(-(2**31)))).cast("bigint")
    return (held == 0) | (held <= F.length(before) + moved)


def readings(given: DataFrame) -> DataFrame:
    """Add ``val``, the canonical text of what a row gives under its ``col_type``, to rows with
    ``kind`` (number, boolean, string or other) and ``text``; null where it can't be read.  Equal
    values have equal canonical texts.

    Each step is a projection of its own, so that no costly expression is evaluated twice.
    """
    kind, col_type = F.col("kind"), F.col("col_type")
    numeric = (kind == "number") | (kind == "string") & F.col("text").rlike(NUMBER)
    steps = given.withColumn("_number", F.when(col_type.isin("double", "long", "boolean", "timestamp") & (kind != "boolean") & (kind != "other") & numeric, F.col("text")))
    steps = steps.withColumn("_short", F.when(col_type == "long", F.coalesce(F.col("_number").rlike(PLAIN_WHOLE), F.lit(False))))
    wide = (col_type == "long") & ~F.col("_short")
    instant = (col_type == "timestamp") & (kind == "string")
    plain = F.col("text").rlike(PLAIN_INSTANT)
    steps = steps.withColumns({
        "_double": F.when(col_type != "long", F.col("_number").try_cast("double")),
        "_exact": F.when(wide & F.col("_number").rlike(NUMBER), F.when(_whole(F.col("_number")), F.col("_number").try_cast("decimal(38,12)"))),
        "_word": F.when(col_type == "boolean", F.lower("text")),
        "_instant": F.when(instant & plain, F.unix_micros(F.col("text").try_cast("timestamp")).cast("string")).when(instant & F.col("text").rlike(ISO), _instant(F.col("text"))),
    })
    text, number = F.col("kind") == "string", F.col("kind") == "number"
    truth = F.when((text & F.col("_word").isin("true", "yes", "1")) | (F.col("_word") == "true") | (number & (F.col("_double") == 1)), "true")
    truth = truth.when((text & F.col("_word").isin("false", "no", "0")) | (F.col("_word") == "false") | (number & (F.col("_double") == 0)), "false")
    whole = F.when(F.col("_short"), F.col("_number").try_cast("bigint")).otherwise(F.col("_exact").try_cast("bigint"))
    value = (
        F.when(F.col("col_type") == "double", F.when(F.abs("_double") < float("inf"), (F.col("_double") + F.lit(0.0)).cast("string")))
        .when(F.col("col_type") == "long", whole.cast("string"))
        .when(F.col("col_type") == "boolean", F.when(F.col("kind") != "other", truth))
        .when(F.col("col_type") == "timestamp", F.coalesce(F.col("_instant"), F.when(number, F.round(F.col("_double") * 1e6).try_cast("bigint").cast("string"))))
        .when(text, F.col("text"))
    )
    return steps.withColumn("val", value).drop("_number", "_short", "_double", "_exact", "_word", "_instant")


def typed(canonical: Column, col_type: str) -> Column:
    """A canonical text as a value of the column type."""
    if col_type == "timestamp":
        return F.timestamp_micros(canonical.cast("bigint"))
    return canonical.cast(COLUMN_TYPES[col_type])


def with_given(rows: DataFrame) -> DataFrame:
    """Add the ``kind`` and ``text`` of what a row gives by its ``value`` and ``num_value``; a null
    kind gives nothing.

    Texts that are a plain JSON number, string or truth value are told by their form.  Others are
    parsed inside an object with an end mark, since the parser would otherwise ignore whatever
    follows a complete value.
    """
    value, raw, easy = F.col("value"), F.col("_raw"), F.col("_easy")
    form = (
        F.when(value.isNull(), "none")
        .when(value.rlike(PLAIN_NUMBER), "number")
        .when(value.rlike(PLAIN_STRING), "string")
        .when(raw.isin("true", "false"), "boolean")
        .when(raw.isin("", "NaN", "null"), "nothing")
    )
    told = rows.withColumn("_raw", strip(value)).withColumn("_easy", form)
    parsed = told.withColumn("_parsed", F.when(easy.isNull(), F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit(f',"{END}":1}}')))))
    whole = F.try_variant_get("_parsed", f"$.{END}", "int").isNotNull()
    shaped = parsed.withColumn("_shape", F.when(easy.isNull(), F.when(whole, F.schema_of_variant(F.try_variant_get("_parsed", "$.v", "variant")))))
    inner = F.when(easy == "string", F.expr("substring(_raw, 2, length(_raw) - 2)")).when(F.col("_shape") == "STRING", F.try_variant_get("_parsed", "$.v", "string"))
    shaped = shaped.withColumn("_text", F.when((easy == "string") | (F.col("_shape") == "STRING"), strip(inner)).otherwise(raw))
    kind = (
        F.when(easy == "none", F.when(F.col("num_value").isNotNull() & ~F.isnan("num_value"), "number"))
        .when(easy == "nothing", None)
        .when((easy == "string") | (F.col("_shape") == "STRING"), F.when(F.col("_text") != "", "string"))
        .when(easy.isNotNull(), easy)
        .when(F.col("_shape") == "BOOLEAN", "boolean")
        .when(F.col("_shape").isin("BIGINT", "DOUBLE") | F.col("_shape").startswith("DECIMAL"), "number")
        .otherwise("other")
    )
    text = F.when(value.isNull(), F.col("num_value").cast("string")).otherwise(F.col("_text"))
    return shaped.withColumns({"kind": kind, "text": text}).drop("_raw", "_easy", "_parsed", "_shape", "_text")


def cells(rows: DataFrame, catalog: dict[str, str], version: Column, batch: Column | None = None, entity: str = "node_id", attr: str = "key", value: str = "value", num_value: str = "num_value") -> DataFrame:
    """(batch, entity, attr, cell): the rows of each cell of a batch, folded into one state.

    A state is struct(latest struct(ver, val), lo, hi): the latest readable value and the extremes
    of the readable ones, all null where a value was given but none can be read.
    """
    types = F.create_map(*[F.lit(x) for pair in catalog.items() for x in pair]) if catalog else F.lit(None).cast("map<string,string>")
    flat = (
        rows.select((batch if batch is not None else F.lit("")).alias("batch"), label(F.col(entity)).alias("entity"), label(F.col(attr)).alias("attr"), version.alias("ver"), F.col(value).cast("string").alias("value"), F.col(num_value).cast("double").alias("num_value"))
        .where(F.col("attr").isin(list(catalog)) & F.col("entity").isNotNull())
        .withColumn("col_type", types[F.col("attr")])
    )
    # rows that give nothing are dropped after the aggregation: a filter on ``kind`` would be pushed below
    # the steps that lead to it and repeat them all
    flat = readings(with_given(flat))
    state = F.struct(F.max(F.when(F.col("val").isNotNull(), F.struct("ver", "val"))).alias("latest"), F.min("val").alias("lo"), F.max("val").alias("hi"))
    return flat.groupBy("entity", "attr", "batch").agg(state.alias("cell"), F.count("kind").alias("n")).where("n > 0").drop("n")


def _widen(folded: DataFrame, catalog: dict[str, str], keys: list[str]) -> DataFrame:
    """One row per key with a column of states per attribute; an entity has at most one entry per
    attribute of the catalog, so its list is bounded by the schema."""
    packed = folded.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("attr", "cell"))).alias("m"))
    return packed.select(*keys, *[F.col("m")[a].alias(a) for a in catalog])


def delta(rows: DataFrame, catalog: dict[str, str], version: Column, batch: Column | None = None, **columns: str) -> DataFrame:
    """The sparse wide rows of one batch, or of each batch where ``batch`` tells them apart.

    The folded cells are partitioned by entity once; widening, and compacting a single delta, group
    within that partitioning and shuffle no more.
    """
    keys = ["entity", "batch"] if batch is not None else ["entity"]
    return _widen(cells(rows, catalog, version, batch, **columns).repartition("entity"), catalog, keys)


def _narrow(run: DataFrame, catalog: dict[str, str]) -> DataFrame:
    """The filled cells of a run as (entity, attr, cell)."""
    if not catalog:
        return run.select("entity", F.lit("").alias("attr"), F.lit(0).alias("cell")).limit(0)
    pairs = F.array(*[F.when(F.col(f"`{a}`").isNotNull(), F.struct(F.lit(a).alias("attr"), F.col(f"`{a}`").alias("cell"))) for a in catalog])
    return run.select("entity", F.explode(F.array_compact(pairs)).alias("x")).select("entity", "x.attr", "x.cell")


def compact(catalog: dict[str, str], *runs: DataFrame) -> DataFrame:
    """Merge runs into one, cell by cell, sorted by entity within its partitions."""
    merged = reduce(DataFrame.unionByName, [_narrow(r, catalog) for r in runs])
    if not catalog:
        return runs[0].select("entity").distinct()
    state = F.struct(F.max("cell.latest").alias("latest"), F.min("cell.lo").alias("lo"), F.max("cell.hi").alias("hi"))
    return _widen(merged.groupBy("entity", "attr").agg(state.alias("cell")), catalog, ["entity"]).sortWithinPartitions("entity")


def unsettled(run: DataFrame, catalog: dict[str, str]) -> DataFrame:
    """(entity, attr, n_readable): cells with a given value but not exactly one readable value;
    n_readable is 0 or 2 (two or more)."""
    state = _narrow(run, catalog)
    if not catalog:
        return state.select("entity", "attr", F.lit(0).alias("n_readable"))
    return state.where("cell.lo is null or cell.lo <> cell.hi").select("entity", "attr", F.when(F.col("cell.lo").isNull(), 0).otherwise(2).alias("n_readable"))


def table(run: DataFrame, catalog: dict[str, str], conflicts: str = "null") -> DataFrame:
    """The typed wide table: entity, a column per attribute, and ``unsettled``, the sorted names of
    the cells that can't be filled with one value.

    Such cells are null, or with ``conflicts="latest"`` hold their latest readable value.
    """
    if conflicts not in ("null", "latest"):
        raise ValueError("conflicts is null or latest")
    torn = {a: F.col(f"`{a}`").isNotNull() & (F.col(f"`{a}`.lo").isNull() | (F.col(f"`{a}`.lo") != F.col(f"`{a}`.hi"))) for a in catalog}
    out = [typed(F.col(f"`{a}`.latest.val"), t) if conflicts == "latest" else F.when(~torn[a], typed(F.col(f"`{a}`.lo"), t)) for a, t in catalog.items()]
    names = F.filter(F.array(*[F.when(torn[a], a) for a in catalog]), lambda x: x.isNotNull()) if catalog else F.array().cast("array<string>")
    return run.select("entity", *[c.alias(a) for c, a in zip(out, catalog, strict=True)], names.alias("unsettled"))


class WideStore:
    """Runs of a wide table in a folder: ``upsert`` appends a delta, ``compact`` merges all runs.

    A run is a folder of Parquet files of a name of its own; ``runs-<n>.txt`` lists those that are
    live, one per line, and the list of the highest number holds.  A list appears whole and only if
    its number is free, so of two writers one has to look again; a reader sees the runs before or
    after a compaction and never both.  Runs that a compaction replaced stay for those who still read
    them, until ``vacuum``.
    """

    def __init__(self, spark, path: str, catalog: dict[str, str]):
        self.spark, self.path, self.catalog = spark, path.rstrip("/"), catalog

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _number(self) -> int:
        p, fs = self._fs("runs-*.txt")
        return max((int(s.getPath().getName()[5:-4]) for s in fs.globStatus(p) or []), default=0)

    def _listed(self, number: int) -> list[str]:
        return [r.value for r in self.spark.read.text(f"{self.path}/runs-{number:06d}.txt").collect() if r.value] if number else []

    def runs(self) -> list[str]:
        """The live runs."""
        return self._listed(self._number())

    def _claim(self, number: int, runs: list[str]) -> bool:
        """Publish a list under a number; False if the number is taken."""
        staged, fs = self._fs(f".{uuid.uuid4().hex}.tmp")
        target, _ = self._fs(f"runs-{number:06d}.txt")
        out = fs.create(staged, False)
        out.write(bytearray("\n".join(runs) + "\n", "utf-8"))
        out.close()
        try:
            if fs.getScheme() != "file":
                return fs.rename(staged, target)  # refuses to replace a file
            files = self.spark._jvm.java.nio.file.Files  # a local rename would replace it, a link doesn't
            paths = [self.spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, staged)]
            try:
                files.createLink(*paths)
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception):
                    return False
                raise
            return True
        finally:
            fs.delete(staged, False)

    def _publish(self, change) -> bool:
        """Publish what ``change`` makes of the live runs; where another writer was first, of what is live
        then.  A change to None is dropped."""
        while True:
            number = self._number()
            if (wanted := change(self._listed(number))) is None:
                return False
            if self._claim(number + 1, wanted):
                return True

    def _write(self, run: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        run.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str]) -> list[DataFrame]:
        schema = T.StructType([T.StructField("entity", T.StringType()), *self.spark.read.parquet(f"{self.path}/{names[0]}").schema.fields[1:]])
        return [self.spark.read.schema(schema).parquet(f"{self.path}/{n}") for n in names]

    def upsert(self, rows: DataFrame, version: Column, **columns: str) -> None:
        """Append the delta of a batch as a sorted run."""
        name = self._write(delta(rows, self.catalog, version, **columns).sortWithinPartitions("entity"))
        self._publish(lambda live: [*live, name])

    def compact(self) -> bool:
        """Replace the live runs by one; runs that arrive meanwhile stay beside it.  Dropped, with
        False, if another compaction was first or there is nothing to merge."""
        if len(old := self.runs()) < 2:
            return False
        name = self._write(compact(self.catalog, *self._read(old)))
        return self._publish(lambda live: [name, *(r for r in live if r not in old)] if set(old) <= set(live) else None)

    def vacuum(self, older_than: float = 7 * 86400) -> int:
        """Delete runs that no list needs any more and whose files are older than so many seconds;
        returns how many."""
        p, fs = self._fs("run-*")
        live, gone = set(self.runs()), 0
        for s in fs.globStatus(p) or []:
            if s.getPath().getName() not in live and s.getModificationTime() < (time.time() - older_than) * 1000:
                gone += fs.delete(s.getPath(), True)
        return gone

    def read(self, conflicts: str = "null") -> DataFrame:
        """The wide table over all live runs; an empty one without runs."""
        if not (live := self.runs()):
            ddl = ", ".join(["entity string", *(f"`{a}` {t if t != 'long' else 'bigint'}" for a, t in self.catalog.items()), "unsettled array<string>"])
            return self.spark.createDataFrame([], ddl)
        runs = self._read(live)
        return table(runs[0] if len(runs) == 1 else compact(self.catalog, *runs), self.catalog, conflicts)
