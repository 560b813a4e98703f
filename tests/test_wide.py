import datetime as dt
import json
import math
import re
from decimal import Decimal

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rootline.operators import wide
from rootline.session import table

SCHEMA = "node_id string, key string, value string, num_value double, at long"
CATALOG = {"acc": "double", "gpu": "boolean", "n": "long", "tag": "string", "when": "timestamp"}
DATA = "/root/testdata/sf0.001"


def run(spark, rows, catalog=CATALOG):
    return wide.compact(catalog, wide.delta(spark.createDataFrame(rows, SCHEMA), catalog, F.col("at")))


def cell(spark, kind, *values):
    """Whether the cell of these (value, num_value) rows is settled, and its value."""
    rows = [("x", "c", v, n, i) for i, (v, n) in enumerate(values)]
    done = run(spark, rows, {"c": kind})
    got = wide.table(done, {"c": kind}).collect()
    return (got[0].c, got[0].unsettled) if got else None


def test_readings(spark):
    cases = [
        ("double", ('" +1.5e0 "', None), 1.5),
        ("double", ("1.50", None), 1.5),
        ("double", ('"1.2.3"', None), None),
        ("double", ("true", None), None),
        ("double", ("[1]", None), None),
        ("double", ('"1" 2', None), None),
        ("double", ("Infinity", None), None),
        ("double", (None, 2.5), 2.5),
        ("long", ("3.0e1", None), 30),
        ("long", ("32.5", None), None),
        ("long", ("1e-30", None), None),
        ("long", ('"9223372036854775807"', None), 2**63 - 1),
        ("long", ('"9223372036854775808"', None), None),
        ("boolean", ('" YES"', None), True),
        ("boolean", ("0", None), False),
        ("boolean", ('"maybe"', None), None),
        ("boolean", ("2", None), None),
        ("string", ('"  a\\u00e9 "', None), "aé"),
        ("string", ("5", None), None),
        ("timestamp", ('"2026-01-02 03:04:05"', None), dt.datetime(2026, 1, 2, 3, 4, 5)),
        ("timestamp", ('"2026-01-02T03:04:05+0200"', None), dt.datetime(2026, 1, 2, 1, 4, 5)),
        ("timestamp", ("1767323045", None), dt.datetime(2026, 1, 2, 3, 4, 5)),
        ("timestamp", ('"02/01/2026"', None), None),
        ("timestamp", ('"2026-13-45"', None), None),
    ]
    rows, catalogs = [], {}
    for i, (kind, (value, num), _) in enumerate(cases):
        catalogs[f"a{i}"] = kind
        rows.append(("x", f"a{i}", value, num, i))
    done = run(spark, rows, catalogs)
    got = wide.table(done, catalogs).withColumns({f"a{i}": F.col(f"a{i}").cast("timestamp_ntz") for i, (k, _, _) in enumerate(cases) if k == "timestamp"}).first()
    for i, (_, _, expected) in enumerate(cases):
        assert got[f"a{i}"] == expected, cases[i]
    assert set(got.unsettled) == {f"a{i}" for i, c in enumerate(cases) if c[2] is None}


def test_whole_by_all_digits(spark):
    """A long is whole by its digits, not by what is left of them after rounding."""
    cases = {
        "1.0000000000001": None, "1.00000000000000000000000000000000001": None, "0.9999999999999": None, "10000000000001e-13": None, "1e-400": None, "1e-99999999999": None, "9007199254740993.5": None,
        "1.0000000000000": 1, "-10000000000000e-13": -1, "1.5e1": 15, "00120e-1": 12, "0.0000000000000e5": 0, "0e-50": 0, "9007199254740993.000": 9007199254740993, "5.": 5, ".5e1": 5,
    }
    catalog = {f"a{i}": "long" for i in range(len(cases))}
    got = wide.table(run(spark, [("x", f"a{i}", f'"{v}"', None, i) for i, v in enumerate(cases)], catalog), catalog).first()
    assert {v: got[f"a{i}"] for i, v in enumerate(cases)} == cases
    assert set(got.unsettled) == {f"a{i}" for i, v in enumerate(cases.values()) if v is None}
    assert cell(spark, "long", ("1", None), ("1.0000000000001", None), (None, 1.0)) == (1, [])
    assert cell(spark, "long", (None, math.inf)) == (None, ["c"])


def test_nothing_given(spark):
    for value in ("null", "NaN", "", "  ", '""', '"  "', None):
        assert cell(spark, "double", (value, None)) is None
    assert cell(spark, "double", (None, math.nan)) is None


def test_contradictions_repeats_and_order(spark):
    assert cell(spark, "double", ("1.0", None), ('"1"', None), ("1e0", None)) == (1.0, [])
    assert cell(spark, "double", ('"pending"', None), ("2", None)) == (2.0, [])
    assert cell(spark, "double", ("1", None), ("2", None)) == (None, ["c"])
    rows = [("x", "c", "1", None, 5), ("x", "c", "2", None, 3)]
    done = run(spark, rows, {"c": "double"})
    assert wide.table(done, {"c": "double"}, "latest").first().c == 1.0


def test_spellings_nulls_and_strangers(spark):
    rows = [(" X\t", "ACC ", "1", None, 0), ("x", "acc", "1", None, 1), (None, "acc", "1", None, 2), ("x", None, "1", None, 3), ("x", "other", "1", None, 4), ("", "acc", "3", None, 5)]
    got = wide.table(run(spark, rows), CATALOG).collect()
    assert [(r.entity, r.acc) for r in got] == [("x", 1.0)]


def test_empty_and_clashing_columns(spark):
    assert wide.table(run(spark, []), CATALOG).count() == 0
    rows = spark.createDataFrame([("x", "acc", "1", None, 0, "e", "b")], SCHEMA + ", entity string, batch string")
    done = wide.compact(CATALOG, wide.delta(rows, CATALOG, F.col("at")))
    assert wide.table(done, CATALOG).first().acc == 1.0


def test_long_text(spark):
    text = "a\\u0041" * 200_000
    assert len(cell(spark, "string", (f'"{text}"', None))[0]) == 400_000


def test_runs_merge_in_any_order(spark):
    parts = [[("x", "acc", "1", None, 1)], [("x", "acc", "1.0", None, 2), ("y", "gpu", "true", None, 3)], [("y", "gpu", "false", None, 4)]]
    runs = [run(spark, p) for p in parts]
    whole = {tuple(r) for r in wide.unsettled(run(spark, sum(parts, [])), CATALOG).collect()}
    folded = wide.compact(CATALOG, runs[2], wide.compact(CATALOG, runs[1], runs[0]))
    assert {tuple(r) for r in wide.unsettled(folded, CATALOG).collect()} == whole == {("y", "gpu", 2)}


def test_store_of_runs(spark, tmp_path):
    store = wide.WideStore(spark, str(tmp_path), CATALOG)
    store.upsert(spark.createDataFrame([("x", "acc", "1", None, 1)], SCHEMA), F.col("at"))
    store.upsert(spark.createDataFrame([("x", "n", "7", None, 2)], SCHEMA), F.col("at"))
    assert len(store.runs()) == 2
    before = store.read().collect()
    store.compact()
    assert len(store.runs()) == 1
    assert store.read().collect() == before
    assert (before[0].acc, before[0].n) == (1.0, 7)


def test_store_with_two_writers(spark, tmp_path):
    """Runs published meanwhile survive, a second compaction gives way, readers keep what they read."""
    store = wide.WideStore(spark, str(tmp_path), CATALOG)
    assert store.read().collect() == [] and not store.compact() and set(store.read().columns) == {"entity", "unsettled", *CATALOG}
    one = lambda i: spark.createDataFrame([("x", "n", "7", None, i)], SCHEMA)
    for i in range(2):
        store.upsert(one(i), F.col("at"))
    reading, old, write = store.read(), store.runs(), store._write

    def late(run):
        name = write(run)
        store._write = write
        store.upsert(spark.createDataFrame([("y", "acc", "1", None, 9)], SCHEMA), F.col("at"))
        return name

    store._write = late
    assert store.compact() and len(store.runs()) == 2 and not set(store.runs()) & set(old)
    assert [r.n for r in reading.collect()] == [7]
    assert {(r.entity, r.acc, r.n) for r in store.read().collect()} == {("x", None, 7), ("y", 1.0, None)}
    assert not store._claim(store._number(), ["lost"])

    def other(run):
        store._write = write
        assert store.compact()
        return write(run)

    store._write = other
    assert not store.compact() and len(store.runs()) == 1
    assert store.vacuum() == 0 and store.vacuum(-1) == 5 and store.read().count() == 2


def test_arrivals_number_files_and_batches(spark, tmp_path):
    """Files of the same name in different folders have versions of their own."""
    for i, part in enumerate(("p=1", "p=2")):
        folder = tmp_path / part
        folder.mkdir()
        spark.createDataFrame([("x", "acc", str(10 * i + j), None, j) for j in range(5)], SCHEMA).coalesce(1).write.parquet(str(folder / "t"))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = sorted((r.version, r.batch, r.value) for r in wide.arrivals(rows, 2).collect())
    assert len({v for v, *_ in got}) == 10 and len({b for _, b, _ in got}) == 6 and [v for *_, v in got] == [str(x) for x in (*range(5), *range(10, 15))]


def brute(rows, catalog):
    """The cells that aren't settled, by Python's own parsers."""
    blanks, number = " \t\n\r\x0b\x0c\xa0", re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")

    def read(v, kind):
        if kind in ("double", "long"):
            if isinstance(v, bool) or not isinstance(v, int | float | str):
                return None
            text = v.strip(blanks) if isinstance(v, str) else repr(v)
            if not number.fullmatch(text):
                return None
            x = Decimal(text)
            return float(x) if kind == "double" else int(x) if x == int(x) else None
        if kind == "boolean":
            if isinstance(v, str):
                return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(v.strip(blanks).lower())
            return bool(v) if isinstance(v, bool | int | float) and v in (0, 1) else None
        if kind == "timestamp":
            if isinstance(v, str):
                try:
                    x = dt.datetime.fromisoformat(v.strip(blanks))
                except ValueError:
                    return None
                return (x if x.tzinfo else x.replace(tzinfo=dt.UTC)).timestamp()
            return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
        return v.strip(blanks) if isinstance(v, str) else None

    cells = {}
    for r in rows:
        if r["node_id"] is None or r["key"] is None:
            continue
        n, k, v = r["node_id"].strip(blanks).lower(), r["key"].strip(blanks).lower(), r["value"]
        if k not in catalog or not n:
            continue
        if v is None:
            if r["num_value"] is None or math.isnan(r["num_value"]):
                continue
            g = r["num_value"]
        else:
            if not v.strip(blanks):
                continue
            try:
                g = json.loads(v)
            except ValueError:
                g = object()
            if g is None or (isinstance(g, float) and math.isnan(g)) or (isinstance(g, str) and not g.strip(blanks)):
                continue
        found = cells.setdefault((n, k), set())
        if (y := read(g, catalog[k])) is not None:
            found.add(y)
    return {k for k, v in cells.items() if len(v) != 1}


def test_against_brute_force(spark):
    catalog = wide.read_catalog(table(spark, DATA, "attr_catalog"))
    deltas = wide.delta(wide.arrivals(table(spark, DATA, "metadata"), 300), catalog, F.col("version"), batch=F.col("batch"))
    got = {(r.entity, r.attr) for r in wide.unsettled(wide.compact(catalog, deltas), catalog).collect()}
    assert got == brute(pq.read_table(f"{DATA}/metadata.parquet").to_pylist(), catalog)
    assert got
