"""Percentiles of very large columns by mergeable relative-rank sketches.

A sketch is a stack of compactors.  Level h holds values that stand for 2**h items each.  A full
level is compacted: its upper part, the *protected* tail, stays; of the rest every other value, odd or
even by a coin, moves one level up.  How deep a compaction cuts follows the number of trailing ones of
the level's counter, so most compactions touch only the lowest section.  The rank error is then
relative to the number of items above, so the extreme upper percentiles are the most exact; sketches
of days, pieces or partitions merge level by level with the same guarantee.

Sketches are rows (one array per level), so that they can be stored and combined later.

Defined results: null, NaN, zero and negative values are left out where asked for positives, null
and NaN always; repeated values count as often as they come; a group without values has no sketch; a
sketch that never compacted is exact; coins are seeded from the sketch's own content, so equal
inputs in equal order give equal sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootline.functions.labels import label
from rootline.session import materialize

#: Section size: the relative error of the rank from above is about 1 / SECTION.
SECTION = 64

#: Sketches that a task holds before it passes them on (some KB each).
TASK_SKETCHES = 5_000

#: Sketches that one task merges at once.
FAN_IN = 64

SKETCH = "n long, low double, high double, levels array<array<double>>, counters array<long>"


class RelativeSketch:
    """Relative-rank compactors protecting the upper tail."""

    def __init__(self, section: int = SECTION):
        self.section = max(4, section + section % 2)
        self.n, self.low, self.high = 0, np.inf, -np.inf
        self.levels: list[np.ndarray] = []
        self.counters: list[int] = []

    def _sections(self) -> int:
        return max(3, int(np.ceil(np.log2(max(2.0, self.n / self.section)))))

    def _capacity(self) -> int:
        return 2 * self.section * self._sections()

    def update(self, values: np.ndarray) -> None:
        """Add values (finite or infinite, not NaN)."""
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self._put(0, values)
            self._compress()

    def merge(self, other: RelativeSketch) -> None:
        """Add all that another sketch has seen."""
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for h, (values, counter) in enumerate(zip(other.levels, other.counters, strict=True)):
            self._put(h, values)
            self.counters[h] |= counter
        self._compress()

    def _put(self, h: int, values: np.ndarray) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.empty(0))
            self.counters.append(0)
        self.levels[h] = np.concatenate([self.levels[h], values])

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            capacity = self._capacity()
            if len(self.levels[h]) > capacity:
                values = np.sort(self.levels[h])
                counter = self.counters[h]
                depth = min(self._sections(), (~counter & (counter + 1)).bit_length())
                keep = max(capacity // 2, capacity - depth * self.section)
                cut = len(values) - keep
                cut -= cut % 2
                coin = (hash((h, counter, self.n, float(values[0]), float(values[cut - 1]))) >> 3) & 1
                self.levels[h], self.counters[h] = values[cut:], counter + 1
                self._put(h + 1, values[coin:cut:2])
            h += 1

    def quantiles(self, shares: list[float]) -> list[float]:
        """The values at shares of the ranks (the least value with at least that share at or below)."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 2**h) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, below = values[order], np.cumsum(weights[order])
        at = np.searchsorted(below, np.asarray(shares) * below[-1], side="left")
        return [float(self.low if s <= 0 else self.high if s >= 1 else values[min(i, len(values) - 1)]) for i, s in zip(at, shares, strict=True)]

    def row(self) -> tuple:
        return self.n, float(self.low), float(self.high), [v.tolist() for v in self.levels], list(self.counters)

    @classmethod
    def of(cls, n, low, high, levels, counters, section: int = SECTION) -> RelativeSketch:
        out = cls(section)
        out.n, out.low, out.high = int(n), low, high
        out.levels = [np.asarray(v, dtype=float) for v in levels]
        out.counters = [int(c) for c in counters]
        return out


def _rows(keys: list[str], found: dict[tuple, RelativeSketch]) -> pd.DataFrame:
    return pd.DataFrame([(*k, *s.row()) for k, s in found.items()], columns=[*keys, "n", "low", "high", "levels", "counters"])


def sketch(values: DataFrame, groups: list[str], value: str, section: int = SECTION) -> DataFrame:
    """(*groups, n, low, high, levels, counters): a sketch of the values of each group from each
    partition, made where the rows are; only sketches are moved afterwards."""
    kept = values.select(*groups, F.col(value).cast("double").alias("_value")).where("_value is not null and not isnan(_value)")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, RelativeSketch] = {}
        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False)["_value"]:
                key = tuple(None if pd.isna(k) else k for k in key)
                found.setdefault(key, RelativeSketch(section)).update(part.to_numpy(dtype=float))
            if len(found) > TASK_SKETCHES:
                yield _rows(groups, found)
                found = {}
        if found:
            yield _rows(groups, found)

    return kept.mapInPandas(build, f"{types}, {SKETCH}")


def merge(sketches: DataFrame, groups: list[str], section: int = SECTION, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per group.  Sketches of a group merge in two rounds, the first in pieces spread
    over all tasks, so that a group with many of them does not wait for one task.  A task reads its
    sketches sorted by group and holds one merged sketch at a time."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*groups).schema.fields)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, done = None, None, {}
        for batch in batches:
            for r in batch.to_dict("records"):
                here = tuple(None if pd.isna(r[g]) else r[g] for g in groups)
                if total is None or here != key:
                    if total is not None:
                        done[key] = total
                    key, total = here, RelativeSketch(section)
                total.merge(RelativeSketch.of(r["n"], r["low"], r["high"], r["levels"], r["counters"], section))
            if done:
                yield _rows(groups, done)
                done = {}
        if total is not None:
            yield _rows(groups, {key: total})

    columns = [*groups, "n", "low", "high", "levels", "counters"]
    pieces = sketches.select(*columns).withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    once = pieces.repartition(*groups, "_piece").sortWithinPartitions(*groups, "_piece", "n", "low", "high").mapInPandas(fold, f"{types}, {SKETCH}")
    return once.repartition(*groups).sortWithinPartitions(*groups, "n", "low", "high").mapInPandas(fold, f"{types}, {SKETCH}")


def percentiles(sketches: DataFrame, groups: list[str], shares: list[float], section: int = SECTION) -> DataFrame:
    """(*groups, n, share, value): percentiles of each sketch."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*groups).schema.fields)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                s = RelativeSketch.of(r["n"], r["low"], r["high"], r["levels"], r["counters"], section)
                out += [(*[r[g] for g in groups], s.n, share, v) for share, v in zip(shares, s.quantiles(shares), strict=True)]
            yield pd.DataFrame(out, columns=[*groups, "n", "share", "value"])

    return sketches.mapInPandas(read, f"{types}, n long, share double, value double")


def node_measures(node: DataFrame) -> DataFrame:
    """(node_id, step_type, day, field, value): the positive durations and sizes, each node once.

    Where rows of a node differ, the least label and the largest values count; ``day`` is the UTC
    day of the earliest creation, null where none is known.
    """
    at = F.col("created_epoch_seconds").cast("double")
    positive = lambda c: F.when((c > 0) & ~F.isnan(c), c)
    day: Column = F.to_date(F.timestamp_seconds(F.when(F.abs(at) < 1e11, at)))
    rows = node.select(label(F.col("node_id")).alias("node_id"), label(F.col("step_type")).alias("step_type"), day.alias("day"), positive(F.col("duration_seconds").cast("double")).alias("duration_seconds"), positive(F.col("size_bytes").cast("double")).alias("size_bytes"))
    once = rows.where("node_id is not null and step_type is not null").groupBy("node_id").agg(F.min("step_type").alias("step_type"), F.min("day").alias("day"), F.max("duration_seconds").alias("duration_seconds"), F.max("size_bytes").alias("size_bytes"))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("duration_seconds", "size_bytes")]))
    return once.select("node_id", "step_type", "day", fields.alias("x")).select("node_id", "step_type", "day", "x.field", "x.value").where("value is not null")


def daily_sketches(measures: DataFrame, section: int = SECTION) -> DataFrame:
    """The sketch of each step type, field and day of ``node_measures``: the figures that are kept
    and combined."""
    return merge(sketch(measures, ["step_type", "field", "day"], "value", section), ["step_type", "field", "day"], section)


def outliers(node: DataFrame, share: float = 0.9, times: float = 20.0, section: int = SECTION) -> DataFrame:
    """(node_id, field, value, limit): values above ``times`` the percentile ``share`` of their step
    type and field, the percentile coming from the merged daily sketches."""
    measures = materialize(node_measures(node), "measures")
    total = merge(daily_sketches(measures, section).drop("day"), ["step_type", "field"], section)
    limit = percentiles(total, ["step_type", "field"], [share], section).select("step_type", "field", (F.col("value") * times).alias("limit"))
    return measures.join(limit, ["step_type", "field"]).where("value > limit").select("node_id", "field", "value", "limit")
