"""The N best items of every group, for groups of any size.

A histogram of the scores of each group, over buckets that keep the order of doubles, gives a
threshold with at least N items at or above it.  Rows below are filtered, and only the survivors are
ranked exactly, by score descending and then by the tie key.  Counting is combined before it is
shuffled, and ranking keeps at most N rows of a group per task before it shuffles, so neither a hot
group nor a score that a whole group shares gathers in one task.  Up to the threshold of Spark's window
group limit that is Spark's own doing; for a larger N the survivors of a group are first ranked in
``SALTS`` parts, each of which keeps N.

Defined results: null and NaN scores and null groups or items take no part; an item counts once per
group, with its largest score; -0.0 equals 0.0; infinities are scores; ties are ordered by item
ascending; groups of fewer than N items keep them all; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rootline.functions.labels import label
from rootline.session import materialize

#: Bits of a double that number its bucket: sign, exponent and 8 of the mantissa, so that a bucket
#: spans at most 1/256 of its value.
BUCKET_BITS = 20

#: Groups whose thresholds are sent to every task (a few hundred bytes each); beyond, rows and thresholds
#: meet by group and one of so many salts.
BROADCAST_GROUPS, SALTS = 50_000, 32


def bucket(score: Column, bits: int = BUCKET_BITS) -> Column:
    """An integer that rises with the score, equal for scores that share their leading bits."""
    size = F.abs(score)
    power = F.when(size < 2.0**-1022, -1023.0).when(size == float("inf"), 1024.0).otherwise(F.least(F.floor(F.log2(size)).cast("double"), F.lit(1023.0)))
    steps = float(2 ** (bits - 12))
    part = F.when((power <= -1023) | (power >= 1024), 0.0).otherwise(F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * steps))
    # log2 may round across a power of two: such a size still gets a bucket between its neighbours
    part = F.greatest(F.lit(0.0), F.least(part, F.lit(steps - 1)))
    rank = ((power + 1024) * steps + part).cast("int")
    return F.when(score < 0, -rank).otherwise(rank)


def thresholds(scored: DataFrame, groups: list[str], n: int) -> DataFrame:
    """(*groups, least): the highest bucket of each group with at least n items at or above it, or
    the lowest one."""
    counts = scored.groupBy(*groups, "bucket").agg(F.count("*").alias("items"))
    above = F.sum("items").over(Window.partitionBy(*groups).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < n).groupBy(*groups).agg(F.min("bucket").alias("least"))


def _above(best: DataFrame, least: DataFrame, groups: list[str], item: str) -> DataFrame:
    """The rows at or above the threshold of their group.

    Few thresholds go to all tasks, so the rows stay where they are.  Many are copied ``SALTS`` times,
    so that the rows of one group spread over as many tasks.
    """
    if least.count() <= BROADCAST_GROUPS:
        return best.join(F.broadcast(least), groups).where("bucket >= least")
    salted = least.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return best.withColumn("_salt", F.pmod(F.hash(item), F.lit(SALTS))).join(salted, [*groups, "_salt"]).where("bucket >= least").drop("_salt")


def top_n(scored: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """(*groups, rank_no, item, score): the n best items of each group."""
    if n < 1:
        raise ValueError("n is at least 1")
    known = scored.select(*groups, F.col(item).alias(item), (F.col(score).cast("double") + F.lit(0.0)).alias(score))
    known = known.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    for g in groups:
        known = known.where(F.col(g).isNotNull())
    best = known.groupBy(*groups, item).agg(F.max(score).alias(score))
    best = materialize(best.withColumn("bucket", bucket(F.col(score))), "scored")
    kept = _above(best, materialize(thresholds(best, groups, n), "thresholds"), groups, item)
    if n > int(scored.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = Window.partitionBy(*groups, "_part").orderBy(F.desc(score), F.asc(item))
        kept = kept.withColumn("_part", F.pmod(F.hash(item), F.lit(SALTS))).withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n).drop("_part", "_rank")
    order = Window.partitionBy(*groups).orderBy(F.desc(score), F.asc(item))
    return kept.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n).select(*groups, "rank_no", item, score)


def best_nodes(metadata: DataFrame, node: DataFrame, n: int = 5) -> DataFrame:
    """(step_type, key, rank_no, node_id, score): the n best nodes of each pair of step type and
    metadata key.  Metadata of nodes that ``node`` lacks doesn't count; a node of several step types
    counts under each."""
    scores = metadata.select(label(F.col("node_id")).alias("node_id"), label(F.col("key")).alias("key"), F.col("num_value").cast("double").alias("score"))
    scores = scores.where("node_id is not null and key is not null and score is not null and not isnan(score)")
    kinds = node.select(label(F.col("node_id")).alias("node_id"), label(F.col("step_type")).alias("step_type")).where("node_id is not null and step_type is not null").distinct()
    return top_n(scores.join(kinds, "node_id"), ["step_type", "key"], "node_id", "score", n)
