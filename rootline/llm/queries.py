"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootline.llm import leakage, mixing, quantiles, subjects, topn
from rootline.plans.lineage import LABEL
from rootline.session import prepare, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best nodes of each pair of step type and metadata key."""
    prepare(spark)
    return topn.best_nodes(table(spark, sf_dir, "metadata"), table(spark, sf_dir, "node"), 5).select("step_type", "key", "rank_no", "node_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations and sizes above 20 times the 90th percentile of their step type."""
    prepare(spark)
    return quantiles.outliers(table(spark, sf_dir, "node"), 0.9, 20.0).select("node_id", "field")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each step type and field, from daily sketches put together."""
    prepare(spark)
    daily = quantiles.daily_sketches(quantiles.node_measures(table(spark, sf_dir, "node")))
    total = quantiles.merge(daily.drop("day"), ["step_type", "field"])
    return quantiles.percentiles(total, ["step_type", "field"], [0.5, 0.9, 0.99, 0.999])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a test item and a document that holds 12 of its words in a row."""
    prepare(spark)
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaked of each test set: items, documents, pairs and the longest passage."""
    prepare(spark)
    items = table(spark, sf_dir, "eval_items")
    found = leakage.matches(table(spark, sf_dir, "documents"), items).join(items.select("item_id", "test_set"), "item_id")
    return found.groupBy("test_set").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("item_id", "doc_id").alias("pairs"), F.max("words").alias("longest"))


def p6_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a test item and a document with at least 10 of 12 words close to their places."""
    prepare(spark)
    return leakage.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


#: Domains of the tree of weights, by source (a parameter of the mixture).
DOMAINS = {"code_forge": "code", "contest_hub": "code", "course_site": "teaching", "wiki_books": "teaching", "paper_repo": "research", "lab_share": "research", "field_archive": "research", "gov_portal": "public"}


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prepare(spark)
    targets = mixing.read_targets(table(spark, sf_dir, "mix_targets"))
    sized = mixing.sized_records(table(spark, sf_dir, "documents"), targets)
    return sized, mixing.plan(sized, targets, domains=DOMAINS)[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that were granted less than their share: every record used as often as allowed."""
    return mixing.report(_mixture(spark, sf_dir)[1]).where("short").select("source")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return mixing.choose(*_mixture(spark, sf_dir)).select("doc_id", "source", "uses")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source that was asked for and the share that was reached."""
    sized, leaves = _mixture(spark, sf_dir)
    return mixing.report(leaves, mixing.choose(sized, leaves))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return subjects.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "subject_labels"))[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each notebook."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many notebooks each subject has, and its share of all that have one."""
    found = _subjects(spark, sf_dir)
    docs = found.agg(F.countDistinct("doc_id").alias("all_docs"))
    return found.groupBy("subject").agg(F.count("*").alias("docs")).join(F.broadcast(docs)).select("subject", "docs", (F.col("docs") / F.col("all_docs")).alias("share"))


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_percentiles, p6_found, p6_report, p6_proximity, p7_found, p7_mixture, p7_report, p8_found, p8_makeup)}

ORACLES = {
    "p3_found": f"""with n as (select distinct {LABEL("node_id")} as node_id, {LABEL("step_type")} as step_type from node),
m as (select {LABEL("node_id")} as node_id, {LABEL("key")} as key, max(num_value) as score from metadata where num_value is not null and not isnan(num_value) group by 1, 2)
select step_type, key, cast(row_number() over (partition by step_type, key order by score desc, node_id) as int) as rank_no, node_id
from m join n using (node_id) where step_type is not null and key is not null qualify rank_no <= 5""",
    "p5_found": f"""with n as (select {LABEL("node_id")} as node_id, min({LABEL("step_type")}) as step_type,
max(case when duration_seconds > 0 and not isnan(duration_seconds) then duration_seconds end) as d, max(case when size_bytes > 0 then size_bytes end)::double as s
from node where {LABEL("step_type")} is not null group by 1),
u as (select node_id, step_type, 'duration_seconds' as field, d as v from n union all select node_id, step_type, 'size_bytes', s from n),
p as (select step_type, field, quantile_disc(v, 0.9) as p90 from u where v is not null group by 1, 2)
select node_id, field from u join p using (step_type, field) where v > 20 * p90""",
}
