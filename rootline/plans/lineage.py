"""Queries over the lineage tables, each with its SQL.

Both sides start from the same clean tables: ``BASE`` says in SQL what ``frames.clean`` does.  Queries
about one node take the *hub*, the node with most children (the least id among ties).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootline.frames import LineageFrames, load
from rootline.operators import audit, find, graph, search, sqlgate, views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_BLANKS = "||".join(f"chr({i})" for i in (32, 9, 10, 13, 11, 12, 133, 160, 8232, 8233, 12288))


def _label(c: str) -> str:
    return f"nullif(lower(trim({c}, {_BLANKS})), '')"


def _number(c: str) -> str:
    return f"case when not isnan({c}) then {c} end"


LABEL, BLANKS = _label, _BLANKS

BASE = f"""with recursive n as (
  select {_label("node_id")} as node_id, max({_label("step_type")}) as step_type, max(generation) as generation, max(created_utc) as created_utc,
    max({_number("created_epoch_seconds")}) as created_epoch_seconds, max(healthy) as healthy, max({_number("duration_seconds")}) as duration_seconds,
    max(size_bytes) as size_bytes, max(content_hash) as content_hash, max(prov_git_dirty) as prov_git_dirty, max(prov_user) as prov_user
  from node where {_label("node_id")} is not null group by 1),
e as (
  select {_label("child_id")} as child_id, {_label("parent_id")} as parent_id, min(ordinal) as ordinal from edge
  where {_label("child_id")} is not null and {_label("parent_id")} is not null group by 1, 2),
m as (
  select {_label("node_id")} as node_id, {_label("key")} as key, max(value) as value, max(data_type) as data_type, max(grp) as grp,
    max(searchable) as searchable, max({_number("num_value")}) as num_value
  from metadata where {_label("node_id")} is not null and {_label("key")} is not null group by 1, 2),
a as (
  select {_label("node_id")} as node_id, replace(trim(relpath, {_BLANKS}), '\\', '/') as relpath, max(size) as size, max(lower(trim(sha256, {_BLANKS}))) as sha256
  from artifact where {_label("node_id")} is not null and relpath is not null group by 1, 2),
hub as (select parent_id as id from e group by 1 order by count(*) desc, 1 limit 1)
"""


def query(sql: str | None = None):
    """Register a query on clean frames by the name of its function, with its SQL after ``BASE``."""

    def register(f: Callable[[LineageFrames], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(load(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


def hub(frames: LineageFrames) -> str:
    """The node with most children."""
    row = frames.edge.groupBy("parent_id").count().orderBy(F.desc("count"), "parent_id").first()
    return row.parent_id if row else ""


def _ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id")


@query("select node_id from n")
def find_all(f: LineageFrames) -> DataFrame:
    """All nodes."""
    return _ids(find.find(f))


@query("select node_id from n where step_type = 'train' and healthy")
def find_column_eq(f: LineageFrames) -> DataFrame:
    """Healthy training runs."""
    return _ids(find.find(f, step_type="train", healthy=True))


@query("select node_id from n where duration_seconds is null")
def find_null_column(f: LineageFrames) -> DataFrame:
    """Nodes without a duration."""
    return _ids(find.find(f, duration_seconds=None))


@query("select node_id from n where node_id in (select node_id from m where key = 'batch_size' and searchable and num_value = 64)")
def find_meta_numeric(f: LineageFrames) -> DataFrame:
    """Nodes by a number in their metadata."""
    return _ids(find.find(f, batch_size=64))


@query("""select node_id from n where node_id in (select node_id from m where key = 'notes' and searchable and value = '"needs review"')""")
def find_meta_text(f: LineageFrames) -> DataFrame:
    """Nodes by a text in their metadata."""
    return _ids(find.find(f, notes="needs review"))


@query("select node_id from n where node_id in (select node_id from m where searchable and ((key = 'gpu' and value = 'true') or (key = 'cached' and value = 'true')) group by 1 having count(distinct key) = 2)")
def find_meta_multi(f: LineageFrames) -> DataFrame:
    """Nodes by two metadata values at once."""
    return _ids(find.find(f, gpu=True, cached=True))


@query("select child_id as node_id from e where child_id in (select node_id from n) group by 1 having count(*) = 1 and max(parent_id) = (select id from hub)")
def find_parent_exact(f: LineageFrames) -> DataFrame:
    """Nodes whose only parent is the hub."""
    return _ids(find.find(f, parent_id=hub(f)))


@query("select node_id from n where node_id not in (select child_id from e)")
def find_roots(f: LineageFrames) -> DataFrame:
    """Nodes without parents."""
    return _ids(find.find(f, parent_id=[]))


@query(r"select node_id from n where node_id in (select node_id from m where key = 'accuracy' and searchable and regexp_full_match(value, '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') and try_cast(value as double) > 0.9)")
def find_predicate(f: LineageFrames) -> DataFrame:
    """Nodes whose stored accuracy a Python predicate accepts."""
    return _ids(find.find(f, accuracy=lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v > 0.9))


@query("select node_id, relpath, size from a where regexp_matches(relpath, '(^|/)[^/]*\\.csv$')")
def artifact_name_match(f: LineageFrames) -> DataFrame:
    """Artifacts by a pattern."""
    return find.artifacts(f, "*.csv").select("node_id", "relpath", "size")


@query("select e.child_id as node_id, e.ordinal as parent_no, e.parent_id, a.relpath, a.size from e join a on a.node_id = e.parent_id where regexp_matches(a.relpath, '(^|/)[^/]*\\.json$')")
def parent_artifacts(f: LineageFrames) -> DataFrame:
    """The JSON files that parents hand to their children."""
    return find.parent_artifacts(f, "*.json")


@query("select node_id from n where step_type = 'evaluate' order by created_epoch_seconds desc nulls last, node_id desc limit 1")
def latest_per_filter(f: LineageFrames) -> DataFrame:
    """The newest evaluation."""
    return _ids(find.latest(find.find(f, step_type="evaluate")))


@query("select n.node_id, count(e.parent_id) as n_parents, coalesce(string_agg(e.parent_id, ',' order by e.ordinal nulls first, e.parent_id), '') as parents from n left join e on e.child_id = n.node_id group by 1")
def records(f: LineageFrames) -> DataFrame:
    """Nodes with their ordered parents."""
    return find.records(f, f.node).select("node_id", F.size("parents").cast("bigint").alias("n_parents"), F.array_join("parents", ",").alias("parents"))


@query("select node_id from n where step_type = 'train' and node_id in (select node_id from m where key = 'gpu' and searchable and value = 'true')")
def search_eq(f: LineageFrames) -> DataFrame:
    """The search bar: two equalities."""
    return _ids(search.search(f, "step_type=train gpu=true"))


@query("select node_id from n where node_id in (select node_id from m where key = 'accuracy' and searchable and num_value > 0.8) and generation <= 20")
def search_range(f: LineageFrames) -> DataFrame:
    """The search bar: a range over metadata and one over a column."""
    return _ids(search.search(f, "accuracy>0.8 generation<=20"))


@query("select node_id from n where node_id like '%ab%' or step_type like '%ab%' or node_id in (select node_id from m where searchable and lower(value) like '%ab%')")
def search_text(f: LineageFrames) -> DataFrame:
    """The search bar: free text."""
    return _ids(search.search(f, "AB"))


@query("select node_id from n where healthy and (node_id like '%a%' or step_type like '%a%' or node_id in (select node_id from m where searchable and lower(value) like '%a%')) and node_id in (select node_id from m where key = 'loss' and searchable and num_value < 1)")
def search_conjunction(f: LineageFrames) -> DataFrame:
    """The search bar: all kinds of terms at once."""
    return _ids(search.search(f, "healthy=true a loss<1"))


@query("select node_id from n where node_id in (select child_id from e where parent_id = (select id from hub))")
def children(f: LineageFrames) -> DataFrame:
    """The children of the hub."""
    return _ids(graph.children(f, hub(f)))


_DOWN = ", down as (select id as node from hub union select e.child_id from down join e on e.parent_id = down.node)"
_TIP = ", tip as (select max(node_id) as id from n where node_id in (select child_id from e))"


@query(_TIP + ", up as (select id as node from tip union select e.parent_id from up join e on e.child_id = up.node) select node from up")
def lineage_closure(f: LineageFrames) -> DataFrame:
    """A node (the one of largest id that has parents) and all above it."""
    return graph.ancestors(f, _tip(f)).select("node")


def _tip(f: LineageFrames) -> str:
    return f.node.join(f.edge.select(F.col("child_id").alias("node_id")), "node_id", "left_semi").agg(F.max("node_id")).first()[0] or ""


@query(_TIP + ", up as (select id as node from tip union select e.parent_id from up join e on e.child_id = up.node) select node_id from n where step_type = 'train' and node_id in (select node from up)")
def ancestors_filtered(f: LineageFrames) -> DataFrame:
    """The training runs above a node."""
    above = graph.ancestors(f, _tip(f)).select(F.col("node").alias("node_id"))
    return _ids(find.find(f, step_type="train").join(above, "node_id", "left_semi"))


@query(_DOWN + " select node from down")
def descendants(f: LineageFrames) -> DataFrame:
    """The hub and all below it."""
    return graph.descendants(f, hub(f)).select("node")


@query(_DOWN + ", up as (select id as node from hub union select e.parent_id from up join e on e.child_id = up.node) select node from down union select node from up")
def related(f: LineageFrames) -> DataFrame:
    """The hub, all above and all below it."""
    return graph.related(f, hub(f))


@query(_DOWN + " select n.step_type, count(*) as runs, sum(case when n.healthy then 1 else 0 end)::bigint as ok, sum(n.size_bytes)::bigint as bytes from down join n on n.node_id = down.node group by 1")
def impact_by_step(f: LineageFrames) -> DataFrame:
    """What depends on the hub, by step type."""
    below = graph.descendants(f, hub(f)).select(F.col("node").alias("node_id"))
    return f.node.join(below, "node_id", "left_semi").groupBy("step_type").agg(F.count("*").alias("runs"), F.count_if("healthy").alias("ok"), F.sum("size_bytes").alias("bytes"))


_SETTLED = """, k as (select e.parent_id as a, e.child_id as b from e where e.parent_id in (select node_id from n) and e.child_id in (select node_id from n)),
above as (select b as node, a as top from k union select above.node, k.a from above join k on k.b = above.top),
looped as (select distinct node from above where node = top),
settled as (select node_id as node from n where node_id not in (select node from looped) and node_id not in (select node from above where top in (select node from looped))),
walk as (select node, 0 as level from settled union select k.b, walk.level + 1 from walk join k on k.a = walk.node where k.b in (select node from settled))
"""


@query(_SETTLED + " select node, max(level) as level from walk group by 1")
def lineage_levels(f: LineageFrames) -> DataFrame:
    """The longest path from a root to each node that no cycle leads to."""
    return graph.node_levels(f).where("settled").select("node", "level")


_PRUNED = """, t as (select id from hub where id in (select node_id from n)),
k as (select parent_id as a, child_id as b from e where child_id in (select node_id from n)),
region as (select id as node from t union select k.b from region join k on k.a = region.node),
within as (select a, b from k where a in (select node from region) and b in (select node from region)),
reach as (select a, b from within union select reach.a, w.b from reach join within w on w.a = reach.b),
stay as (select node from (select b as node from k where b in (select node from region) and b <> (select id from t) and a not in (select node from region) union select a from reach where a = b)
  union select w.b from stay join within w on w.a = stay.node),
going as (select node from region where node not in (select node from stay)),
walk as (select id as node, 0 as level from t where id in (select node from going) union select w.b, walk.level + 1 from walk join within w on w.a = walk.node where w.b in (select node from going))
"""


@query(_PRUNED + " select node, max(level)::int as level from walk group by 1")
def prune_plan(f: LineageFrames) -> DataFrame:
    """What a deletion of the hub takes along."""
    return graph.prune_plan(f, hub(f))


@query('select e.parent_id as "from", e.child_id as "to", e.ordinal from e join n on n.node_id = e.child_id')
def graph_edges(f: LineageFrames) -> DataFrame:
    """The edges to draw."""
    return graph.edge_list(f).select("from", "to", "ordinal")


@query("select child_id, parent_id from e where child_id in (select node_id from n where step_type in ('train', 'evaluate')) and parent_id in (select node_id from n where step_type in ('train', 'evaluate'))")
def focus_edges(f: LineageFrames) -> DataFrame:
    """Edges between training and evaluation."""
    return graph.focus_edges(f, views.focus(f, types=["train", "evaluate"])).select("child_id", "parent_id")


@query("""select p.node_id, p.step_type, e.parent_id, q.step_type as parent_type from n p left join (e join n q on q.node_id = e.parent_id) on e.child_id = p.node_id
where (p.step_type = 'clean' and (q.step_type is null or q.step_type <> 'ingest')) or (p.step_type = 'evaluate' and (q.step_type is null or q.step_type not in ('train', 'ensemble')))""")
def rule_audit(f: LineageFrames) -> DataFrame:
    """Transitions that the rules of the store's policy don't allow."""
    return audit.violations(f, audit.policy(f)["rules"])


_GENERATION = """, gen as (select n.node_id as node, 0 as value from n where n.node_id in (select node from settled)
union select k.b, gen.value + case when c.step_type in ('ensemble', 'featurize', 'train') then 1 else 0 end from gen join k on k.a = gen.node join n c on c.node_id = k.b where k.b in (select node from settled))
"""


@query(_SETTLED + _GENERATION + " select node as node_id, max(value) as generation from gen group by 1")
def generation_fold(f: LineageFrames) -> DataFrame:
    """The generation of each node by rule, where no cycle leads to it."""
    return audit.generations(f, audit.policy(f)["gen_triggers"]).where("generation is not null").select("node_id", "generation")


@query("select 'edge' as table_name, child_id as node_id from e where child_id not in (select node_id from n) union select 'edge', parent_id from e where parent_id not in (select node_id from n) union select 'metadata', node_id from m where node_id not in (select node_id from n) union select 'artifact', node_id from a where node_id not in (select node_id from n)")
def dangling(f: LineageFrames) -> DataFrame:
    """References to nodes that don't exist."""
    return audit.dangling(f)


@query("select n.node_id, n.size_bytes, coalesce(s.b, 0)::bigint as artifact_bytes from n left join (select node_id, sum(size)::bigint as b from a group by 1) s using (node_id) where n.size_bytes is distinct from coalesce(s.b, 0)")
def size_mismatch(f: LineageFrames) -> DataFrame:
    """Nodes whose size isn't that of their artifacts."""
    return audit.size_mismatch(f)


@query("select content_hash, (array_agg(node_id order by created_epoch_seconds nulls first, node_id))[1] as first_node, count(*) as runs from n where content_hash is not null group by 1 having count(*) > 1")
def fingerprint_dups(f: LineageFrames) -> DataFrame:
    """Contents that several nodes share."""
    return views.duplicates(f)


@query("select (select count(*) from n) as nodes, (select count(*) from a) as artifacts, (select coalesce(sum(size), 0)::bigint from a) as artifact_bytes, 0::bigint as chunks, 0::bigint as chunk_bytes")
def store_stats(f: LineageFrames) -> DataFrame:
    """Totals of the store."""
    return views.stats(f).select("nodes", "artifacts", "artifact_bytes", F.col("chunks").cast("bigint").alias("chunks"), F.col("chunk_bytes").cast("bigint").alias("chunk_bytes"))


_METRIC = "searchable and num_value is not null and coalesce(value, '') not in ('true', 'false')"


@query(f"select key, count(*) as runs from m where {_METRIC} group by 1")
def metric_keys(f: LineageFrames) -> DataFrame:
    """The metrics of all runs."""
    return views.metric_keys(f)


@query(f"select n.node_id, n.step_type, n.healthy, max(case when key = 'accuracy' then num_value end) as accuracy, max(case when key = 'loss' then num_value end) as loss, max(case when key = 'rmse' then num_value end) as rmse from n left join (select * from m where {_METRIC}) x using (node_id) group by 1, 2, 3")
def runs_table(f: LineageFrames) -> DataFrame:
    """One row per run with some of its metrics."""
    return views.runs_table(f, ["accuracy", "loss", "rmse"]).select("node_id", "step_type", "healthy", "accuracy", "loss", "rmse")


@query(f"select n.node_id, x.num_value as loss from n left join (select node_id, num_value from m where key = 'loss' and {_METRIC}) x using (node_id) order by x.num_value asc nulls last, n.node_id")
def runs_sorted_nulls_last(f: LineageFrames) -> DataFrame:
    """Runs by loss, those without one last."""
    return views.sorted_runs(views.runs_table(f, ["loss"]), "loss", False).select("node_id", "loss")


@query(f"select min(num_value) as low, max(num_value) as high, (min(num_value) + max(num_value)) / 2 as mid from m where key = 'loss' and {_METRIC}")
def metric_range(f: LineageFrames) -> DataFrame:
    """The range of a metric."""
    return views.metric_range(f, "loss")


@query(f"select node_id, num_value, round((num_value - lo) / (hi - lo), 9) as share from m, (select min(num_value) lo, max(num_value) hi from m where key = 'loss' and {_METRIC}) r where key = 'loss' and {_METRIC}")
def metric_normalised(f: LineageFrames) -> DataFrame:
    """A metric brought to the range from 0 to 1."""
    return views.normalise(f, "loss").select("node_id", "num_value", F.round("share", 9).alias("share"))


@query(f"select row_number() over (order by num_value desc, node_id)::int as rank_no, node_id, num_value from m where key = 'accuracy' and {_METRIC} order by num_value desc, node_id limit 5")
def ranking_top5(f: LineageFrames) -> DataFrame:
    """The five best runs by a metric."""
    return views.ranking(f, "accuracy")


@query("select count(*) as runs, count(*) filter (not healthy) as failed, count(*) filter (prov_git_dirty) as dirty from n")
def status_counts(f: LineageFrames) -> DataFrame:
    """How many runs failed or were dirty."""
    return views.status_counts(f)


@query("select cast(to_timestamp(created_epoch_seconds) at time zone 'UTC' as date) as day, count(*) filter (healthy) as ok, count(*) filter (not healthy) as failed from n where created_epoch_seconds is not null group by 1")
def timeline_daily(f: LineageFrames) -> DataFrame:
    """Runs of each day."""
    return views.timeline(f)


@query("select step_type, min(created_epoch_seconds) as first_seen, count(*) as runs from n group by 1")
def step_types(f: LineageFrames) -> DataFrame:
    """The step types in order of appearance."""
    return views.step_types(f)


def _side(of: str) -> str:
    shown = [("step_type", "step_type", "null"), ("generation", "generation", "generation"), ("healthy", "healthy", "null"), ("duration_seconds", "duration_seconds", "duration_seconds"), ("size_bytes", "size_bytes", "size_bytes"), ("created_display", "strftime(make_timestamp((created_epoch_seconds * 1000000)::bigint), '%Y-%m-%d %H:%M:%S')", "null")]
    own = " union all ".join(f"select 'node' as section, '{k}' as key, ({v})::varchar as value, ({n})::double as v from n where node_id = (select id from {of})" for k, v, n in shown)
    return f"{own} union all select 'metadata', key, value, case when coalesce(value, '') not in ('true', 'false') then num_value end from m where node_id = (select id from {of})"


@query(_TIP + f""", x as ({_side("tip")}), y as ({_side("hub")})
select coalesce(x.section, y.section) as section, coalesce(x.key, y.key) as key, x.value as a, y.value as b, coalesce(x.v = y.v, x.value is not distinct from y.value) as same, round(y.v - x.v, 6) as delta from x full join y on x.key = y.key and x.section = y.section""")
def node_diff(f: LineageFrames) -> DataFrame:
    """Two nodes compared."""
    return views.diff(f, _tip(f), hub(f))


@query("""select m.node_id, coalesce(m.grp, 'General') as section, m.key as name, case when a.node_id is not null then m.node_id || '/' || a.relpath else m.value end as value
from m left join a on a.node_id = m.node_id and m.data_type in ('image', 'link') and a.relpath = case when json_valid(m.value) then json_extract_string(m.value, '$') end
union all select node_id, 'Artifacts', relpath, size::varchar from a""")
def node_entries(f: LineageFrames) -> DataFrame:
    """Metadata and artifacts of each node as named texts."""
    return views.entries(f).where(~F.col("section").isin("Node", "Provenance"))


@query("select node_id, count(*) as files, coalesce(sum(size), 0)::bigint as bytes, string_agg(relpath, '|' order by relpath) as names from a group by 1")
def artifact_listing(f: LineageFrames) -> DataFrame:
    """The artifacts of each node."""
    return f.artifact.groupBy("node_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.array_join(F.array_sort(F.collect_list("relpath")), "|").alias("names"))


@query("select node_id, count(*) as n_entries from m where node_id in (select node_id from n) group by 1")
def envelope_sizes(f: LineageFrames) -> DataFrame:
    """How many entries each node with metadata has, from its map of entries."""
    return views.envelopes(f).select("node_id", F.size("entries").cast("bigint").alias("n_entries")).where("n_entries > 0")


def _passthrough(name: str, spark_sql: str, oracle: str) -> None:
    """A query in SQL text, as users of the store write them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sqlgate.sql(load(spark, sf_dir), spark_sql)

    run.__name__, run.__doc__ = name, "SQL over the tables of the store."
    QUERIES[name], ORACLES[name] = run, BASE + oracle


_passthrough("sql_step_counts", "select step_type, count(*) as runs from node group by 1", "select step_type, count(*) as runs from n group by 1")
_passthrough(
    "sql_step_cost",
    "select step_type, count(*) as runs, round(sum(duration_seconds), 3) as seconds, round(avg(duration_seconds) * 1000) as mean_ms, round(sum(size_bytes) / 1e6, 3) as megabytes from node where duration_seconds > 0 and duration_seconds < 1e6 group by step_type order by seconds desc",
    "select step_type, count(*) as runs, round(sum(duration_seconds), 3) as seconds, round(avg(duration_seconds) * 1000) as mean_ms, round(sum(size_bytes) / 1e6, 3) as megabytes from n where duration_seconds > 0 and duration_seconds < 1e6 group by step_type",
)
_passthrough(
    "sql_step_health",
    "select step_type, count(*) as runs, count_if(healthy) as ok from node group by step_type order by min(created_epoch_seconds)",
    "select step_type, count(*) as runs, count(*) filter (healthy) as ok from n group by step_type",
)
_passthrough(
    "sql_eav_join_3",
    "select d.value as dataset, count(*) as runs, round(avg(s.num_value), 6) as mean_accuracy from node n join metadata d on d.node_id = n.node_id and d.key = 'dataset' join metadata s on s.node_id = n.node_id and s.key = 'accuracy' group by d.value",
    "select d.value as dataset, count(*) as runs, round(avg(s.num_value), 6) as mean_accuracy from n join m d on d.node_id = n.node_id and d.key = 'dataset' join m s on s.node_id = n.node_id and s.key = 'accuracy' group by d.value",
)
_passthrough(
    "sql_eav_join_4",
    "select o.value as optimizer, count(*) as runs, min(l.num_value) as best_loss, max(s.num_value) as best_accuracy from node n join metadata o on o.node_id = n.node_id and o.key = 'optimizer' join metadata l on l.node_id = n.node_id and l.key = 'loss' join metadata s on s.node_id = n.node_id and s.key = 'accuracy' group by o.value",
    "select o.value as optimizer, count(*) as runs, min(l.num_value) as best_loss, max(s.num_value) as best_accuracy from n join m o on o.node_id = n.node_id and o.key = 'optimizer' join m l on l.node_id = n.node_id and l.key = 'loss' join m s on s.node_id = n.node_id and s.key = 'accuracy' group by o.value",
)
_passthrough(
    "sql_phase_buckets",
    "select generation div 10 as phase, count(*) as runs, sum(cast(healthy as int)) as ok, sum(case when duration_seconds between 1 and 100 then 1 else 0 end) as short from node where generation between 0 and 1000 group by 1",
    "select generation // 10 as phase, count(*) as runs, sum(healthy::int)::bigint as ok, sum(case when duration_seconds between 1 and 100 then 1 else 0 end)::bigint as short from n where generation between 0 and 1000 group by 1",
)
_passthrough(
    "sql_generation_steps",
    "select generation, step_type, count(*) as runs from node group by generation, step_type order by min(created_epoch_seconds)",
    "select generation, step_type, count(*) as runs from n group by generation, step_type",
)
_passthrough(
    "sql_window_rank",
    "select * from (select node_id, step_type, rank() over (partition by step_type order by size_bytes desc, node_id) as place from node) where place <= 3",
    "select node_id, step_type, rank() over (partition by step_type order by size_bytes desc, node_id) as place from n qualify place <= 3",
)
_passthrough(
    "sql_set_operations",
    "select node_id from node where healthy except select child_id from edge union select parent_id from edge intersect select node_id from node where not healthy",
    "select node_id from n where healthy except select child_id from e union (select parent_id from e intersect select node_id from n where not healthy)",
)
