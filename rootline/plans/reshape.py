"""Queries of the reshaping operators: wide tables, hierarchies, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootline.operators import hierarchy, nested, wide
from rootline.plans.lineage import BASE, BLANKS, LABEL
from rootline.session import prepare, table


def _wide_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    """All rows of metadata as a compacted run, from the deltas of their batches in order of arrival."""
    prepare(spark)
    catalog = wide.read_catalog(table(spark, sf_dir, "attr_catalog"))
    deltas = wide.delta(wide.arrivals(table(spark, sf_dir, "metadata")), catalog, F.col("version"), batch=F.col("batch"))
    return wide.compact(catalog, deltas), catalog


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a given value but not exactly one readable value."""
    run, catalog = _wide_run(spark, sf_dir)
    return wide.unsettled(run, catalog).select(F.col("entity").alias("node_id"), "attr")


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node with a typed column per attribute, null where the rows don't agree."""
    run, catalog = _wide_run(spark, sf_dir)
    out = wide.table(run, catalog)
    return out.select(F.col("entity").alias("node_id"), *catalog, F.array_join("unsettled", ",").alias("unsettled"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached again from themselves."""
    prepare(spark)
    return hierarchy.cycle_nodes(hierarchy.edges(table(spark, sf_dir, "edge"))).select(F.col("node").alias("node_id"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    nodes = table(spark, sf_dir, "node").select(hierarchy.label(F.col("node_id")).alias("node")).where("node is not null").distinct()
    return hierarchy.paths(hierarchy.edges(table(spark, sf_dir, "edge")), nodes)


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and root of each node by first parents, and whether it leads to a loop."""
    return _paths(spark, sf_dir).select(F.col("node").alias("node_id"), "root", F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("path"), "looped")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each node along any parents, by their least distance."""
    prepare(spark)
    return hierarchy.all_descendants(hierarchy.edges(table(spark, sf_dir, "edge"))).select(F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are elements of an array, at any depth, with the row they belong to."""
    prepare(spark)
    return nested.elements(table(spark, sf_dir, "metadata"))


def p4_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged schema of all nested values: levels, columns and their types."""
    prepare(spark)
    return nested.schema(nested.shred(table(spark, sf_dir, "metadata")))


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p2_found, p2_paths, p2_descendants, p4_found, p4_schema)}

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"

_SETTLED = rf"""with c as (select {LABEL("attr")} as attr, {LABEL("col_type")} as t from attr_catalog),
r as (select {LABEL("node_id")} as node_id, {LABEL("key")} as attr, value, num_value, trim(value, {BLANKS}) as raw from metadata),
k as (select r.node_id, r.attr, c.t, raw, value, num_value, case
    when value is null then case when num_value is not null and not isnan(num_value) then 'number' end
    when raw in ('', 'NaN', 'null') then null
    when regexp_full_match(raw, '"([^"\\]|\\.)*"') and json_valid(raw) then case when trim(json_extract_string(raw, '$'), {BLANKS}) <> '' then 'string' end
    when raw in ('true', 'false') then 'boolean'
    when regexp_full_match(raw, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') then 'number'
    else 'other' end as kind
  from r join c using (attr) where r.node_id is not null),
x as (select node_id, attr, t, kind, case when value is null then num_value::varchar when kind = 'string' then trim(json_extract_string(raw, '$'), {BLANKS}) else raw end as text from k where kind is not null),
v as (select node_id, attr, case
    when t = 'double' and kind in ('number', 'string') and regexp_full_match(text, '{_NUMBER}') then (try_cast(text as double) + 0)::varchar
    when t = 'long' and kind in ('number', 'string') and regexp_full_match(text, '{_NUMBER}') and try_cast(text as double) = floor(try_cast(text as double)) then try_cast(try_cast(text as double) as bigint)::varchar
    when t = 'boolean' and (kind = 'string' and lower(text) in ('true', 'yes', '1') or kind = 'boolean' and text = 'true' or kind = 'number' and try_cast(text as double) = 1) then 'true'
    when t = 'boolean' and (kind = 'string' and lower(text) in ('false', 'no', '0') or kind = 'boolean' and text = 'false' or kind = 'number' and try_cast(text as double) = 0) then 'false'
    when t = 'timestamp' and kind = 'number' then round(try_cast(text as double) * 1000000)::bigint::varchar
    when t = 'timestamp' and kind = 'string' and regexp_full_match(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then epoch_us(try_cast(text || ' 00:00:00+00' as timestamptz))::varchar
    when t = 'timestamp' and kind = 'string' and regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]') then epoch_us(try_cast(text || case when regexp_matches(text, '(Z|[+-][0-9:]+)$') and not regexp_matches(text, '^[0-9-]+$') and regexp_matches(text, '[T ][0-9:.]+(Z|[+-][0-9:]+)$') then '' else '+00' end as timestamptz))::varchar
    when t = 'string' and kind = 'string' then text end as val from x)
select node_id, attr from v group by 1, 2 having count(distinct val) <> 1"""

_FIRST = BASE + """, f as (select child_id as node, (array_agg(parent_id order by coalesce(ordinal, 2147483647), parent_id))[1] as parent from e group by 1),
known as (select node_id as node from n union select child_id from e union select parent_id from e),
walk as (select node, node as root, 0 as depth, node as path from known where node not in (select node from f)
  union all select f.node, walk.root, walk.depth + 1, walk.path || '/' || f.node from walk join f on f.parent = walk.node)
select node as node_id, root, depth, path, false as looped from walk union all select node, null, null, null, true from f where node not in (select node from walk)"""

_BELOW = BASE + """, down(node, descendant, distance) using key (node, descendant) as (
  select parent_id, child_id, 1 from e where child_id <> parent_id
  union select d.node, e.child_id, d.distance + 1 from down d join e on e.parent_id = d.descendant left join recurring.down r on r.node = d.node and r.descendant = e.child_id
  where e.child_id <> d.node and r.node is null)
select node as node_id, descendant as descendant_id, distance from down"""

_ELEMENTS = BASE + """, texts as (select distinct {node} as node_id, {key} as key, value from metadata where regexp_matches(value, '^\\s*["\\[{{]')),
plain as (select node_id, key, case when json_valid(value) then value else regexp_replace(value, '\\bNaN\\b', 'null', 'g') end as v from texts),
outer_ as (select node_id, key, case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') else v end as v from plain where json_valid(v)),
valid as (select node_id, key, case when json_valid(v) then v else regexp_replace(v, '\\bNaN\\b', 'null', 'g') end as v from outer_),
walk as (
  select node_id, key, '$' as path, '$' as owner, null::varchar as found, v::json as j from valid where json_valid(v) and json_type(v) in ('OBJECT', 'ARRAY')
  union all
  select node_id, key, path || x.step, case when x.element and json_type(x.value) = 'OBJECT' then path || x.step else owner end, case when x.element and json_type(x.value) = 'OBJECT' then owner end, x.value
  from (select *, unnest(case json_type(j)
      when 'OBJECT' then list_transform(map_entries(j::map(varchar, json)), lambda m: {{'step': '.' || m.key, 'value': m.value, 'element': false}})
      else list_transform(range(json_array_length(j)::bigint), lambda i: {{'step': '[' || i || ']', 'value': j->i, 'element': true}}) end) as x from walk where json_type(j) in ('OBJECT', 'ARRAY')))
select distinct node_id, key, path, found as parent_path from walk where found is not null""".format(node=LABEL("node_id"), key=LABEL("key"))

ORACLES = {
    "p2_paths": _FIRST,
    "p2_descendants": _BELOW,
    "p4_found": _ELEMENTS,
    "p1_found": _SETTLED,
    "p2_found": BASE + ", above as (select child_id as node, parent_id as top from e union select above.node, e.parent_id from above join e on e.child_id = above.top) select distinct node as node_id from above where node = top",
}
