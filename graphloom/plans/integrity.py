"""Problems 1 and 5: orphan references, and per-key results of very uneven keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.orphans import orphan_references, orphan_report
from graphloom.operators.skewed_keys import edge_key_statistics, heavy_keys
from graphloom.plans.sql import W, sql_id, sql_path
from graphloom.sources.tables import table


def _orphans(spark: SparkSession, d: str, count_late: bool) -> DataFrame:
    return orphan_references(*[table(spark, d, t) for t in ("edges", "nodes", "shared_nodes", "tombstones", "files")], count_late=count_late)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, False).select("ref_field", "repo_id", "ref_value", "ref_month", "ref_state")


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d, True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    return heavy_keys(edge_key_statistics(edges), edges).select("key_field", "key_value")


def p5_key_statistics(spark: SparkSession, d: str) -> DataFrame:
    return edge_key_statistics(table(spark, d, "edges"))


_ORPHANS = f"""
with t as (select {sql_id("node_id")} id, max(removed_at) removed from tombstones group by 1),
live as (
  select {sql_id("n.id")} id, min(n.loaded_at) first_at from nodes n left join t on t.id = {sql_id("n.id")}
  where t.removed is null or n.loaded_at > t.removed group by 1
  union all select {sql_id("id")}, min(loaded_at) from shared_nodes group by 1),
first_live as (select id, min(first_at) first_at from live group by 1),
f as (select repo_id, {sql_path("path")} path, min(make_timestamp(cast(round(indexed_at * 1000000) as bigint))) first_at from files group by 1, 2),
refs as (
  select 'src' ref_field, repo_id, {sql_id("src")} ref_value, loaded_at from edges
  union all select 'dst', repo_id, {sql_id("dst")}, loaded_at from edges
  union all select 'owner_path', repo_id, {sql_path("owner_path")}, loaded_at from edges),
grouped as (
  select ref_field, repo_id, ref_value, strftime(loaded_at, '%Y-%m') ref_month, min(loaded_at) edge_at, count(*) n_refs
  from refs where ref_value is not null group by all),
stated as (
  select g.* exclude (n_refs), case when g.ref_field = 'owner_path' and edge_at < f.first_at or g.ref_field <> 'owner_path' and edge_at < l.first_at then (select count(*) from refs r where r.ref_field = g.ref_field and r.repo_id is not distinct from g.repo_id
    and r.ref_value = g.ref_value and strftime(r.loaded_at, '%Y-%m') = g.ref_month and r.loaded_at < coalesce(f.first_at, l.first_at)) else n_refs end n_refs, case when g.ref_field = 'owner_path' then (case when f.path is null then 'missing' when edge_at < f.first_at then 'late' end)
    when l.id is null then (case when t.id is null then 'missing' else 'deleted' end) when edge_at < l.first_at then 'late' end ref_state
  from grouped g left join first_live l on l.id = g.ref_value and g.ref_field <> 'owner_path'
  left join t on t.id = g.ref_value and g.ref_field <> 'owner_path'
  left join f on f.path = g.ref_value and f.repo_id is not distinct from g.repo_id and g.ref_field = 'owner_path')
"""

_KEYS = f"""
with rows as (
  select 'dst' key_field, {sql_id("dst")} key_value, {sql_id("src")} src, nullif(trim(repo_id, {W}), '') repo, loaded_at from edges
  union all select 'kind', nullif(upper(trim(kind, {W})), ''), {sql_id("src")}, nullif(trim(repo_id, {W}), ''), loaded_at from edges)
"""

QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report, "p5_found": p5_found, "p5_key_statistics": p5_key_statistics}
ORACLE = {
    "p1_found": _ORPHANS + "select ref_field, repo_id, ref_value, ref_month, ref_state from stated where ref_state is not null",
    "p1_orphan_report": _ORPHANS + "select repo_id, ref_field, ref_month, ref_state, count(*) n_values, cast(sum(n_refs) as bigint) n_refs from stated where ref_state is not null group by all",
    "p5_found": _KEYS + "select key_field, key_value from rows where key_value is not null group by all having count(*) >= 0.007 * (select count(*) from edges)",
    "p5_key_statistics": _KEYS + """select key_field, key_value, count(*) n_rows, count(distinct repo) n_repo, count(distinct src) n_src, min(loaded_at) first_load, max(loaded_at) last_load
from rows where key_value is not null group by all""",
}
