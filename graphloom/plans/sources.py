"""Queries of parsers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.normalize import clean_path
from graphloom.sources import parse
from graphloom.sources.tables import table
from graphloom.sources.trees import probably_generated
from graphloom.streaming import incremental


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_texts").select("repo_id", clean_path("path").alias("path"), F.col("head").alias("text"))


def parsed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_sources(_texts(spark, d), "nodes")


def parsed_edges(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_sources(_texts(spark, d), "edges")


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return parse.markdown_sections(_texts(spark, d).filter(F.col("path").rlike(r"(?i)\.mdx?$")))


def running_depth(spark: SparkSession, d: str) -> DataFrame:
    return parse.running_depth(_texts(spark, d))


def generated_file_filter(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").withColumn("path", clean_path("path"))
    return f.filter(~probably_generated("path", "size")).groupBy("repo_id", "language").agg(F.countDistinct("path").alias("n_files"))


def streaming_event_counters(spark: SparkSession, d: str) -> DataFrame:
    events = incremental.event_stream(spark, f"{d.rstrip('/')}/event[s].parquet")  # a pattern: the stream reader takes folders or patterns
    out = incremental.run_to_table(incremental.windowed_counters(events, "1 day", "60 days"), "event-counters")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "total")


_LINES = """with t as (select repo_id, regexp_replace(replace(path, chr(92), '/'), '^(\\./)+', '') path, head from file_texts where path is not null and head is not null)
"""
QUERIES = {f.__name__: f for f in (parsed_nodes, parsed_edges, markdown_sections, running_depth, generated_file_filter, streaming_event_counters)}
ORACLE = {
    "markdown_sections": _LINES + """, l as (select repo_id, path, len(p) n, unnest(p) line, unnest(range(1, len(p) + 1)) pos from (select *, string_split(replace(replace(head, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) p from t where regexp_matches(lower(path), '\\.mdx?$'))),
h as (select * from l where regexp_matches(line, '^#{1,6}\\s+\\S'))
select repo_id, path, length(regexp_extract(line, '^(#+)', 1))::int "level", trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) title, pos::int start_line, coalesce(lead(pos) over (partition by repo_id, path order by pos), n)::int end_line from h""",
    "running_depth": _LINES + """, l as (select repo_id, path, unnest(p) line, unnest(range(1, len(p) + 1)) pos from (select *, string_split(head, chr(10)) p from t)),
d as (select *, sum(length(regexp_replace(line, '[^{]', '', 'g')) - length(regexp_replace(line, '[^}]', '', 'g'))) over (partition by repo_id, path order by pos) d from l)
select repo_id, path, max(d)::bigint max_depth, arg_max(d, pos)::bigint end_depth from d group by all""",
    "generated_file_filter": """select repo_id, "language", count(distinct p) n_files from (select *, regexp_replace(replace(path, chr(92), '/'), '^(\\./)+', '') p from files)
where not (regexp_matches(lower(list_extract(string_split(p, '/'), -1)), '\\.(min|bundle)\\.js$|generated|\\.lock$') or coalesce(size, 0) > 1000000) group by all""",
    "streaming_event_counters": "select date_trunc('day', ts)::timestamp window_start, event_type, count(*) n_events, round(sum(value), 4) total from events group by all",
}
