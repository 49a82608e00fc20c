"""Queries of resolution, snapshots, queues, logs and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evaluation, model, resolution, snapshots
from graphloom.plans.graph import E, N
from graphloom.plans.sql import BASE, sql_id, sql_kind, sql_path
from graphloom.sources.tables import table


def import_bindings(spark: SparkSession, d: str) -> DataFrame:
    return resolution.import_bindings(N(spark, d))


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_imports(resolution.import_bindings(N(spark, d)), model.valid_files(table(spark, d, "files")))


def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The files that modules mean, for bindings derived from the files' own paths: the last two parts of Python paths seen from the root, and scripts seen from a folder below theirs."""
    f = model.valid_files(table(spark, d, "files")).select("repo_id", "path")
    python = f.filter("path like '%.py'").withColumn("stem", F.regexp_replace("path", r"\.py$", ""))
    absolute = python.select("repo_id", F.lit("seen.py").alias("path"), F.translate(F.substring_index("stem", "/", -2), "/", ".").alias("module"))
    script = f.filter(F.col("path").rlike(r"/[^/]*\.(ts|tsx|js|jsx|mjs|cjs)$"))
    below = script.select("repo_id", F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/below/seen.ts")).alias("path"), F.concat(F.lit("./.././"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")).alias("module"))
    bindings = absolute.unionByName(below).filter("not contains(module, '..py')").distinct().withColumn("name", F.lit(None).cast("string"))
    return resolution.resolve_imports(bindings, f).select("repo_id", "path", "module", "target", "how")


def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges by repo, kind and confidence after all resolved ones were built anew."""
    return resolution.resolve_graph(E(spark, d), N(spark, d)).groupBy("repo_id", "kind", "confidence").agg(F.count("*").alias("n_edges"))


def unique_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    return resolution.unique_names(N(spark, d))


def cascade_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_calls(E(spark, d), N(spark, d))


def range_join_enclosing(spark: SparkSession, d: str) -> DataFrame:
    return resolution.enclosing(N(spark, d))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files by index run: what each repo's latest run changed against the rows that came before it."""
    rows = table(spark, d, "files").withColumn("path", model.clean_path("path"))
    last = rows.groupBy("repo_id").agg(F.max("indexed_at").alias("at"))
    old = model.last_wins(rows.join(last, "repo_id").filter("indexed_at < at").drop("at"), ["repo_id", "path"], ["indexed_at", "content_hash"])
    new = model.valid_files(table(spark, d, "files"))
    return snapshots.snapshot_diff(old, new, ["repo_id", "path"])


def live_nodes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.live_nodes(N(spark, d), table(spark, d, "tombstones")).groupBy("repo_id", "kind").agg(F.count("*").alias("n_live"))


def _previous(spark: SparkSession, d: str) -> DataFrame:
    """The queue as the first deliveries left it: all of them embedded the moment they came."""
    n = table(spark, d, "nodes").select(model.clean_id("id").alias("node_id"), "repo_id", "content_hash", "loaded_at").filter("node_id is not null")
    first = n.groupBy("node_id").agg(F.min(F.struct("loaded_at", F.coalesce("content_hash", F.lit("")).alias("h"), "repo_id")).alias("m"))
    return first.select("node_id", "m.repo_id", F.col("m.h").alias("content_hash"), F.col("m.loaded_at").alias("queued_at"), F.col("m.loaded_at").alias("embedded_at"))


def queue_upsert(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.embedding_queue(N(spark, d), _previous(spark, d))


def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.pending(queue_upsert(spark, d).withColumn("embedded_at", F.when(F.col("embedded_at") < F.lit("2025-07-01").cast("timestamp_ntz"), F.col("embedded_at"))), 100)


def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Queue and embeddings after a run that embedded the pending nodes whose id begins with a digit: what is there, by repo and model."""
    q = queue_upsert(spark, d)
    old = q.filter("embedded_at is not null").select("node_id", "repo_id", F.lit(64).alias("dims"), F.lit("old").alias("model"), "embedded_at")
    new = q.filter("embedded_at is null and node_id < 'a'").select("node_id", "repo_id", F.lit(384).alias("dims"), F.lit("new").alias("model"), F.col("queued_at").alias("embedded_at"))
    done = snapshots.complete(q, new).select("node_id", F.col("embedded_at").isNull().alias("pending"))
    there = snapshots.upsert_embeddings(old, new).select("node_id", "model", "dims")
    return q.select("node_id", "repo_id").join(done, "node_id").join(there, "node_id", "left").groupBy("repo_id", "model", "dims").agg(F.count("*").alias("n_nodes"), F.count_if("pending").alias("n_pending"))


def removed_files(spark: SparkSession, d: str) -> DataFrame:
    """What is left of nodes, edges and queue by repo once all that belongs to files that the latest index run of their repo no longer has is gone."""
    f = model.valid_files(table(spark, d, "files"))
    last = f.groupBy("repo_id").agg(F.max("indexed_at").alias("at"))
    live = f.join(last, "repo_id").filter("indexed_at >= at - 86400 * 90")
    parts = snapshots.remove_missing_files(N(spark, d), E(spark, d), queue_upsert(spark, d), live)
    return reduce(DataFrame.unionByName, [p.groupBy("repo_id").agg(F.count("*").alias("n_left")).select("repo_id", F.lit(t).alias("table_name"), "n_left") for t, p in zip(("nodes", "edges", "queue"), parts)])


def embedding_counts(spark: SparkSession, d: str) -> DataFrame:
    return queue_upsert(spark, d).groupBy("repo_id").agg(F.count_if(F.col("embedded_at").isNull()).alias("n_pending"), F.count_if(F.col("embedded_at").isNotNull()).alias("n_embedded"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.embedding_text(N(spark, d))


def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.exact_duplicates(table(spark, d, "documents"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.nearest_vectors(table(spark, d, "embeddings"), 5)


def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.timing_summary(table(spark, d, "events"), "event_type", "value")


def _means(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


def metric_compare(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of each event type in the second half of the month against the first; lower is better for purchases, higher for the rest."""
    ev = table(spark, d, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    kinds = ev.select(F.col("event_type").alias("metric")).distinct().withColumn("direction", F.when(F.col("metric") < "p", "lower").otherwise("higher"))
    return evaluation.compare_metrics(_means(ev.filter(F.col("ts") >= half)), _means(ev.filter(F.col("ts") < half)), kinds)


def reconciliation_check(spark: SparkSession, d: str) -> DataFrame:
    """Per repo: the nodes to be embedded, counted from the nodes, against those that the queue holds as pending or embedded."""
    n = N(spark, d).filter(F.col("kind").isin(*model.EMBEDDABLE)).groupBy("repo_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.coalesce("content_hash", F.lit("")) != "").alias("n_wanted"))
    both = n.join(embedding_counts(spark, d), "repo_id", "left").fillna(0, ["n_pending", "n_embedded"])
    return both.select("repo_id", "n_nodes", "n_wanted", (F.col("n_pending") + F.col("n_embedded")).alias("n_queued"), (F.col("n_wanted") == F.col("n_pending") + F.col("n_embedded")).alias("balanced"))


def timing_sanity(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.timing_sanity(timing_summary(spark, d), "event_type")


def parameter_diff(spark: SparkSession, d: str) -> DataFrame:
    """The commonest kind of edge of each repo, before and after the middle of 2025, where it changed."""
    e = table(spark, d, "edges").select("repo_id", model.clean_kind("kind").alias("kind"), (F.col("loaded_at") >= F.lit("2025-07-01").cast("timestamp_ntz")).alias("late")).filter("repo_id is not null and kind is not null")
    top = e.groupBy("repo_id", "late", "kind").agg(F.count("*").alias("n")).groupBy("repo_id", "late").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("b")).select("late", F.col("repo_id").alias("name"), F.col("b.kind").alias("value"))
    return evaluation.compare_parameters(top.filter("late"), top.filter("not late"))


def redact_json(spark: SparkSession, d: str) -> DataFrame:
    """Event records as nested JSON, with the values of telling fields replaced."""
    record = F.to_json(F.struct("event_type", F.struct(F.col("user_id").alias("session_key"), F.struct(F.col("value").alias("cost"), F.concat(F.lit('say "'), "event_type", F.lit('"')).alias("api_token")).alias("inner")).alias("user")))
    return table(spark, d, "events").select("event_id", evaluation.redact_json(record).alias("record")).withColumn("record", F.regexp_replace("record", r'"cost":[^,}]*,?', ""))


def request_counters(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.request_counters(table(spark, d, "events"))


def json_extra_extract(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return ev.groupBy("k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def redact_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.map_from_arrays(F.array(F.lit("k"), F.lit("user_token")), F.array(F.get_json_object("props", "$.k"), F.col("user_id").cast("string")))
    out = table(spark, d, "events").select("event_id", evaluation.redact_values(m).alias("m"))
    return out.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["user_token"].alias("user_token"))


def section_lead(spark: SparkSession, d: str) -> DataFrame:
    """Documentation sections with the line where the next one of their file begins."""
    from pyspark.sql import Window

    s = N(spark, d).filter("kind = 'DOCSECTION'").select("repo_id", "path", "id", "start_line")
    return s.withColumn("next_line", F.lead("start_line").over(Window.partitionBy("repo_id", "path").orderBy("start_line", "id")))


_QUEUE = BASE + f""", pr as (select node_id, min(struct_pack(l := loaded_at, h := coalesce(content_hash, ''))) m from (select {sql_id("id")} node_id, * from nodes) where node_id is not null group by 1),
qu as (select n.id node_id, n.repo_id, n.content_hash, case when m.h is not distinct from n.content_hash then m.l else n.loaded_at end queued_at, case when m.h is not distinct from n.content_hash then m.l end embedded_at
  from n left join pr on pr.node_id = n.id where n.kind in ('FUNCTION','METHOD','CLASS','ROUTE','DOCSECTION') and coalesce(n.content_hash, '') <> '')
"""
_DEFS = "('FUNCTION', 'METHOD', 'CLASS')"
_UNIQUE = f""", u as (select repo_id, name, count(*) filter (kind in ('FUNCTION', 'CLASS')) a, count(*) b, min(id) filter (kind in ('FUNCTION', 'CLASS')) ai, min(id) bi from n where kind in {_DEFS} and name is not null group by all),
un as (select repo_id, name, case when a = 1 then ai when a = 0 and b = 1 then bi end id from u where a = 1 or (a = 0 and b = 1))
"""
QUERIES = {f.__name__: f for f in (
    import_bindings, import_resolution, module_resolution, resolved_edges, unique_or_nothing, cascade_resolution, range_join_enclosing, snapshot_diff, live_nodes, queue_upsert, pending_queue, embedding_upsert, removed_files, embedding_counts, embedding_text,
    exact_duplicate_groups, cosine_topk, timing_summary, metric_compare, reconciliation_check, timing_sanity, parameter_diff, redact_json, request_counters, json_extra_extract, redact_keys, section_lead,
)}
ORACLE = {
    "import_bindings": BASE + ", i as (select repo_id, path, unnest(extra.imports) i from n where kind = 'FILE' and extra is not null) select distinct repo_id, path, i.module, i.name, coalesce(nullif(i.alias, ''), nullif(nullif(i.name, ''), 'default'), i.module) \"alias\" from i where i.module is not null or i.name is not null",
    "unique_or_nothing": BASE + _UNIQUE + "select repo_id, name, id from un",
    "module_resolution": BASE + """, py as (select repo_id, 'seen.py' path, replace(array_to_string(list_slice(string_split(regexp_replace(path, '\\.py$', ''), '/'), -2, -1), '/'), '/', '.') "module" from f where path like '%.py'),
sc as (select repo_id, regexp_replace(path, '/[^/]*$', '') dir, regexp_replace(list_extract(string_split(path, '/'), -1), '\\.[^.]*$', '') stem from f where regexp_matches(path, '/[^/]*\\.(ts|tsx|js|jsx|mjs|cjs)$')),
pc as (select distinct py.repo_id, py.path, "module", k, replace("module", '.', '/') || sfx cand from py, (values (0, '.py'), (1, '/__init__.py')) v(k, sfx)),
ph as (select pc.*, f.path target, k pr, 'exact' how from pc join f on f.repo_id = pc.repo_id and f.path = cand union all
  select pc.*, target, k + 20, 'suffix' from pc join (select repo_id, sfx, min(path) target from (select repo_id, path, array_to_string(list_slice(string_split(path, '/'), i, -1), '/') sfx from (select *, unnest(range(2, len(string_split(path, '/')) + 1)) i from f)) group by all having count(*) = 1) u on u.repo_id = pc.repo_id and u.sfx = cand),
sh as (select distinct sc.repo_id, dir || '/below/seen.ts' path, './.././' || stem "module", f.path target, k pr from sc, (values (0, ''), (3, '.ts'), (4, '.tsx'), (5, '.js'), (6, '.jsx'), (7, '.mjs'), (8, '.cjs'), (9, '/index.ts'), (10, '/index.tsx'), (11, '/index.js'), (12, '/index.jsx'), (13, '/index.mjs'), (14, '/index.cjs')) v(k, sfx) join f on f.repo_id = sc.repo_id and f.path = dir || '/' || stem || sfx),
al as (select repo_id, path, "module", target, how, pr from ph union all select repo_id, path, "module", target, 'exact', pr from sh)
select repo_id, path, "module", target, how from (select *, row_number() over (partition by repo_id, path, "module" order by pr) o from al) where o = 1 and target <> path""",
    "range_join_enclosing": BASE + f""", d as (select * from n where kind in {_DEFS}), h as (select a.id, b.id \"owner\", b.end_line - b.start_line span, b.start_line s from d a join d b on a.repo_id = b.repo_id and a.path = b.path and a.id <> b.id
  and a.start_line between b.start_line and b.end_line and not (b.start_line = a.start_line and b.id > a.id)) select id, \"owner\", span from (select *, row_number() over (partition by id order by span, s, \"owner\") k from h) where k = 1""",
    "cascade_resolution": BASE + _UNIQUE + f""", d as (select repo_id, id, qname, kind from n where kind in {_DEFS} and qname is not null),
c as (select distinct e.repo_id, e.src, e.detail, s.qname q, regexp_replace(s.qname, '\\.[^.]*$', '') sc from e join n x on x.id = e.dst and x.kind = 'EXTERNALSYMBOL' join n s on s.id = e.src and s.kind in {_DEFS} where e.kind = 'CALLS' and e.detail <> ''),
r1 as (select c.repo_id, c.src, c.detail, max(d.id) target, 1 rule from c join d on d.repo_id = c.repo_id and d.qname = c.detail group by all),
m as (select repo_id, qname, min(id) id from d where kind = 'METHOD' group by all having count(*) = 1),
r2 as (select c.repo_id, c.src, c.detail, m.id target, 2 rule from c join m on m.repo_id = c.repo_id and m.qname = sc || '.' || split_part(c.detail, '.', 2) where regexp_matches(c.detail, '^(self|cls|this)\\.') and len(string_split(c.detail, '.')) = 2),
sf as (select repo_id, array_to_string(list_slice(p, i, len(p)), '.') sfx, min(id) id from (select repo_id, id, string_split(qname, '.') p, unnest(range(1, len(string_split(qname, '.')) + 1)) i from d) group by all having count(*) = 1),
r3 as (select c.repo_id, c.src, c.detail, sf.id target, 3 rule from c join sf on sf.repo_id = c.repo_id and sf.sfx = c.detail where not regexp_matches(c.detail, '^(self|cls|this)\\.') and contains(c.detail, '.')),
un1 as (select repo_id, name, min(id) id from n where kind in ('FUNCTION', 'METHOD', 'CLASS') and name is not null group by all having count(*) = 1),
r4 as (select c.repo_id, c.src, c.detail, un.id target, 4 rule from c join un1 un on un.repo_id = c.repo_id and un.name = list_extract(string_split(c.detail, '.'), -1) where not regexp_matches(c.detail, '^(self|cls|this)\\.')),
al as (select * from r1 union all select * from r2 union all select * from r3 union all select * from r4)
select repo_id, src, detail, target, rule from (select *, row_number() over (partition by repo_id, src, detail order by rule, target) k from al) where k = 1 and target <> src""",
    "snapshot_diff": BASE + f""", a as (select repo_id, {sql_path("path")} path, content_hash, indexed_at from files), l as (select repo_id, max(indexed_at) latest from a group by 1),
o as (select repo_id, path, content_hash from (select a.*, row_number() over (partition by repo_id, path order by indexed_at desc, content_hash desc nulls last) k from a join l using (repo_id) where indexed_at < latest) where k = 1 and path is not null)
select coalesce(o.repo_id, f.repo_id) repo_id, coalesce(o.path, f.path) path, case when o.path is null then 'added' when f.path is null then 'removed' when o.content_hash is not distinct from f.content_hash then 'unchanged' else 'changed' end change
from o full join f on o.repo_id = f.repo_id and o.path = f.path""",
    "live_nodes": BASE + f", t as (select {sql_id('node_id')} id, max(removed_at) gone from tombstones group by 1) select repo_id, kind, count(*) n_live from n left join t using (id) where t.gone is null or n.loaded_at > t.gone group by all",
    "queue_upsert": _QUEUE + "select * from qu",
    "pending_queue": _QUEUE + "select node_id, repo_id, content_hash, queued_at, null::timestamp embedded_at from qu where embedded_at is null or embedded_at >= '2025-07-01' order by queued_at, node_id limit 100",
    "embedding_upsert": _QUEUE + """, x as (select *, case when embedded_at is not null then 'old' when node_id < 'a' then 'new' end model from qu)
select repo_id, model, case model when 'old' then 64 when 'new' then 384 end dims, count(*) n_nodes, count(*) filter (model is null) n_pending from x group by all""",
    "removed_files": _QUEUE + """, lv as (select repo_id, path from (select *, max(indexed_at) over (partition by repo_id) latest from f) where indexed_at >= latest - 86400 * 90),
kn as (select * from n where owner_path is null or repo_id is null or exists (select 1 from lv where lv.repo_id = n.repo_id and lv.path = n.owner_path)), ke as (select * from e where owner_path is null or repo_id is null or exists (select 1 from lv where lv.repo_id = e.repo_id and lv.path = e.owner_path))
select repo_id, 'nodes' table_name, count(*) n_left from kn group by all union all select repo_id, 'edges', count(*) from ke group by all union all select repo_id, 'queue', count(*) from qu where node_id in (select id from kn) group by all""",
    "embedding_counts": _QUEUE + "select repo_id, count(*) filter (embedded_at is null) n_pending, count(embedded_at) n_embedded from qu group by all",
    "reconciliation_check": _QUEUE + """, w as (select repo_id, count(*) n_nodes, count(*) filter (coalesce(content_hash, '') <> '') n_wanted from n where kind in ('FUNCTION','METHOD','CLASS','ROUTE','DOCSECTION') group by 1)
select repo_id, n_nodes, n_wanted, n_queued, n_wanted = n_queued balanced from (select *, (select count(*) from qu where qu.repo_id is not distinct from w.repo_id) n_queued from w)""",
    "embedding_text": BASE + "select id, regexp_replace(left(array_to_string([x for x in [qname, signature, doc] if length(trim(coalesce(x, ''))) > 0], chr(10)), 384), chr(10) || '+$', '') text from n where kind in ('FUNCTION','METHOD','CLASS','ROUTE','DOCSECTION')",
    "cosine_topk": """with v as (select vec_id, embedding::double[] v from embeddings where embedding is not null), s as (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.v, v.v), 6) similarity from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select * from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) "position" from s) where "position" <= 5""",
    "exact_duplicate_groups": "with g as (select text, min(doc_id) class_id, count(*) n_copies from documents where text is not null group by text having count(*) > 1) select doc_id, class_id, n_copies from documents join g using (text)",
    "timing_summary": """with v as (select event_type, value v, row_number() over (partition by event_type order by value) - 1 i, count(*) over (partition by event_type) n from events where value is not null)
select event_type, any_value(n) n, round(min(v), 6) min_v, round(median(v), 6) p50, round(avg(v), 4) mean_v, round(max(v) filter (i = round_even(0.95 * (n - 1), 0)), 6) p95, round(max(v), 6) max_v from v group by event_type""",
    "metric_compare": """with c as (select event_type m, round(avg(value), 6) v from events where ts >= '2024-01-16' group by 1), b as (select event_type m, round(avg(value), 6) v from events where ts < '2024-01-16' group by 1),
k as (select distinct event_type m, case when event_type < 'p' then 'lower' else 'higher' end dir from events)
select k.m metric, c.v "current", b.v baseline, case when c.v is null or b.v is null then 'missing' when (dir = 'lower' and c.v < b.v) or (dir = 'higher' and c.v > b.v) then 'ok' else 'regression' end verdict from k left join c using (m) left join b using (m)""",
    "timing_sanity": "select event_type, unnest(['present', 'counted', 'ordered', 'mean_within']) \"check\", true passed from (select distinct event_type from events where value is not null)",
    "parameter_diff": f"""with t as (select repo_id, loaded_at >= '2025-07-01' late, {sql_kind('kind')} kind, count(*) c from edges where repo_id is not null and loaded_at is not null group by all), k as (select *, row_number() over (partition by repo_id, late order by c desc, kind) o from t where kind is not null),
a as (select * from k where o = 1 and late), b as (select * from k where o = 1 and not late)
select coalesce(a.repo_id, b.repo_id) "name", a.kind "current", b.kind baseline, case when b.repo_id is null then 'added' when a.repo_id is null then 'removed' else 'changed' end change from a full join b using (repo_id) where a.kind is distinct from b.kind""",
    "redact_json": """select event_id, '{"event_type":"' || event_type || '","user":{"session_key":"[REDACTED]","inner":{"api_token":"[REDACTED]"}}}' record from events""",
    "request_counters": "select event_type, strftime(ts, '%Y-%m-%d') \"day\", count(*) n_events, count(distinct user_id) n_users, round(sum(value), 4) total from events group by all",
    "json_extra_extract": "select json_extract(props, '$.k')::bigint k, count(*) n, min(event_id) first_event from events group by all",
    "redact_keys": "select event_id, json_extract_string(props, '$.k') k, '[REDACTED]' user_token from events",
    "section_lead": BASE + "select repo_id, path, id, start_line, lead(start_line) over (partition by repo_id, path order by start_line, id) next_line from n where kind = 'DOCSECTION'",
}
