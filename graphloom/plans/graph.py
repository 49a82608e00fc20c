"""Queries over the property graph: model, neighbours, symbols, traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import impact, model, neighbors, symbols, traversal
from graphloom.plans.sql import BASE, EXTERNAL
from graphloom.session import stored
from graphloom.sources.tables import table


def N(spark: SparkSession, d: str) -> DataFrame:
    return model.valid_nodes(table(spark, d, "nodes"))


def E(spark: SparkSession, d: str) -> DataFrame:
    return model.valid_edges(table(spark, d, "edges"))


def repo_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return model.repo_status(model.valid_repos(table(spark, d, "repos")), model.valid_files(table(spark, d, "files")), N(spark, d)).orderBy(F.desc("indexed_at"), "repo_id")


def table_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    return model.cardinalities({t: table(spark, d, t) for t in ("repos", "files", "nodes", "edges", "tombstones", "documents", "embeddings", "events")})


def node_projection(spark: SparkSession, d: str) -> DataFrame:
    n = N(spark, d)
    return n.select("id", "kind", "qname", "path", "start_line", "end_line", model.node_id(F.col("kind"), F.col("qname"), F.col("path"), F.col("start_line")).alias("content_id"), F.size(F.coalesce("extra.imports", F.array())).alias("n_imports"))


def edge_projection(spark: SparkSession, d: str) -> DataFrame:
    return E(spark, d).select("repo_id", "owner_path", "src", "dst", "kind", "detail", "confidence", F.when(F.col("kind") == "IMPORTS", "conservative_file").otherwise("precise_symbol").alias("scope"))


def degree_top_node(spark: SparkSession, d: str) -> DataFrame:
    return model.top_degree(E(spark, d))


def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    return model.kind_histogram(N(spark, d))


def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return model.graph_links(E(spark, d), N(spark, d))


def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors(E(spark, d), N(spark, d), "out", 16)


def neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors(E(spark, d), N(spark, d), "in", 16)


def neighbors_dangling(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors(E(spark, d), N(spark, d), "out", 16).filter("dangling").select("center_id", "node_id", "kind", "position")


def impact_shadow_filter(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.without_shadows(E(spark, d), N(spark, d)).groupBy("repo_id", "kind").agg(F.count("*").alias("n_edges"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names to look up: those of all classes and routes, in another case."""
    return N(spark, d).filter("kind in ('CLASS', 'ROUTE')").select(F.upper("name").alias("query")).filter("query is not null").distinct()


def symbol_exact(spark: SparkSession, d: str) -> DataFrame:
    return symbols.exact_symbols(N(spark, d), _names(spark, d), 20)


def _parts(nodes: DataFrame) -> DataFrame:
    """Parts of names: the last two words of each function's name."""
    return nodes.filter("kind = 'FUNCTION'").select(F.substring_index("name", "_", -2).alias("query")).filter("query is not null").distinct()


def symbol_substring(spark: SparkSession, d: str) -> DataFrame:
    # Queries are counted, collected and looked for one after the other: the valid nodes are found once.
    n = stored(N(spark, d).select("id", "name", "qname", "kind", "path"), "valid-nodes")
    return symbols.substring_symbols(n, _parts(n), 20)


def symbol_cascade(spark: SparkSession, d: str) -> DataFrame:
    return symbols.find_symbols(N(spark, d), _parts(N(spark, d)).unionByName(_names(spark, d)).distinct(), 20).select("query", "id", "tier", "position")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return N(spark, d).filter("kind = 'ROUTE'").select(F.col("id").alias("seed"), "id")


def bfs_distance_down(spark: SparkSession, d: str) -> DataFrame:
    return traversal.reach(E(spark, d), N(spark, d), _seeds(spark, d), "down", None).select("seed", "id", "distance")


def _sinks(spark: SparkSession, d: str) -> DataFrame:
    """Whatever code may change: files and definitions."""
    return N(spark, d).filter("kind in ('FILE', 'FUNCTION', 'METHOD', 'CLASS')").select(F.col("id").alias("seed"), "id")


def bfs_distance_up(spark: SparkSession, d: str) -> DataFrame:
    return traversal.reach(E(spark, d), N(spark, d), _sinks(spark, d), "up", None).select("seed", "id", "distance")


def bfs_weakest_confidence(spark: SparkSession, d: str) -> DataFrame:
    return traversal.reach(E(spark, d), N(spark, d), _seeds(spark, d), "down", None).select("seed", "id", "distance", "rank", "conservative")


def bfs_files(spark: SparkSession, d: str) -> DataFrame:
    n = N(spark, d)
    return traversal.radius_files(traversal.reach(E(spark, d), n, _seeds(spark, d), "down", None), n)


def impact_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    n, e, seeds = _changes(spark, d)
    return traversal.blast_radius(e, n, seeds, None, 1000).drop("n_reached")


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid nodes, and of the valid edges what a radius needs, each written once, and whatever code may change."""
    n = stored(N(spark, d).select("id", "repo_id", "kind", "qname", "path", "start_line"), "valid-nodes")
    e = E(spark, d).filter(F.col("kind").isin(*model.TRAVERSED, "DEFINES")).select("repo_id", "src", "dst", "kind", "confidence")
    return n, stored(e, "valid-edges"), n.filter("kind in ('FILE', 'FUNCTION', 'METHOD', 'CLASS')").select(F.col("id").alias("seed"), "id")


def impact_targets(spark: SparkSession, d: str) -> DataFrame:
    """Ids, names of classes in another case, parts of function names, and what is no name at all."""
    n = stored(N(spark, d), "valid-nodes")
    ids = n.filter("kind = 'ROUTE'").select(F.upper("id").alias("query"))
    names = n.filter("kind = 'CLASS' and name is not null").select(F.upper("name").alias("query"))
    words = n.filter("kind = 'DOCSECTION' and name is not null").select(F.concat("name", F.lit(" zzqx")).alias("query"))
    return impact.impact_targets(n, ids.unionByName(names).unionByName(words).distinct(), 5)


def impact_report(spark: SparkSession, d: str) -> DataFrame:
    """A report for each class, route and function."""
    n, e = stored(N(spark, d).select("id", "repo_id", "kind", "name", "qname", "path", "start_line"), "valid-nodes"), stored(model.valid_edges(table(spark, d, "edges"), "src").drop("loaded_at"), "valid-edges")
    return impact.impact_report(e, n, n.filter("kind in ('CLASS', 'ROUTE', 'FUNCTION')").select("id"))


def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    n, e, seeds = _changes(spark, d)
    c = traversal.radius_counters(e, n, seeds, None, 1000).filter("upstream + downstream > 0")
    return c.select("seed", F.col("upstream").alias("n_upstream"), F.col("downstream").alias("n_downstream"), F.col("files").alias("n_files"), F.col("entrypoints").alias("n_entrypoints"), "max_distance")


def impact_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    """Routes above functions. Walked down from the routes, which are few: a way up passes the same nodes."""
    n = N(spark, d)
    down = traversal.reach(E(spark, d), n, _seeds(spark, d), "down", None).filter("distance > 0").select(F.col("seed").alias("route"), F.col("id").alias("seed"), "distance")
    found = down.join(n.filter("kind = 'FUNCTION'").select(F.col("id").alias("seed")), "seed")
    return found.join(n.select(F.col("id").alias("route"), "qname"), "route").select("seed", F.col("route").alias("id"), "qname", "distance")


_NEIGHBORS = BASE + """, b as (select e.{near} center_id, e.{far} node_id, e.kind, e.confidence, e.detail, e.owner_path, n.name node_name, n.kind node_kind, n.path node_path, n.start_line node_line from e left join n on n.id = e.{far}),
k as (select *, node_kind is null dangling, row_number() over (partition by center_id order by coalesce(node_kind in %s, false)::int, case lower(confidence) when 'resolved' then 0 when 'strong' then 1 else 2 end,
  coalesce(node_path, ''), coalesce(node_line, 0), kind, node_id, detail, coalesce(owner_path, '')) position from b)
select center_id, node_id, kind, confidence, detail, node_name, node_kind, node_path, node_line, dangling, position from k where position <= 16""" % EXTERNAL

_RANKED = "case lower(e.confidence) when 'exact' then 0 when 'strong' then 1 when 'resolved' then 2 else 3 end"
_WALKED = "('CALLS', 'IMPORTS', 'EXTENDS', 'HANDLES', 'EXPOSES')"
_LEFT = "('FILE', 'FUNCTION', 'METHOD', 'CLASS', 'ROUTE')"


def _walk(name: str, near: str, far: str, starts: str) -> str:
    """A walk until nothing new is found, as a recursive table with one row per (seed, id)."""
    return f""", m_{name} as (select e.{near} id, e.{far} nxt, min({_RANKED}) rk, bool_and(e.kind = 'IMPORTS') c, bool_or(coalesce(n.kind in {_LEFT}, false)) x from e join n on n.id = e.{far} where e.kind in {_WALKED} group by all),
{name} (seed, id, distance, rk, c, x) using key (seed, id) as (select distinct seed, id, 0, 0, false, true from ({starts}) union
  select w.seed, m.nxt, min(w.distance) + 1, min(greatest(w.rk, m.rk)), bool_and(m.c), bool_or(m.x) from {name} w join m_{name} m on m.id = w.id where w.x and not exists (select 1 from recurring.{name} o where o.seed = w.seed and o.id = m.nxt) group by w.seed, m.nxt)
"""


_RBASE = BASE.replace("with n as", "with recursive n as", 1)
_SINKS = "('FILE', 'FUNCTION', 'METHOD', 'CLASS')"
_DOWN = _RBASE + _walk("walk", "src", "dst", "select id seed, id from n where kind = 'ROUTE'")
_UP = _RBASE + _walk("walk", "dst", "src", f"select id seed, id from n where kind in {_SINKS}")
_BLAST = _RBASE + f""", sk as (select * from n where kind in {_SINKS}), df as (select sk.id seed, e.dst id from sk join e on e.src = sk.id and e.repo_id = sk.repo_id and e.kind = 'DEFINES' where sk.kind = 'FILE'),
fl as (select repo_id, path, min(id) id from n where kind = 'FILE' group by all)
""" + _walk("wd", "src", "dst", "select id seed, id from sk union select seed, id from df") + _walk("wu", "dst", "src", "select id seed, id from sk union select seed, id from df union select sk.id, fl.id from sk join fl on fl.repo_id = sk.repo_id and fl.path = sk.path where sk.kind <> 'FILE'") + """,
bw as (select 'up' direction, * from wu union all select 'down', * from wd),
bk as (select bw.*, n.kind, n.qname, n.path, row_number() over (partition by direction, seed order by distance, rk, coalesce(n.path, ''), n.start_line, n.id) "position" from bw join n using (id) where distance > 0),
blast as (select seed, direction, id, kind, qname, path, distance, ['exact', 'strong', 'resolved', 'heuristic'][rk + 1] confidence, "position", c conservative from bk where "position" <= 1000)
"""

_HITS = """, {q}, k as (select distinct query, n.id, n.name, n.qname, n.kind, n.path from n join q on {on}),
p as (select *, row_number() over (partition by query order by (kind in %s)::int, (lower(name) <> lower(query))::int, length(qname), qname, id) position from k where qname is not null)
""" % EXTERNAL
_PARTS = "qp as (select distinct array_to_string(list_slice(string_split(name, '_'), -2, -1), '_') query from n where kind = 'FUNCTION' and name is not null)"
_NAMES = "qn as (select distinct upper(name) query from n where kind in ('CLASS', 'ROUTE') and name is not null)"

QUERIES = {f.__name__: f for f in (
    repo_status_counts, table_cardinalities, node_projection, edge_projection, degree_top_node, kind_histogram, graph_links, neighbors_out, neighbors_in, neighbors_dangling, impact_shadow_filter,
    symbol_exact, symbol_substring, symbol_cascade, bfs_distance_down, bfs_distance_up, bfs_weakest_confidence, bfs_files, impact_blast_radius, impact_summary, impact_targets, impact_report, impact_entrypoints,
)}
ORACLE = {
    "repo_status_counts": BASE + "select r.id repo_id, r.name, r.indexed_at, (select count(distinct path) from f where f.repo_id = r.id) n_files, (select count(distinct id) from n where n.repo_id = r.id) n_nodes from r",
    "table_cardinalities": " union all ".join(f"select '{t}' table_name, count(*) n_rows from {t}" for t in ("repos", "files", "nodes", "edges", "tombstones", "documents", "embeddings", "events")),
    "node_projection": BASE + "select id, kind, qname, path, start_line, end_line, substr(sha1(concat_ws(chr(0), kind, qname, path, start_line::varchar)), 1, 24) content_id, coalesce(len(extra.imports), 0)::int n_imports from n",
    "edge_projection": BASE + "select repo_id, owner_path, src, dst, kind, detail, confidence, case when kind = 'IMPORTS' then 'conservative_file' else 'precise_symbol' end \"scope\" from e",
    "degree_top_node": BASE + ", g as (select repo_id, src, count(*) degree from e group by all) select repo_id, src node_id, degree from (select *, row_number() over (partition by repo_id order by degree desc, src) k from g) where k = 1",
    "kind_histogram": BASE + ", k as (select repo_id, kind, count(*) c from n group by all) select repo_id, string_agg(c || ' ' || kind, ', ' order by c desc, kind) summary, (select count(distinct path) from n where n.repo_id = k.repo_id) n_paths from k where repo_id is not null group by repo_id",
    "graph_links": BASE + "select src, dst, kind, confidence, detail, repo_id from e where src in (select id from n) and dst in (select id from n)",
    "neighbors_out": _NEIGHBORS.format(near="src", far="dst"),
    "neighbors_in": _NEIGHBORS.format(near="dst", far="src"),
    "neighbors_dangling": "select center_id, node_id, kind, position from (" + _NEIGHBORS.format(near="src", far="dst") + ") where dangling",
    "impact_shadow_filter": BASE + """, j as (select e.*, n.kind nk from e left join n on n.id = e.dst),
res as (select distinct src, trim(detail) t from j where kind = 'CALLS' and lower(confidence) = 'resolved' and coalesce(nk, '') <> 'EXTERNALSYMBOL' and trim(detail) <> '')
select repo_id, kind, count(*) n_edges from j where not (kind = 'CALLS' and coalesce(nk, '') = 'EXTERNALSYMBOL' and exists (select 1 from res where res.src = j.src and res.t = trim(j.detail))) group by all""",
    "symbol_exact": BASE + ", " + _NAMES + _HITS.format(q="q as (select query from qn)", on="lower(n.name) = lower(q.query) or lower(n.qname) = lower(q.query)") + "select query, id, name, qname, kind, path, position from p where position <= 20",
    "bfs_distance_down": _DOWN + "select seed, id, distance from walk",
    "bfs_distance_up": _UP + "select seed, id, distance from walk",
    "bfs_weakest_confidence": _DOWN + "select seed, id, distance, rk rank, c conservative from walk",
    "bfs_files": _DOWN + f"select seed, path, min(distance) distance from walk join n using (id) where n.kind in {_LEFT} and path is not null group by all",
    "impact_entrypoints": _DOWN + "select walk.id seed, seed id, r.qname, distance from walk join n on n.id = walk.id join n r on r.id = seed where distance > 0 and n.kind = 'FUNCTION'",
    "impact_blast_radius": _BLAST + "select * from blast",
    "impact_report": _BLAST.replace("sk as (select * from n where kind in ('FILE', 'FUNCTION', 'METHOD', 'CLASS'))", "sk as (select * from n where kind in ('CLASS', 'ROUTE', 'FUNCTION'))") + f""", nb as (select 'in' d, e.dst center, e.src other, e.* from e where dst in (select id from sk) union all select 'out', e.src, e.dst, e.* from e where src in (select id from sk)),
nk as (select * from (select nb.*, n.kind nkind, row_number() over (partition by d, center order by coalesce(n.kind in {EXTERNAL}, false)::int, case lower(nb.confidence) when 'resolved' then 0 when 'strong' then 1 else 2 end, coalesce(n.path, ''), coalesce(n.start_line, 0), nb.kind, other, detail, coalesce(nb.owner_path, '')) o
  from nb left join n on n.id = other) where o <= 200),
me as (select distinct d, center, trim(detail) t from nk where kind = 'CALLS' and not coalesce(nkind in {EXTERNAL}, false) and trim(detail) <> ''),
nx as (select * from nk where not (kind = 'CALLS' and coalesce(nkind, '') = 'EXTERNALSYMBOL' and exists (select 1 from me where me.d = nk.d and me.center = nk.center and me.t = trim(nk.detail)))),
nc as (select center id, count(*) filter (d = 'in' and kind = 'CALLS') callers, count(*) filter (d = 'out' and kind = 'CALLS') callees, count(*) filter (d = 'in') incoming, count(*) filter (d = 'out') outgoing from nx group by 1),
rc as (select seed id, count(*) filter (direction = 'up') upstream, count(*) filter (direction = 'down') downstream, count(*) filter (direction = 'up' and kind = 'ROUTE') entrypoints, count(*) filter (conservative) conservative from blast group by 1),
fc as (select id, count(distinct path) files from (select id, path from sk union all select seed, path from blast where kind in ('FILE','FUNCTION','METHOD','CLASS','ROUTE','DOCSECTION')) where path <> '' group by 1),
tr as (select seed id, max(c) > 1000 truncated from (select direction, seed, count(*) c from bk group by all) group by 1)
select sk.id, {", ".join(f"coalesce({c}, 0) {c}" for c in ("callers", "callees", "incoming", "outgoing", "upstream", "downstream", "files", "entrypoints", "conservative"))}, coalesce(truncated, false) truncated from sk left join nc using (id) left join rc using (id) left join fc using (id) left join tr using (id)""",
    "impact_summary": _BLAST + "select seed, count(*) filter (direction = 'up') n_upstream, count(*) filter (direction = 'down') n_downstream, count(distinct path) n_files, count(*) filter (direction = 'up' and kind = 'ROUTE') n_entrypoints, max(distance) max_distance from blast group by seed",
    "symbol_substring": BASE + ", " + _PARTS + _HITS.format(q="q as (select query from qp)", on="contains(lower(n.qname), lower(q.query)) and q.query <> ''") + "select query, id, name, qname, kind, path, position from p where position <= 20",
    "symbol_cascade": BASE + ", " + _PARTS + ", " + _NAMES + ", qa as (select query from qp union select query from qn)" + _HITS.format(q="q as (select query from qa)", on="lower(n.name) = lower(q.query) or lower(n.qname) = lower(q.query)")
    + _HITS.format(q="q2 as (select query from qa where query not in (select query from p) and query <> '')", on="contains(lower(n.qname), lower(q.query))").replace(" k as", " k2 as").replace("from k ", "from k2 ").replace("join q on", "join q2 q on").replace("p as (", "p2 as (")
    + "select query, id, 'exact' tier, position from p where position <= 20 union all select query, id, 'substring', position from p2 where position <= 20",
}
