"""Queries of full-text search, context packs and retrieval quality. The query set is derived from the data: one query per documentation section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import context, evaluation, model, search
from graphloom.plans.graph import E, N
from graphloom.plans.sql import BASE, EXTERNAL, sql_terms
from graphloom.session import stored
from graphloom.sources.tables import table


def Q(spark: SparkSession, d: str) -> DataFrame:
    """(qid, query): the heading of each documentation section, once per repo and heading; an empty one asks for nothing."""
    return _sections(N(spark, d))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(search.terms("text")).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


def search_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(N(spark, d))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.corpus_stats(search.postings(N(spark, d))).select("n_docs", "n_tokens", F.round("avg_len", 6).alias("avg_len"))


def search_and_bm25(spark: SparkSession, d: str) -> DataFrame:
    n = _once(spark, d)
    return search.bm25(search.index(n), _sections(n), True)


def search_or_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _best(_once(spark, d))


def search_path_tier(spark: SparkSession, d: str) -> DataFrame:
    return search.any_field(search.index(N(spark, d)), Q(spark, d), ("path",), 20)


def search_column_tier(spark: SparkSession, d: str) -> DataFrame:
    return search.any_field(search.index(N(spark, d)), Q(spark, d), ("qname", "name", "path"), 20)


def _once(spark: SparkSession, d: str) -> DataFrame:
    """The valid nodes, written once for the stages that read them."""
    return stored(N(spark, d).select("id", "kind", "name", "qname", "path", "start_line", "end_line", "signature", "doc", "confidence"), "valid-nodes")


def _sections(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'DOCSECTION' and name is not null").groupBy(F.lower("name").alias("query")).agg(F.min("id").alias("qid")).select("qid", "query")


def search_tiered(spark: SparkSession, d: str) -> DataFrame:
    n = _once(spark, d)
    return search.tiered_search(n, _sections(n), 20)


def substring_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that contain the address of a route as it stands, whatever the case."""
    n = _once(spark, d)
    return search.containing(n, n.filter("kind = 'ROUTE' and name is not null").groupBy(F.lower("name").alias("query")).agg(F.min("id").alias("qid")), 20)


def _best(nodes: DataFrame) -> DataFrame:
    return search.bm25(search.by_node(nodes), _sections(nodes), False, 20)


def _candidates(nodes: DataFrame) -> DataFrame:
    """(qid, id, position): the 20 best nodes of each query by BM25; every node with any word of the query is weighed before the limit.

    Written, so that what was shuffled for the search is deleted before nodes are shuffled for its hits."""
    return stored(_best(nodes).select("qid", "id", "position"), "candidates")


def search_path_priority(spark: SparkSession, d: str) -> DataFrame:
    n = _once(spark, d)
    return search.promote(_candidates(n), n)


def external_like_fill(spark: SparkSession, d: str) -> DataFrame:
    n = _once(spark, d)
    return search.external_fill(n, _sections(n), 20)


def context_pack_budget(spark: SparkSession, d: str) -> DataFrame:
    n = _once(spark, d)
    return context.context_pack(_candidates(n), n, 1000)


def context_summary_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = _once(spark, d)
    return context.confidence_summary(_candidates(n), n)


def context_must_read(spark: SparkSession, d: str) -> DataFrame:
    """The items of each pack with the reason for each."""
    n = _once(spark, d)
    q = _sections(n)
    # Written, so that what was shuffled for the packs is deleted before nodes are shuffled with their texts.
    packed = stored(context.context_pack(_candidates(n), n, 1000), "packs")
    return context.context_items(packed, n, q).select("qid", "place", "id", "why", "confidence", F.length("doc").alias("n_doc"))


def context_related(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the first five hits of each query."""
    n = _once(spark, d)
    hits = stored(search.bm25(search.by_node(n), _sections(n), False, 5), "first-hits")
    e = stored(E(spark, d).drop("loaded_at"), "valid-edges")
    return context.related(hits, e, n).select("qid", "id", "direction", "node_id", "kind", "position")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """A retrieval sample for each function: the code of its file up to it, and as candidates the ten definitions around it in its file, itself the gold one."""
    n = N(spark, d).filter("kind in ('FUNCTION', 'METHOD') and path is not null and qname is not null")
    around = Window.partitionBy("repo_id", "path").orderBy("start_line", "id")
    one = F.struct(F.col("qname").alias("identifier"), F.concat_ws("/", "path", "name").alias("path"), F.coalesce("doc", F.lit("")).alias("snippet"))
    each = n.select("id", "repo_id", "path", "start_line", F.collect_list(one).over(around.rowsBetween(-5, 4)).alias("context"), F.least(F.lit(5), F.row_number().over(around) - 1).alias("gold_snippet_index"))
    text = table(spark, d, "file_texts").select("repo_id", model.clean_path("path").alias("path"), "head").filter("head is not null").groupBy("repo_id", "path").agg(F.max("head").alias("head"))
    code = F.array_join(F.slice(F.split("head", "\n"), F.lit(1), F.greatest(F.lit(1), F.col("start_line"))), "\n")
    return each.join(text, ["repo_id", "path"]).select(F.col("id").alias("idx"), code.alias("cropped_code"), "context", "gold_snippet_index")


def sample_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Where the gold candidate of each sample comes out, by the words of the code before it."""
    s = stored(_samples(spark, d), "samples")
    words = s.select(F.col("idx").alias("qid"), F.split(evaluation.sample_query("cropped_code", 5), " ").alias("query_terms"), evaluation.import_terms("cropped_code").alias("import_terms"))
    words = words.withColumn("query_terms", F.array_distinct(F.transform("query_terms", F.lower)))
    c = evaluation.sample_candidates(s).select(F.col("idx").alias("qid"), F.col("path").alias("id"), "gold", *[evaluation.identifier_terms(x).alias(f"{k}_terms") for k, x in (("name", "identifier"), ("path", "path"), ("body", "snippet"))])
    ranked = evaluation.rerank(c.join(words, "qid").withColumn("position", F.lit(None).cast("int")))
    return c.filter("gold").select("qid", "id").join(ranked, ["qid", "id"], "left").select("qid", "id", "score", "rank")


def sample_hits(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hit_rates(sample_ranks(spark, d))


def _ranked(n: DataFrame) -> DataFrame:
    q = _sections(n).select("qid", F.array_distinct(search.terms("query")).alias("query_terms"))
    words = [F.array_distinct(search.terms(F.coalesce(c, F.lit("")))).alias(f"{k}_terms") for k, c in (("name", "name"), ("path", "path"), ("body", "doc"))]
    # Only the nodes that are hits are taken apart again, each once.
    hits = _candidates(n)
    hit_words = n.select("id", "name", "path", "doc").join(hits.select("id").distinct(), "id", "left_semi").select("id", *words)
    return evaluation.rerank(hits.join(hit_words, "id").join(q, "qid"))


def rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_once(spark, d))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Where each query's own section came out, with the size of its candidate list."""
    n = _once(spark, d)
    q = _sections(n).select("qid")
    r = _ranked(n)
    found = r.groupBy("qid").agg(F.min(F.when(F.col("id") == F.col("qid"), F.col("rank"))).alias("rank"), F.count("*").alias("n_candidates"))
    home = n.filter("kind = 'DOCSECTION'").select(F.col("id").alias("qid"), F.substring_index("path", "/", 1).alias("split"))
    return q.join(found, "qid", "left").join(home, "qid").select("qid", "split", "rank", evaluation.size_bucket(F.coalesce("n_candidates", F.lit(0))).alias("bucket"))


def hit_at_k_mrr(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hit_rates(_gold(spark, d))


def hit_by_bucket_level(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hit_rates(_gold(spark, d), "bucket", "split")


_FIELDS = ("qname", "name", "signature", "doc", "path")
_SEARCH = BASE + f""", q as (select min(id) qid, lower(name) query from n where kind = 'DOCSECTION' and name is not null group by lower(name)),
s as (select * from n where coalesce(kind, '') not in {EXTERNAL}),
w as ({" union all ".join(f"select id, '{c}' field, unnest({sql_terms(c)}) term from s" for c in _FIELDS)}),
p as (select id, field, term, count(*) tf from w where term <> '' group by all),
qt as (select distinct qid, term from (select qid, unnest({sql_terms("query")}) term from q) where term <> '')
"""
_BM25 = _SEARCH + """, t as (select id, term, sum(tf) tf from p where term in (select term from qt) group by all), dl as (select id, sum(tf) dl from p group by all), df as (select term, count(*) df from t group by all),
st as (select count(distinct id) n, sum(tf) / count(distinct id) a from p), qn as (select qid, count(*) k from qt group by all),
hits as (select qt.qid, t.id, count(*) n_hit, any_value(k) k, round(-sum((case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) score
  from qt join t using (term) join df using (term) join dl using (id) join qn using (qid) cross join st group by qt.qid, t.id)
"""
_FIRST = _SEARCH + ", h as (select distinct qid, id from p join qt using (term) where field in @FIELDS), k as (select *, row_number() over (partition by qid order by id) \"position\" from h), tier as (select * from k where \"position\" <= 20)\n"
#: The 20 best nodes of each query.
_TOP = _BM25 + ", k as (select *, row_number() over (partition by qid order by score, id) \"position\" from hits), tier as (select qid, id, \"position\" from k where \"position\" <= 20)\n"
_PRIORITY = "case when regexp_matches(lower(path), '(^|/)(readme|agents)[^/]*$|^(docs|skills)/') then 3 when regexp_matches(lower(path), '(^|/)tests?/') then 2 when starts_with(lower(path), 'src/') then 0 else 1 end"
_EXTERNAL = f""", xt as (select n.id, unnest({sql_terms("name")}) term from n where kind in {EXTERNAL}), x as (select distinct qid, n.id, n.name, n.qname, n.path, n.start_line from xt join qt using (term) join n using (id)),
xk as (select x.*, row_number() over (partition by qid order by (lower(name) <> lower(query))::int, length(qname), coalesce(path, ''), start_line, id) "position" from x join q using (qid))
"""
_STAGES = _BM25 + f""", z as (select qid, query, len(regexp_extract_all(query, '[A-Za-z0-9_./:-]+')) m from q),
a0 as (select *, row_number() over (partition by qid order by id) o from (select distinct qid, id from p join qt using (term) join z using (qid) where field = 'path' and m between 3 and 8)),
g0 as (select qid from a0 group by 1 having count(*) >= 10), t0 as (select qid, id, 0 t, o from a0 where o <= 20 and qid in (select qid from g0)),
op as (select * from z where m <= 8 and qid not in (select qid from g0)),
a1 as (select *, row_number() over (partition by qid order by id) o from (select distinct qid, id from p join qt using (term) where field in ('qname', 'name', 'path') and qid in (select qid from op))),
g1 as (select qid from a1 group by 1 having count(*) >= 20), t1 as (select qid, id, 1 t, o from a1 where o <= 20 and qid in (select qid from g1)),
t2 as (select qid, id, 2 t, o from (select qid, id, row_number() over (partition by qid order by score, id) o from hits where n_hit = k and qid in (select qid from op) and qid not in (select qid from g1)) where o <= 20),
f1 as (select * from t0 union all select * from t1 union all select * from t2), c1 as (select qid, count(distinct id) c from f1 group by 1),
t3 as (select qid, id, 3 t, o from a1 where o <= 20 and qid in (select qid from z where m <= 8) and qid not in (select qid from c1 where c >= 10)),
f2 as (select * from f1 union all select * from t3), c2 as (select z.qid, (select count(distinct id) from f2 where f2.qid = z.qid) c from z),
a4 as (select *, row_number() over (partition by qid order by id) o from (select distinct qid, id from p join qt using (term))),
t4 as (select a4.qid, id, 4 t, o from a4 join c2 using (qid) where c < 20 and o <= 20 and o <= case when c >= 10 then 22 - c else 20 end),
f3 as (select qid, id, min((t, o)) b from (select * from f2 union all select * from t4) group by all), f4 as (select *, row_number() over (partition by qid order by b, id) "position" from f3),
b as (select f4.qid, f4.id, b[1] t, "position", {_PRIORITY} priority, n.path, n.start_line, n.qname from f4 join n using (id)),
mv as (select *, case when row_number() over (partition by qid order by priority, "position", path, start_line, qname, id) = 1 then 0 else "position" end moved from b),
f5 as (select qid, id, t, "position" from (select qid, id, t, row_number() over (partition by qid order by moved, id) "position" from mv) where "position" <= 20), c5 as (select q.qid, (select count(*) from f5 where f5.qid = q.qid) c from q)
""" + _EXTERNAL + f""", t5 as (select xk.qid, xk.id, 5 t, xk."position" + c "position" from xk join c5 using (qid) where xk."position" + c <= 20), f6 as (select * from f5 union all select * from t5),
t6 as (select q.qid, n.id, 6 t, row_number() over (partition by q.qid order by coalesce(kind in {EXTERNAL}, false)::int, coalesce(lower(name) <> query, true)::int, length(qname), id) "position"
  from q join n on contains(lower(concat_ws(chr(0), qname, name, path, doc)), query) where query <> '' and q.qid not in (select qid from f6)),
f7 as (select * from f6 union all select * from t6 where "position" <= 20)
"""

#: Packs, item by item.
_PACK = _TOP.replace("with n as", "with recursive n as", 1) + f""", ct as (select tier.*, coalesce(kind in {EXTERNAL}, false)::int ext, path, start_line, end_line, greatest(120, floor(({" + ".join(f"least(800, length(coalesce({c}, '')))" for c in ("qname", "path", "signature", "doc"))} + 160) / 4))::int "cost" from tier join n using (id)),
it as (select *, row_number() over (partition by qid order by ext, "position", id) i from (select *, row_number() over (partition by qid, path, start_line, end_line order by "position", id) o from ct) where o = 1),
pk as (select distinct qid, 0::bigint i, 1000 room, 0 place, null::varchar id, 0 "cost", false took from it union all
  select pk.qid, it.i, case when pk.room > 0 and (it."cost" <= pk.room or place = 0) then pk.room - it."cost" else pk.room end, case when pk.room > 0 and (it."cost" <= pk.room or place = 0) then place + 1 else place end, it.id, it."cost", pk.room > 0 and (it."cost" <= pk.room or place = 0)
  from pk join it on it.qid = pk.qid and it.i = pk.i + 1) """

QUERIES = {f.__name__: f for f in (
    tokenize_terms, search_postings, corpus_stats, search_and_bm25, search_or_bm25, search_path_tier, search_column_tier, search_tiered, substring_fallback, search_path_priority, external_like_fill,
    context_pack_budget, context_must_read, context_related, sample_ranks, sample_hits, context_summary_confidence, rerank_scores, hit_at_k_mrr, hit_by_bucket_level,
)}
ORACLE = {
    "tokenize_terms": f"select term, count(*) n from (select unnest({sql_terms('text')}) term from documents) where term <> '' group by all",
    "search_postings": _SEARCH + "select id, field, term, tf from p",
    "corpus_stats": _SEARCH + "select count(distinct id) n_docs, sum(tf)::bigint n_tokens, round(sum(tf) / count(distinct id), 6) avg_len from p",
    "search_and_bm25": _BM25 + "select qid, id, n_hit, score from hits where n_hit = k",
    "search_or_bm25": _BM25 + "select qid, id, n_hit, score, \"position\" from (select *, row_number() over (partition by qid order by score, id) \"position\" from hits) where \"position\" <= 20",
    "search_path_tier": _FIRST.replace("@FIELDS", "('path')") + "select qid, id, \"position\" from tier",
    "search_column_tier": _FIRST.replace("@FIELDS", "('qname', 'name', 'path')") + "select qid, id, \"position\" from tier",
    "search_tiered": _STAGES + f"select qid, id, {list(search.TIERS)}[t + 1] tier, \"position\" from f7",
    "substring_fallback": BASE + f""", q as (select min(id) qid, lower(name) query from n where kind = 'ROUTE' and name is not null group by 2), h as (select q.qid, n.id, row_number() over (partition by q.qid order by coalesce(kind in {EXTERNAL}, false)::int,
  coalesce(lower(name) <> query, true)::int, length(qname), id) "position" from q join n on contains(lower(concat_ws(chr(0), qname, name, path, doc)), query) where query <> '') select qid, id, "position" from h where "position" <= 20""",
    "search_path_priority": _TOP + f""", b as (select tier.*, n.path, n.start_line, n.qname, {_PRIORITY} priority from tier join n using (id)),
m as (select *, case when row_number() over (partition by qid order by priority, "position", path, start_line, qname, id) = 1 then 0 else "position" end moved from b)
select qid, id, path, priority, row_number() over (partition by qid order by moved, id) place from m""",
    "external_like_fill": _SEARCH + _EXTERNAL + """select qid, id, qname, "position" from xk where "position" <= 20""",
    "context_pack_budget": _PACK + "select qid, id, \"cost\", place from pk where took",
    "context_must_read": _PACK + """select pk.qid, place, pk.id, case when contains(lower(coalesce(name, '')), query) then 'name match' when contains(lower(coalesce(qname, '')), query) then 'qualified-name match' when contains(lower(coalesce(path, '')), query) then 'path match' else 'full-text match' end why,
  coalesce(confidence, 'unknown') confidence, least(800, length(coalesce(doc, '')))::int n_doc from pk join q using (qid) join n on n.id = pk.id where took""",
    "context_related": _TOP + f""", t5 as (select qid, id from tier where "position" <= 5), nb as (select 'in' direction, e.dst center, e.src other, e.* from e union all select 'out', e.src, e.dst, e.* from e),
nk as (select nb.*, row_number() over (partition by direction, center order by coalesce(n.kind in {EXTERNAL}, false)::int, case lower(nb.confidence) when 'resolved' then 0 when 'strong' then 1 else 2 end, coalesce(n.path, ''), coalesce(n.start_line, 0), nb.kind, other, detail, coalesce(nb.owner_path, '')) o from nb join n on n.id = other)
select t5.qid, t5.id, direction, other node_id, kind, o "position" from t5 join nk on nk.center = t5.id where o <= 16""",
    "context_summary_confidence": _TOP + """, g as (select qid, count(*) n_hits, count(distinct path) n_paths, count(*) filter (lower(confidence) = 'exact') e, count(*) filter (lower(confidence) = 'strong') s, count(confidence) c from tier join n using (id) group by qid)
select qid, n_hits, n_paths, case when c = 0 then 'none' when n_hits = 1 and e = 1 then 'exact' when e + s = c then 'strong' else 'mixed' end confidence from g""",
}
_RANK = _TOP + f""", qw as (select qid, unnest(w) term, unnest(range(1, len(w) + 1)) k from (select qid, list_filter(ws, lambda x, i: x <> '' and list_position(ws, x) = i) w from (select qid, {sql_terms("query")} ws from q))),
m as (select tier.qid, tier.id, "position", sum(case when k <= 32 then 1 - (k - 1) / 40.0 else 0 end * case field when 'name' then 4 when 'path' then 3 else 0.35 end + case field when 'name' then 8 when 'path' then 6 else 1 end) s
  from tier join qw using (qid) join p on p.id = tier.id and p.term = qw.term and field in ('name', 'path', 'doc') group by all),
sc as (select tier.qid, tier.id, tier."position", round(coalesce(s, 0) + greatest(0, 13 - tier."position") * 0.75, 6)::double score from tier left join m using (qid, id)),
rk as (select qid, id, score, row_number() over (partition by qid order by score desc, "position", id) rank from sc where score > 0),
gold as (select q.qid, split_part(n.path, '/', 1) split, (select min(rank) from rk where rk.qid = q.qid and rk.id = q.qid) rank, (select count(*) from rk where rk.qid = q.qid) c from q join n on n.id = q.qid),
gb as (select *, case when c < 5 then '<5' when c < 10 then '5-9' else '>=10' end bucket from gold)
"""
_RATES = "count(*) n_queries, " + ", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 6) hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1 / rank, 0.0)), 6) mrr"
ORACLE |= {
    "rerank_scores": _RANK + "select qid, id, score, rank from rk",
    "hit_at_k_mrr": _RANK + f"select {_RATES} from gb",
    "hit_by_bucket_level": _RANK + f"select bucket, split, {_RATES} from gb group by grouping sets ((bucket), (split), ())",
}
