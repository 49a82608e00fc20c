"""Work must grow with the rows, not with pairs of rows: records that are shuffled, with nothing small enough for Spark to broadcast by itself."""

from __future__ import annotations

import time
from datetime import datetime

import pytest
from conftest import EDGES, NODES
from pyspark.sql import functions as F

from graphloom.operators import context, impact, model, neighbors, search, symbols, traversal
from graphloom.plans import graph, retrieval
from graphloom.session import CLEANED, stored

T = datetime(2025, 1, 1)


def moved(spark, job, stages_only=False):
    """(result of job, records written to shuffles, or the stages that ran)."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before, was = stages(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = job()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    new = [n for k, n in stages().items() if k not in before]
    return out, len(new) if stages_only else sum(new)


@pytest.fixture(scope="module")
def sections(spark, tmp_path_factory):
    """400 sections that share a word, so that every query meets every node: 160,000 pairs."""
    from pyspark.sql.types import _parse_datatype_string

    d, t = str(tmp_path_factory.mktemp("sections")), _parse_datatype_string(NODES)
    rows = [dict(id=f"n{i:03}", repo_id="r", kind="DocSection", name=f"usage left{i % 20} right{i // 20}", qname=f"docs/a.md#s{i}", path="docs/a.md", start_line=i + 1, loaded_at=T) for i in range(400)]
    rows += [dict(id=f"x{i:03}", repo_id="r", kind="ExternalSymbol", name=f"usage.m{i}", qname=f"external:usage.m{i}", path="a.py", start_line=1, loaded_at=T) for i in range(400)]
    spark.createDataFrame([tuple(r.get(f.name) for f in t.fields) for r in rows], t).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([("r", "a.py", "n000", "n001", "CALLS", "strong", "x", T)], EDGES).write.parquet(f"{d}/edges.parquet")
    return d


@pytest.mark.parametrize("name", ["search_or_bm25", "search_path_priority", "context_pack_budget", "context_must_read", "context_related", "context_summary_confidence", "rerank_scores", "hit_at_k_mrr", "hit_by_bucket_level", "external_like_fill"])
def test_queries_do_not_meet_every_node(spark, sections, name):
    rows, n = moved(spark, lambda: retrieval.QUERIES[name](spark, sections).collect())
    assert rows and n < 110_000


def test_queries_with_every_word(spark, sections):
    rows, n = moved(spark, lambda: retrieval.search_and_bm25(spark, sections).collect())
    assert sorted((r.qid, r.id) for r in rows) == [(f"n{i:03}", f"n{i:03}") for i in range(400)] and n < 22_000


def test_best_by_sets_equals_all_pairs(spark):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    posts = spark.createDataFrame([(f"n{i:02}", "doc", w, rnd.randint(1, 3)) for i in range(60) for w in rnd.sample(words, rnd.randint(1, 6))], "id string, field string, term string, tf int")
    asked = [(f"q{i}", " ".join(rnd.sample(words, rnd.randint(1, 7)))) for i in range(15)] + [("none", ""), ("odd", "zzz w1"), ("twice", "w1 w1")]
    queries = spark.createDataFrame(asked, "qid string, query string")
    every = [tuple(r) for r in search.bm25(posts, queries, False).select("qid", "id", "n_hit", "score").collect()]
    want = {(q, *x[1:], k) for q, _ in asked for k, x in enumerate(sorted((x for x in every if x[0] == q), key=lambda x: (x[3], x[1]))[:5], 1)}
    assert {tuple(r) for r in search.bm25(posts, queries, False, 5).select("qid", "id", "n_hit", "score", "position").collect()} == want
    size = {q: len(set(t.split())) for q, t in asked}
    assert {tuple(r) for r in search.bm25(posts, queries, True).select("qid", "id", "n_hit", "score").collect()} == {x for x in every if x[2] == size[x[0]]}


@pytest.mark.parametrize("name", ["impact_report", "impact_blast_radius", "impact_summary"])
def test_walks_are_not_a_job_for_each_level(spark, make, tmp_path, name):
    nodes = [dict(id=f"f{i:02}", repo_id="r", kind="Function", name=f"f{i}", qname=f"a.f{i}", path=f"p{i}.py", start_line=1, loaded_at=T) for i in range(25)]
    make(NODES, nodes).write.parquet(f"{tmp_path}/nodes.parquet")
    make(EDGES, [dict(repo_id="r", src=f"f{i:02}", dst=f"f{i + 1:02}", kind="CALLS", confidence="strong", loaded_at=T) for i in range(24)]).write.parquet(f"{tmp_path}/edges.parquet")
    rows, n = moved(spark, lambda: graph.QUERIES[name](spark, str(tmp_path)).collect(), True)
    assert len(rows) == (600 if name == "impact_blast_radius" else 25) and n < 150


def test_radius_in_tasks_equals_joins(spark, make, monkeypatch, max_nodes=9):
    import random

    rnd = random.Random(9)
    kinds = ["File", "Function", "Method", "Class", "Route", "DocSection", "ExternalSymbol", None]
    nodes = [dict(id=f"n{i:02}", repo_id=rnd.choice(["r", "s", "t", None]), kind=rnd.choice(kinds), name="n", qname=f"q{i}", path=rnd.choice(["a.py", "b.py", "", None]), start_line=rnd.randint(1, 3), loaded_at=T) for i in range(40)]
    edges = [dict(repo_id=rnd.choice("rst"), owner_path="a", src=f"n{rnd.randint(0, 44):02}", dst=f"n{rnd.randint(0, 44):02}", kind=rnd.choice(["CALLS", "CALLS", "IMPORTS", "DEFINES", "CONTAINS"]), confidence=rnd.choice(["exact", "strong", "resolved", "x", None]), detail=str(i), loaded_at=T) for i in range(110)]
    n, e = model.valid_nodes(make(NODES, nodes)), model.valid_edges(make(EDGES, edges))
    seeds = n.filter("kind in ('FILE', 'FUNCTION', 'CLASS', 'DOCSECTION')").selectExpr("id as seed", "id").unionByName(spark.createDataFrame([("n00", "n41")], "seed string, id string"))
    run = lambda: [sorted(map(str, f(e, n, seeds, None, max_nodes).collect())) for f in (traversal.blast_radius, traversal.radius_counters)]
    whole = run()
    monkeypatch.setattr(traversal, "GROUP_ROWS", 0)
    assert whole == run() and whole[0]


@pytest.mark.parametrize("name", ["substring_fallback", "symbol_substring"])
def test_texts_are_not_taken_apart_for_the_shuffle(spark, make, tmp_path, name):
    rows = [dict(id=f"n{i:03}", repo_id="r", kind=k, name=f"get /word{i}/x", qname=f"route:get /word{i}/x", path="a.py", doc="some longer text that is of no use here", start_line=1, loaded_at=T) for i, k in enumerate(["Route", "Function"] * 100)]
    make(NODES, rows).write.parquet(f"{tmp_path}/nodes.parquet")
    found, n = moved(spark, lambda: (graph.QUERIES | retrieval.QUERIES)[name](spark, str(tmp_path)).collect())
    assert len(found) == 100 and n < 2_000


def test_substrings_equal_brute_force(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abAB\u00e9\u65e5_") for _ in range(rnd.randint(0, 30))) for _ in range(80)] + [None, ""]
    asked = sorted({"".join(rnd.choice("abA\u00e9\u65e5") for _ in range(rnd.choice([1, 2, 3, 4, 6, 9, 12]))) for _ in range(40)} | {t[2:14] for t in texts[:20] if t} | {"", "zz"})
    nodes, names = spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame([(q,) for q in asked], "query string")
    want = sorted((q, i) for q in asked for i, t in enumerate(texts) if q and t is not None and q.lower() in t.lower())
    for chars in (symbols.BLOCK_CHARS, 100):
        monkeypatch.setattr(symbols, "BLOCK_CHARS", chars)
        assert sorted(map(tuple, symbols.substring_hits(nodes, names, "t", ["id"]).collect())) == want


@pytest.mark.parametrize("name, most", [("context_pack_budget", 55_000), ("context_must_read", 64_000), ("rerank_scores", 57_500), ("context_summary_confidence", 48_000), ("hit_at_k_mrr", 58_500), ("search_path_priority", 55_500)])
def test_words_are_counted_in_their_node(spark, sections, name, most):
    rows, n = moved(spark, lambda: retrieval.QUERIES[name](spark, sections).collect())
    assert rows and n < most


def test_words_of_a_node_equal_postings(spark, make):
    rows = [dict(id="a", kind="Function", name="Run run", qname="b.run", doc="zeta alpha run", path="a/b.py"), dict(id="b", kind="Function", doc="\u00e9t\u00e9 ete"), dict(id="c", kind="Function", name="--"), dict(id="x", kind="ExternalSymbol", name="run")]
    nodes = model.valid_nodes(make(NODES, [r | dict(loaded_at=T) for r in rows]))
    got = {(r.id, w.term): (w.tf, r.dl) for r in search.by_node(nodes).collect() for w in r.words}
    want: dict = {}
    for r in search.postings(nodes).collect():
        want[r.id, r.term] = want.get((r.id, r.term), 0) + r.tf
    size = {i: sum(n for (k, _), n in want.items() if k == i) for i, _ in want}
    assert got == {k: (n, size[k[0]]) for k, n in want.items()} and want["a", "run"] == 4
    queries = spark.createDataFrame([("q", "run alpha"), ("p", "ete py b a run")], "qid string, query string")
    each = [[tuple(r) for r in search.bm25(posts, queries, every, limit).orderBy("qid", "id").collect()] for posts in (search.postings(nodes), search.by_node(nodes)) for every, limit in ((False, 1), (False, None), (True, None))]
    assert each[:3] == each[3:] and each[0]


@pytest.mark.parametrize("name", ["impact_summary", "impact_report"])
def test_starts_that_are_no_nodes_do_not_link_repos(spark, make, tmp_path, monkeypatch, name):
    monkeypatch.setattr(traversal, "LINKS", 2)
    nodes = [dict(id=f"{k}{i}", repo_id=f"r{i}", kind=kind, name=f"{k}{i}", qname=f"a.{k}{i}", path=f"p{i}.py", start_line=1, loaded_at=T) for i in range(5) for k, kind in (("f", "File"), ("g", "Function"))]
    ends = [(f"f{i}", x, "DEFINES") for i in range(5) for x in ("none", f"gone{i}")] + [(f"g{i}", f"gone{i}", "CALLS") for i in range(5)]
    make(NODES, nodes).write.parquet(f"{tmp_path}/nodes.parquet")
    make(EDGES, [dict(repo_id=f"r{a[1:]}", src=a, dst=b, kind=k, confidence="strong", loaded_at=T) for a, b, k in ends]).write.parquet(f"{tmp_path}/edges.parquet")
    n, e, seeds = graph._changes(spark, str(tmp_path))
    assert traversal._grouped(e, n, seeds) is not None
    assert {r[0] for r in graph.QUERIES[name](spark, str(tmp_path)).filter("n_upstream > 0" if name == "impact_summary" else "id like 'g%'").collect()} == {("f" if name == "impact_summary" else "g") + str(i) for i in range(5)}


@pytest.mark.parametrize("max_nodes", [3, 14])
def test_shared_starts_that_are_no_nodes_leave_groups_apart(spark, make, monkeypatch, max_nodes):
    import random

    rnd = random.Random(max_nodes)
    kinds = ["File", "File", "Function", "Method", "Class", "Route", "DocSection"]
    ids = {f"{r}{i}": f"r{r}" for r in range(6) for i in range(9)}
    nodes = [dict(id=x, repo_id=r, kind=rnd.choice(kinds), name="n", qname=x, path=rnd.choice(["a.py", "b.py", "", None]), start_line=rnd.randint(1, 3), loaded_at=T) for x, r in ids.items()]
    gone = ["none", "unknown", "lost"]
    ends = [(r, rnd.choice([x for x in ids if ids[x] == r] + gone), rnd.choice([x for x in ids if ids[x] == r] + gone)) for r in sorted(set(ids.values())) for _ in range(40)]
    edges = [dict(repo_id=r, owner_path="a", src=a, dst=b, kind=rnd.choice(["CALLS", "CALLS", "IMPORTS", "DEFINES"]), confidence=rnd.choice(["exact", "strong", "x"]), detail=str(i), loaded_at=T) for i, (r, a, b) in enumerate(ends)]
    n, e = model.valid_nodes(make(NODES, nodes)), model.valid_edges(make(EDGES, edges))
    seeds = n.filter("kind in ('FILE', 'FUNCTION', 'CLASS')").selectExpr("id as seed", "id").unionByName(spark.createDataFrame([("00", "lost"), ("10", "lost"), ("no node", "20")], "seed string, id string"))
    run = lambda: [sorted(map(str, f(e, n, seeds, None, max_nodes).collect())) for f in (traversal.blast_radius, traversal.radius_counters)]
    monkeypatch.setattr(traversal, "GROUP_ROWS", 90)
    assert traversal._grouped(e, n, seeds) is not None
    parts = run()
    monkeypatch.setattr(traversal, "GROUP_ROWS", 0)
    assert parts == run() and parts[0]


def test_blast_radius_over_placeholders_keeps_repos_apart(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(traversal, "GROUP_ROWS", 12)
    nodes = [dict(id=f"{k}{i}", repo_id=f"r{i}", kind=kind, name=f"{k}{i}", qname=f"a.{k}{i}", path=f"p{i}.py", start_line=1, loaded_at=T) for i in range(5) for k, kind in (("f", "File"), ("g", "Function"))]
    ends = [(f"f{i}", "none", "DEFINES") for i in range(4)] + [(f"g{i}", "none", "CALLS") for i in range(5)]
    make(NODES, nodes).write.parquet(f"{tmp_path}/nodes.parquet")
    make(EDGES, [dict(repo_id=f"r{a[1:]}", src=a, dst=b, kind=k, confidence="strong", loaded_at=T) for a, b, k in ends]).write.parquet(f"{tmp_path}/edges.parquet")
    assert traversal._grouped(*(graph._changes(spark, str(tmp_path))[k] for k in (1, 0, 2))) is not None
    rows = graph.impact_blast_radius(spark, str(tmp_path)).collect()
    assert sorted((r.seed, r.direction, r.id, r.distance, r.position) for r in rows) == [(f"f{i}", "up", f"g{j}", 1, j + 1) for i in range(4) for j in range(5)]


def test_edges_without_a_hit_are_not_looked_up(spark, make):
    nodes = model.valid_nodes(make(NODES, [dict(id=f"n{i}", kind="Function", qname=f"q{i}", loaded_at=T) for i in range(3)]))
    edges = make(EDGES, [dict(repo_id="r", src=f"n{k}", dst="n1", kind="CALLS", detail=str(i), loaded_at=T) for i, k in enumerate([0] + [2] * 999)]).localCheckpoint()
    hits = spark.createDataFrame([("q", "n0", 1)], "qid string, id string, position int")
    rows, n = moved(spark, lambda: context.related(hits, edges, nodes).collect())
    assert [(r.direction, r.node_id) for r in rows] == [("out", "n1")] and n < 2_500


def test_neighbors_are_counted_without_lists(spark, make, monkeypatch):
    import random

    rnd = random.Random(5)
    nodes = model.valid_nodes(make(NODES, [dict(id=f"n{i:02}", repo_id="r", kind=rnd.choice(["Function", "ExternalSymbol", "ExternalDependency", None]), name="n", qname=f"q{i}", path="a.py", start_line=i, loaded_at=T) for i in range(30)])).localCheckpoint()
    rows = [dict(repo_id="r", owner_path=str(i), src=f"n{rnd.randint(0, 33):02}", dst=f"n{rnd.choice([0, 1, rnd.randint(2, 33)]):02}", kind=rnd.choice(["CALLS", "CALLS", "IMPORTS", None]), confidence=rnd.choice(["resolved", "x", None]), detail=rnd.choice(["a", "b", " a", "", None]), loaded_at=T) for i in range(600)]
    edges, targets = model.valid_edges(make(EDGES, rows), "src").localCheckpoint(), nodes.select("id")

    def listed(name, limit):
        near = impact.unshadowed(neighbors.neighbors(edges, nodes, name, limit, targets))
        return {r[0]: (r[1], r[2]) for r in near.groupBy("center_id").agg(F.count("*"), F.count_if(F.col("kind") == "CALLS")).collect()}

    for limit, block in ((200, 100), (15, 100), (15, 0)):
        monkeypatch.setattr(impact, "BLOCK_CENTERS", block)
        (into, out), n = moved(spark, lambda: [listed(x, limit) for x in ("in", "out")])  # noqa: B023
        got, m = moved(spark, lambda: impact.neighbor_counts(edges, nodes, targets, limit).collect())  # noqa: B023
        assert {r.id: tuple(r)[1:] for r in got} == {i: (*into.get(i, (0, 0)), *out.get(i, (0, 0))) for i in into.keys() | out.keys()}
    edges, nodes = edges.withColumn("detail", F.concat("owner_path", F.lit("_"))), nodes.withColumn("kind", F.lit("FUNCTION"))
    n, m = (moved(spark, f)[1] for f in (lambda: [listed(x, 200) for x in ("in", "out")], lambda: impact.neighbor_counts(edges, nodes, targets).collect()))
    assert m < 0.8 * n


def test_what_was_shuffled_for_a_stored_table_is_deleted(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: {x.apply(i).getName() for x in [files.getAllFiles()] for i in range(x.size())}
    before, was, end = names(), spark.conf.get(CLEANED), time.monotonic() + 10
    assert len(stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept").collect()) == 7
    while left := {x for x in names() - before if x.startswith("shuffle_")}:
        assert time.monotonic() < end, left
        time.sleep(0.1)
    assert spark.conf.get(CLEANED) == was


def test_valid_nodes_are_found_once_for_substrings(spark, make, tmp_path):
    rows = [dict(id=f"n{i:03}", repo_id="r", kind="Function", name=f"word{i}_x", qname=f"a.word{i}_x", path="a.py", doc="text", start_line=1, loaded_at=T) for i in range(400)]
    make(NODES, rows).write.parquet(f"{tmp_path}/nodes.parquet")
    found, n = moved(spark, lambda: graph.symbol_substring(spark, str(tmp_path)).collect())
    assert len(found) == 400 and n < 2_300, n


def test_packs_are_done_before_their_items_are_looked_up(spark, sections):
    items = retrieval.context_must_read(spark, sections)
    rows, n = moved(spark, items.collect)
    assert rows and n < 12_000, n


@pytest.mark.parametrize("name", ["context_summary_confidence", "search_path_priority"])
def test_candidates_are_found_before_nodes_are_joined(spark, sections, name):
    df = retrieval.QUERIES[name](spark, sections)
    rows, n = moved(spark, df.collect)
    assert rows and n < 34_000, n
