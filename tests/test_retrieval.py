"""Impact reports, context items, samples, reranking, embeddings and comparisons against brute force and small fixtures."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime

from conftest import EDGES, NODES
from pyspark.sql import functions as F

from graphloom.operators import context, evaluation, impact, model, snapshots

T = datetime(2025, 1, 1)
row = lambda i, kind, path="a.py", **k: dict(id=i, repo_id="r", owner_path=path, kind=kind, name=i, qname=f"m.{i}", path=path, start_line=1, loaded_at=T) | k
edge = lambda a, kind, b, **k: dict(repo_id="r", owner_path="a.py", src=a, dst=b, kind=kind, confidence="strong", detail=b, loaded_at=T) | k


def test_impact_report(spark, make):
    nodes = [row("f", "File"), row("g", "File", "b.py"), row("x", "Function"), row("y", "Function", "b.py"), row("z", "Function", "c.py"), row("r", "Route", "b.py"), row("e", "ExternalSymbol", ""), row("d", "DocSection", "d.md")]
    edges = [edge("f", "DEFINES", "x"), edge("g", "IMPORTS", "f"), edge("y", "CALLS", "x"), edge("r", "CALLS", "y"), edge("x", "CALLS", "z", confidence="resolved", detail="zed"), edge("x", "CALLS", "e", detail=" zed"), edge("x", "CALLS", "e", detail="other"), edge("x", "CALLS", "gone")]
    n, e = model.valid_nodes(make(NODES, nodes)), model.valid_edges(make(EDGES, edges))
    got = {r.id: r for r in impact.impact_report(e, n, n.filter("id in ('x', 'f', 'd')")).collect()}
    x = got["x"]
    assert (x.callers, x.callees, x.incoming, x.outgoing) == (1, 3, 2, 3)  # the shadowed call to e is gone, the dangling one stays
    assert (x.upstream, x.downstream, x.files, x.entrypoints, x.conservative, x.truncated) == (3, 2, 3, 1, 1, False)
    assert (got["f"].upstream, got["f"].downstream, got["f"].files) == (3, 2, 3) and (got["d"].files, got["d"].upstream) == (1, 0)
    assert [r.truncated for r in impact.impact_report(e, n, n.filter("id = 'x'"), max_nodes=1).collect()] == [True]
    assert impact.impact_report(e.limit(0), n.limit(0), n.limit(0)).count() == 0


def test_impact_targets(spark, make):
    n = model.valid_nodes(make(NODES, [row("aa", "Function", name="load", qname="m.load"), row("bb", "Class", name="Loader", qname="m.Loader"), row("cc", "DocSection", name="usage notes", qname="x#y", doc="how it works")]))
    names = spark.createDataFrame([("AA",), ("LOAD",), ("oade",), ("works here",), ("zzz",), ("",), (None,)], "query string")
    got = {(r.query, r.id, r.how) for r in impact.impact_targets(n, names).collect()}
    assert got == {("AA", "aa", "id"), ("LOAD", "aa", "symbol"), ("oade", "bb", "symbol"), ("works here", "cc", "search")}


def test_context_items_and_related(spark, make):
    n = model.valid_nodes(make(NODES, [row("a", "Function", name="Parse tree", doc="d" * 900), row("b", "Function", name="q", qname="parse tree.q"), row("c", "Function", "parse tree/c.py", name=None), row("d", "Function", doc=None)]))
    e = model.valid_edges(make(EDGES, [edge("a", "CALLS", x) for x in ("b", "c", "gone")] + [edge("d", "CALLS", "a")]))
    q = spark.createDataFrame([("q1", "Parse Tree")], "qid string, query string")
    packed = spark.createDataFrame([("q1", x, 1, k) for k, x in enumerate("abcd", 1)], "qid string, id string, cost int, place int")
    got = {r.id: r for r in context.context_items(packed, n, q).collect()}
    assert {k: r.why for k, r in got.items()} == {"a": "name match", "b": "qualified-name match", "c": "path match", "d": "full-text match"}
    assert got["a"].doc == "d" * 797 + "..." and got["d"].doc == "" and got["a"].confidence == "unknown" and got["a"].lines == [1, 1]
    near = context.related(packed.selectExpr("qid", "id", "place as position"), e, n, first=1, limit=1).collect()
    assert {(r.id, r.direction, r.node_id) for r in near} == {("a", "out", "b"), ("a", "in", "d")}


def words_of(text):
    out = []
    for name in re.findall("[A-Za-z_][A-Za-z0-9_]*", text):
        for part in [*re.findall("[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|[^A-Za-z0-9]|$)|[0-9]+", name), name]:
            if len(part) > 1 and part.lower() not in evaluation.STOP_TERMS and part.lower() not in out:
                out.append(part.lower())
    return out


def test_terms_and_queries(spark):
    code = "import os.path\nfrom pkg import HTTPServer as srv\n\ndef load_userData2(x):\r\n    return srv.get_42(x)\n"
    r = spark.createDataFrame([(code,), (None,)], "c string").select(evaluation.identifier_terms("c").alias("t"), evaluation.import_terms("c").alias("i"), evaluation.sample_query("c", 1).alias("q")).collect()
    assert r[0].t == words_of(code) and r[0].i == words_of("import os.path\nfrom pkg import HTTPServer as srv") and (r[1].t, r[1].i, r[1].q) == ([], [], "")
    assert r[0].q.split() == [*words_of("return srv.get_42(x)"), *[w for w in r[0].i if w not in words_of("srv.get_42")]]


def test_samples(spark):
    schema = "idx string, context array<struct<identifier: string, path: string, snippet: string>>, gold_snippet_index int"
    c = lambda p: ("i", p, "s")
    s = spark.createDataFrame([("a", [c("/x/./../y.py"), c("y\\z"), c(None), c("x/y.py"), c("../..")], 3), ("b", [], 0), ("c", [c("p")], 4), ("d", None, None)], schema)
    got = [(r.order, r.path, r.gold) for r in evaluation.sample_candidates(s).orderBy("order").collect()]
    assert got == [(0, "x/y.py", False), (1, "y/z.py", False), (2, "context_2.py", False), (3, "x/y__ctx3.py", True), (4, "context_4.py", False)]
    assert {(r.idx, r.reason[:10]) for r in evaluation.skipped_samples(s).collect()} == {("b", "no context"), ("c", "gold_snipp"), ("d", "no context")}


def test_rerank_equals_brute_force(spark):
    rnd = random.Random(5)
    pool = [f"t{i}" for i in range(50)]
    some = lambda n: list(dict.fromkeys(rnd.choice(pool) for _ in range(n)))
    rows = [("q", f"c{i:02}", rnd.choice([None, i + 1]), [], some(4), some(5), some(9), some(6)) for i in range(30)]
    query = some(45)
    rows = [(*r[:3], query, *r[4:]) for r in rows] + [("q", "none", None, query, [], [], [], [])]
    df = spark.createDataFrame(rows, "qid string, id string, position int, query_terms array<string>, name_terms array<string>, path_terms array<string>, body_terms array<string>, import_terms array<string>")

    def score(r):
        _, _, pos, q, name, path, body, imp = r
        s = sum(w * len(set(a) & set(b)) for a, b, w in ((q, name, 8), (q, path, 6), (q, body, 1), (imp, path, 12), (imp, name, 10), (imp, body, 0.75)))
        for k, t in enumerate(q[:32]):
            s += (1 - k / 40) * (4 * (t in name) + 3 * (t in path) + 0.35 * (t in body))
        return round(s + (max(0, 12 - (pos - 1)) * 0.75 if pos else 0), 6)

    want = sorted(((-score(r), r[2] or 10**9, r[1]) for r in rows if score(r) > 0))
    got = evaluation.rerank(df).orderBy("rank").collect()
    assert [r.id for r in got] == [x[2] for x in want] and all(abs(r.score + x[0]) < 1e-5 for r, x in zip(got, want))
    assert {r.score for r in evaluation.rerank(df.drop("import_terms")).collect()} != {r.score for r in got}


def test_embedding_writes(spark, make):
    s = "node_id string, repo_id string, dims int, model string, embedded_at double"
    old = spark.createDataFrame([("a", "r", 2, "m", 1.0), ("b", "r", 2, "m", 1.0)], s)
    new = spark.createDataFrame([("b", "r", 3, "n", 2.0), ("c", "r", 3, "n", 2.0), ("c", "r", 4, "n", 3.0)], s)
    assert {(r.node_id, r.dims) for r in snapshots.upsert_embeddings(old, new).collect()} == {("a", 2), ("b", 3), ("c", 4)}
    queue = spark.createDataFrame([("a", 1.0), ("c", None), ("d", None)], "node_id string, embedded_at double")
    assert {(r.node_id, r.embedded_at) for r in snapshots.complete(queue, new).collect()} == {("a", 1.0), ("c", 3.0), ("d", None)}
    nodes = make(NODES, [row("a", "Function"), row("b", "Function", "b.py"), row("c", "ExternalSymbol", None)])
    n, e, q = snapshots.remove_missing_files(nodes, make(EDGES, [edge("a", "CALLS", "b"), edge("b", "CALLS", "a", owner_path="b.py")]), queue, spark.createDataFrame([("r", "a.py"), ("r", "a.py")], "repo_id string, path string"))
    assert ({r.id for r in n.collect()}, e.count(), {r.node_id for r in q.collect()}) == ({"a", "c"}, 1, {"a", "c"})


def test_comparisons(spark):
    m = "metric string, value string"
    cur = spark.createDataFrame([("fast", "1"), ("slow", "3"), ("same", "5"), ("floor", "20"), ("odd", "x"), ("nan", "NaN"), ("tie", "2"), ("fix", "7")], m)
    base = spark.createDataFrame([("fast", "2"), ("slow", "2"), ("same", "5"), ("odd", "1"), ("nan", "1"), ("gone", "1"), ("tie", "2")], m)
    spec = spark.createDataFrame([("fast", "lower", None), ("slow", "lower", None), ("same", "invariant", None), ("floor", "floor", 19.0), ("odd", "higher", None), ("nan", "higher", None), ("gone", "higher", None), ("tie", "higher", None), ("fix", "invariant", 8.0)], "metric string, direction string, expected double")
    got = {r.metric: r.verdict for r in evaluation.compare_metrics(cur, base, spec).collect()}
    assert got == {"fast": "ok", "slow": "regression", "same": "ok", "floor": "ok", "odd": "not_a_number", "nan": "not_a_number", "gone": "missing", "tie": "regression", "fix": "regression"}
    p = "name string, value string"
    a, b = spark.createDataFrame([("k", "1"), ("l", None), ("n", "3"), ("s", "9")], p), spark.createDataFrame([("k", "2"), ("l", None), ("o", None), ("s", "9")], p)
    assert {(r.name, r.change) for r in evaluation.compare_parameters(a, b).collect()} == {("k", "changed"), ("n", "added"), ("o", "removed")}
    t = spark.createDataFrame([("a", 3, 1.0, 2.0, 2.0, 3.0, 4.0), ("b", 0, 2.0, 1.0, 2.0, None, 4.0)], "g string, n long, min_v double, p50 double, mean_v double, p95 double, max_v double")
    assert {(r.g, r.check) for r in evaluation.timing_sanity(t, "g").filter("not passed").collect()} == {("b", "present"), ("b", "counted"), ("b", "ordered")}


def test_timings_with_outliers(spark):
    rnd = random.Random(3)
    v = sorted([rnd.random() for _ in range(400)] + [1e12] * 3)
    r = evaluation.timing_summary(spark.createDataFrame([("g", x) for x in v] + [("h", 1.0), ("n", None)], "g string, v double"), "g", "v")
    got = {x.g: x for x in r.collect()}
    assert (got["g"].n, got["g"].p50, got["g"].max_v, got["g"].p95) == (403, round(v[201], 6), 1e12, round(v[round(0.95 * 402)], 6)) and got["h"].p95 == 1.0 and "n" not in got


def test_redacted_json(spark):
    record = {"user": {"api_key": 'a"b', "n": 1, "deep": [{"Password": None, "ok": "token: x"}]}, "private_key": 12.5, "list_token": ["keep"]}
    got = json.loads(spark.createDataFrame([(json.dumps(record),)], "j string").select(evaluation.redact_json(F.col("j")).alias("j")).first().j)
    assert got == {"user": {"api_key": "[REDACTED]", "n": 1, "deep": [{"Password": "[REDACTED]", "ok": "token: x"}]}, "private_key": "[REDACTED]", "list_token": ["keep"]}
