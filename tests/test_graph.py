"""Graph operators against brute force on small random graphs."""

from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta

from conftest import EDGES, NODES, TOMBS
from pyspark.sql import functions as F

from graphloom.operators import context, evaluation, model, neighbors, resolution, search, snapshots, symbols, traversal

T = datetime(2025, 1, 1)


def graph(make, seed=1, n=40, m=120):
    rnd = random.Random(seed)
    kinds = ["Function", "method ", "CLASS", "Route", "ExternalSymbol", "ParseError"]
    nodes = [dict(id=f"n{i}", repo_id="r", kind=rnd.choice(kinds), name=f"f_{i % 7}", qname=f"pkg.m{i % 3}.f_{i % 7}", path=f"src/p{i % 5}.py", start_line=i, end_line=i + rnd.randrange(9), confidence=rnd.choice(["exact", "strong", None]), doc="two words", loaded_at=T) for i in range(n)]
    nodes.append(nodes[0] | {"doc": "newer", "loaded_at": T + timedelta(days=1)})
    edges = [dict(repo_id="r", owner_path="p", src=f"n{rnd.randrange(n)}", dst=f" N{rnd.randrange(n + 5)}", kind=rnd.choice(["CALLS", "Imports", "DEFINES"]), confidence=rnd.choice(["exact", "strong", "resolved", "heuristic"]), detail=f"d{rnd.randrange(9)}", loaded_at=T) for _ in range(m)]
    edges += edges[:10]
    return nodes, edges, model.valid_nodes(make(NODES, nodes)), model.valid_edges(make(EDGES, edges))


def test_valid_rows(spark, make):
    nodes, edges, n, e = graph(make)
    assert n.count() == 40 and n.filter("id = 'n0'").first().doc == "newer"
    assert e.count() == len({(x["src"], x["dst"], x["kind"].upper(), x["detail"]) for x in edges})
    assert n.select(model.node_id(*[n[c] for c in ("kind", "qname", "path", "start_line")])).first()[0].__len__() == 24


def test_node_id_equals_hashlib(spark):
    import hashlib

    df = spark.createDataFrame([("Function", "a.é", "p.py", 3)], "k string, q string, p string, s int")
    assert df.select(model.node_id(df.k, df.q, df.p, df.s)).first()[0] == hashlib.sha1("Function\0a.é\0p.py\x003".encode()).hexdigest()[:24]


def test_neighbors_prefix_and_dangling(spark, make):
    _, _, n, e = graph(make)
    full = {(r.center_id, r.position): r for r in neighbors.neighbors(e, n, "out", 10**6).collect()}
    some = {(r.center_id, r.position): r for r in neighbors.neighbors(e, n, "out", 3).collect()}
    assert some == {k: r for k, r in full.items() if k[1] <= 3}
    known = {r.id for r in n.collect()}
    assert all(r.dangling == (r.node_id not in known) for r in full.values())
    assert len(full) == e.count()


def test_reach_equals_breadth_first_search(spark, make):
    for seed in (1, 2):
        _, _, n, e = graph(make, seed)
        kind = {r.id: r.kind for r in n.collect()}
        out = {}
        for r in e.collect():
            if r.kind in model.TRAVERSED and r.dst in kind:
                out.setdefault(r.src, set()).add(r.dst)
        starts = ["n1", "n2", "n3"]
        got = {(r.seed, r.id): r.distance for r in traversal.reach(e, n, spark.createDataFrame([(s, s) for s in starts], "seed string, id string"), "down", 3).collect()}
        want = {}
        for s in starts:
            seen, todo = {s: 0}, deque([s])
            while todo:
                x = todo.popleft()
                if seen[x] < 3 and (x == s or kind.get(x) in model.EXPANDABLE):
                    for y in out.get(x, ()):
                        if y not in seen:
                            seen[y] = seen[x] + 1
                            todo.append(y)
            want |= {(s, k): d for k, d in seen.items()}
        assert got == want


def test_blast_radius_limit_is_a_prefix(spark, make):
    _, _, n, e = graph(make)
    seeds = spark.createDataFrame([("n1", "n1")], "seed string, id string")
    full = {(r.direction, r.position): r for r in traversal.blast_radius(e, n, seeds).drop("n_reached").collect()}
    some = {(r.direction, r.position): r for r in traversal.blast_radius(e, n, seeds, max_nodes=2).drop("n_reached").collect()}
    assert some == {k: r for k, r in full.items() if k[1] <= 2}
    assert traversal.impact_summary(traversal.blast_radius(e, n, seeds)).count() == 1


def test_symbols(spark, make):
    _, _, n, _ = graph(make)
    q = spark.createDataFrame([("F_1",), ("m2.f_3",), ("nothing here",), (None,)], "query string")
    got = symbols.find_symbols(n, q, 100).collect()
    rows = n.collect()
    want = {("F_1", r.id, "exact") for r in rows if r.name.lower() == "f_1"} | {("m2.f_3", r.id, "substring") for r in rows if "m2.f_3" in r.qname}
    assert {(r.query, r.id, r.tier) for r in got} == want


def test_bm25_equals_sqlite(spark, make):
    import sqlite3

    texts = ["alpha beta", "beta beta gamma", "alpha", "delta", "gamma delta alpha", "zeta eta", "eta theta iota"]
    nodes = model.valid_nodes(make(NODES, [dict(id=f"n{i}", kind="Function", doc=t, loaded_at=T) for i, t in enumerate(texts)]))
    posts = search.postings(nodes, ("doc",))
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(doc)")
    db.executemany("insert into t values (?)", [(t,) for t in texts])
    want = {f"n{i - 1}": round(s, 6) for i, s in db.execute("select rowid, bm25(t) from t where t match 'beta OR eta'")}
    got = search.bm25(posts, spark.createDataFrame([("q", "beta eta")], "qid string, query string"), False).collect()
    assert {r.id: r.score for r in got} == want
    both = search.bm25(posts, spark.createDataFrame([("q", "alpha gamma")], "qid string, query string"), True).collect()
    assert {r.id for r in both} == {"n4"}


def test_tiered_search_gates(spark, make):
    nodes = model.valid_nodes(make(NODES, [dict(id=f"n{i}", kind="Function", name="walk", qname=f"a.walk{i}", path=f"src/deep/tree{i}.py", doc="prints leaves", loaded_at=T) for i in range(6)]))
    q = spark.createDataFrame([("path", "src deep tree0"), ("col", "walk"), ("strict", "prints leaves"), ("long", " ".join(["prints"] + [f"w{i}" for i in range(9)])), ("none", "")], "qid string, query string")
    got = {}
    for r in search.tiered_search(nodes, q, 4).collect():
        got.setdefault(r.qid, []).append(r.tier)
    assert set(got["path"]) == {"path"} and set(got["col"]) == {"column"} and set(got["strict"]) == {"strict"} and set(got["long"]) == {"broad"} and "none" not in got


def test_resolution_rules(spark, make):
    rows = [
        dict(id="f1", kind="Function", name="go", qname="a.go", path="a.py", start_line=1, end_line=9), dict(id="m1", kind="Method", name="run", qname="a.C.run", path="a.py", start_line=12, end_line=15), dict(id="m2", kind="Method", name="save", qname="a.C.save", path="a.py", start_line=16, end_line=18),
        dict(id="m3", kind="Method", name="save", qname="b.D.save", path="b.py", start_line=2, end_line=4), dict(id="c", kind="Class", name="C", qname="a.C", path="a.py", start_line=11, end_line=20), *[dict(id=f"x{i}", kind="ExternalSymbol", name=t, qname=f"external:{t}") for i, t in enumerate(["self.save", "obj.save", "go", "a.go", "C.run"])],
    ]
    n = model.valid_nodes(make(NODES, [r | {"repo_id": "r", "loaded_at": T} for r in rows]))
    e = model.valid_edges(make(EDGES, [dict(repo_id="r", src="m1", dst=f"x{i}", kind="CALLS", detail=t, loaded_at=T) for i, t in enumerate(["self.save", "obj.save", "go", "a.go", "C.run"])]))
    got = {r.detail: (r.target, r.rule) for r in resolution.resolve_calls(e, n).collect()}
    assert got == {"self.save": ("m2", 2), "go": ("f1", 4), "a.go": ("f1", 1)}
    assert {r.id: r.owner for r in resolution.enclosing(n).collect()} == {"m1": "c", "m2": "c"}


IMPORT_CASES = [  # importer, module, name, files besides it, target
    ("pkg/a.py", ".b", "x", ["pkg/b.py"], "pkg/b.py"), ("pkg/a.py", ".", "b", ["pkg/b.py", "pkg/__init__.py"], "pkg/b.py"), ("pkg/a.py", ".", "name", ["pkg/__init__.py"], "pkg/__init__.py"), ("pkg/sub/a.py", "..b", None, ["pkg/b.py"], "pkg/b.py"),
    ("a.py", ".", "x", ["__init__.py"], "__init__.py"), ("a.py", "...b", None, ["b.py"], None), ("pkg/a.py", "pkg.util", None, ["src/pkg/util/__init__.py"], "src/pkg/util/__init__.py"), ("a.py", "util", "sub", ["x/util/sub.py", "util.py"], "x/util/sub.py"),
    ("a.py", "m", None, ["x/m.py", "y/m.py"], None), ("a.py", "m", None, ["m.py", "y/m.py"], "m.py"), ("a.py", "m", None, ["xm.py"], None), ("a.py", "a", None, [], None), ("a.py", "m", "*", ["m.py", "m/*.py"], "m.py"), ("a.py", "m", "default", ["m/default.py", "m.py"], "m.py"),
    ("pkg/a.ts", "./lib", "y", ["pkg/lib.ts"], "pkg/lib.ts"), ("pkg/sub/a.ts", "../lib", None, ["pkg/lib.tsx"], "pkg/lib.tsx"), ("pkg/a.ts", "./x.js", None, ["pkg/x.ts"], "pkg/x.ts"), ("pkg/a.ts", "./x.js", None, ["pkg/x.js", "pkg/x.ts"], "pkg/x.js"),
    ("pkg/a.ts", "./dir", None, ["pkg/dir/index.js"], "pkg/dir/index.js"), ("pkg/a.ts", "./dir", None, ["pkg/dir/index.js", "pkg/dir.cjs"], "pkg/dir.cjs"), ("pkg/a.ts", "../../out", None, ["out.ts"], None), ("a.ts", "././b/../c", None, ["c.mjs"], "c.mjs"),
    ("pkg/a.ts", "react", None, ["react.ts", "pkg/react.ts"], None), ("pkg/a.py", "./lib", None, ["pkg/lib.ts"], None), ("README.md", "./lib", None, ["lib.ts"], None), ("a.py", None, "x", ["x.py"], None), ("a.py", " ", None, ["x.py"], None),
]


def test_import_resolution(spark, make):
    from conftest import FILES

    nodes, files, want = [], [], {}
    for i, (importer, module, name, others, target) in enumerate(IMPORT_CASES):
        imports = [dict(module=module, name=name, alias=None)]
        nodes.append(dict(id=f"f{i}", repo_id=f"r{i}", kind="File", path=importer, extra={"imports": imports, "language": "any"}, loaded_at=T))
        files += [dict(repo_id=f"r{i}", path=p) for p in [importer, *others]]
        want[f"r{i}"] = target
    got = {r.repo_id: r.target for r in resolution.resolve_imports(resolution.import_bindings(model.valid_nodes(make(NODES, nodes))), make(FILES, files)).collect()}
    assert {k: got.get(k) for k in want} == want
    assert resolution.resolve_imports(resolution.import_bindings(model.valid_nodes(make(NODES, []))), make(FILES, [])).count() == 0


def test_normal_path(spark):
    import posixpath

    paths = ["a/./b", "a/../b", "../a", "a/../../b", "./", "a//b/", "", "x/y/../../../z/.."]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(resolution.normal_path(F.col("p")).alias("n")).collect()
    assert [r.n or "." for r in got] == [posixpath.normpath(p or ".") for p in paths]


def test_resolved_edges(spark, make):
    """Classes, relative and star imports, scripts, aliases, duplicates, methods of the own class; resolved edges are rebuilt and nothing is doubled."""
    row = lambda i, kind, name, qname, path, **k: dict(id=i, repo_id="r", kind=kind, name=name, qname=qname, path=path, start_line=1, loaded_at=T) | k
    imp = lambda *b: {"imports": [dict(module=m, name=n, alias=a) for m, n, a in b], "language": "x"}
    nodes = [
        row("fa", "File", "a.py", "p/a.py", "p/a.py", extra=imp((".base", "Animal", None), (".one", "save", "keep"), (".two", "*", None))), row("fb", "File", "base.py", "p/base.py", "p/base.py"), row("f1", "File", "one.py", "p/one.py", "p/one.py"), row("f2", "File", "two.py", "p/two.py", "p/two.py"),
        row("ft", "File", "t.ts", "w/t.ts", "w/t.ts", extra=imp(("./lib", "help", "h"), ("./lib", "default", "Lib"), ("./lib", None, "ns"))), row("fl", "File", "lib.ts", "w/lib.ts", "w/lib.ts"),
        row("dog", "Class", "Dog", "p.a.Dog", "p/a.py"), row("bark", "Method", "bark", "p.a.Dog.bark", "p/a.py"), row("wag", "Method", "wag", "p.a.Dog.wag", "p/a.py"), row("ani", "Class", "Animal", "p.base.Animal", "p/base.py"), row("ani2", "Class", "Animal", "p.two.Animal", "p/two.py"),
        row("s1", "Function", "save", "p.one.save", "p/one.py"), row("s2", "Function", "save", "p.two.save", "p/two.py"), row("star", "Function", "shine", "p.two.shine", "p/two.py"), row("shine2", "Function", "shine", "p.one.shine", "p/one.py"),
        row("tf", "Function", "run", "w.t.run", "w/t.ts"), row("hp", "Function", "help", "w.lib.help", "w/lib.ts"), row("lib", "Class", "Lib", "w.lib.Lib", "w/lib.ts"), row("hp2", "Function", "help", "p.one.help", "p/one.py"),
        *[row(f"x{n}", "ExternalSymbol", n, f"external:{n}", "") for n in ("Animal", "keep", "shine", "self.wag", "obj.save", "h", "ns.help", "Lib", "print")],
    ]
    edge = lambda src, name, kind, path, **k: dict(repo_id="r", owner_path=path, src=src, dst=f"x{name}", kind=kind, confidence="heuristic", detail=name, loaded_at=T) | k
    edges = [edge("dog", "Animal", "EXTENDS", "p/a.py"), *[edge("bark", n, "CALLS", "p/a.py") for n in ("keep", "shine", "self.wag", "obj.save", "print")], *[edge("tf", n, "CALLS", "w/t.ts") for n in ("h", "ns.help", "Lib")]]
    edges += [edge("bark", "keep", "CALLS", "p/a.py", dst="s2", confidence="resolved"), edge("tf", "h", "CALLS", "w/t.ts", dst="hp", confidence="exact"), edge("s1", "self.wag", "CALLS", "p/one.py")]
    out = resolution.resolve_graph(model.valid_edges(make(EDGES, edges)), model.valid_nodes(make(NODES, nodes)))
    new = {(r.src, r.kind, r.detail, r.dst) for r in out.filter("confidence = 'resolved'").collect()}
    assert new == {
        ("dog", "EXTENDS", "Animal", "ani"), ("bark", "CALLS", "keep", "s1"), ("bark", "CALLS", "shine", "star"), ("bark", "CALLS", "self.wag", "wag"), ("tf", "CALLS", "ns.help", "hp"), ("tf", "CALLS", "Lib", "lib"),
        ("fa", "IMPORTS", ".base", "fb"), ("fa", "IMPORTS", ".one", "f1"), ("fa", "IMPORTS", ".two", "f2"), ("ft", "IMPORTS", "./lib", "fl"),
    }
    assert out.filter("confidence = 'exact'").count() == 1 and out.count() == 10 + 11
    again = resolution.resolve_graph(out, model.valid_nodes(make(NODES, nodes)))
    assert sorted(map(str, again.select(*out.columns).collect())) == sorted(map(str, out.collect()))


def test_snapshots_and_queue(spark, make):
    s = "path string, content_hash string"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], s)
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4")], s)
    assert {r.path: r.change for r in snapshots.snapshot_diff(old, new, ["path"]).collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "added"}
    kept = snapshots.replace_files(old, spark.createDataFrame([("b", "3")], s), spark.createDataFrame([("b",)], "path string"), ["path"])
    assert {tuple(r) for r in kept.collect()} == {("a", "1"), ("b", "3"), ("c", None)}
    n = model.valid_nodes(make(NODES, [dict(id=i, kind=k, content_hash=h, loaded_at=T) for i, k, h in (("a", "Function", "1"), ("b", "Function", "2"), ("c", "ExternalSymbol", "1"), ("d", "Class", None))]))
    before = spark.createDataFrame([("a", "1", T, T), ("b", "0", T, T)], "node_id string, content_hash string, queued_at timestamp_ntz, embedded_at timestamp_ntz")
    q = snapshots.embedding_queue(n, before)
    assert {(r.node_id, r.embedded_at is None) for r in q.collect()} == {("a", False), ("b", True)}
    assert [r.node_id for r in snapshots.pending(q).collect()] == ["b"]
    live = snapshots.live_nodes(n, make(TOMBS, [dict(node_id="A ", removed_at=T), dict(node_id="b", removed_at=T - timedelta(days=1))]))
    assert {r.id for r in live.collect()} == {"b", "c", "d"}


def test_nearest_vectors(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(250, 8))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(250)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in snapshots.nearest_vectors(df, 4).collect():
        got.setdefault(r.query_id, {})[r.position] = r.vec_id
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 100, 200):
        sim = u @ u[q]
        sim[q] = -9
        assert [got[q][k] for k in range(1, 5)] == list(np.argsort(-sim)[:4])


def test_context_pack_skips_what_does_not_fit(spark, make):
    n = model.valid_nodes(make(NODES, [dict(id=f"n{i}", kind="Function", qname="q", path=f"p{i}", start_line=i, doc="x" * size, loaded_at=T) for i, size in enumerate([700, 5000, 700, 700, 100])]))
    hits = spark.createDataFrame([("q", f"n{i}", i + 1) for i in range(5)], "qid string, id string, position int")
    got = context.context_pack(hits, n, 1000).orderBy("place").collect()
    left, want = 1000, []
    for i, size in enumerate([700, 5000, 700, 700, 100]):
        cost = max(120, (min(size, 800) + 3 + 160) // 4)
        if left > 0 and (cost <= left or not want):
            want.append((f"n{i}", cost))
            left -= cost
    assert [(r.id, r.cost) for r in got] == want


def test_timing_summary_is_exact(spark):
    import statistics

    rnd = random.Random(3)
    rows = [(g, rnd.choice([1.5, 2.25, rnd.random() * 100])) for g in "abb" for _ in range(301)] + [("a", None), ("one", 4.0)]
    got = {r.g: r for r in evaluation.timing_summary(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in ("a", "b", "one"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g].n == len(v) and got[g].p50 == round(statistics.median(v), 6) and got[g].p95 == round(v[round(0.95 * (len(v) - 1))], 6)


def test_hit_rates_and_compare(spark):
    ranks = spark.createDataFrame([("a", 1), ("a", 4), ("b", None)], "g string, rank int")
    r = evaluation.hit_rates(ranks).first()
    assert (r.n_queries, r.hit_1, r.hit_5, r.mrr) == (3, round(1 / 3, 6), round(2 / 3, 6), round(1.25 / 3, 6))
    assert evaluation.hit_rates(ranks, "g").count() == 3
    s = "metric string, value double"
    cur, base = spark.createDataFrame([("t", 1.0), ("n", 5.0), ("q", 2.0)], s), spark.createDataFrame([("t", 2.0), ("n", 6.0)], s)
    kinds = spark.createDataFrame([("t", "lower"), ("n", "floor"), ("q", "higher")], "metric string, direction string")
    assert {x.metric: x.verdict for x in evaluation.compare_metrics(cur, base, kinds).collect()} == {"t": "ok", "n": "regression", "q": "missing"}
