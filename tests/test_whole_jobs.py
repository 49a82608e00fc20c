"""Jobs that must be whole: nothing is cut before it is ranked, walked or read."""

from __future__ import annotations

from datetime import datetime

from conftest import EDGES, NODES

from graphloom.operators import model, resolution, search
from graphloom.plans import graph, retrieval
from graphloom.sources import parse

T = datetime(2025, 1, 1)


def folder(make, path, **tables):
    """A data folder of the given tables: name=(schema, rows)."""
    for name, (schema, rows) in tables.items():
        make(schema, rows).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_candidates_are_ranked_before_the_limit(spark, make, tmp_path):
    rows = [dict(id=f"n{i:02}", repo_id="r", kind="DocSection", name=f"usage topic{i}", qname=f"docs/a.md#s{i}", path="docs/a.md", start_line=i + 1, loaded_at=T) for i in range(40)]
    d = folder(make, tmp_path, nodes=(NODES, rows))
    r = retrieval.hit_at_k_mrr(spark, d).first()
    assert (r.n_queries, r.hit_1, r.mrr) == (40, 1.0, 1.0)
    for q in (retrieval.rerank_scores, retrieval.context_pack_budget, retrieval.search_path_priority):
        assert q(spark, d).filter("id = qid").count() == 40
    assert retrieval.context_summary_confidence(spark, d).filter("n_hits = 20").count() == 40


def test_traversal_has_no_depth(spark, make, tmp_path):
    nodes = [dict(id="r", repo_id="r", kind="Route", name="GET /", qname="route:GET /", path="a.py", start_line=1, loaded_at=T)]
    nodes += [dict(id=f"f{i}", repo_id="r", kind="Function", name=f"f{i}", qname=f"a.f{i}", path=f"p{i}.py", start_line=i + 1, loaded_at=T) for i in range(6)]
    edges = [dict(repo_id="r", src=a, dst=b, kind="CALLS", confidence="strong", loaded_at=T) for a, b in [("r", "f0"), *((f"f{i}", f"f{i + 1}") for i in range(5)), ("f5", "f0")]]
    d = folder(make, tmp_path, nodes=(NODES, nodes), edges=(EDGES, edges))
    assert {(r.id, r.distance) for r in graph.bfs_distance_down(spark, d).collect()} == {("r", 0), *((f"f{i}", i + 1) for i in range(6))}
    assert graph.bfs_weakest_confidence(spark, d).filter("rank = 1").count() == 6
    assert {r.path: r.distance for r in graph.bfs_files(spark, d).collect()} == {"a.py": 0, **{f"p{i}.py": i + 1 for i in range(6)}}
    assert {(r.seed, r.id, r.distance) for r in graph.impact_entrypoints(spark, d).collect()} == {(f"f{i}", "r", i + 1) for i in range(6)}


def test_radius_starts_at_files_and_definitions(spark, make, tmp_path):
    row = lambda i, kind, path: dict(id=i, repo_id="r", kind=kind, name=i, qname=i, path=path, start_line=1, loaded_at=T)
    nodes = [row("fa", "File", "a.py"), row("fb", "File", "b.py"), row("g", "Function", "a.py"), row("h", "Function", "b.py"), row("x", "Function", "c.py")]
    edges = [dict(repo_id="r", src=a, dst=b, kind=k, confidence="strong", loaded_at=T) for a, k, b in [("fa", "DEFINES", "g"), ("fb", "DEFINES", "h"), ("fb", "IMPORTS", "fa"), ("h", "CALLS", "g"), ("g", "CALLS", "x")]]
    d = folder(make, tmp_path, nodes=(NODES, nodes), edges=(EDGES, edges))
    got = {}
    for r in graph.impact_blast_radius(spark, d).collect():
        got.setdefault((r.seed, r.direction), set()).add(r.id)
    assert got == {("fa", "up"): {"fb", "h"}, ("fa", "down"): {"x"}, ("fb", "down"): {"fa", "g", "x"}, ("g", "up"): {"fb", "h"}, ("g", "down"): {"x"}, ("h", "down"): {"g", "x"}, ("x", "up"): {"g", "h"}}
    assert {r.seed: (r.n_upstream, r.n_downstream) for r in graph.impact_summary(spark, d).collect()} == {"fa": (2, 1), "fb": (0, 3), "g": (2, 1), "h": (0, 2), "x": (2, 0)}
    assert {(r.seed, r.id) for r in graph.bfs_distance_up(spark, d).filter("distance > 0").collect()} == {("g", "h"), ("x", "g"), ("x", "h"), ("fa", "fb")}


def test_resolution_goes_through_imports(spark, make):
    imports = [dict(module="pkg.util", name=None, alias="u"), dict(module="pkg", name="other", alias=None), dict(module="pkg.util", name="save", alias="keep"), dict(module="pkg.stars", name="*", alias=None)]
    row = lambda i, kind, name, qname, path, **k: dict(id=i, repo_id="r", kind=kind, name=name, qname=qname, path=path, start_line=1, loaded_at=T) | k
    names = ["u.save", "keep", "other.save", "twinkle", "nowhere.save", "Base", "lonely"]
    nodes = [
        row("f", "File", "a.py", "a.py", "a.py", extra={"imports": imports, "language": "python"}), *[row(f"f{m}", "File", m, m, f"pkg/{m}.py") for m in ("util", "other", "stars", "far")],
        row("me", "Function", "go", "a.go", "a.py"), row("c", "Class", "C", "a.C", "a.py"), row("s1", "Function", "save", "pkg.util.save", "pkg/util.py"), row("s2", "Function", "save", "pkg.other.save", "pkg/other.py"),
        row("t1", "Function", "twinkle", "pkg.stars.twinkle", "pkg/stars.py"), row("t2", "Function", "twinkle", "pkg.far.twinkle", "pkg/far.py"), row("b1", "Class", "Base", "pkg.far.Base", "pkg/far.py"), row("b2", "Function", "Base", "pkg.util.Base", "pkg/util.py"),
        row("l", "Function", "lonely", "pkg.far.lonely", "pkg/far.py"), *[row(f"x{i}", "ExternalSymbol", n, f"external:{n}", "a.py") for i, n in enumerate(names)],
    ]
    edges = [dict(repo_id="r", src="c" if n == "Base" else "me", dst=f"x{i}", kind="EXTENDS" if n == "Base" else "CALLS", detail=None if n == "lonely" else n, loaded_at=T) for i, n in enumerate(names)]
    got = {r.detail: (r.target, r.rule) for r in resolution.resolve_calls(model.valid_edges(make(EDGES, edges)), model.valid_nodes(make(NODES, nodes))).collect()}
    assert got == {"u.save": ("s1", 5), "keep": ("s1", 5), "other.save": ("s2", 5), "twinkle": ("t1", 5), "Base": ("b1", 4), "lonely": ("l", 4)}


def test_parsers_emit_routes_arrows_and_imports(spark):
    py = "import os\nimport a.b as ab\nfrom .lib import helper, other as o\nfrom m import *\n@app.get('/x')\ndef show():\n    return helper()\n"
    js = "import d, { e as f, g } from './lib';\nimport * as ns from 'far';\nconst h = require('h');\nconst one = x => far(x);\nexport const two = async y => {\n  near(y);\n};\nfunction last() { one(1); }\napp.options('/o', last);\n"
    facts = parse.parse_file("r", "a.py", py), parse.parse_file("r", "a.ts", js)
    edges = [{(f.nodes[e[2]][4], e[4], f.nodes[e[3]][4]) for e in f.edges.values()} for f in facts]
    assert {("a.py", "DEFINES", "GET /x"), ("GET /x", "HANDLES", "show"), ("GET /x", "CALLS", "show"), ("show", "EXPOSES", "GET /x")} <= edges[0]
    assert ("a.py", "EXPOSES", "GET /x") not in edges[0]
    assert {("one", "CALLS", "far"), ("two", "CALLS", "near"), ("last", "CALLS", "one"), ("a.ts", "DEFINES", "OPTIONS /o"), ("OPTIONS /o", "HANDLES", "last")} <= edges[1]
    assert ("one", "CALLS", "near") not in edges[1]
    src = spark.createDataFrame([("r", "a.py", py), ("r", "a.ts", js)], "repo_id string, path string, text string")
    got = {(r.path, r.module, r.name, r.alias) for r in resolution.import_bindings(model.valid_nodes(parse.parse_sources(src, "nodes").selectExpr("*", "timestamp_ntz'2025-01-01' loaded_at"))).collect()}
    want = {("a.py", "os", None, "os"), ("a.py", "a.b", None, "ab"), ("a.py", ".lib", "helper", "helper"), ("a.py", ".lib", "other", "o"), ("a.py", "m", "*", "*")}
    want |= {("a.ts", "./lib", "default", "d"), ("a.ts", "./lib", "e", "f"), ("a.ts", "./lib", "g", "g"), ("a.ts", "far", None, "ns"), ("a.ts", "h", None, "h")}
    assert got == want


def test_words_of_every_script_are_indexed(spark, make):
    df = spark.createDataFrame([("Café_CAFE\u0301 naïve2 \u65e5\u672c \u041f\u0440\u0438\u0432\u0435\u0442 Ελλάδα a_b",), (None,)], "t string")
    got = [r.w for r in df.select(search.terms("t").alias("w")).collect()]
    assert got == [["cafe", "cafe", "naive2", "\u65e5\u672c", "\u043f\u0440\u0438\u0432\u0435\u0442", "ελλαδα", "a", "b"], None]
    nodes = model.valid_nodes(make(NODES, [dict(id="n", kind="Function", doc="Café \u65e5\u672c", loaded_at=T)]))
    queries = spark.createDataFrame([("q1", "cafe"), ("q2", "\u65e5\u672c")], "qid string, query string")
    assert {r.qid for r in search.bm25(search.postings(nodes), queries, True).collect()} == {"q1", "q2"}


def test_short_names_are_looked_up(spark, make, tmp_path):
    names = ["go", "a", "get_edge", "run"]
    rows = [dict(id=f"n{i}", repo_id="r", kind="Function", name=n, qname=f"pkg.{n}", path="a.py", start_line=1, loaded_at=T) for i, n in enumerate(names)] + [dict(id="m", repo_id="r", kind="Method", name="ungo", qname="pkg.K.ungo", path="a.py", start_line=9, loaded_at=T)]
    d = folder(make, tmp_path, nodes=(NODES, rows))
    assert {(r.query, r.id) for r in graph.symbol_substring(spark, d).collect()} == {("go", "n0"), ("go", "m"), ("a", "n1"), ("get_edge", "n2"), ("run", "n3")}
    assert {(r.query, r.id, r.tier) for r in graph.symbol_cascade(spark, d).collect()} == {(n, f"n{i}", "exact") for i, n in enumerate(names)}
