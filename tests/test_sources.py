"""Parsers, readers, streaming and the registered queries."""

from __future__ import annotations

import os

from graphloom.sources import parse, trees
from graphloom.streaming import incremental

PY = '''import os
from .lib import helper

class Base:
    pass

class Dog(Base):
    def bark(self, loud, *a, **k):
        """Barks."""
        return helper(loud)

@app.post("/dogs")
def make_dog(name):
    def inner():
        return helper(name)
    return Dog(name)

def caller():
    return make_dog("x")
'''


def test_python_facts():
    f = parse.parse_file("r", "pkg/app.py", PY)
    kinds = {(n[3], n[4]) for n in f.nodes.values()}
    assert {("Class", "Dog"), ("Method", "bark"), ("Function", "make_dog"), ("Route", "POST /dogs"), ("ExternalDependency", ".lib")} <= kinds
    name = {n[0]: n[4] for n in f.nodes.values()}
    edges = {(name[e[2]], e[4], name[e[3]], e[5]) for e in f.edges.values()}
    assert {("caller", "CALLS", "make_dog", "strong"), ("make_dog", "CALLS", "helper", "heuristic"), ("Dog", "EXTENDS", "Base", "heuristic"), ("POST /dogs", "HANDLES", "make_dog", "exact"), ("Dog", "CONTAINS", "bark", "exact")} <= edges
    assert next(n for n in f.nodes.values() if n[4] == "bark")[9] == "bark(self, loud, *a, **k)"
    broken = parse.parse_file("r", "x.py", "def f(:\n")
    assert [n[3] for n in broken.nodes.values()] == ["File", "ParseError"] and [e[4] for e in broken.edges.values()] == ["HAS_PARSE_ERROR"]


def test_script_and_markdown_facts():
    js = "import { a } from './lib';\nexport class K extends B {}\nexport function go(x) {\n  other(x);\n}\nfunction other(y) { return y; }\napp.get('/p', go);\n"
    f = parse.parse_file("r", "web/app.ts", js)
    name = {n[0]: n[4] for n in f.nodes.values()}
    edges = {(name[e[2]], e[4], name[e[3]]) for e in f.edges.values()}
    assert {("go", "CALLS", "other"), ("GET /p", "HANDLES", "go"), ("app.ts", "IMPORTS", "./lib"), ("K", "EXTENDS", "B")} <= edges
    md = parse.parse_file("r", "README.md", "# One\ntext\n## Two\nmore")
    assert [(n[4], n[7], n[8]) for n in md.nodes.values() if n[3] == "DocSection"] == [("One", 1, 3), ("Two", 3, 4)]


def test_trees_and_parse_through_spark(spark, tmp_path):
    for p, t in {"pkg/__init__.py": "", "pkg/app.py": PY, "README.md": "# Hi\n", "node_modules/x.js": "a()", ".git/config.toml": "x", "pkg/bad.py": "é"}.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_bytes(t.encode("latin-1" if "bad" in p else "utf-8"))
    listed = trees.list_sources(spark, str(tmp_path), "r")
    assert {r.path for r in listed.collect()} == {"pkg/__init__.py", "pkg/app.py", "README.md", "pkg/bad.py"}
    read = trees.read_sources(listed)
    import hashlib

    rows = {r.path: r for r in read.collect()}
    assert rows["pkg/app.py"].content_hash == hashlib.sha1(PY.encode()).hexdigest() and rows["pkg/bad.py"].text == "�"
    assert parse.parse_sources(read, "nodes").filter("kind = 'Function'").count() == 2
    assert {r.title for r in parse.markdown_sections(read).collect()} == {"Hi"}
    gen = listed.select(trees.probably_generated("path", "size").alias("g")).collect()
    assert not any(r.g for r in gen)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 2}\n{broken\n')
    rows = trees.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    assert sorted(r.a for r in rows if r.bad_line is None) == [1, 2] and sum(r.bad_line is not None for r in rows) == 2


def test_follow_files_goes_on_after_a_restart(spark, tmp_path):
    schema = "repo_id string, path string, text string, indexed_at double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("r", "a.md", "# One\n", 1.0), ("r", "b.md", "# Two\n", 1.0)], [("r", "b.md", "# New\n", 2.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.follow_files(spark.readStream.schema(schema).parquet(src), out, parse.markdown_sections)
    assert {(r.path, r.title) for r in spark.read.parquet(f"{out}/v1").collect()} == {("a.md", "One"), ("b.md", "New")}
    assert {r.title for r in spark.read.parquet(f"{out}/v0").collect()} == {"One", "Two"}


def test_follow_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "repo_id string, path string, text string, indexed_at double"
    spark.createDataFrame([("r", "a.md", "# A", 1.0), ("r", "b.md", "# B", 1.0)], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    spark.createDataFrame([("r", "a.md", "# A2", 2.0)], schema).coalesce(1).write.mode("append").parquet(src)
    incremental.follow_files(stream, out, parse.markdown_sections)
    versions = [x for x in os.listdir(out) if x.startswith("v")]  # beside them lies the stream's progress
    last = max(versions)
    assert len(versions) == 2 and {r.title for r in spark.read.parquet(f"{out}/{last}").collect()} == {"A2", "B"}


def test_registered_queries():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p1_found", "p5_found", "impact_blast_radius"} <= set(q)
