"""Orphan references and uneven keys against brute force, with nulls, repeats, spellings, ties and empty tables."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

from conftest import EDGES, FILES, NODES, TOMBS

from graphloom.functions.normalize import clean_id, clean_kind, clean_path, packed_id, trimmed, unpacked_id
from graphloom.operators.orphans import orphan_references, orphan_report
from graphloom.operators.skewed_keys import edge_key_statistics, heavy_keys

T = datetime(2025, 3, 1)
DAY = timedelta(days=1)


def found(df):
    return {(r.ref_field, r.repo_id, r.ref_value, r.ref_month, r.ref_state) for r in df.collect()}


def test_normal_forms(spark):
    rows = [(" AbC\t", "./a\\b//c"), ("　", " "), (None, None), ("", "."), ("x ", "././d")]
    got = spark.createDataFrame(rows, "a string, b string").select(clean_id("a"), clean_kind("a"), trimmed("a"), clean_path("b")).collect()
    assert [tuple(r) for r in got] == [("abc", "ABC", "AbC", "a/b//c"), (None, None, None, None), (None, None, None, None), (None, None, None, "."), ("x", "X", "x", "d")]


def test_packed_ids_round_trip(spark):
    ids = ["0123456789abcdef01234567", "zz", "", "0123456789abcdef0123456z", "é" * 24, None, "a" * 24]
    df = spark.createDataFrame([(x,) for x in ids], "x string")
    assert [r[0] for r in df.select(unpacked_id(packed_id(df.x))).collect()] == ids


def test_orphan_states(spark, make):
    nodes = make(NODES, [
        dict(id="N1", loaded_at=T), dict(id="n2 ", loaded_at=T), dict(id="n3", loaded_at=T), dict(id="n3", loaded_at=T + 9 * DAY), dict(id="n4", loaded_at=T + 5 * DAY), dict(id=None, loaded_at=T), dict(id="n6", loaded_at=None),
    ])
    shared = make(NODES, [dict(id="s1", loaded_at=T - 900 * DAY)])
    tombs = make(TOMBS, [dict(node_id="N2", removed_at=T), dict(node_id="n3", removed_at=T + DAY), dict(node_id="gone", removed_at=T), dict(node_id="s1", removed_at=T + DAY), dict(node_id="n1", removed_at=None)])
    files = make(FILES, [dict(repo_id="r", path="a.py", indexed_at=(T + 2 * DAY).timestamp()), dict(repo_id=None, path="b.py", indexed_at=0.0)])
    edges = make(EDGES, [
        dict(repo_id="r", src="n1", dst="N2", owner_path=".\\a.py", loaded_at=T + DAY), dict(repo_id="r", src="n1", dst="N2", owner_path="a.py", loaded_at=T + DAY),
        dict(repo_id="r", src="n3", dst="n4", owner_path="a.py", loaded_at=T + 3 * DAY), dict(repo_id="r", src="nope", dst="gone", owner_path="B.py", loaded_at=T),
        dict(repo_id="r", src=" ", dst=None, owner_path="", loaded_at=T), dict(repo_id=None, src="s1", dst="n6", owner_path="b.py", loaded_at=T), dict(repo_id="r", src="x", dst="n4", owner_path=None, loaded_at=None),
    ])
    want = {
        ("dst", "r", "n2", "2025-03", "deleted"), ("src", "r", "n3", "2025-03", "late"), ("dst", "r", "n4", "2025-03", "late"), ("src", "r", "nope", "2025-03", "missing"),
        ("dst", "r", "gone", "2025-03", "deleted"), ("owner_path", "r", "a.py", "2025-03", "late"), ("owner_path", "r", "B.py", "2025-03", "missing"), ("src", "r", "x", None, "missing"),
    }
    for heavy in (1000, 2, 1):
        out = orphan_references(edges, nodes, shared, tombs, files, heavy=heavy, heavy_groups=1)
        assert found(out) == want
        assert out.count() == len(want)
    assert orphan_report(out).count() > 0
    extra = edges.withColumn("ref_value", edges.src).withColumn("us", edges.dst)
    assert found(orphan_references(extra, nodes, shared, tombs, files)) == want


def test_late_references_are_counted_one_by_one(spark, make):
    rnd = random.Random(8)
    nodes = [dict(id=f"n{i}", loaded_at=T + i * DAY) for i in range(20)]
    edges = [dict(repo_id=rnd.choice(["r", None]), src=f"n{rnd.choice([3, rnd.randrange(20)])}", loaded_at=T + rnd.randrange(25) * DAY) for _ in range(600)]
    got = {(r.repo_id, r.ref_value, r.ref_month): r.n_refs for r in orphan_references(make(EDGES, edges), make(NODES, nodes), make(NODES, []), make(TOMBS, []), make(FILES, []), heavy_groups=1).collect()}
    want = defaultdict(int)
    for e in edges:
        if e["loaded_at"] < T + int(e["src"][1:]) * DAY:
            want[e["repo_id"], e["src"], e["loaded_at"].strftime("%Y-%m")] += 1
    assert got == want


def test_orphans_of_empty_tables(spark, make):
    e = make(EDGES, [dict(repo_id="r", src="a", dst="b", owner_path="p", loaded_at=T)])
    empty = [make(NODES, []), make(NODES, []), make(TOMBS, []), make(FILES, [])]
    assert {r[4] for r in found(orphan_references(e, *empty))} == {"missing"}
    assert orphan_references(make(EDGES, []), *empty).count() == 0


def test_key_statistics_match_brute_force(spark, make):
    rnd = random.Random(5)
    rows = [
        dict(repo_id=rnd.choice(["r1", "r2", " r1", None]), src=rnd.choice([None, " ", *(f"s{rnd.randrange(40)}" for _ in range(6))]), dst="HOT " if rnd.random() < 0.5 else rnd.choice([f"d{rnd.randrange(30)}", "0123456789abcdef01234567", None, "\t"]),
             kind=rnd.choice(["CALLS", "calls ", None, "Imports"]), loaded_at=rnd.choice([None, T + rnd.randrange(99) * DAY]))
        for _ in range(3000)
    ]
    rows += rows[:500]
    want = defaultdict(lambda: [0, set(), set(), []])
    for r in rows:
        for field, key in (("dst", (r["dst"] or "").strip().lower()), ("kind", (r["kind"] or "").strip().upper())):
            if key:
                w = want[field, key]
                w[0] += 1
                w[1] |= {(r["repo_id"] or "").strip()} - {""}
                w[2] |= {(r["src"] or "").strip().lower()} - {""}
                w[3] += [r["loaded_at"]] if r["loaded_at"] else []
    edges = make(EDGES, rows).repartition(5).withColumn("key", clean_id("src"))
    for chunk in (7, 200_000):
        stats = edge_key_statistics(edges, chunk_rows=chunk)
        got = {(r.key_field, r.key_value): (r.n_rows, r.n_repo, r.n_src, r.first_load, r.last_load) for r in stats.collect()}
        assert got == {k: (n, len(a), len(b), min(t, default=None), max(t, default=None)) for k, (n, a, b, t) in want.items()}
    heavy = {(r.key_field, r.key_value) for r in heavy_keys(stats, edges, 0.1).collect()}
    assert heavy == {k for k, w in want.items() if w[0] >= 0.1 * len(rows)}
    assert edge_key_statistics(make(EDGES, [])).count() == 0
