"""What a change of a target reaches: targets by id, name or search, neighbours without shadows, blast radius, and counters - for many targets in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.context import BLOCK_CENTERS
from graphloom.operators.model import EXTERNAL
from graphloom.operators.neighbors import neighbors
from graphloom.operators.search import tiered_search
from graphloom.operators.symbols import find_symbols
from graphloom.operators.traversal import radius_counters
from graphloom.session import stored


def impact_targets(nodes: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """(query, id, how): the nodes that each name means. A node id means its node; else symbols are looked up; a name without any is searched for. names: (query)."""
    asked = names.select("query").filter(F.length("query") > 0).distinct()
    by_id = stored(asked.join(nodes.select("id"), F.lower("query") == F.col("id")).select("query", "id", F.lit("id").alias("how")), "targets-by-id")
    rest = asked.join(by_id, "query", "left_anti")
    symbols = stored(find_symbols(nodes, rest, limit).select("query", "id", F.lit("symbol").alias("how")), "targets-by-name")
    rest = stored(rest.join(symbols, "query", "left_anti"), "targets-to-search")
    found = by_id.unionByName(symbols)
    if not rest.isEmpty():
        hits = tiered_search(nodes, rest.select(F.col("query").alias("qid"), "query"), limit)
        found = found.unionByName(hits.select(F.col("qid").alias("query"), "id", F.lit("search").alias("how")))
    return found


def unshadowed(near: DataFrame) -> DataFrame:
    """Neighbours (see ``neighbors``) without calls to an external symbol whose detail the same centre also has resolved."""
    detail = F.trim(F.coalesce("detail", F.lit("")))
    inside = ~F.coalesce(F.col("node_kind").isin(*EXTERNAL), F.lit(False))
    meant = near.filter((F.col("kind") == "CALLS") & inside & (detail != "")).select("center_id", detail.alias("_d"), F.lit("CALLS").alias("kind"), F.lit("EXTERNALSYMBOL").alias("node_kind")).distinct()
    return near.withColumn("_d", detail).join(meant, ["center_id", "_d", "kind", "node_kind"], "left_anti").drop("_d")


def neighbor_counts(edges: DataFrame, nodes: DataFrame, targets: DataFrame, limit: int = 200) -> DataFrame:
    """(id, incoming, callers, outgoing, callees): how many of the first ``limit`` neighbours in each direction are no shadowed calls, and how many of these are calls; see ``unshadowed``. targets: (id).

    The order of neighbours matters only to nodes with more than ``limit`` of them. The others' edges are counted as they lie; then calls that can be shadowed, which are few, are
    looked up: those that share node and detail with another call (out), or with a call from an external symbol (in). Hashes of node and detail say which these may be.
    """
    call = F.coalesce(F.col("kind") == "CALLS", F.lit(False))
    ends = F.array(*[F.struct(F.col(end).alias("id"), F.lit(end == "src").alias("out")) for end in ("src", "dst")])
    each = edges.select(F.explode(ends).alias("end"), call.alias("call")).select("end.*", "call")
    totals = each.groupBy("id").agg(F.count_if(~F.col("out")).alias("incoming"), F.count_if(~F.col("out") & F.col("call")).alias("callers"), F.count_if("out").alias("outgoing"), F.count_if(F.col("out") & F.col("call")).alias("callees"))
    found = totals = stored(targets.join(totals, "id"), "end-counts")
    calls = edges.filter(call).select("src", "dst", F.trim(F.coalesce("detail", F.lit(""))).alias("_d")).filter("_d <> ''")
    few = lambda d: F.broadcast(d) if d.count() <= BLOCK_CENTERS else d
    for direction, all_, called in (("in", "incoming", "callers"), ("out", "outgoing", "callees")):
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        keyed = calls.withColumn("_k", F.xxhash64(near, "_d"))
        if direction == "out":
            keys = keyed.groupBy("_k").agg(F.count("*").alias("c")).filter("c > 1").select("_k")
        else:
            outside = stored(nodes.filter("kind = 'EXTERNALSYMBOL'").select(F.col("id").alias("src")).join(calls.select("src"), "src", "left_semi"), "external-callers")
            keys = keyed.join(few(outside), "src", "left_semi").select("_k").distinct()
        doubtful = stored(keyed.join(few(stored(keys, "doubtful-keys")), "_k", "left_semi").drop("_k"), "doubtful-calls")
        kinds = nodes.select(F.col("id").alias(far), F.col("kind").alias("node_kind")).join(few(stored(doubtful.select(far).distinct(), "doubtful-ends")), far, "left_semi")
        inside = ~F.coalesce(F.col("node_kind").isin(*EXTERNAL), F.lit(False))
        shadowed = doubtful.join(kinds, far, "left").groupBy(near, "_d").agg(F.count_if(F.col("node_kind") == "EXTERNALSYMBOL").alias("n"), F.count_if(inside).alias("meant")).filter("n > 0 and meant > 0")
        found = found.join(shadowed.groupBy(F.col(near).alias("id")).agg(F.sum("n").alias("_s")), "id", "left").withColumns({c: F.col(c) - F.coalesce("_s", F.lit(0)) for c in (all_, called)}).drop("_s")
        many = stored(totals.filter(F.col(all_) > limit).select("id"), "many-neighbours")
        if not many.isEmpty():
            first = unshadowed(neighbors(edges.join(few(many).withColumnRenamed("id", near), near, "left_semi"), nodes, direction, limit)).groupBy(F.col("center_id").alias("id")).agg(F.count("*").alias("_a"), F.count_if(F.col("kind") == "CALLS").alias("_c"))
            found = found.join(first, "id", "left").withColumns({all_: F.coalesce("_a", all_), called: F.coalesce("_c", called)}).drop("_a", "_c")
    return found


def impact_report(edges: DataFrame, nodes: DataFrame, targets: DataFrame, neighbor_limit: int = 200, depth: int | None = None, max_nodes: int = 1000) -> DataFrame:
    """One row per target: (id, callers, callees, incoming, outgoing, upstream, downstream, files, entrypoints, conservative, truncated). targets: (id).

    Neighbours are the first ``neighbor_limit`` in each direction, without shadowed calls. files counts the paths of reached internal nodes and the target's own;
    conservative counts reached nodes into which only imports lead; truncated says that a direction held more than ``max_nodes``.
    """
    targets = stored(targets.select("id").distinct().join(nodes.select("id"), "id"), "impact-targets")
    near = stored(neighbor_counts(edges, nodes, targets, neighbor_limit), "neighbor-counts")
    counts = radius_counters(edges, nodes, targets.select(F.col("id").alias("seed"), "id"), depth, max_nodes).drop("files").withColumnsRenamed({"seed": "id", "internal_files": "files"}).withColumn("truncated", F.col("reached") > max_nodes)
    both = targets.select("id")
    for part in (near, counts):
        both = both.join(part, "id", "left")
    numbers = ["callers", "callees", "incoming", "outgoing", "upstream", "downstream", "files", "entrypoints", "conservative"]
    return both.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("truncated", F.lit(False)).alias("truncated"))
