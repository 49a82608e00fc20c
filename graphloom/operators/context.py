"""Context packs: hits ranked, deduplicated and fitted into a budget, with the reason for each and the neighbours of the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.model import EXTERNAL
from graphloom.operators.neighbors import neighbors

#: At most so many centres are broadcast.
BLOCK_CENTERS = 200_000


def shortened(c: Column | str, size: int = 800) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size - 3)), F.lit("..."))).otherwise(c)


def item_cost(*parts: str) -> Column:
    """What an item takes of the budget: a quarter of its characters (parts after shortening, plus a frame of 160), 120 at least."""
    return F.greatest(F.lit(120), ((sum((F.length(F.coalesce(shortened(p), F.lit(""))) for p in parts), F.lit(0)) + 160) / 4).cast("int"))


def context_pack(hits: DataFrame, nodes: DataFrame, budget: int = 6000) -> DataFrame:
    """(qid, id, cost, place): which hits of each query fit, taken greedily in order; one that does not fit is skipped, unless the pack is empty.

    hits: (qid, id, position), bounded per query by the search's limit, so a query's list is small. Hits with the same path and lines count once.
    """
    n = nodes.select("id", "kind", "path", "start_line", "end_line", item_cost("qname", "path", "signature", "doc").alias("cost"))
    rows = hits.join(n, "id")
    once = Window.partitionBy("qid", "path", "start_line", "end_line").orderBy("position", "id")
    rows = rows.withColumn("_r", F.row_number().over(once)).filter("_r = 1")
    order = F.struct(F.coalesce(F.col("kind").isin(*EXTERNAL), F.lit(False)).cast("int").alias("ext"), F.col("position"), F.col("id"), F.col("cost"))
    empty = F.struct(F.lit(max(1000, budget)).alias("left"), F.array().cast("array<struct<id:string,cost:int,place:int>>").alias("taken"))

    def take(state: Column, item: Column) -> Column:
        fits = (state["left"] > 0) & ((item["cost"] <= state["left"]) | (F.size(state["taken"]) == 0))
        more = F.struct(item["id"].alias("id"), item["cost"].alias("cost"), (F.size(state["taken"]) + 1).alias("place"))
        return F.when(fits, F.struct((state["left"] - item["cost"]).alias("left"), F.array_append(state["taken"], more).alias("taken"))).otherwise(state)

    packed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(order)).alias("items")).select("qid", F.aggregate("items", empty, take).alias("s"))
    return packed.select("qid", F.explode("s.taken").alias("t")).select("qid", "t.id", "t.cost", "t.place")


def confidence_summary(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, n_hits, n_paths, confidence): none without a confidence, exact for one exact hit, strong if all are exact or strong, else mixed."""
    c = F.lower("confidence")
    g = hits.join(nodes.select("id", "path", "confidence"), "id").groupBy("qid").agg(
        F.count("*").alias("n_hits"), F.countDistinct("path").alias("n_paths"), F.count_if(c == "exact").alias("e"), F.count_if(c == "strong").alias("s"), F.count("confidence").alias("n"))
    said = F.when(F.col("n") == 0, "none").when((F.col("n_hits") == 1) & (F.col("e") == 1), "exact").when(F.col("e") + F.col("s") == F.col("n"), "strong").otherwise("mixed")
    return g.select("qid", "n_hits", "n_paths", said.alias("confidence"))


def reason(query: Column, name: Column, qname: Column, path: Column) -> Column:
    """Why a node is a hit: the first of name, qualified name and path that contains the query, whatever the case."""
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lower(query)), F.lit(False))
    return F.when(holds(name), "name match").when(holds(qname), "qualified-name match").when(holds(path), "path match").otherwise("full-text match")


def context_items(packed: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, place, id, kind, qname, path, lines, doc, why, confidence): the items of a pack as they are read. packed: (qid, id, cost, place)."""
    n = nodes.select("id", "kind", "name", "qname", "path", F.array("start_line", "end_line").alias("lines"), shortened(F.coalesce("doc", F.lit(""))).alias("doc"), F.coalesce("confidence", F.lit("unknown")).alias("confidence"))
    both = packed.join(n, "id").join(queries.select("qid", "query"), "qid")
    return both.select("qid", "place", "id", "kind", "qname", "path", "lines", "doc", reason(F.col("query"), F.col("name"), F.col("qname"), F.col("path")).alias("why"), "confidence")


def related(hits: DataFrame, edges: DataFrame, nodes: DataFrame, first: int = 5, limit: int = 16) -> DataFrame:
    """(qid, id, direction, node_id, kind, qname, node_kind, path, confidence, position): neighbours in the graph of the first hits of each query; dangling ones are left out.

    Neighbours are looked up once for each node, however many queries it is a hit of. hits: (qid, id, position).
    """
    top = hits.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("position", "id"))).filter(F.col("_r") <= first).select("qid", "id")
    centers, q = top.select("id").distinct(), nodes.select(F.col("id").alias("node_id"), "qname")
    # Up to BLOCK_CENTERS centres travel to the edges; more of them meet the edges by a shuffle.
    asked = F.broadcast(centers) if centers.count() <= BLOCK_CENTERS else centers
    parts = []
    for direction in ("in", "out"):
        close, far = ("src", "dst") if direction == "out" else ("dst", "src")
        # Edges of the centres first, which are few, then those of them that lead to a node.
        there = edges.join(asked.select(F.col("id").alias(close)), close, "left_semi").join(nodes.select(F.col("id").alias(far)), far, "left_semi")
        near = neighbors(there, nodes, direction, limit, centers).join(q, "node_id")
        parts.append(top.join(near.withColumnRenamed("center_id", "id"), "id").select("qid", "id", F.lit(direction).alias("direction"), "node_id", "kind", "qname", "node_kind", F.col("node_path").alias("path"), "confidence", "position"))
    return parts[0].unionByName(parts[1])
