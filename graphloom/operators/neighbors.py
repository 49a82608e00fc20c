"""Neighbours of nodes, for many centres in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.model import EXTERNAL


def _order(prefix: str = "") -> list[Column]:
    """External ones last; resolved, strong, others; path; line; then kind, id and detail, so that the order is total."""
    c = F.lower("confidence")
    return [
        F.coalesce(F.col("node_kind").isin(*EXTERNAL), F.lit(False)).cast("int"), F.when(c == "resolved", 0).when(c == "strong", 1).otherwise(2),
        F.coalesce("node_path", F.lit("")), F.coalesce("node_line", F.lit(0)), F.col("kind"), F.col("node_id"), F.col("detail"), F.coalesce("owner_path", F.lit("")),
    ]


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str, limit: int = 16, centers: DataFrame | None = None) -> DataFrame:
    """(center_id, node_id, kind, confidence, detail, node_name, node_kind, node_path, node_line, dangling, position).

    The first ``limit`` neighbours of each centre in the given direction ("out" or "in"). The join is an outer one: an edge whose other end
    does not exist stays, as dangling. A node of any degree is safe: each task keeps only ``limit`` rows per centre before the shuffle.
    """
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.select(F.col(near).alias("center_id"), F.col(far).alias("node_id"), "repo_id", "owner_path", "kind", "confidence", "detail")
    if centers is not None:
        e = e.join(centers.select(F.col("id").alias("center_id")), "center_id", "left_semi")
    n = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), F.col("kind").alias("node_kind"), F.col("path").alias("node_path"), F.col("start_line").alias("node_line"))
    both = e.join(n, "node_id", "left")
    ranked = both.withColumn("position", F.row_number().over(Window.partitionBy("center_id").orderBy(*_order()))).filter(F.col("position") <= limit)
    return ranked.select("center_id", "node_id", "kind", "confidence", "detail", "node_name", "node_kind", "node_path", "node_line", F.col("node_kind").isNull().alias("dangling"), "position")


def without_shadows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those calls to an external symbol whose detail the same source also has resolved."""
    kinds = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    e = edges.join(kinds, "dst", "left")
    detail = F.trim(F.coalesce("detail", F.lit("")))
    resolved = e.filter((F.col("kind") == "CALLS") & (F.lower("confidence") == "resolved") & ~F.coalesce(F.col("dst_kind").isin("EXTERNALSYMBOL"), F.lit(False)) & (detail != "")).select("src", detail.alias("_d")).distinct()
    external = F.coalesce((F.col("kind") == "CALLS") & (F.col("dst_kind") == "EXTERNALSYMBOL"), F.lit(False))
    shadowed = e.filter(external).withColumn("_d", detail).join(resolved, ["src", "_d"], "left_anti").drop("_d")
    return e.filter(~external).unionByName(shadowed).drop("dst_kind")
