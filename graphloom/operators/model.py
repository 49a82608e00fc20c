"""The graph model: valid nodes and edges out of deliveries that repeat, identities, counts and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.normalize import clean_id, clean_kind, clean_path, trimmed

EXTERNAL = ("EXTERNALSYMBOL", "EXTERNALDEPENDENCY")
DEFINITIONS = ("FUNCTION", "METHOD", "CLASS")
EMBEDDABLE = ("FUNCTION", "METHOD", "CLASS", "ROUTE", "DOCSECTION")
EXPANDABLE = ("FILE", "FUNCTION", "METHOD", "CLASS", "ROUTE")
TRAVERSED = ("CALLS", "IMPORTS", "EXTENDS", "HANDLES", "EXPOSES")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by order, nulls last. Equal rows are interchangeable."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """The valid row of each id, with kind and path in compared form and lines clamped (start >= 1, end >= start)."""
    start = F.greatest(F.lit(1), F.coalesce("start_line", F.lit(0)))
    rows = nodes.select(
        clean_id("id").alias("id"), "repo_id", clean_path("owner_path").alias("owner_path"), clean_kind("kind").alias("kind"), "name", "qname",
        clean_path("path").alias("path"), start.alias("start_line"), F.greatest(start, F.coalesce("end_line", F.lit(0))).alias("end_line"),
        "signature", "doc", "confidence", "content_hash", "extra", "loaded_at",
    ).filter("id is not null")
    return last_wins(rows, ["id"], ["loaded_at", "doc", "signature", "content_hash"])


def valid_edges(edges: DataFrame, by: str | None = None) -> DataFrame:
    """One row per (repo_id, owner_path, src, dst, kind, detail): the one loaded last, of equals the greatest confidence. by: the part of this key by whose values the result is laid out."""
    key = ["repo_id", "owner_path", "src", "dst", "kind", "detail"]
    rows = edges.select(
        "repo_id", clean_path("owner_path").alias("owner_path"), clean_id("src").alias("src"), clean_id("dst").alias("dst"), clean_kind("kind").alias("kind"),
        F.coalesce(trimmed("detail"), F.lit("")).alias("detail"), "confidence", "loaded_at",
    ).filter("src is not null and dst is not null")
    return last_wins(rows.repartition(by) if by else rows, key, ["loaded_at", "confidence"])


def valid_files(files: DataFrame) -> DataFrame:
    """One row per (repo_id, path): the one indexed last."""
    rows = files.withColumn("path", clean_path("path")).filter("path is not null")
    return last_wins(rows, ["repo_id", "path"], ["indexed_at", "content_hash", "size", "mtime"])


def valid_repos(repos: DataFrame) -> DataFrame:
    return last_wins(repos, ["id"], ["indexed_at", "name", "root"])


def node_id(kind: Column, qname: Column, path: Column, start_line: Column) -> Column:
    """The content-addressed id: the first 24 hex digits of sha1 over the four parts, joined by NUL."""
    return F.substring(F.sha1(F.concat_ws("\x00", kind, qname, path, start_line.cast("string"))), 1, 24)


def repo_id(root: Column) -> Column:
    return F.substring(F.sha1(root), 1, 16)


def confidence_rank(c: Column | str) -> Column:
    """exact 0, strong 1, resolved 2, anything else 3: the order of traversals."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(c == "exact", 0).when(c == "strong", 1).when(c == "resolved", 2).otherwise(3)


def repo_status(repos: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, name, indexed_at, n_files, n_nodes): both counts are made before the join, so that nothing fans out."""
    f = files.groupBy("repo_id").agg(F.countDistinct("path").alias("n_files"))
    n = nodes.groupBy("repo_id").agg(F.countDistinct("id").alias("n_nodes"))
    both = repos.select(F.col("id").alias("repo_id"), "name", "indexed_at").join(f, "repo_id", "left").join(n, "repo_id", "left")
    return both.fillna(0, ["n_files", "n_nodes"])


def cardinalities(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_degree(edges: DataFrame, scope: str = "repo_id", end: str = "src") -> DataFrame:
    """The node of highest degree in each scope; ties go to the smaller id. Degrees are counted before the window sees them."""
    degree = edges.groupBy(scope, end).agg(F.count("*").alias("degree"))
    best = degree.groupBy(scope).agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col(end).alias("id"))).alias("b"))
    return best.select(scope, F.col("b.id").alias("node_id"), (-F.col("b.d")).alias("degree"))


def kind_histogram(nodes: DataFrame) -> DataFrame:
    """(repo_id, summary, n_paths): a sentence of node kinds with counts, most frequent first, and how many paths hold them."""
    kinds = nodes.groupBy("repo_id", "kind").agg(F.count("*").alias("n"))
    text = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "kind", "n")))
    said = kinds.groupBy("repo_id").agg(F.array_join(F.transform(text, lambda x: F.concat_ws(" ", x["n"].cast("string"), x["kind"])), ", ").alias("summary"))
    return said.join(nodes.groupBy("repo_id").agg(F.countDistinct("path").alias("n_paths")), "repo_id")


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """The twelve columns that a property graph takes over."""
    return nodes.select("id", "repo_id", "owner_path", "kind", "name", "qname", "path", "start_line", "end_line", "signature", "doc", "confidence")


def graph_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist, with the six columns that a property graph takes over."""
    ends = nodes.select("id")
    kept = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.select("src", "dst", "kind", "confidence", "detail", "repo_id")


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    """Sorted CSV files with a header; their names keep the order. Range partitions sort without one task for all."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False)
