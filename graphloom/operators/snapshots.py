"""Incremental snapshots: differences by hash, replacement, removal, and the embedding queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.normalize import clean_id
from graphloom.operators.model import EMBEDDABLE, last_wins


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], content: str = "content_hash") -> DataFrame:
    """(keys, change): added, removed, changed or unchanged; equal null hashes count as unchanged."""
    o = old.select(*keys, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return o.join(n, keys, "full_outer").select(*keys, change.alias("change"))


def replace_files(rows: DataFrame, fresh: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a new snapshot: those of files that did not change, and the fresh ones. Write it to a new folder."""
    return rows.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def remove_missing(rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of files that still exist."""
    return rows.join(live.select(*keys).distinct(), keys, "left_semi")


def live_nodes(nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Valid nodes that were not removed at or after their load."""
    gone = tombstones.groupBy(clean_id("node_id").alias("id")).agg(F.max("removed_at").alias("removed_at"))
    return nodes.join(gone, "id", "left").filter(F.col("removed_at").isNull() | (F.col("loaded_at") > F.col("removed_at"))).drop("removed_at")


def upsert_repos(old: DataFrame, new: DataFrame) -> DataFrame:
    return last_wins(old.unionByName(new), ["id"], ["indexed_at", "name", "root"])


def embedding_queue(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """(node_id, repo_id, content_hash, queued_at, embedded_at): an unchanged hash keeps its times, another hash is queued again.

    previous: the queue so far, of the same columns. Nodes without a hash, or of kinds that are not embedded, are not queued.
    """
    want = nodes.filter(F.col("kind").isin(*EMBEDDABLE) & (F.coalesce("content_hash", F.lit("")) != "")).select(F.col("id").alias("node_id"), "repo_id", "content_hash", F.col("loaded_at").alias("now"))
    old = previous.select("node_id", F.col("content_hash").alias("h"), "queued_at", "embedded_at")
    same = F.col("h").eqNullSafe(F.col("content_hash"))
    return want.join(old, "node_id", "left").select(
        "node_id", "repo_id", "content_hash", F.when(same, F.col("queued_at")).otherwise(F.col("now")).alias("queued_at"), F.when(same, F.col("embedded_at")).alias("embedded_at")
    )


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, repo_id, dims, model, embedded_at, ...): embeddings with new ones in place of old; of several new ones for a node the last."""
    fresh = last_wins(new, ["node_id"], ["embedded_at", "model"])
    return old.join(fresh.select("node_id"), "node_id", "left_anti").unionByName(fresh)


def complete(queue: DataFrame, embedded: DataFrame) -> DataFrame:
    """The queue with the times of what was embedded. embedded: (node_id, embedded_at)."""
    done = embedded.groupBy("node_id").agg(F.max("embedded_at").alias("_done"))
    return queue.join(done, "node_id", "left").withColumn("embedded_at", F.coalesce("_done", "embedded_at")).drop("_done")


def drop_stale(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Queue entries or embeddings whose node still exists."""
    return rows.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def remove_missing_files(nodes: DataFrame, edges: DataFrame, queue: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and queue without what belongs to files that are gone. Rows are owned by (repo_id, owner_path); one without an owner stays. live: (repo_id, path)."""
    owner = live.select("repo_id", F.col("path").alias("owner_path")).distinct()
    kept = lambda df: df.filter("owner_path is null or repo_id is null").unionByName(df.join(owner, ["repo_id", "owner_path"], "left_semi").select(*df.columns))
    n = kept(nodes)
    return n, kept(edges), drop_stale(queue, n)


def pending(queue: DataFrame, limit: int = 32) -> DataFrame:
    """The next rows of the queue: first in, first out."""
    return queue.filter("embedded_at is null").orderBy("queued_at", "node_id").limit(limit)


def embedding_text(nodes: DataFrame, size: int = 384) -> DataFrame:
    """(id, text): qualified name, signature and doc, one a line, at most ``size`` characters, without a dangling line end."""
    parts = F.filter(F.array("qname", "signature", "doc"), lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0)
    text = F.left(F.array_join(parts, "\n"), F.lit(size))
    return nodes.filter(F.col("kind").isin(*EMBEDDABLE)).select("id", F.regexp_replace(text, r"\n+\z", "").alias("text"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies): texts that occur under several ids; the least id stands for the class.

    Grouped by hash first, with counts alone; ids join their class by the hash, so no group is gathered in one place.
    """
    h = docs.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    g = h.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    return h.join(g, "h").select("doc_id", "class_id", "n_copies")


#: Queries scored against a batch at a time.
SCORED = 256


def nearest_vectors(vectors: DataFrame, k: int = 5, every: int = 100) -> DataFrame:
    """(query_id, vec_id, similarity, position): the k most similar vectors, by cosine, of each query; the queries are ids divisible by ``every``.

    The queries are a stated set, searched against all rows in blocks: each task scores its block of rows against the queries and keeps k per query.
    """
    import numpy as np
    import pandas as pd

    rows = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding").orderBy("vec_id")
    spark = vectors.sparkSession

    def block(queries: list) -> DataFrame:
        ids = np.array([r[0] for r in queries], np.int64)
        q = np.array([r[1] for r in queries], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches):
            ids, q = shared.value
            for b in batches:
                if not len(b):
                    continue
                v = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                own = b["vec_id"].to_numpy()
                for at in range(0, len(ids), SCORED):  # so many queries at a time bound the matrix
                    sim = np.round(q[at : at + SCORED] @ v.T, 6)
                    sim[ids[at : at + SCORED, None] == own[None, :]] = -2
                    best = [np.lexsort((own, -s))[:k] for s in sim]
                    best = [x[s[x] > -2] for x, s in zip(best, sim)]
                    yield pd.DataFrame({"query_id": np.repeat(ids[at : at + SCORED], list(map(len, best))), "vec_id": np.concatenate([own[x] for x in best]), "similarity": np.concatenate([s[x] for x, s in zip(best, sim)])})

        return vectors.filter("embedding is not null").select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, similarity double")

    out, pending_rows = None, []
    for r in rows.toLocalIterator():  # a block of queries at a time: its size is bounded, however many there are
        pending_rows.append((r[0], r[1]))
        if len(pending_rows) == 10_000:
            out = block(pending_rows) if out is None else out.unionByName(block(pending_rows))
            pending_rows = []
    if pending_rows or out is None:
        part = block(pending_rows) if pending_rows else spark.createDataFrame([], "query_id long, vec_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
