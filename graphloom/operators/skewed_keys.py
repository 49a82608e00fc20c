"""Per-key results where a few keys hold most records, with evenly loaded tasks.

Method: exact offset chunking.

1. The input is combined inside each task (``mapInArrow``), so that the repeats of one (key, member) pair, however
   many, leave a task as one row per batch. Then it is sorted by (key, member) over range partitions: a hot key spreads over as many
   partitions as its members need. The sorted, combined rows are written once to the shared folder.
2. Keys are counted per written file. A prefix sum over the files gives each key's offset in each of its files.
3. A row's number within its key is its row index in the file, less the key's first row index there, plus the offset.
4. Chunks are ``number div chunk_rows``: no task ever sees more than chunk_rows rows of a key in one group.
5. Each chunk yields a state: rows, distinct members, first and last member, first and last time. States of one key are
   merged in order of their chunks; where a chunk begins with the member the one before ended with, it is counted once.

Defined results
---------------
A null or blank key is no key. A null or blank member counts as a row, not as a distinct member; null times are ignored
(null if all are null). Repeats count as rows. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.normalize import clean_id, clean_kind, micros, packed_id, trimmed, unpacked_id
from graphloom.session import stored

#: Rows of one key in a chunk, at most.
CHUNK_ROWS = 200_000

PAIR = ["field", "what", "key", "member"]


PAIRS = "field tinyint, what tinyint, key binary, member binary, n bigint, first_us bigint, last_us bigint"
#: Input rows that a task combines at a time.
COMBINE_ROWS = 100_000


def _combiner(n_keys: int, n_members: int):
    """Pairs each key with each member, and adds up equal pairs of COMBINE_ROWS rows at a time: memory stays bounded."""

    def merged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        for i in range(n_keys):
            for j in range(n_members):
                pair = pa.table({"key": t.column(i), "member": t.column(n_keys + j), "us": t.column(t.num_columns - 1)})
                pair = pair.filter(pc.is_valid(pair["key"]) if j == 0 else pc.and_(pc.is_valid(pair["key"]), pc.is_valid(pair["member"])))
                # Only the first member kind carries rows and times; the others say which members there are.
                what = [([], "count_all"), ("us", "min"), ("us", "max")] if j == 0 else []
                g = pair.group_by(["key", "member"], use_threads=False).aggregate(what)
                none = pa.nulls(g.num_rows, pa.int64())
                counts = [g["count_all"], g["us_min"], g["us_max"]] if j == 0 else [none] * 3
                consts = [pa.repeat(pa.scalar(x, pa.int8()), g.num_rows) for x in (i, j)]
                out = pa.table([*consts, g["key"], g["member"], *counts], names=[*PAIR, "n", "first_us", "last_us"])
                yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for b in batches:
            pending.append(b)
            if sum(x.num_rows for x in pending) >= COMBINE_ROWS:
                yield from merged(pending)
                pending = []
        if pending:
            yield from merged(pending)

    return run


def sorted_pairs(edges: DataFrame, keys: dict[str, Column], members: dict[str, Column], time: str) -> DataFrame:
    """Distinct (field, what, key, member) with n, first_us, last_us, written sorted by range."""
    clean = edges.select(*[packed_id(c).alias(f"k_{k}") for k, c in keys.items()], *[packed_id(c).alias(f"m_{m}") for m, c in members.items()], micros(time).alias("us"))
    combined = clean.mapInArrow(_combiner(len(keys), len(members)), PAIRS)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # A range partitioning by exactly these columns is what the grouping needs, so it adds no exchange of its own.
    pairs = combined.repartitionByRange(n, *PAIR).groupBy(*PAIR).agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return stored(pairs.sortWithinPartitions(*PAIR), "sorted-pairs")


def key_statistics(edges: DataFrame, keys: dict[str, Column], members: dict[str, Column], time: str = "loaded_at", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key_field, key_value, n_rows, n_<member>..., first_load, last_load), one row per key. See the module's docstring."""
    names, kinds = list(keys), list(members)
    pairs = sorted_pairs(edges, keys, members, time)
    at = pairs.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("idx"))
    group = ["field", "what", "key"]
    per_file = at.groupBy(*group, "file").agg(F.count("*").alias("rows"), F.min("idx").alias("begin"), F.min("member").alias("least"))
    # Only keys in several files, or with more rows than a chunk, need offsets: at most one key per file boundary plus total/chunk_rows.
    spread = per_file.groupBy(*group).agg(F.count("*").alias("files"), F.sum("rows").alias("total")).filter((F.col("files") > 1) | (F.col("total") > chunk_rows)).select(*group)
    in_order = Window.partitionBy(*group).orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_file.join(F.broadcast(spread), group, "left_semi")
        .withColumn("offset", F.coalesce(F.sum("rows").over(in_order), F.lit(0)))
        .select(*group, "file", "begin", "offset")
    )
    numbered = at.join(F.broadcast(offsets), [*group, "file"], "left").withColumn(
        "chunk", F.coalesce(F.floor((F.col("idx") - F.col("begin") + F.col("offset")) / chunk_rows), F.lit(0))
    )
    states = numbered.groupBy(*group, "chunk").agg(
        F.sum("n").alias("n"), F.count("member").alias("members"), F.min("member").alias("head"), F.max("member").alias("tail"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    )
    order = Window.partitionBy(*group).orderBy("chunk")
    merged = (
        states.withColumn("again", (F.lag("tail").over(order) == F.col("head")).cast("int"))
        .withColumn("members", F.col("members") - F.coalesce("again", F.lit(0)))
        .groupBy("field", "key")
        .agg(
            F.sum("n").alias("n_rows"),
            *[F.coalesce(F.sum(F.when(F.col("what") == j, F.col("members"))), F.lit(0)).alias(f"n_{k}") for j, k in enumerate(kinds)],
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
        )
    )
    as_time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("field").cast("int") + 1)
    return merged.select(name.alias("key_field"), unpacked_id(F.col("key")).alias("key_value"), "n_rows", *[f"n_{k}" for k in kinds], as_time("first_us").alias("first_load"), as_time("last_us").alias("last_load"))


def edge_key_statistics(edges: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows, distinct repos and src, first and last load per dst and per kind of edges."""
    return key_statistics(edges, {"dst": clean_id("dst"), "kind": clean_kind("kind")}, {"repo": trimmed("repo_id"), "src": clean_id("src")}, chunk_rows=chunk_rows)


def heavy_keys(stats: DataFrame, edges: DataFrame, share: float = 0.007) -> DataFrame:
    """Keys that hold at least the share of all rows of edges. The total is one counted number."""
    least = edges.count() * share
    return stats.filter(F.col("n_rows") >= least)
