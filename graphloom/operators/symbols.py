"""Symbol lookup: exact first, substring only for names without an exact hit. Many names in one plan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.model import EXTERNAL

#: Queries are searched in blocks of about so many characters, so that what is broadcast has a bound.
BLOCK_CHARS = 20_000_000
#: Bytes of the window by which a query is found: the most that it holds.
_WIDTHS = {8: "<u8", 4: "<u4", 2: "<u2", 1: "u1"}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _first(hits: DataFrame, limit: int) -> DataFrame:
    order = [F.col("kind").isin(*EXTERNAL).cast("int"), (F.lower("name") != F.lower("query")).cast("int"), F.length("qname"), F.col("qname"), F.col("id")]
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("position") <= limit)


def exact_symbols(nodes: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes whose name or qualified name equals the query, whatever the case. names: (query)."""
    cols = ["id", "name", "qname", "kind", "path"]
    q = names.select("query", F.lower("query").alias("_q")).distinct()
    keys = nodes.select(*cols, F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qname")))).alias("_q"))
    return _first(keys.join(q, "_q").drop("_q"), limit).select("query", *cols, "position")


class Patterns:
    """Queries by a window of their bytes, one that few of them share."""

    def __init__(self, queries: list[bytes]):
        self.queries = queries
        self.tables = {}
        for width in _WIDTHS:
            own = [i for i, q in enumerate(queries) if next(w for w in _WIDTHS if w <= len(q)) == width]
            if not own:
                continue
            shared: dict[bytes, int] = {}
            windows = lambda q: [q[k : k + width] for k in range(len(q) - width + 1)]  # noqa: B023, E731
            for i in own:
                for x in set(windows(queries[i])):
                    shared[x] = shared.get(x, 0) + 1
            held: dict[int, list[tuple[int, int]]] = {}
            for i in own:
                each = windows(queries[i])
                k = min(range(len(each)), key=lambda k: (shared[each[k]], -k))  # noqa: B023
                held.setdefault(int.from_bytes(each[k], "little"), []).append((i, k))
            keys = np.array(sorted(held), np.uint64)
            marks = np.zeros(1 << 20, bool)
            marks[(keys * _MIX) >> np.uint64(44)] = True
            self.tables[width] = keys, marks, [held[int(x)] for x in keys]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, query), each once: texts that hold a query. Row k's text is data[offsets[k]:offsets[k + 1]]."""
        raw, found, queries = data.tobytes(), set(), self.queries
        for width, (keys, marks, held) in self.tables.items():
            if len(raw) < width:
                continue
            windows = np.ndarray((len(raw) - width + 1,), _WIDTHS[width], raw, 0, (1,)).astype(np.uint64)
            at = np.flatnonzero(marks[(windows * _MIX) >> np.uint64(44)])
            key = np.minimum(np.searchsorted(keys, windows[at]), len(keys) - 1)
            same = keys[key] == windows[at]
            at, key = at[same], key[same]
            row = np.searchsorted(offsets, at, "right") - 1
            for p, k, r, low, high in zip(at.tolist(), key.tolist(), row.tolist(), offsets[row].tolist(), offsets[row + 1].tolist()):
                for i, shift in held[k]:
                    q = queries[i]
                    if low <= p - shift and p - shift + len(q) <= high and raw.startswith(q, p - shift):
                        found.add((r, i))
        return sorted(found)


_WORKER: dict[str, Patterns] = {}


def _patterns(key: str, queries: list[bytes]) -> Patterns:
    """The tables of a block of queries, built once per worker process; only the last block's are kept."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Patterns(queries)
    return _WORKER[key]


def substring_hits(nodes: DataFrame, names: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """(query, cols): rows whose text contains the query, whatever the case and however short it is.

    All queries of a block are looked for in one pass over each text, where it lies: nothing but the hits leaves a task.
    """
    spark = nodes.sparkSession
    q = names.filter(F.length("query") > 0).select("query", F.lower("query").alias("_q")).distinct()
    blocks = max(1, -(-(q.agg(F.sum(F.length("query"))).first()[0] or 0) // BLOCK_CHARS))
    texts = nodes.filter(F.col(text).isNotNull()).select(F.lower(text).alias("_t"), *cols)
    schema = ", ".join(["query string", *[f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in cols]])

    def part(k: int) -> DataFrame:
        key, rows = uuid.uuid4().hex, q.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(([r["query"] for r in rows], [r["_q"].encode() for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, low = shared.value
            patterns, said = _patterns(key, low), pa.array(names, pa.string())
            for b in batches:
                t = b.column(0).cast(pa.large_binary())
                offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
                hits = patterns.search(np.frombuffer(t.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(t) and names else []
                for n in range(0, len(hits), 50_000):
                    rows, own = (pa.array([x[j] for x in hits[n : n + 50_000]], pa.int64()) for j in (0, 1))
                    yield pa.RecordBatch.from_arrays([said.take(own), *[c.take(rows) for c in b.columns[1:]]], ["query", *b.schema.names[1:]])

        return texts.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [part(k) for k in range(blocks)])


def substring_symbols(nodes: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes whose qualified name contains the query, however short. names: (query)."""
    cols = ["id", "name", "qname", "kind", "path"]
    return _first(substring_hits(nodes, names, "qname", cols), limit).select("query", *cols, "position")


def find_symbols(nodes: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """Exact hits, and for names that have none, substring hits; tier says which."""
    exact = exact_symbols(nodes, names, limit)
    rest = names.join(exact.select("query").distinct(), "query", "left_anti")
    return exact.withColumn("tier", F.lit("exact")).unionByName(substring_symbols(nodes, rest, limit).withColumn("tier", F.lit("substring")))
