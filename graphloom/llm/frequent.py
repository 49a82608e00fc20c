"""The most frequent values of a column with very many distinct values.

Method: exact, spillable aggregation. ``groupBy`` combines within each task before the shuffle (so a value that fills a
third of all rows arrives as one row per task), hash partitions spill to disk, each partition keeps its own top k, and
one ordered limit joins those. Nothing but k rows per partition is ever in one place.

Defined results: values are trimmed; null and blank ones are no values. Repeated rows count. Ties at rank k are broken
by the value itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.normalize import trimmed


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(item_value, n_rows) of each trimmed value."""
    return df.select(trimmed(column).alias("item_value")).filter("item_value is not null").groupBy("item_value").agg(F.count("*").alias("n_rows"))


def _first(counts: DataFrame, column: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n_rows"), "item_value").limit(k).select(F.lit(column).alias("item_field"), "item_value", "n_rows")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """(item_field, item_value, n_rows): the k most frequent values of the column, with exact counts."""
    return _first(value_counts(df, column), column, k)


def frequent_values(df: DataFrame, column: str, share: float = 0.005) -> DataFrame:
    """Values that hold at least the share of the rows with a value. At most 1/share values can, so so many of the first are enough; the total is the sum of the counts."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n_rows").alias("total")).scalar()
    return _first(counts, column, int(1 / share)).filter(F.col("n_rows") >= F.lit(share) * total)
