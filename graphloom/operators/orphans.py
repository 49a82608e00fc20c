"""References to records that do not exist, were removed, or arrived only after the reference.

Method: a skew-aware split. References are first pre-aggregated by value and month, which also removes the repeats
of a hot value before anything is shuffled by value. Values that still hold a large share of the groups (at most HEAVY can, so the
set that is broadcast has a fixed bound) take a broadcast path; all others are joined by shuffle; both are united.

Defined results
---------------
* A null or blank reference is no reference. A null repo_id is a value of its own (compared null-safe).
* A null time of an edge gives a null month; such a reference can be missing or deleted, never late.
* A record whose own time is null counts as always present. A tombstone without a time removes no row,
  but an id that has only such tombstones and no row is ``deleted``.
* Repeated rows change nothing; extra columns are ignored; empty tables give no rows (or all references missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.normalize import clean_id, clean_path, micros
from graphloom.session import stored

#: A value that holds a 1/HEAVY share of all groups takes the broadcast path; so at most HEAVY values do.
HEAVY = 1000
#: A value with fewer groups than this is never heavy.
HEAVY_GROUPS = 64

#: Parts into which the rows of a value and month are split when late ones are counted.
SALTS = 16

ALWAYS = -(1 << 62)
#: Stands for a null repo_id while joining.
NO_REPO = "\x00"


def node_states(nodes: DataFrame, shared: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(ref_value, first_us, gone): first time of a live row, or null without one; whether the id has a tombstone."""
    rows = nodes.select(clean_id("id").alias("ref_value"), micros("loaded_at").alias("us"), F.lit(False).alias("always")).unionByName(
        shared.select(clean_id("id").alias("ref_value"), micros("loaded_at").alias("us"), F.lit(True).alias("always"))
    )
    rows = rows.filter("ref_value is not null").withColumn("us", F.coalesce("us", F.lit(ALWAYS)))
    removed = (
        tombstones.select(clean_id("node_id").alias("ref_value"), F.coalesce(micros("removed_at"), F.lit(ALWAYS)).alias("removed_us"))
        .filter("ref_value is not null")
        .groupBy("ref_value")
        .agg(F.max("removed_us").alias("removed_us"))
    )
    live = F.when(F.col("always") | F.col("removed_us").isNull() | (F.col("us") > F.col("removed_us")) | (F.col("us") == ALWAYS), F.col("us"))
    return (
        rows.join(removed, "ref_value", "full_outer")
        .groupBy("ref_value")
        .agg(F.min(F.when(F.col("us").isNotNull(), live)).alias("first_us"), F.max(F.col("removed_us").isNotNull()).alias("gone"))
    )


def file_states(files: DataFrame) -> DataFrame:
    """(ref_repo, ref_value, first_us, gone): first index time of a file."""
    us = F.coalesce(F.round(F.col("indexed_at") * 1e6).cast("long"), F.lit(ALWAYS))
    return (
        files.select(F.coalesce("repo_id", F.lit(NO_REPO)).alias("ref_repo"), clean_path("path").alias("ref_value"), us.alias("us"))
        .filter("ref_value is not null")
        .groupBy("ref_repo", "ref_value")
        .agg(F.min("us").alias("first_us"))
        .withColumn("gone", F.lit(False))
    )


def _with_states(refs: DataFrame, states: DataFrame, keys: list[str], heavy: int, heavy_groups: int) -> DataFrame:
    """refs with first_us and gone of their value: heavy values by broadcast, the others by shuffle."""
    # A value with a 1/heavy share of all groups is heavy: at most ``heavy`` values can be, whatever the input's size.
    least = F.greatest(F.lit(heavy_groups), refs.agg(F.count("*").alias("n")).scalar() / heavy)
    top = refs.groupBy(*keys).agg(F.count("*").alias("groups")).filter(F.col("groups") >= least).select(*keys)
    marked = top.join(states.join(F.broadcast(top), keys, "left_semi"), keys, "left")
    hot = refs.join(F.broadcast(marked), keys, "inner")
    cold = refs.join(F.broadcast(top), keys, "left_anti").join(states, keys, "left")
    return hot.unionByName(cold)


def orphan_references(
    edges: DataFrame,
    nodes: DataFrame,
    shared: DataFrame,
    tombstones: DataFrame,
    files: DataFrame,
    heavy: int = HEAVY,
    heavy_groups: int = HEAVY_GROUPS,
    count_late: bool = True,
) -> DataFrame:
    """(ref_field, repo_id, ref_value, ref_month, ref_state, n_refs), one row per orphan value, repo and month.

    n_refs counts the edge rows that make up the case; for ``late``, those of the month that came before the record (``count_late``; without it, all of the month,
    for callers that need no counts). The pre-aggregated references are written once, since the split reads them several times.
    See the module's docstring for nulls, repeats and empty tables.
    """
    base = edges.select(
        "repo_id",
        F.substring(F.col("loaded_at").cast("timestamp_ntz").cast("string"), 1, 7).alias("ref_month"),
        micros("loaded_at").alias("us"),
        clean_id("src").alias("src"),
        clean_id("dst").alias("dst"),
        clean_path("owner_path").alias("owner_path"),
    )

    def grouped(df: DataFrame, *keys: str) -> DataFrame:
        return df.filter("ref_value is not null").groupBy(*keys).agg(F.min("us").alias("edge_us"), F.max("us").alias("last_us"), F.count("*").alias("n_refs"))

    id_rows = base.select(F.explode(F.array(*[F.struct(F.lit(k).alias("ref_field"), F.col(k).alias("ref_value")) for k in ("src", "dst")])).alias("r"), F.coalesce("repo_id", F.lit(NO_REPO)).alias("ref_repo"), "ref_month", "us").select("r.*", "ref_repo", "ref_month", "us")
    path_rows = base.select(F.lit("owner_path").alias("ref_field"), F.col("owner_path").alias("ref_value"), F.coalesce("repo_id", F.lit(NO_REPO)).alias("ref_repo"), "ref_month", "us")
    group = ["ref_field", "ref_value", "ref_repo", "ref_month"]
    by_id, by_path = stored(grouped(id_rows, *group), "references"), stored(grouped(path_rows, *group), "path-references")
    ids = _with_states(by_id, node_states(nodes, shared, tombstones), ["ref_value"], heavy, heavy_groups)
    paths = _with_states(by_path, file_states(files), ["ref_repo", "ref_value"], heavy, heavy_groups)
    state = (
        F.when(F.col("first_us").isNull(), F.when(F.coalesce(F.col("gone"), F.lit(False)), "deleted").otherwise("missing"))
        .when(F.col("edge_us") < F.col("first_us"), "late")
    )
    out = ids.unionByName(paths).withColumn("ref_state", state).filter("ref_state is not null")
    if count_late:
        out = stored(out, "orphans")
        # Only months in which a record arrived hold references from before and after it; those are counted again, row by row.
        both = out.filter("ref_state = 'late' and last_us >= first_us").select(*group, "first_us", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = id_rows.unionByName(path_rows).filter("ref_value is not null and us is not null").withColumn("salt", F.pmod(F.hash("us"), F.lit(SALTS)))
        early = rows.join(both, [*group, "salt"]).filter("us < first_us").groupBy(*group).agg(F.count("*").alias("n_early"))
        out = out.join(early, group, "left").withColumn("n_refs", F.coalesce("n_early", "n_refs"))
    out = out.withColumn("repo_id", F.nullif("ref_repo", F.lit(NO_REPO)))
    return out.select("ref_field", "repo_id", "ref_value", "ref_month", "ref_state", "n_refs")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans by repo, field, month and state: number of distinct values and of edge rows. The field says which table is referred to: nodes, or files for owner_path."""
    return orphans.groupBy("repo_id", "ref_field", "ref_month", "ref_state").agg(F.count("*").alias("n_values"), F.sum("n_refs").alias("n_refs"))
