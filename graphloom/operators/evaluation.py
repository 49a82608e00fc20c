"""Retrieval quality, timings and regression comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import stored


# Words of programs that say nothing about what they do.
STOP_TERMS = (
    "false none true and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield self cls super __init__".split()
)


def identifier_terms(c: Column | str) -> Column:
    """The words of the identifiers of a text, in order: parts of camel case, digits, and each identifier whole; in lower case, of two characters or more, without STOP_TERMS."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    names = F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    parts = lambda x: F.array_append(F.regexp_extract_all(x, F.lit("[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|[^A-Za-z0-9]|$)|[0-9]+"), F.lit(0)), x)
    words = F.transform(F.flatten(F.transform(names, parts)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_TERMS)))


def import_terms(code: Column | str) -> Column:
    """The identifier words of a program's import lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit("")), "\r\n|\r|\n"), F.trim), lambda x: x.startswith("import ") | x.startswith("from "))
    return identifier_terms(F.array_join(lines, "\n"))


def sample_query(code: Column | str, lines: int = 12, limit: int = 96) -> Column:
    """The query of a piece of code: identifier words of its last lines, the last line first, then of its imports; at most ``limit``."""
    c = F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit(""))
    full = F.filter(F.split(c, "\r\n|\r|\n"), lambda x: F.trim(x) != "")
    last = F.reverse(F.slice(full, F.greatest(F.lit(1), F.size(full) - (lines - 1)), F.lit(lines)))
    words = F.flatten(F.transform(last, identifier_terms))
    return F.array_join(F.slice(F.array_distinct(F.concat(words, import_terms(c))), F.lit(1), F.lit(limit)), " ")


def safe_path(c: Column | str, fallback: Column | str) -> Column:
    """A relative path without ``.`` and ``..``; a missing one is the fallback; one without a suffix becomes Python."""
    c, fallback = (F.col(x) if isinstance(x, str) else x for x in (c, fallback))
    parts = lambda x: F.filter(F.split(F.translate(x, "\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    own = F.array_join(parts(F.coalesce(c, F.lit(""))), "/")
    path = F.when(own != "", own).otherwise(fallback)
    return F.when(F.substring_index(path, "/", -1).rlike(r"[^.]\.[^.]+$"), path).otherwise(F.concat(path, F.lit(".py")))


def sample_candidates(samples: DataFrame) -> DataFrame:
    """(idx, order, path, gold, identifier, snippet) of samples (idx, context: array<struct<identifier, path, snippet>>, gold_snippet_index).

    A path that an earlier candidate of the sample has gets the candidate's number, ``stem__ctx3.py``. Samples without candidates, or whose gold lies outside, give nothing; see ``skipped_samples``.
    """
    valid = samples.filter(F.coalesce((F.size("context") > 0) & F.col("gold_snippet_index").between(0, F.size("context") - 1), F.lit(False)))
    each = valid.select("idx", "gold_snippet_index", F.posexplode("context").alias("order", "c")).withColumn("path", safe_path(F.col("c.path"), F.concat(F.lit("context_"), F.col("order").cast("string"), F.lit(".py"))))
    again = F.row_number().over(Window.partitionBy("idx", "path").orderBy("order")) > 1
    numbered = F.regexp_replace("path", r"(\.[^./]*)$", F.concat(F.lit("__ctx"), F.col("order").cast("string"), F.lit("$1")))
    rows = each.withColumn("again", again)
    return rows.select("idx", "order", F.when(F.col("again"), numbered).otherwise(F.col("path")).alias("path"), (F.col("order") == F.col("gold_snippet_index")).alias("gold"), F.coalesce("c.identifier", F.lit("")).alias("identifier"), F.coalesce("c.snippet", F.lit("")).alias("snippet"))


def skipped_samples(samples: DataFrame) -> DataFrame:
    """(idx, reason) of samples that cannot be evaluated."""
    reason = F.when(F.coalesce(F.size("context"), F.lit(0)) <= 0, "no context list").when(~F.coalesce(F.col("gold_snippet_index").between(0, F.size("context") - 1), F.lit(False)), "gold_snippet_index is outside context list")
    return samples.select("idx", reason.alias("reason")).filter("reason is not null")


def rerank(candidates: DataFrame) -> DataFrame:
    """(qid, id, score, rank): candidates (qid, id, position, query_terms, name_terms, path_terms, body_terms[, import_terms]) by overlap with the query's words.

    Weights for a shared word of the query: 8 in the name, 6 in the path, 1 in the body, and 4, 3, 0.35 more times 1 - k / 40 for the k-th of its first 32 words; for a word of
    the imports: 12 in the path, 10 in the name, 0.75 in the body; and up to 9 for an early place in retrieval (position counts from 1; null: not retrieved). Scores of 0 or less are dropped.
    """
    if "import_terms" not in candidates.columns:
        candidates = candidates.withColumn("import_terms", F.array().cast("array<string>"))
    over = lambda a, c: F.size(F.array_intersect(a, c))
    first = F.slice("query_terms", F.lit(1), F.lit(32))
    fade = lambda w: 1.0 - (F.array_position(first, w) - 1) / 40.0
    faded = lambda c: F.aggregate(F.array_intersect(first, F.col(c)), F.lit(0.0), lambda s, w: s + fade(w))
    score = (
        over("query_terms", "name_terms") * 8.0 + over("query_terms", "path_terms") * 6.0 + over("query_terms", "body_terms") * 1.0 + over("import_terms", "path_terms") * 12.0 + over("import_terms", "name_terms") * 10.0
        + over("import_terms", "body_terms") * 0.75 + faded("name_terms") * 4.0 + faded("path_terms") * 3.0 + faded("body_terms") * 0.35 + F.coalesce(F.greatest(F.lit(0), 13 - F.col("position")) * 0.75, F.lit(0.0))
    )
    scored = candidates.withColumn("score", F.round(score, 6)).filter("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("position").asc_nulls_last(), "id"))).select("qid", "id", "score", "rank")


def hit_rates(ranks: DataFrame, *groups: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hit@k and mean reciprocal rank of (groups, rank); a null rank is a miss. Several groups: one row for each grouping set, in one pass."""
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    aggs = [F.count("*").alias("n_queries"), *map(at, ks), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")]
    if not groups:
        return ranks.agg(*aggs)
    sets = [[F.col(g)] for g in groups] + [[]]
    return ranks.groupingSets(sets, *[F.col(g) for g in groups]).agg(*aggs)


def size_bucket(c: Column) -> Column:
    return F.when(c < 5, "<5").when(c < 10, "5-9").otherwise(">=10")


def timing_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: count, min, median, mean, p95 (the value at the rounded place 0.95 (n - 1), halves to even) and max, all exact.

    A few groups may hold everything, and a few outliers may lie far off, so values are counted, sorted by (group, value) over ranges of equal size and written
    once; a prefix sum over the files tells which file holds each wanted place, and only those files' rows are numbered.
    """
    v = samples.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    counts = v.groupBy(group, "v").agg(F.count("*").alias("c"))  # equal values travel as one row
    rows = stored(counts.repartitionByRange(parts, group, "v").sortWithinPartitions(group, "v"), "timings").select("*", F.col("_metadata.file_path").alias("file"))
    files = rows.groupBy(group, "file").agg(F.sum("c").alias("size"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v") * F.col("c")).alias("total"))
    in_order = Window.partitionBy(group).orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    stats = files.groupBy(group).agg(F.sum("size").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), (F.sum("total") / F.sum("size")).alias("mean"))
    low, high, p95 = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2), F.bround((F.col("n") - 1) * 0.95, 0)
    holds = lambda place, base, size: (base <= place) & (place < base + size)
    wanted = files.select(group, "file", "base", "size").join(stats, group).filter(reduce(Column.__or__, [holds(p, F.col("base"), F.col("size")) for p in (low, high, p95)])).drop("size")
    near = rows.join(wanted, [group, "file"])
    at = F.coalesce(F.sum("c").over(Window.partitionBy(group, "file").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base")
    placed = near.withColumn("at", at)
    pick = lambda place: F.max(F.when(holds(place, F.col("at"), F.col("c")), F.col("v")))
    return placed.groupBy(group).agg(
        F.max("n").alias("n"), F.round(F.max("least"), 6).alias("min_v"), F.round((pick(low) + pick(high)) / 2, 6).alias("p50"), F.round(F.max("mean"), 4).alias("mean_v"),
        F.round(pick(p95), 6).alias("p95"), F.round(F.max("most"), 6).alias("max_v"),
    )


def timing_sanity(summaries: DataFrame, group: str) -> DataFrame:
    """(group, check, passed) of timing summaries: everything is there, the count is positive, and min, median, p95 and max are in order."""
    cols = ["n", "min_v", "p50", "mean_v", "p95", "max_v"]
    checks = {
        "present": reduce(Column.__and__, [F.col(c).isNotNull() for c in cols]), "counted": F.col("n") > 0,
        "ordered": (F.col("min_v") <= F.col("p50")) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("max_v")), "mean_within": F.col("mean_v").between(F.col("min_v") - 1e-4, F.col("max_v") + 1e-4),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()]))
    return summaries.select(group, each.alias("x")).select(group, "x.check", "x.passed")


def compare_metrics(current: DataFrame, baseline: DataFrame, directions: DataFrame) -> DataFrame:
    """(metric, current, baseline, verdict) of (metric, value): ok, regression, missing, or not_a_number for a value that is there but is none.

    directions: (metric, direction[, expected]) with lower, higher, invariant (equal to the expected value, else to the baseline) or floor (at least that).
    Values may be texts. Lower and higher ask for a strictly better value.
    """
    if "expected" not in directions.columns:
        directions = directions.withColumn("expected", F.lit(None).cast("double"))
    of = lambda df, name: df.select("metric", F.col("value").cast("string").alias(f"{name}_text"), F.expr("try_cast(value as double)").alias(name))
    j = directions.join(of(current, "current"), "metric", "left").join(of(baseline, "baseline"), "metric", "left")
    goal = F.coalesce(F.col("expected"), F.col("baseline"))
    good = F.when(F.col("direction") == "lower", F.col("current") < F.col("baseline")).when(F.col("direction") == "higher", F.col("current") > F.col("baseline")).when(F.col("direction") == "invariant", F.col("current") == goal).when(F.col("direction") == "floor", F.col("current") >= goal)
    fixed = F.col("direction").isin("invariant", "floor") & F.col("expected").isNotNull()
    absent = F.col("current_text").isNull() | (F.col("baseline_text").isNull() & ~fixed)
    none = F.col("current").isNull() | F.isnan("current") | ((F.col("baseline").isNull() | F.isnan("baseline")) & ~fixed)
    verdict = F.when(absent, "missing").when(none, "not_a_number").when(good, "ok").otherwise("regression")
    return j.select("metric", "current", "baseline", verdict.alias("verdict"))


def compare_parameters(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(name, current, baseline, change) of (name, value) that differ: added, removed or changed."""
    j = current.select("name", F.col("value").alias("current"), F.lit(True).alias("_c")).join(baseline.select("name", F.col("value").alias("baseline"), F.lit(True).alias("_b")), "name", "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "removed").otherwise("changed")
    return j.filter(~F.col("current").eqNullSafe(F.col("baseline")) | F.col("_b").isNull() | F.col("_c").isNull()).select("name", "current", "baseline", change.alias("change"))


def request_counters(events: DataFrame) -> DataFrame:
    """(event_type, day, n_events, n_users, total) of a log."""
    return events.groupBy("event_type", F.substring(F.col("ts").cast("string"), 1, 10).alias("day")).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))


#: Parts of names whose values must not be shown.
SECRET = r"(?i)(password|passwd|secret|token|key|authorization|cookie|credential)"
_SECRET_FIELD = r'(?i)("[^"\\]*(?:password|passwd|secret|token|key|authorization|cookie|credential)[^"\\]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^\s",{}\[\]]+)'


def redact_values(c: Column) -> Column:
    """A map with the values of telling keys replaced."""
    return F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET), F.lit("[REDACTED]")).otherwise(v))


def redact_json(c: Column) -> Column:
    """A JSON text with the single values of telling fields replaced, at any depth; lists and objects below such a field are searched in turn."""
    return F.regexp_replace(c, _SECRET_FIELD, '$1"[REDACTED]"')
