"""Source trees: paths are listed once on the driver (names only), contents are read and hashed by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as a source.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".md": "markdown", ".mdx": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}
#: Folders that are not entered unless a caller says otherwise.
SKIPPED = frozenset({"node_modules", "dist", "build", "venv", "__pycache__", "coverage"})


def list_sources(spark: SparkSession, root: str, repo_id: str, skipped: frozenset[str] = SKIPPED) -> DataFrame:
    """(repo_id, path, abspath, language, size, mtime): the sources below root. Spark's file sources would miss names that begin with ``_`` or ``.``."""
    rows = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(x for x in dirs if x not in skipped and not x.startswith("."))
        for n in sorted(names):
            language = LANGUAGES.get(os.path.splitext(n)[1].lower())
            if language:
                p = os.path.join(folder, n)
                s = os.stat(p)
                rows.append((repo_id, os.path.relpath(p, root).replace(os.sep, "/"), p, language, s.st_size, s.st_mtime))
    return spark.createDataFrame(rows, "repo_id string, path string, abspath string, language string, size long, mtime double")


def probably_generated(path: Column | str, size: Column | str) -> Column:
    """Minified, bundled, locked, called generated, or above a million bytes."""
    name = F.lower(F.substring_index(path, "/", -1))
    return name.rlike(r"\.(min|bundle)\.js$|generated|\.lock$") | (F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)) > 1_000_000)


def read_sources(listed: DataFrame) -> DataFrame:
    """The listing with content_hash (sha1 of the bytes) and text (UTF-8, bad bytes replaced); files that cannot be read are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for p in b["abspath"]:
                try:
                    with open(p, "rb") as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            b = b.assign(content=data)
            yield b[b["content"].notna()]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields) + ", content binary"
    raw = listed.mapInPandas(run, schema)
    return raw.select(*listed.columns, F.sha1("content").alias("content_hash"), F.expr("validate_utf8(make_valid_utf8(cast(content as string)))").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one a line; blank lines are skipped, what is no object comes back in ``bad_line``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, bad_line string", {"columnNameOfCorruptRecord": "bad_line", "mode": "PERMISSIVE"}).alias("r"), "value")
    return parsed.select("r.*", "value").withColumn("bad_line", F.when(~F.trim("value").startswith("{"), F.col("value")).otherwise(F.col("bad_line"))).drop("value")
