import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")

from graphloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, spark__sql__shuffle__partitions="4")
    yield s
    s.stop()


NODES = "id string, repo_id string, owner_path string, kind string, name string, qname string, path string, start_line int, end_line int, signature string, doc string, confidence string, content_hash string, extra struct<imports: array<struct<module: string, name: string, alias: string>>, language: string>, loaded_at timestamp_ntz"
EDGES = "repo_id string, owner_path string, src string, dst string, kind string, confidence string, detail string, loaded_at timestamp_ntz"
FILES = "repo_id string, path string, abspath string, language string, size long, mtime double, content_hash string, generated boolean, indexed_at double"
TOMBS = "node_id string, repo_id string, removed_at timestamp_ntz"


@pytest.fixture
def make(spark):
    """make(schema, [dict, ...]): a frame of the given rows, missing columns null."""

    def build(schema, rows):
        from pyspark.sql.types import _parse_datatype_string

        t = _parse_datatype_string(schema)
        return spark.createDataFrame([tuple(r.get(f.name) for f in t.fields) for r in rows], t)

    return build
