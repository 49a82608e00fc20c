"""Pieces of the DuckDB statements that the queries are checked against."""

QUERIES: dict = {}
ORACLE: dict = {}

W = r"' \t\n\r' || chr(11) || chr(12) || chr(160) || chr(12288) || chr(65279)".replace(r"\t", "' || chr(9) || '").replace(r"\n", "' || chr(10) || '").replace(r"\r", "' || chr(13) || '")


def sql_id(c: str) -> str:
    return f"nullif(lower(trim({c}, {W})), '')"


def sql_path(c: str) -> str:
    return f"case when trim({c}, {W}) <> '' then regexp_replace(replace({c}, chr(92), '/'), '^(\\./)+', '') end"


def sql_kind(c: str) -> str:
    return f"nullif(upper(trim({c}, {W})), '')"


def sql_terms(c: str) -> str:
    """The words of a text: runs of letters or digits of any script, in lower case and without marks."""
    return f"list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*'), lambda x: strip_accents(x))"


#: Valid nodes n, edges e, files f and repos r, each once.
BASE = f"""
with n as (select * from (select *, row_number() over (partition by id order by loaded_at desc nulls last, doc desc nulls last, signature desc nulls last, content_hash desc nulls last) rn from (
  select {sql_id("id")} id, repo_id, {sql_path("owner_path")} owner_path, {sql_kind("kind")} kind, name, qname, {sql_path("path")} path, greatest(1, coalesce(start_line, 0)) start_line,
    greatest(1, coalesce(start_line, 0), coalesce(end_line, 0)) end_line, signature, doc, confidence, content_hash, extra, loaded_at from nodes) where id is not null) where rn = 1),
e as (select * from (select *, row_number() over (partition by repo_id, owner_path, src, dst, kind, detail order by loaded_at desc nulls last, confidence desc nulls last) rn from (
  select repo_id, {sql_path("owner_path")} owner_path, {sql_id("src")} src, {sql_id("dst")} dst, {sql_kind("kind")} kind, coalesce(nullif(trim(detail, {W}), ''), '') detail, confidence, loaded_at from edges)
  where src is not null and dst is not null) where rn = 1),
f as (select * from (select * exclude (path), {sql_path("path")} path, row_number() over (partition by repo_id, {sql_path("path")} order by indexed_at desc nulls last, content_hash desc nulls last, size desc nulls last, mtime desc nulls last) rn from files) where rn = 1 and path is not null),
r as (select * from (select *, row_number() over (partition by id order by indexed_at desc nulls last, name desc nulls last, root desc nulls last) rn from repos) where rn = 1)
"""

EXTERNAL = "('EXTERNALSYMBOL', 'EXTERNALDEPENDENCY')"
