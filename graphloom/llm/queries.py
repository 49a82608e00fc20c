"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.docpairs import documented_pairs
from graphloom.llm.frequent import frequent_values, top_values
from graphloom.llm.handwritten import classify_files
from graphloom.llm.leakage import leaked_items
from graphloom.llm.pii import personal_information, redacted
from graphloom.llm.tokenize import encode
from graphloom.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = frequent_values(table(spark, d, "edges"), "detail").unionByName(frequent_values(table(spark, d, "nodes"), "qname"))
    return found.select("item_field", "item_value")


def p4_top_values(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most frequent values of either column: the report itself is a top k."""
    return top_values(table(spark, d, "edges"), "detail", 100).unionByName(top_values(table(spark, d, "nodes"), "qname", 100))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_pairs(table(spark, d, "nodes"), table(spark, d, "file_texts"), with_code=False).select("node_id")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented_pairs(table(spark, d, "nodes"), table(spark, d, "file_texts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return classify_files(table(spark, d, "files"), table(spark, d, "file_texts")).select("repo_id", "path")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody wrote by hand, by repo and class."""
    return classify_files(table(spark, d, "files"), table(spark, d, "file_texts")).groupBy("repo_id", "file_class").agg(F.count("*").alias("n_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(table(spark, d, "documents"), table(spark, d, "name_list")).select("doc_id", "pii_kind", "start_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(table(spark, d, "documents"), table(spark, d, "name_list"))


W = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(8239) || chr(12288) || chr(65279)"
_VALUES = f"""
with v as (
  select 'detail' item_field, trim(detail, {W}) item_value from edges union all select 'qname', trim(qname, {W}) from nodes),
c as (select item_field, item_value, count(*) n_rows from v where item_value <> '' group by all)
"""

QUERIES = {
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_top_values": p4_top_values,
    "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_redacted": p8_redacted,
}
ORACLE = {
    "p4_found": _VALUES + "select item_field, item_value from c where n_rows >= 0.005 * (select sum(n_rows) from c x where x.item_field = c.item_field)",
    "p4_top_values": _VALUES + "select * from (select *, row_number() over (partition by item_field order by n_rows desc, item_value) r from c) where r <= 100",
}
ORACLE["p4_top_values"] = ORACLE["p4_top_values"].replace("select * from (select", "select item_field, item_value, n_rows from (select")
