"""Relational stand-ins for the review store (FIXTURES.md B3).

The driver's TPC-H-like tables play the stored tables: ``orders`` are review
runs, ``lineitem`` rows are stored findings, ``labels`` joined to
``documents`` are evaluation cases.  All are projections (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.sources.tables import table


def reviews_from_orders(orders: DataFrame) -> DataFrame:
    """reviews(id, repo_name, pr_number, commit_sha, analyzed_at, status)."""
    return orders.select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.concat(F.lit("o/r"), F.col("o_custkey").cast("string")).alias("repo_name"),
        F.col("o_orderkey").cast("int").alias("pr_number"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit_sha"),
        F.col("o_orderdate").alias("analyzed_at"),
        F.col("o_orderstatus").alias("status"),
    )


def findings_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """review_findings(review_id, rule_id, severity, file_path, line_number, ...)."""
    return lineitem.select(
        F.col("l_orderkey").cast("long").alias("review_id"),
        F.concat(F.lit("RULE-00"), (1 + F.col("l_partkey") % 7).cast("string")).alias("rule_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("ERROR")).otherwise(F.lit("WARNING")).alias("severity"),
        F.concat(F.lit("src/P"), F.col("l_partkey").cast("string"), F.lit(".java")).alias("file_path"),
        F.col("l_linenumber").cast("int").alias("line_number"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_from_orders(table(spark, sf_dir, "orders"))


def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_from_lineitem(table(spark, sf_dir, "lineitem"))


def pull_request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, file): one file per line item; every third is no source file."""
    ext = F.element_at(F.array(F.lit(".java"), F.lit(".md"), F.lit(".py")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("review_id"),
        F.concat(F.lit("src/P"), F.col("l_partkey").cast("string"), ext).alias("file"))


# SQL twins for the oracle (same mappings).
REVIEWS_SQL = """SELECT CAST(o_orderkey AS BIGINT) AS id, 'o/r' || CAST(o_custkey AS VARCHAR) AS repo_name,
  CAST(o_orderkey AS INTEGER) AS pr_number, sha256(CAST(o_orderkey AS VARCHAR)) AS commit_sha,
  o_orderdate AS analyzed_at, o_orderstatus AS status FROM orders"""
FINDINGS_SQL = """SELECT CAST(l_orderkey AS BIGINT) AS review_id, 'RULE-00' || CAST(1 + l_partkey % 7 AS VARCHAR) AS rule_id,
  CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'WARNING' END AS severity,
  'src/P' || CAST(l_partkey AS VARCHAR) || '.java' AS file_path, CAST(l_linenumber AS INTEGER) AS line_number
  FROM lineitem"""
PR_FILES_SQL = """SELECT CAST(l_orderkey AS BIGINT) AS review_id,
  'src/P' || CAST(l_partkey AS VARCHAR) || ['.java', '.md', '.py'][l_partkey % 3 + 1] AS file FROM lineitem"""
