"""History queries Q1-Q6 over the review store.

The reference issues one findings query per review (N+1); here every query
is one set-based plan: aggregate the findings by review (partial aggregation
before the shuffle), then join the reviews once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rule list reported by the status endpoint (Q5).
STATUS_RULES = [
    "RULE-001-RESOURCE-LEAK",
    "RULE-002-NULL-SAFETY",
    "RULE-003-CONCURRENCY",
    "RULE-004-NPLUSONE-QUERY",
]


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
    )


def review_history(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Q1: every review with its finding and error counts (zeros kept), id desc."""
    counts = finding_counts(findings)
    return (
        reviews.join(counts, reviews["id"] == counts["review_id"], "left")
        .select(
            reviews["id"], "repo_name", "pr_number", "commit_sha", "analyzed_at", "status",
            F.coalesce(F.col("finding_count"), F.lit(0)).cast("long").alias("finding_count"),
            F.coalesce(F.col("error_count"), F.lit(0)).cast("long").alias("error_count"),
        )
        .orderBy(F.col("id").desc())
    )


def findings_of_review(reviews: DataFrame, findings: DataFrame, review_id: int | None = None) -> DataFrame:
    """Q2: findings of existing reviews (one review when ``review_id`` is given)."""
    if review_id is not None:
        reviews = reviews.filter(F.col("id") == review_id)
        findings = findings.filter(F.col("review_id") == review_id)
    return findings.join(reviews.select(F.col("id").alias("review_id")), "review_id", "left_semi")


def files_of_review(reviews: DataFrame, files: DataFrame, review_id: int | None = None) -> DataFrame:
    """Q3: file paths of existing reviews; never touches ``content``."""
    if review_id is not None:
        reviews = reviews.filter(F.col("id") == review_id)
        files = files.filter(F.col("review_id") == review_id)
    return files.select("review_id", "file_path").join(
        reviews.select(F.col("id").alias("review_id")), "review_id", "left_semi")


def file_content(files: DataFrame, review_id: int | None = None, file_path: str | None = None) -> DataFrame:
    """Q4: (review, path) -> content; at most one answer, copies flagged.

    The reference returns an Optional from a derived finder; with duplicate
    rows it would fail.  We return the smallest content and ``n_copies``.
    Which keys have several rows is decided on the keys alone, so only their
    texts are grouped; all others stay where they are while those keys are few
    enough for Spark to broadcast by size.
    """
    if review_id is not None:
        files = files.filter(F.col("review_id") == review_id)
    if file_path is not None:
        files = files.filter(F.col("file_path") == file_path)
    # a struct is never null, so null keys meet like others
    rows = files.select(F.struct("review_id", "file_path").alias("k"), "content")
    many = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    single = rows.join(many, "k", "left_anti").select("k", "content", F.lit(1).cast("long").alias("n_copies"))
    several = rows.join(many, "k", "left_semi").groupBy("k").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_copies"))
    return single.unionByName(several).select("k.*", "content", "n_copies", (F.col("n_copies") > 1).alias("duplicated"))


def status_totals(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Q5: one row with the two store counts and the listed rules."""
    marks = reviews.select(F.lit(1).alias("r"), F.lit(0).alias("f")).unionByName(
        findings.select(F.lit(0).alias("r"), F.lit(1).alias("f")))
    return marks.agg(
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("total_reviews"),
        F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("total_findings"),
    ).withColumn("rules", F.lit(",".join(STATUS_RULES)))


def dashboard_totals(history: DataFrame) -> DataFrame:
    """Q6: sums over Q1."""
    return history.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.coalesce(F.sum("finding_count"), F.lit(0)).cast("long").alias("findings"),
        F.coalesce(F.sum("error_count"), F.lit(0)).cast("long").alias("errors"),
    )
