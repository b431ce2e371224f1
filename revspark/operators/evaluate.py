"""Evaluation M1-M3: confusion counts, precision / recall / F1, throughput.

Cases and findings are DataFrames; findings are counted per (case, rule)
with partial aggregation, left-joined to the cases, and the per-case
confusion contribution is summed in one global aggregate (one row out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """M1.  cases(case_id, rule_id, expected); findings(case_id, rule_id).

    Only findings of the case's own rule count.  expected>0: TP += min,
    FP += surplus, FN += expected when nothing was found (a partial hit adds
    no FN); expected=0: FP += actual, else TN += 1.
    """
    actual = findings.groupBy("case_id", "rule_id").agg(F.count(F.lit(1)).alias("actual"))
    j = cases.join(actual, ["case_id", "rule_id"], "left").withColumn(
        "actual", F.coalesce(F.col("actual"), F.lit(0)))
    e, a = F.col("expected"), F.col("actual")
    per_case = j.select(
        F.when((e > 0) & (a > 0), F.least(e, a)).otherwise(0).alias("tp"),
        F.when((e > 0) & (a > e), a - e).when((e <= 0) & (a > 0), a).otherwise(0).alias("fp"),
        F.when((e > 0) & (a == 0), e).otherwise(0).alias("fn"),
        F.when((e <= 0) & (a == 0), 1).otherwise(0).alias("tn"),
    )
    return per_case.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])


def scores(conf: DataFrame) -> DataFrame:
    """M2: precision / recall / F1 in percent; empty denominators give 100, 100, 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p = F.when(tp + fp == 0, F.lit(100.0)).otherwise(tp * 100.0 / (tp + fp))
    r = F.when(tp + fn == 0, F.lit(100.0)).otherwise(tp * 100.0 / (tp + fn))
    out = conf.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).select(
        "tp", "fp", "fn", "tn",
        F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"),
        F.round("f1", 4).alias("f1"),
    )


def throughput(n_files: int, seconds: float) -> dict:
    """M3: files per second and mean milliseconds per file of a measured run."""
    return {
        "files": n_files,
        "seconds": seconds,
        "files_per_sec": (n_files / seconds) if seconds > 0 else 0.0,
        "ms_per_file": (seconds * 1000.0 / n_files) if n_files else 0.0,
    }
