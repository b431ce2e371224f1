"""Sinks K1 (persist findings / reviews / files) and K2 (review status).

Texts are stored whole, with a flag where they exceed the reference's column
limits.  Rows get dense, deterministic ids without a global single-task window:
range-partition and sort by the key, take each row's place in its partition, and add
the running total of the per-partition counts (a table with one row per
partition, so its broadcast is bounded by the partition count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revspark.session import ensure_checkpoint_dir

# Column length limits of the stored findings table.
LIMITS = {"code_snippet": 2000, "message": 1000, "rationale": 2000, "fix_suggestion": 3000}


def with_row_ids(df: DataFrame, order_cols: list[str], id_col: str = "id", partitions: int | None = None,
                 after: int = 0) -> DataFrame:
    """Dense ids in the order of ``order_cols``, from ``after`` + 1 on."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
        .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
        .checkpoint(eager=True)  # fixes partitions and places; survives executor loss
    )
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = placed.join(F.broadcast(counts.select("_pid", (before - F.col("_first") + 1).alias("_shift"))), "_pid")
    return out.withColumn(id_col, (F.col("_mid") + F.col("_shift") + after).cast("long")).drop("_pid", "_mid", "_shift")


def flag_overflow(df: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Flag texts longer than the reference table's columns; the text itself is stored whole."""
    for c, n in limits.items():
        if c in df.columns:
            df = df.withColumn(f"{c}_overflow", F.coalesce(F.length(c) > n, F.lit(False)))
    return df


def last_id(spark, path: str, id_col: str = "id") -> int:
    """Largest id of the stored table; 0 if nothing is stored yet."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    return stored.agg(F.max(id_col)).first()[0] or 0


def persist_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """K1: append review_findings rows as Parquet partitioned by rule."""
    findings.write.mode(mode).partitionBy("rule_id").parquet(path)


def review_status(reviews: DataFrame, files: DataFrame, review_key: str = "id") -> DataFrame:
    """K2: SUCCESS, or NO_CODE_FILES when a review has no supported file."""
    n = files.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_files"))
    j = reviews.join(n, reviews[review_key] == n["review_id"], "left")
    return j.select(
        reviews[review_key].alias("review_id"),
        F.coalesce(F.col("n_files"), F.lit(0)).cast("long").alias("n_files"),
        F.when(F.coalesce(F.col("n_files"), F.lit(0)) == 0, F.lit("NO_CODE_FILES"))
        .otherwise(F.lit("SUCCESS")).alias("status"),
    )
