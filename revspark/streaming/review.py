"""W4 continuous review and W5 live history on Structured Streaming.

W4: webhook deliveries stream -> W1 intake -> triggered PRs ->
``foreachBatch``: read the PR's files and diff, stored by bucket of their review
(``store_by_review``) so that a batch opens the buckets of its own reviews only -> rules (D3) -> diff scope
(D2) -> enrichment (E1) -> reviews, files, findings and documents (K1, E3, E4).
The outputs of a micro-batch become visible together with its commit
(``batch_tables``); a replayed batch replaces its own output: exactly-once
effect on top of the checkpointed source offsets.  Reviews are keyed by
(repo, pr, sha); deliveries that repeat one, in the same batch or a later
one, add nothing.

W5: a streaming aggregate of stored findings per review in ``update`` mode;
each trigger writes the counts of the reviews that changed, readers merge
them and join the reviews (a review without findings counts 0).
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.functions.text import is_supported
from revspark.operators import diffs as DF
from revspark.operators import enrich as EN
from revspark.plans import review as RV
from revspark.session import cut_lineage, scratch_table_dir, together
from revspark.streaming.batch_tables import BatchTables, compact
from revspark.streaming.intake import intake


KEYS = ["repo_name", "pr_number", "commit_sha", "review_id"]
#: Folders that the files and diffs of W4 are stored in.
BUCKETS = 128
OUTPUTS = ("reviews", "files", "findings", "documents")


def review_batch(prs: DataFrame, files: DataFrame, diffs: DataFrame | None) -> dict[str, DataFrame]:
    """The four outputs of reviewing ``prs`` (KEYS, one row per review).

    files: the changed files of supported kinds.  findings: rules on these
    files, scoped to the changed lines, enriched.  reviews: one row per PR with
    its counts; without any supported file the status is NO_CODE_FILES and no
    rule runs.  documents: summary and request body."""
    ids = prs.select("review_id").distinct()
    code = files.join(ids, "review_id", "left_semi").filter(is_supported(F.col("file")))
    changed = None
    if diffs is not None:
        d = diffs.join(ids, "review_id", "left_semi")
        named = DF.changed_files(d.select(F.col("review_id").alias("diff_id"), "diff_text")).select(F.col("diff_id").alias("review_id"), "file").distinct()
        code = code.join(named, ["review_id", "file"], "left_semi")
        changed = lambda: DF.changed_lines(d, keys=("diff_id", "review_id")).select("review_id", "file", "line")
    code = cut_lineage(code).hint("merge")
    # the diffs are parsed while the rules run
    found, changed = together([lambda: RV.run_rules(code), lambda: changed and cut_lineage(changed())])
    if changed is not None:
        found = DF.scope_to_diff(found, changed)
    # read by three outputs
    found = cut_lineage(EN.enrich(found)).hint("merge")
    n_files = code.groupBy("review_id").agg(F.count(F.lit(1)).alias("file_count"))
    n_found = found.groupBy("review_id").agg(F.count(F.lit(1)).alias("finding_count"))
    reviews = prs.join(n_files, "review_id", "left").join(n_found, "review_id", "left").fillna(0, ["file_count", "finding_count"]) \
        .withColumn("status", F.when(F.col("file_count") == 0, "NO_CODE_FILES").otherwise("SUCCESS"))
    # a document belongs to one PR and commit; its texts are made once per review, also where many touch the same review
    summary = EN.review_summary(ids, found)
    texts = summary.hint("merge").join(EN.comment_texts(found), "review_id", "left")
    documents = prs.join(texts.hint("merge"), "review_id", "left") \
        .withColumn("summary", F.coalesce("summary", F.lit(EN.REPORT_HEADER + EN.REPORT_EMPTY))).select(*KEYS, "summary", EN.request_body().alias("request_json"))
    return {"reviews": reviews, "files": prs.join(code.select("review_id", "file"), "review_id"),
            "findings": prs.join(found, "review_id"), "documents": documents}


def _bucket() -> Column:
    return F.pmod(F.xxhash64("review_id"), F.lit(BUCKETS)).cast("int")


def store_by_review(df: DataFrame, path: str) -> str:
    """Writes a table with a review_id as folders of BUCKETS buckets; returns the path.

    Rows are dealt out by (bucket, row digest), so a review with a third of
    all rows is many files of its bucket."""
    rows = df.withColumn("bucket", _bucket())
    rows.repartitionByRange("bucket", F.xxhash64(*df.columns)).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path


def of_reviews(spark: SparkSession, source: DataFrame | str, buckets: list[int]) -> DataFrame:
    """The table, of a stored one the given buckets only: the others are never opened."""
    if not isinstance(source, str):
        return source
    return spark.read.parquet(source).filter(F.col("bucket").isin(buckets)).drop("bucket")


def continuous_review(spark: SparkSession, webhook_stream: DataFrame, files: DataFrame | str, diffs: DataFrame | str | None,
                      secret: str, out_dir: str, checkpoint: str, pr_to_review, trigger: dict | None = None) -> None:
    """Run W4 until the source is drained (or by ``trigger``, arguments of the stream's trigger).

    files and diffs: tables, or paths of ``store_by_review``."""
    trig = intake(webhook_stream, secret).filter("triggered")
    trig = trig.withColumn("review_id", pr_to_review(F.col("pr_number")))

    def run(batch: DataFrame, batch_id: int) -> None:
        prs = batch.select(*KEYS).dropDuplicates(KEYS[:3])
        tables = BatchTables(spark, out_dir, batch_id)
        known = tables.read("reviews")
        if known is not None:
            prs = prs.join(known.select(*KEYS[:3]), KEYS[:3], "left_anti")
        # written once: the signatures are checked once per batch
        prs = cut_lineage(prs)
        # at most BUCKETS numbers
        buckets = [r.bucket for r in prs.select(_bucket().alias("bucket")).distinct().collect()]
        own = [None if t is None else of_reviews(spark, t, buckets) for t in (files, diffs)]
        together([partial(tables.write, name, out, batch_id) for name, out in review_batch(prs, *own).items()])
        tables.commit(batch_id)

    q = (trig.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()


def read_output(spark: SparkSession, out_dir: str, name: str) -> DataFrame | None:
    """One of OUTPUTS, all committed batches; None before the first commit."""
    return BatchTables(spark, out_dir).read(name)


def live_history(spark: SparkSession, findings_stream: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None) -> None:
    """Counts per review over the stored-findings stream, update mode.

    A trigger writes one row per review that got findings.  ``trigger``:
    arguments of the stream's trigger (default: until the source is drained)."""
    agg = findings_stream.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(F.col("severity") == "ERROR").alias("error_count"))

    def run(batch: DataFrame, batch_id: int) -> None:
        tables = BatchTables(spark, out_dir, batch_id)
        tables.write("counts", batch, batch_id)
        base = tables.compacts(batch_id)
        if base:
            compact(tables, "counts", ["review_id"], batch_id)
        tables.commit(batch_id, base=base)

    q = (agg.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()


def read_history(spark: SparkSession, out_dir: str, reviews: DataFrame) -> DataFrame:
    """Every review with its counts as of the latest commit; 0 without findings."""
    rows = reviews.select(F.col("id").alias("review_id"), "repo_name", "pr_number", "commit_sha", "analyzed_at")
    counts = BatchTables(spark, out_dir).latest("counts", ["review_id"])
    if counts is None:
        return rows.withColumns({"finding_count": F.lit(0).cast("long"), "error_count": F.lit(0).cast("long")})
    return rows.join(counts, "review_id", "left").fillna(0, ["finding_count", "error_count"])


def fresh_dir(spark: SparkSession, name: str) -> str:
    return scratch_table_dir(spark, f"{name}_{uuid.uuid4().hex}")
