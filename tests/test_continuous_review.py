"""W4 over several micro-batches: redelivered reviews add nothing."""
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from revspark.streaming import review as WR

SECRET = "s"


def delivery(k, pr, sha):
    body = json.dumps({"action": "opened", "number": pr, "repository": {"full_name": "o/r"}, "pull_request": {"head": {"sha": sha}}})
    # a repeated key: the last value counts
    body = body.replace('{"action": "opened"', '{"action": "closed", "action": "opened"')
    return (k, body, "sha256=" + hmac.new(SECRET.encode(), body.encode(), hashlib.sha256).hexdigest(), "pull_request")


def test_redelivery_and_reviews_without_code(spark, tmp_path):
    schema = "event_id long, payload string, signature string, event string"
    files = spark.createDataFrame([(1, "src/a.py", "f = open('x')\nf.read()\n"), (1, "notes.md", "f = open('x')"), (2, "src/b.py", "x = 1\n"), (3, "c.md", "text")],
                                  "review_id long, file string, content string")
    diff = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1,2 @@\n+one\n+two"
    diffs = spark.createDataFrame([(k, r, diff.format(f)) for k, (r, f) in enumerate([(1, "src/a.py"), (2, "src/b.py"), (3, "c.md")])],
                                  "diff_id long, review_id long, diff_text string")
    out, check, src = f"{tmp_path}/out", f"{tmp_path}/ck", f"{tmp_path}/in"
    batches = [[delivery(1, 1, "s1"), delivery(2, 1, "s1"), delivery(3, 2, "s2")], [delivery(4, 1, "s1"), delivery(5, 3, "s3")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        WR.continuous_review(spark, spark.readStream.schema(schema).parquet(src), files, diffs, SECRET, out, check, lambda pr: pr.cast("long"))
    reviews = WR.read_output(spark, out, "reviews")
    got = {(r.pr_number, r.status, r.file_count, r.finding_count) for r in reviews.collect()}
    assert got == {(1, "SUCCESS", 1, 1), (2, "SUCCESS", 1, 0), (3, "NO_CODE_FILES", 0, 0)}
    assert reviews.count() == 3
    assert [(r.pr_number, r.file, r.line) for r in WR.read_output(spark, out, "findings").collect()] == [(1, "src/a.py", 1)]
    docs = WR.read_output(spark, out, "documents")
    assert docs.count() == 3 and docs.filter(F.col("request_json").contains("src/a.py")).count() == 1


def test_documents_name_their_own_commit(spark):
    """Two PRs that touch one review: each request body has its own commit."""
    prs = spark.createDataFrame([("o/r", 1, "sha-one", 7), ("o/r", 2, "sha-two", 7)], "repo_name string, pr_number int, commit_sha string, review_id long")
    files = spark.createDataFrame([(7, "a.py", "f = open('x')\nf.read()\n")], "review_id long, file string, content string")
    docs = {r.pr_number: json.loads(r.request_json) for r in WR.review_batch(prs, files, None)["documents"].collect()}
    assert {k: d["commit_id"] for k, d in docs.items()} == {1: "sha-one", 2: "sha-two"}
    assert all(len(d["comments"]) == 1 for d in docs.values())


def test_history_writes_changed_reviews_only(spark, tmp_path, monkeypatch):
    from revspark.streaming import batch_tables

    monkeypatch.setattr(batch_tables, "COMPACT_EVERY", 2)
    schema = "review_id long, severity string"
    reviews = spark.createDataFrame([(k, "o/r", k, "s", None) for k in range(6)], "id long, repo_name string, pr_number int, commit_sha string, analyzed_at timestamp")
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    assert {r.finding_count for r in WR.read_history(spark, out, reviews).collect()} == {0}
    want = {k: [0, 0] for k in range(6)}
    for rows in ([(1, "ERROR"), (2, "INFO")], [(1, "INFO")], [(3, "ERROR"), (3, "ERROR")], [(1, "ERROR")], [(4, "INFO")]):
        for k, s in rows:
            want[k][0] += 1
            want[k][1] += s == "ERROR"
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        WR.live_history(spark, spark.readStream.schema(schema).parquet(src), out, f"{tmp_path}/ck")
        got = {r.review_id: [r.finding_count, r.error_count] for r in WR.read_history(spark, out, reviews).collect()}
        assert got == want
    counts = spark.read.parquet(f"{out}/counts")
    assert sorted((r.batch_id, r.review_id) for r in counts.collect()) == [(0, 1), (0, 2), (1, 1), (2, 3), (3, 1), (4, 4)]


def test_a_batch_opens_its_own_buckets(spark, tmp_path):
    schema = "event_id long, payload string, signature string, event string"
    files = spark.range(300).select(F.col("id").alias("review_id"), F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("file"), F.lit("f = open('x')\nf.read()\n").alias("content"))
    path = WR.store_by_review(files, f"{tmp_path}/code")
    assert spark.read.parquet(path).select(*files.columns).exceptAll(files).isEmpty()
    few = WR.of_reviews(spark, path, [3, 5])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan and "IN (3,5)" in plan
    assert 0 < len(few.inputFiles()) <= len(spark.read.parquet(path).inputFiles())
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([delivery(1, 17, "s1")], [delivery(2, 40, "s2"), delivery(3, 17, "s1")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        WR.continuous_review(spark, spark.readStream.schema(schema).parquet(src), path, None, SECRET, out, f"{tmp_path}/ck", lambda pr: pr.cast("long"))
    assert sorted((r.pr_number, r.file, r.line, r.batch_id) for r in WR.read_output(spark, out, "findings").collect()) == [(17, "src/f17.py", 1, 0), (40, "src/f40.py", 1, 1)]
