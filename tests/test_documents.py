"""Paged review documents, late text lookup, ids of stored findings."""
import json

from pyspark.sql import functions as F

from revspark.operators import diffs as DF
from revspark.operators import enrich as EN
from revspark.operators import history as H
from revspark.sources import sinks as K

FIELDS = "review_id long, file string, line int, rule_id string, severity string, message string, code_snippet string, rationale string, fix_suggestion string, priority_score int"


def findings(spark):
    """Review 1 holds nearly everything, with equal findings among them; review 3 has none."""
    rows = [(1, f"src/F{k % 7}.java", k % 11, f"RULE-00{k % 3}", "ERROR", f"m{k % 5}", "x();", 'say "no"', "fix\n", k % 10) for k in range(500)]
    rows += [(2, "a.py", None, "RULE-001", "INFO", "m", None, None, "f", 3), (2, "a.py", 4, "RULE-001", "INFO", "m", "c", "r", "f", 3)]
    return spark.createDataFrame(rows, FIELDS).repartition(6)


def test_pages_make_the_same_documents(spark, monkeypatch):
    found = findings(spark)
    reviews = spark.createDataFrame([(1, "s1", "pr", None), (2, None, "pr", None), (3, "s3", "pr", None)], "review_id long, commit_sha string, source string, analyzed_at timestamp")
    whole = {}
    for size in (10_000, 7):
        monkeypatch.setattr(EN, "PAGE_FINDINGS", size)
        summary = EN.review_summary(reviews, found)
        request = EN.review_request(reviews, summary, found)
        result = EN.result_document(reviews, found)
        whole[size] = [sorted(map(tuple, df.collect()), key=repr) for df in (summary, request, result)]
    assert whole[7] == whole[10_000]
    rows = found.collect()
    doc = {r.review_id: r for r in result.collect()}
    assert {k: d.finding_count for k, d in doc.items()} == {1: 500, 2: 2, 3: 0}
    items = [tuple(x.values()) for x in json.loads(doc[1].findings_json)]
    assert items == sorted(tuple(r)[1:] for r in rows if r.review_id == 1)
    body = {r.review_id: json.loads(r.request_json) for r in request.collect()}
    assert len(body[1]["comments"]) == 500 and body[3] == {"body": body[3]["body"], "event": "COMMENT", "commit_id": "s3", "comments": []}
    assert "commit_id" not in body[2]
    lines = [(c["path"], c["line"]) for c in body[1]["comments"]]
    assert lines == sorted(lines)


def test_no_page_is_longer_than_asked(spark, monkeypatch):
    monkeypatch.setattr(EN, "PAGE_FINDINGS", 50)
    page = EN.result_pages(findings(spark)).collect()
    one = sorted((r.page for r in page if r.review_id == 1))
    assert one == list(range(len(one))) and {r.pages for r in page if r.review_id == 1} == {len(one)} and len(one) >= 10
    assert max(r.n for r in page) <= 50 and sum(r.n for r in page) == 502


def test_content_of_keys_with_and_without_copies(spark):
    rows = [(1, "a", "x"), (1, "a", "w"), (1, "b", "y"), (None, "c", "z"), (None, "c", "z"), (None, None, None), (2, "a", "q")]
    got = {(r.review_id, r.file_path): (r.content, r.n_copies, r.duplicated) for r in H.file_content(spark.createDataFrame(rows, "review_id long, file_path string, content string")).collect()}
    assert got == {(1, "a"): ("w", 2, True), (1, "b"): ("y", 1, False), (None, "c"): ("z", 2, True), (None, None): (None, 1, False), (2, "a"): ("q", 1, False)}


def test_dense_ids_go_on_after_the_stored_ones(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), (F.col("id") * 7 % 1000).alias("b"))
    got = K.with_row_ids(df, ["a", "b"], partitions=5, after=40).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(41, 1041))
    assert K.with_row_ids(df.limit(0), ["a", "b"]).collect() == []


def test_scope_keeps_copies_and_findings_by_their_steps(spark):
    step = "array<struct<file:string,line:int,description:string>>"
    rows = [(1, "f", 1, None), (1, "f", 2, [("f", 9, "d")]), (1, "f", 2, [("f", 9, "d")]), (1, "f", 3, [("f", 4, "d")]), (2, "f", 9, []), (1, None, None, None)]
    df = spark.createDataFrame(rows, f"review_id long, file string, line int, dataflow_path {step}")
    changed = spark.createDataFrame([(1, "f", 1), (1, "f", 9), (1, "f", 9)], "review_id long, file string, line int")
    got = sorted((r.file, r.line) for r in DF.scope_to_diff(df, changed).collect())
    assert got == [("f", 1), ("f", 2), ("f", 2)]
    assert DF.scope_to_diff(df, None).count() == 6


def test_bad_hunk_numbers_keep_the_counter(spark):
    text = "\n".join(["diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -1 +5,2 @@", "+five", "@@ -1 +9999999999 @@", "+six",
                      "@@ -1 +2147483647 @@", "+largest", "+smallest", "@@ nothing @@", "+next"])
    got = {r.line for r in DF.changed_lines(spark.createDataFrame([(1, text)], "diff_id long, diff_text string")).collect()}
    assert got == {5, 6, 2147483647, -2147483648, -2147483647}


def test_scores_beyond_int_and_not_a_number(spark):
    raw = ['{"priorityScore": 1e300}', '{"priorityScore": "NaN"}', '{"priorityScore": "-1e99"}', '{"priorityScore": 3.9}', '{"priorityScore": 1, "priorityScore": 2}', '{"priorityScore": 99999999999999999999999}']
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = [r.p for r in df.select("i", EN.guard_response(F.col("raw"))[2].alias("p")).orderBy("i").collect()]
    assert got == [2147483647, 0, -2147483648, 3, 2, 2147483647]
