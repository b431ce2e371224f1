"""Diff parse / scope, enrichment guard, webhook intake, evaluation."""
import hashlib
import hmac

from file_tables import files_df
from pyspark.sql import functions as F

from revspark.operators import diffs as DF
from revspark.operators import enrich as EN
from revspark.operators import evaluate as EV
from revspark.operators import java_rules as J
from revspark.streaming.intake import intake


def test_diff_parse_quirks(spark):
    diff = "\n".join([
        "diff --git a/src/A.java b/src/A.java", "--- a/src/A.java", "+++ b/src/A.java",
        "@@ -1,3 +1,4 @@", " a", "+b", "-c", "+++i;", " d", "+e",
        "diff --git a/notes.md b/notes.md", "@@ -1 +1 @@", "+ignored",
        "diff --git a/B.py b/B.py", "@@ -1 +7 @@ f(a,b)", "+x",
    ])
    d = spark.createDataFrame([(1, diff)], "diff_id long, diff_text string")
    got = sorted((r.file, r.line) for r in DF.changed_lines(d).collect())
    # '+++i;' inside a hunk is added text; the hunk start ignores the comma in the context text
    assert got == [("B.py", 7), ("src/A.java", 2), ("src/A.java", 3), ("src/A.java", 5)]


def test_scope_keeps_path_hits_and_copies(spark):
    path_t = "array<struct<file:string,line:int,description:string>>"
    f = spark.createDataFrame(
        [(1, "R", "E", "a", 10, "s", None, "m"), (1, "R", "E", "a", 10, "s", None, "m"),
         (1, "R", "E", "a", 20, "s", [("a", 3, "x")], "m2"), (1, "R", "E", "a", 30, "s", None, "m3")],
        f"review_id long, rule_id string, severity string, file string, line int, code_snippet string, "
        f"dataflow_path {path_t}, message string")
    ch = spark.createDataFrame([(1, "a", 10), (1, "a", 3)], "review_id long, file string, line int")
    got = sorted(r.line for r in DF.scope_to_diff(f, ch).collect())
    assert got == [10, 10, 20]


def test_response_guard(spark):
    rows = [("```json\n{\"rationale\": \"r\", \"fix\": \"f\", \"priorityScore\": 7}\n```",),
            ("{\"rationale\": null, \"fix\": {\"a\": 1}, \"priorityScore\": \"8\"}",),
            ("{\"rationale\": 3}",), ("not json",), ("   ",)]
    df = spark.createDataFrame(rows, "raw string")
    r, f, p = EN.guard_response(F.col("raw"))
    got = [tuple(x) for x in df.select(r, f, p).collect()]
    assert got == [("r", "f", 7), ("null", "", 8), ("3", "", 5),
                   (EN.FALLBACK_RATIONALE, EN.FALLBACK_FIX, EN.FALLBACK_PRIORITY), ("", "", 5)]


def test_enrich_priorities(spark):
    f = spark.createDataFrame([("RULE-001-RESOURCE-LEAK", "a.py"), ("RULE-002-NULL-SAFETY", "a.ts"),
                               ("RULE-003-CONCURRENCY", "A.java"), ("RULE-005-SQL-INJECTION", "A.java")],
                              "rule_id string, file string")
    got = sorted((r.rule_id, r.priority_score) for r in EN.enrich(f).collect())
    assert [p for _, p in got] == [9, 8, 7, 6]


def test_webhook_intake_hmac(spark):
    secret = "s3cret"
    body = '{"action": "opened", "number": 5, "repository": {"full_name": "o/r"}, "pull_request": {"head": {"sha": "abc"}}}'
    good = "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    rows = [(body, good, "pull_request"), (body, "sha256=00", "pull_request"), (body, None, "pull_request"),
            (body, good, "push"), (body[:20], "sha256=" + hmac.new(secret.encode(), body[:20].encode(),
                                                                    hashlib.sha256).hexdigest(), "pull_request")]
    df = spark.createDataFrame(rows, "payload string, signature string, event string")
    got = [(r.status, r.triggered, r.repo_name, r.pr_number, r.commit_sha) for r in intake(df, secret).collect()]
    assert got == [(200, True, "o/r", 5, "abc"), (401, False, None, None, None), (401, False, None, None, None),
                   (200, False, None, None, None), (400, False, None, None, None)]


#: (file, rule, expected) -> program: per rule one with the defect and one without.
SEEDED = {
    ("Tap", "RULE-001-RESOURCE-LEAK", 1): """class Tap {
        int first(String p) throws Exception { FileReader tap = new FileReader(p); int c = tap.read(); return c; } }""",
    ("Sink", "RULE-001-RESOURCE-LEAK", 0): """class Sink {
        int first(String p) throws Exception { FileReader tap = new FileReader(p); try { return tap.read(); } finally { tap.close(); } } }""",
    ("Gap", "RULE-002-NULL-SAFETY", 1): """class Gap {
        int size(boolean b) { int[] dims; Box box = null; if (b) box = new Box(); return box.area(); } }""",
    ("Fill", "RULE-002-NULL-SAFETY", 0): """class Fill {
        int size(boolean b) { Box box = null; if (box == null) { return 0; } return box.area(); } }""",
    ("Race", "RULE-003-CONCURRENCY", 1): """@Repository class Race {
        private long seen; boolean more(long top) { return top > seen; } }""",
    ("Calm", "RULE-003-CONCURRENCY", 0): """@Repository class Calm {
        private AtomicLong seen = new AtomicLong(); long now() { return seen.get(); } }""",
    ("Many", "RULE-004-NPLUSONE-QUERY", 1): """class Many {
        void all(OrderMapper orderMapper, int n) { while (n-- > 0) orderMapper.insertOne(n); } }""",
    ("Once", "RULE-004-NPLUSONE-QUERY", 0): """class Once {
        void all(OrderMapper orderMapper, java.util.List<Integer> ns) { orderMapper.insertAll(ns); for (int n : ns) log(n); } }""",
}


def test_seeded_benchmark_scores(spark):
    src = {f"{n}.java": code for (n, _, _), code in SEEDED.items()}
    found = J.run_java_rules(files_df(spark, src)).select(
        F.regexp_replace("file", r"\.java$", "").alias("case_id"), "rule_id")
    cases = spark.createDataFrame([(n, r, e) for (n, r, e) in SEEDED], "case_id string, rule_id string, expected int")
    s = EV.scores(EV.confusion(cases, found)).collect()[0]
    assert (s.tp, s.fp, s.fn, s.tn) == (4, 0, 0, 4)
    assert (s.precision, s.recall, s.f1) == (100.0, 100.0, 100.0)


def test_confusion_partial_hit_adds_no_fn(spark):
    cases = spark.createDataFrame([("a", "R", 3), ("b", "R", 0), ("c", "R", 2)], "case_id string, rule_id string, expected int")
    found = spark.createDataFrame([("a", "R")] + [("b", "R")] * 2 + [("c", "R")] * 5 + [("c", "X")],
                                  "case_id string, rule_id string")
    c = EV.confusion(cases, found).collect()[0]
    assert (c.tp, c.fp, c.fn, c.tn) == (1 + 2, 2 + 3, 0, 0)
