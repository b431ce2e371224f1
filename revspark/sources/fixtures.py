"""Derived inputs for operators whose natural input (diffs, webhook payloads,
review requests, model answers, PR payloads) is not among the driver's
tables (FIXTURES.md B4).  Every builder is a projection of a driver table
(or of ``code_files``), so the work grows with the data.  Each has a DuckDB
twin in ``*_SQL`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The webhook secret used by the fixtures and the intake job.
WEBHOOK_SECRET = "revspark-test-secret"
WEBHOOK_ACTIONS = ["opened", "synchronize", "reopened", "closed", "edited"]


# ------------------------------------------------------------------ diffs

def diffs_from_code_files(cf: DataFrame) -> DataFrame:
    """One unified diff per file: hunks of 10 lines, '+' on every 3rd line,
    '-' on every 7th, context otherwise.  Every eleventh diff has after each
    hunk head another whose number is no int: it changes nothing."""
    cf = cf.withColumn("_lines", F.split(F.col("content"), "\n"))
    lines = F.col("_lines")
    n = F.size(lines)

    def one(i: Column) -> Column:
        hunk = F.when(i % 10 == 1, F.concat(F.lit("@@ -"), i.cast("string"), F.lit(",10 +"), i.cast("string"),
                                           F.lit(",10 @@\n"), F.when(F.col("doc_id") % 11 == 3, F.lit("@@ -1 +99999999999 @@\n")).otherwise(F.lit("")))).otherwise(F.lit(""))
        prefix = F.when(i % 3 == 0, F.lit("+")).when(i % 7 == 0, F.lit("-")).otherwise(F.lit(" "))
        return F.concat(hunk, prefix, F.element_at(lines, i))

    head = F.concat(F.lit("diff --git a/"), F.col("file"), F.lit(" b/"), F.col("file"),
                    F.lit("\n--- a/"), F.col("file"), F.lit("\n+++ b/"), F.col("file"), F.lit("\n"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), n), one), "\n")
    return cf.select(F.col("doc_id").alias("diff_id"), "review_id", F.concat(head, body).alias("diff_text"))


# Expected changed lines of that diff, computed directly (oracle formulation).
DIFF_EXPECTED_SQL = """
dl AS (
  SELECT doc_id AS diff_id, review_id, file, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i
  FROM cf
),
dc AS (
  SELECT *, ((i - 1) // 10) * 10 + 1 AS hs,
         CASE WHEN i % 3 = 0 THEN '+' WHEN i % 7 = 0 THEN '-' ELSE ' ' END AS pfx FROM dl
),
dn AS (
  SELECT *, hs + coalesce(sum(CASE WHEN pfx <> '-' THEN 1 ELSE 0 END)
     OVER (PARTITION BY diff_id, hs ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_line
  FROM dc
),
changed AS (SELECT DISTINCT diff_id, review_id, file, CAST(new_line AS INTEGER) AS line FROM dn WHERE pfx = '+')
"""


# ------------------------------------------------------------- model answers

def responses_from_conversations(conv: DataFrame) -> DataFrame:
    """{fenced JSON, plain JSON, JSON without score, score as string, raw text,
    empty}[turn % 6], built around each conversation turn's text.  Some of the
    string scores are no number or far beyond int."""
    fix = F.concat(F.lit("fix #"), F.col("conv_id").cast("string"))
    prio = (1 + F.col("conv_id") % 10).cast("int")
    full = F.to_json(F.struct(F.col("text").alias("rationale"), fix.alias("fix"), prio.alias("priorityScore")))
    noscore = F.to_json(F.struct(F.col("text").alias("rationale"), fix.alias("fix")))
    odd = F.when(F.col("conv_id") % 9 == 4, "NaN").when(F.col("conv_id") % 9 == 5, "-1e300")
    strscore = F.to_json(F.struct(F.col("text").alias("rationale"), fix.alias("fix"),
                                  F.coalesce(odd, prio.cast("string")).alias("priorityScore")))
    k = F.col("turn") % 6
    resp = (F.when(k == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
            .when(k == 1, full).when(k == 2, noscore).when(k == 3, strscore)
            .when(k == 4, F.col("text")).otherwise(F.lit("")))
    return conv.select("conv_id", "turn", resp.alias("response"))


RESPONSES_SQL = """
responses AS (
  SELECT conv_id, turn, CASE turn % 6
    WHEN 0 THEN '```json' || chr(10) || json_object('rationale', text, 'fix', 'fix #' || conv_id, 'priorityScore', CAST(1 + conv_id % 10 AS INTEGER))::VARCHAR || chr(10) || '```'
    WHEN 1 THEN json_object('rationale', text, 'fix', 'fix #' || conv_id, 'priorityScore', CAST(1 + conv_id % 10 AS INTEGER))::VARCHAR
    WHEN 2 THEN json_object('rationale', text, 'fix', 'fix #' || conv_id)::VARCHAR
    WHEN 3 THEN json_object('rationale', text, 'fix', 'fix #' || conv_id, 'priorityScore', CASE conv_id % 9 WHEN 4 THEN 'NaN' WHEN 5 THEN '-1e300' ELSE CAST(1 + conv_id % 10 AS VARCHAR) END)::VARCHAR
    WHEN 4 THEN text ELSE '' END AS response
  FROM conversations
)
"""


# -------------------------------------------------------- PR / request payloads

def pr_files_payloads(cf: DataFrame) -> DataFrame:
    """PR 'files' API answer per review: a JSON list of {filename, status}
    with the review's code files plus two non-code files."""
    extra = F.array(
        F.struct(F.concat(F.lit("docs/R"), F.col("review_id").cast("string"), F.lit(".md")).alias("filename"),
                 F.lit("added").alias("status")),
        F.struct(F.concat(F.lit("img/R"), F.col("review_id").cast("string"), F.lit(".PNG")).alias("filename"),
                 F.lit("added").alias("status")),
    )
    per_review = cf.groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("file").alias("filename"),
                                             F.lit("modified").alias("status")))).alias("files"))
    return per_review.select("review_id", F.to_json(F.concat("files", extra)).alias("payload"))


def pr_metadata_payloads(orders: DataFrame) -> DataFrame:
    """PR API answer per order: head ref/sha; some lack the sha, some have it empty."""
    k = F.col("o_orderkey")
    sha = F.sha2(k.cast("string"), 256)
    head = (F.when(k % 5 == 0, F.concat(F.lit('{"ref": "b'), k.cast("string"), F.lit('"}')))
            .when(k % 5 == 1, F.concat(F.lit('{"ref":"b'), k.cast("string"), F.lit('","sha":""}')))
            .otherwise(F.concat(F.lit('{"ref": "feature/'), k.cast("string"), F.lit('", "sha": "'), sha,
                                F.lit('"}'))))
    body = F.concat(F.lit('{"number": '), k.cast("string"), F.lit(', "state": "open", "head": '), head,
                    F.lit(', "base": {"ref": "main", "sha": "'), F.sha2(F.col("o_custkey").cast("string"), 256),
                    F.lit('"}}'))
    return orders.select(k.alias("review_id"), body.alias("body"))


def requests_from_pages(pages: DataFrame) -> DataFrame:
    """Review requests: type by page_id % 3; url valid / blank / malformed /
    padded by page_id % 4; pasted code is the page's html."""
    pid = F.col("page_id")
    t = F.element_at(F.array(F.lit("github"), F.lit("code"), F.lit("other")), (pid % 3 + 1).cast("int"))
    url = (F.when(pid % 4 == 0, F.concat(F.lit("https://github.com/o"), (pid % 13).cast("string"), F.lit("/r"),
                                         (pid % 5).cast("string"), F.lit("/pull/"), pid.cast("string")))
           .when(pid % 4 == 1, F.lit("   "))
           .when(pid % 4 == 2, F.col("url"))
           .otherwise(F.concat(F.lit("  see https://github.com/a-"), pid.cast("string"), F.lit("/b/pull/"),
                               (pid * 7).cast("string"), F.lit("/files "))))
    code = F.when(pid % 5 == 0, F.lit(" ")).otherwise(F.col("html"))
    fname = F.when(pid % 4 == 0, F.lit(None).cast("string")).when(pid % 4 == 1, F.lit("  ")) \
        .otherwise(F.concat(F.lit("page"), pid.cast("string"), F.lit(".js")))
    return pages.select(pid.alias("request_id"), t.alias("type"), url.alias("github_url"), code.alias("code"),
                        fname.alias("file_name"))


# ------------------------------------------------------------------ webhooks

def webhooks_from_events(events: DataFrame, secret: str = WEBHOOK_SECRET) -> DataFrame:
    """Signed webhook deliveries (FIXTURES B4): payload, signature header,
    event header, ts."""
    from revspark.functions.crypto import hmac_sha256_hex

    eid = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in WEBHOOK_ACTIONS]), (eid % 5 + 1).cast("int"))
    full = F.concat(
        # every 29th number is beyond int
        F.lit('{"action": "'), action, F.lit('", "number": '), eid.cast("string"), F.when(eid % 29 == 0, F.lit("0000000000")).otherwise(F.lit("")),
        F.lit(', "repository": {"full_name": "o/r'), F.col("user_id").cast("string"),
        F.lit('"}, "pull_request": {"head": {"sha": "'), F.sha2(eid.cast("string"), 256), F.lit('"}}}'))
    # every 17th payload is cut to half its length (bad JSON, signed after the cut)
    payload = F.when(eid % 17 == 0, F.expr("substring(_full, 1, CAST(floor(length(_full) / 2) AS INT))")) \
        .otherwise(F.col("_full"))
    sig_ok = F.concat(F.lit("sha256="), hmac_sha256_hex(secret, F.col("payload")))
    sig = (F.when(eid % 13 == 0, F.lit(None).cast("string"))
           .when(eid % 11 == 0, F.concat(F.lit("sha256="), F.sha2(F.col("payload"), 256)))
           .otherwise(sig_ok))
    event = F.when(eid % 7 == 0, F.lit("push")).otherwise(F.lit("pull_request"))
    return (events.select("event_id", "ts", "user_id", full.alias("_full"))
            .withColumn("payload", payload)
            .select("event_id", "payload", sig.alias("signature"), event.alias("event"), "ts"))
