"""Registry of the engine's queries: one entry per SURVEY section-2 operator id.

Each query takes (spark, sf_dir) and reads the driver's tables (or tables
Spark derives from them), so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.operators import evaluate as EV
from revspark.operators import history as H
from revspark.operators import line_rules as LR
from revspark.operators.lines import lines
from revspark.plans import oracle_sql as O
from revspark.sources import analogs as A
from revspark.sources import sinks as K
from revspark.sources.code_files import code_files
from revspark.sources.tables import table
from revspark.functions.text import prompt_lang, rule_lang
from revspark.operators import diffs as DF
from revspark.operators import enrich as EN
from revspark.operators.lines import code_lines
from revspark.plans import review as RV
from revspark.session import cut_lineage, scratch_table_dir, together
from revspark.sources import fixtures as FX
from revspark.sources import scan as SC
from revspark.operators import java_rules as JR
from revspark.operators import flow as FL
from revspark.sources import event_flow as EF
from revspark.streaming import intake as WI
from revspark.streaming import review as WR
from revspark.streaming import throttle as WT

OUT_COLS = ["review_id", "rule_id", "severity", "file", "line", "code_snippet", "message"]


def _line_rule_query(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(lines(code_files(spark, sf_dir))).select(*OUT_COLS)
    return run


def _line_queries():
    return {key: _line_rule_query(fn) for key, fn in LR.LINE_RULES.items()}


def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_files(review_id, file_path, content) = the code corpus."""
    return code_files(spark, sf_dir).select("review_id", F.col("file").alias("file_path"), "content")


def eval_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """labels as cases (expected = quality); documents of 400+ chars as one finding each."""
    cases = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("case_id"), F.lit("RULE-QUALITY").alias("rule_id"),
        F.col("quality").cast("int").alias("expected"))
    found = table(spark, sf_dir, "documents").filter(F.col("n_chars") >= 400).select(
        F.col("doc_id").alias("case_id"), F.lit("RULE-QUALITY").alias("rule_id"))
    return cases, found


def _history_queries():
    def q1(spark, d):
        return H.review_history(A.reviews(spark, d), A.stored_findings(spark, d))

    def q2(spark, d):
        return H.findings_of_review(A.reviews(spark, d), A.stored_findings(spark, d))

    def q3(spark, d):
        # code files belong to reviews doc_id div 10; orders stand for the review table
        return H.files_of_review(A.reviews(spark, d), review_files(spark, d))

    def q4(spark, d):
        return H.file_content(review_files(spark, d))

    def q5(spark, d):
        return H.status_totals(A.reviews(spark, d), A.stored_findings(spark, d))

    def q6(spark, d):
        return H.dashboard_totals(q1(spark, d))

    def m1(spark, d):
        return EV.confusion(*eval_cases(spark, d))

    def m2(spark, d):
        return EV.scores(m1(spark, d))

    def k2(spark, d):
        files = A.pull_request_files(spark, d)
        return K.review_status(A.reviews(spark, d), files.filter(SC.is_supported(F.col("file"))))

    return {
        "q1_review_history": q1, "q2_findings_of_review": q2, "q3_files_of_review": q3,
        "q4_file_content": q4, "q5_status_totals": q5, "q6_dashboard_totals": q6,
        "m1_confusion": m1, "m2_scores": m2, "k2_review_status": k2,
    }




# ---------------------------------------------------------------------------
# P, S, D, E, K1 queries
# ---------------------------------------------------------------------------

FINDING_OUT = ["review_id", "rule_id", "severity", "file", "line", "code_snippet", "message"]
DOC_EXTS = ["txt", "py", "js", "cpp"]


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths to classify: code file names and page URLs."""
    return code_files(spark, d).select(F.col("file").alias("path")).unionByName(
        table(spark, d, "pages").select(F.col("url").alias("path")))


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """documents as source files (whole texts) with a rotating extension."""
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in DOC_EXTS]), (F.col("doc_id") % len(DOC_EXTS) + 1).cast("int"))
    return docs.select((F.floor(F.col("doc_id") / 10)).cast("long").alias("review_id"),
                       F.concat(F.lit("docs/"), F.col("source"), F.lit("/D"), F.col("doc_id").cast("string"),
                                F.lit("."), ext).alias("file"),
                       F.col("text").alias("content"))


def code_reviews(spark: SparkSession, d: str) -> DataFrame:
    """One review per group of ten code files (review_id = doc_id div 10)."""
    r = code_files(spark, d).select("review_id").distinct()
    return r.select("review_id",
                    F.concat(F.lit("repo/R"), F.col("review_id").cast("string")).alias("source"),
                    F.sha2(F.col("review_id").cast("string"), 256).alias("commit_sha"),
                    F.timestamp_seconds(F.lit(1704067200) + F.col("review_id")).cast("timestamp_ntz").alias("analyzed_at"))


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every rule over the code corpus."""
    return RV.run_rules(code_files(spark, d))


def enriched_findings(spark: SparkSession, d: str) -> DataFrame:
    """Enriched once and written: summaries, comments and documents all read it."""
    return cut_lineage(EN.enrich(all_findings(spark, d)))


def _more_queries():
    q = {}
    q["p1_rule_lang"] = lambda s, d: paths(s, d).select("path", rule_lang(F.col("path")).alias("lang"))
    q["p2_prompt_lang"] = lambda s, d: paths(s, d).select("path", prompt_lang(F.col("path")).alias("language"))
    q["p3_line_explode"] = lambda s, d: lines(doc_files(s, d)).select("review_id", "file", "line", "raw")
    q["p4_comment_strip"] = lambda s, d: lines(code_files(s, d)).select("review_id", "file", "line", "code")

    def p5(s, d):
        return code_lines(lines(code_files(s, d))).filter("in_loop").select("review_id", "file", "line")
    q["p5_inside_loop"] = p5
    q["p6_blank_filter"] = lambda s, d: code_lines(lines(code_files(s, d))).groupBy("review_id", "file").agg(
        F.count(F.lit(1)).alias("n_code_lines"))
    q["p7_prompt_text"] = lambda s, d: EN.prompts(all_findings(s, d)).select(
        "review_id", "file", "line", "rule_id", "system_prompt", "user_prompt")

    q["s1_file_scan"] = lambda s, d: SC.source_files(code_files(s, d).unionByName(
        doc_files(s, d).select("review_id", "file", "content"), allowMissingColumns=True)
        .select("review_id", "file", "content"))
    q["s2_supported_filter"] = lambda s, d: paths(s, d).select("path", SC.is_supported(F.col("path")).alias("supported"))
    q["s3_pr_files"] = lambda s, d: SC.explode_pr_files(FX.pr_files_payloads(code_files(s, d)))
    q["s4_pr_metadata"] = lambda s, d: SC.pr_metadata(FX.pr_metadata_payloads(table(s, d, "orders")))
    q["s5_request_routing"] = lambda s, d: SC.route_requests(FX.requests_from_pages(table(s, d, "pages")))

    q["s6_changed_files"] = lambda s, d: DF.changed_files(FX.diffs_from_code_files(code_files(s, d)))
    q["d1_diff_parse"] = lambda s, d: DF.changed_lines(FX.diffs_from_code_files(code_files(s, d)),
                                                       keys=("diff_id", "review_id"))

    def d2(s, d):
        def changed():
            ch = DF.changed_lines(FX.diffs_from_code_files(code_files(s, d)), keys=("diff_id", "review_id"))
            return cut_lineage(ch.select("review_id", "file", "line"))
        # the diffs are parsed while the rules run
        found, ch = together([lambda: all_findings(s, d), changed])
        return DF.scope_to_diff(found, ch).select(*FINDING_OUT)
    q["d2_diff_scope"] = d2
    q["d3_run_rules"] = lambda s, d: RV.run_rules(code_files(s, d)).select(*FINDING_OUT)
    q["d4_rule_stats"] = lambda s, d: RV.rule_stats(RV.run_rules(code_files(s, d)))
    q["d5_scan_once"] = lambda s, d: RV.run_rules_once_per_content(
        code_files(s, d).select("review_id", "file", "content").unionByName(doc_files(s, d))).select(*FINDING_OUT)

    q["e1_enrich"] = lambda s, d: enriched_findings(s, d).select(
        *FINDING_OUT, "rationale", "fix_suggestion", "priority_score")

    def e2(s, d):
        s.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        r = FX.responses_from_conversations(table(s, d, "conversations"))
        rat, fix, prio = EN.guard_response(F.col("response"))
        return r.select("conv_id", "turn", rat.alias("rationale"), fix.alias("fix"), prio.alias("priority"))
    q["e2_response_guard"] = e2
    q["e3_review_summary"] = lambda s, d: EN.review_summary(code_reviews(s, d), enriched_findings(s, d))

    def e4(s, d):
        found, reviews = enriched_findings(s, d), code_reviews(s, d)
        return EN.review_request(reviews, EN.review_summary(reviews, found), found)
    q["e4_review_request"] = e4
    q["e5_result_document"] = lambda s, d: EN.result_document(code_reviews(s, d), enriched_findings(s, d))

    def k1(s, d):
        import uuid
        f = K.flag_overflow(enriched_findings(s, d).select(
            "review_id", "rule_id", "severity", F.col("file").alias("file_path"),
            F.col("line").alias("line_number"), "code_snippet", "message", "rationale", "fix_suggestion",
            "priority_score"))
        f = K.with_row_ids(f, ["review_id", "file_path", "line_number", "rule_id", "message", "code_snippet"])
        path = scratch_table_dir(s, f"review_findings_{uuid.uuid4().hex}")
        K.persist_findings(f, path)
        return s.read.parquet(path)
    q["k1_persist_findings"] = k1

    def r1(s, d):
        import uuid
        cf = code_files(s, d)
        return RV.requests_to_results(
            FX.requests_from_pages(table(s, d, "pages")), FX.pr_files_payloads(cf), cf,
            lambda pr: F.floor(pr / 10).cast("long"), scratch_table_dir(s, f"request_findings_{uuid.uuid4().hex}"))
    q["r1_request_to_result"] = r1
    return q




# ---------------------------------------------------------------------------
# T and J queries (Java files of the code corpus)
# ---------------------------------------------------------------------------


def java_tables(spark: SparkSession, d: str) -> JR.JavaTables:
    cf = code_files(spark, d)
    return JR.JavaTables(cf.filter(F.col("file").endswith(".java")).select("review_id", "file", "content"))


PATH_RULES = ("j1_resource_leak", "j2_null_deref")


def _java_rule_query(fn, with_path: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        steps = [F.transform("dataflow_path", lambda x: x["line"]).alias("path_lines")] if with_path else []
        return fn(java_tables(spark, d)).select(*FINDING_OUT, *steps)
    return run


def _java_queries():
    q = {}
    q["t1_tokens"] = lambda s, d: java_tables(s, d).t.select("review_id", "file", "line", "idx", "tok", "kind",
                                                             "nd", "bd")
    q["t2_scopes"] = lambda s, d: java_tables(s, d).scopes.select(
        "review_id", "file", "open_pos", "close_pos", "open_line", "close_line", "depth", "kind", "name")
    q["t3_calls"] = lambda s, d: java_tables(s, d).calls.select(
        "review_id", "file", "name", "receiver", "call_line", "a_open", "a_close")
    q["t4_fields"] = lambda s, d: java_tables(s, d).fields.select(
        "review_id", "file", "c_open", "f_name", "type_text", "is_final")
    for key, fn in JR.JAVA_RULES.items():
        q[key] = _java_rule_query(fn, key in PATH_RULES)
    return q



# ---------------------------------------------------------------------------
# G queries (event-transition graphs)
# ---------------------------------------------------------------------------


def flow_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    # the edge table feeds every graph query and each fixpoint round: materialise it once
    edges = cut_lineage(EF.event_edges(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")))
    nodes = EF.flow_nodes(edges)
    return {"edges": edges, "nodes": nodes, "defs": EF.flow_defs(nodes), "uses": EF.flow_uses(nodes),
            "guards": EF.flow_guards(edges), "resources": EF.flow_marks(nodes, EF.RESOURCE_DEF),
            "closes": EF.flow_marks(nodes, EF.CLOSE_NODE), "escapes": EF.flow_marks(nodes, EF.ESCAPE_NODE)}


def leak_paths(t: dict[str, DataFrame]) -> DataFrame:
    return FL.leak_paths(t["edges"], t["nodes"], t["resources"], t["closes"], t["escapes"])


def _flow_queries():
    q = {}
    q["g0_flow_edges"] = lambda s, d: flow_tables(s, d)["edges"]
    q["g1_degrees"] = lambda s, d: FL.degrees(flow_tables(s, d)["edges"])


    def g1n(s, d):
        t = flow_tables(s, d)
        return FL.successors(t["edges"], t["nodes"]).select(FL.G, "node", F.col("dst").alias("neighbour"), F.lit("successor").alias("kind")) \
            .unionByName(FL.predecessors(t["edges"], t["nodes"]).select(FL.G, "node", F.col("src").alias("neighbour"), F.lit("predecessor").alias("kind")))
    q["g1_neighbours"] = g1n

    def g1r(s, d):
        t = flow_tables(s, d)
        return FL.remove_edge(t["edges"], t["guards"]).select(FL.G, "src", "dst")
    q["g1_remove_edges"] = g1r
    q["g2_gen_kill"] = lambda s, d: FL.gen_kill(flow_tables(s, d)["defs"])

    def g3(s, d):
        t = flow_tables(s, d)
        return FL.reaching_definitions(t["edges"], t["defs"]).select(FL.G, "node", "def_id")
    q["g3_reaching_defs"] = g3

    def g4(s, d):
        t = flow_tables(s, d)
        return FL.def_use_chains(FL.reaching_definitions(t["edges"], t["defs"]), t["uses"])
    q["g4_def_use"] = g4

    def g5(s, d):
        t = flow_tables(s, d)
        return leak_paths(t).select(FL.G, "def_node")
    q["g5_leak_paths"] = g5

    def g6(s, d):
        t = flow_tables(s, d)
        reach = FL.reaching_definitions(t["edges"], t["defs"])
        return FL.unguarded_null_uses(t["edges"], t["nodes"], t["defs"], t["uses"], t["guards"], reach)
    q["g6_unguarded_null"] = g6

    def g7(s, d):
        t = flow_tables(s, d)
        steps = FL.witness_steps(leak_paths(t).select(FL.G, "def_node", "path"), t["nodes"])
        return steps.select(FL.G, "def_node", F.array_join("steps.description", " -> ").alias("witness"),
                            F.transform("steps", lambda x: x["line"]).alias("lines"))
    q["g7_witness_path"] = g7
    return q




# ---------------------------------------------------------------------------
# W queries (webhooks, throttle, TTL, continuous review, live history)
# ---------------------------------------------------------------------------

THROTTLE_GAP = 10 * 3600   # fixture: 10 hours on events by user_id (the service uses 10 s per client)
TTL_GAP = 3600             # fixture: 1 hour on key user_id % 20
TTL_KEYS = 20
SLICES = 4                 # fixture: runs in which the events of the throttle streams arrive
PRS_PER_REVIEW = 100       # fixture: PR number (event_id) div 100 names the code review it touches


def arrival():
    """Fixture: the run in which an event arrives: by day of the month, every 20th event a run later."""
    own = F.floor((F.dayofmonth("ts") - 1) / 8) + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)
    return F.least(own, F.lit(SLICES - 1))


def stream_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table as a file stream (glob path: the source needs a folder pattern)."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{name}.parque[t]")


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")


def _w_queries():
    q = {}
    out_cols = ["event_id", "status", "outcome", "triggered", "repo_name", "pr_number", "commit_sha"]
    q["w1_webhook_intake"] = lambda s, d: WI.intake(FX.webhooks_from_events(_events(s, d)), FX.WEBHOOK_SECRET) \
        .select(*out_cols)

    def w1s(s, d):
        path = WR.fresh_dir(s, "w1")
        st = WI.intake(FX.webhooks_from_events(stream_table(s, d, "events")), FX.WEBHOOK_SECRET).select(*out_cols)
        st.writeStream.format("parquet").option("path", path + "/out") \
            .option("checkpointLocation", path + "/ck").trigger(availableNow=True).start().awaitTermination()
        return s.read.parquet(path + "/out")
    q["w1_webhook_intake_stream"] = w1s

    q["w2_throttle"] = lambda s, d: WT.throttle(_events(s, d), "user_id", "ts", "event_id", THROTTLE_GAP) \
        .select("user_id", "event_id", "accepted")

    def throttled(s, d, name, key, gap, delay):
        """The stream's answers when the events arrive in SLICES runs, some of them late."""
        path = WR.fresh_dir(s, name)
        ev = _events(s, d).withColumn(name, key)
        for n in range(SLICES):
            ev.filter(arrival() == n).write.mode("append").parquet(path + "/in")
            WT.throttle_stream(s.readStream.schema(ev.schema).parquet(path + "/in"), name, "ts", "event_id", gap, path + "/out", path + "/ck", delay)
        return WT.read_answers(s, path + "/out").withColumnRenamed("batch_id", "slice")

    def w2s(s, d):
        return throttled(s, d, "user_id", F.col("user_id"), THROTTLE_GAP, THROTTLE_GAP).select("user_id", "event_id", "accepted", "late", "slice")
    q["w2_throttle_stream"] = w2s

    def w3(s, d):
        ev = _events(s, d).withColumn("ttl_key", F.col("user_id") % TTL_KEYS)
        return WT.first_version(ev, "ttl_key", "ts", "event_id", TTL_GAP)
    q["w3_first_version"] = w3

    def w3s(s, d):
        return throttled(s, d, "ttl_key", F.col("user_id") % TTL_KEYS, TTL_GAP, TTL_GAP).select("ttl_key", "event_id", "set_id", "late", "slice")
    q["w3_first_version_stream"] = w3s

    runs: dict[tuple[str, str], str] = {}

    def w4_run(s, d):
        """One run of the stream writes all outputs; the queries of an application read the same one."""
        run = s.sparkContext.applicationId, d
        if run in runs:
            return runs[run]
        path = WR.fresh_dir(s, "w4")
        # dealing out by range reads its input twice, and both tables are made of the same texts
        cf = cut_lineage(code_files(s, d))
        files = WR.store_by_review(cf.select("review_id", "file", "content"), path + "/code")
        diffs = WR.store_by_review(FX.diffs_from_code_files(cf), path + "/diffs")
        hooks = FX.webhooks_from_events(_events(s, d))
        # deliveries arrive in several runs, every seventh of them once more in the next
        for n in range(SLICES - 1):
            own = F.pmod("event_id", F.lit(SLICES - 1)) == n
            again = (F.col("event_id") % 7 == 0) & (F.pmod(F.col("event_id") + 1, F.lit(SLICES - 1)) == n)
            hooks.filter(own | again).write.mode("append").parquet(path + "/in")
            WR.continuous_review(s, s.readStream.schema(hooks.schema).parquet(path + "/in"), files, diffs, FX.WEBHOOK_SECRET, path, path + "/ck",
                                 lambda pr: F.floor(pr / PRS_PER_REVIEW).cast("long"))
        runs[run] = path
        return path

    def w4(s, d):
        return WR.read_output(s, w4_run(s, d), "findings").select(
            "repo_name", "pr_number", "commit_sha", "review_id", "rule_id", "severity", "file", "line",
            "code_snippet", "message", "priority_score")
    q["w4_continuous_review"] = w4
    q["w4_reviews"] = lambda s, d: WR.read_output(s, w4_run(s, d), "reviews").select(
        "repo_name", "pr_number", "commit_sha", "review_id", "status", "file_count", "finding_count")
    q["w4_files"] = lambda s, d: WR.read_output(s, w4_run(s, d), "files").select(
        "repo_name", "pr_number", "commit_sha", "review_id", "file")

    def w5(s, d):
        path = WR.fresh_dir(s, "w5")
        rows = A.findings_from_lineitem(table(s, d, "lineitem"))
        # a review's findings arrive in several runs, so its counts change
        for n in range(SLICES - 1):
            rows.filter(F.pmod("line_number", F.lit(SLICES - 1)) == n).write.mode("append").parquet(path + "/in")
            WR.live_history(s, s.readStream.schema(rows.schema).parquet(path + "/in"), path + "/out", path + "/ck")
        return WR.read_history(s, path + "/out", A.reviews(s, d)).select(
            "review_id", F.col("finding_count").cast("long").alias("finding_count"),
            F.col("error_count").cast("long").alias("error_count"))
    q["w5_live_history"] = w5
    return q


# ---------------------------------------------------------------------------
# registry
# ---------------------------------------------------------------------------

QUERY_GROUPS = (_line_queries, _history_queries, _more_queries, _java_queries, _flow_queries, _w_queries)
ORACLE_GROUPS = (O.line_rule_sql, O.history_sql, O.more_sql, O.java_sql, O.flow_sql, O.w_sql, O.w4_sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for group in QUERY_GROUPS:
        q.update(group())
    return q


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    for group in ORACLE_GROUPS:
        s.update(group())
    return s
