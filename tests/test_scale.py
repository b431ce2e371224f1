"""Joins whose tables grow with the input go through no driver; sizes of partitions follow the input."""

import random

import pytest
from pyspark.sql import functions as F

from revspark.operators import diffs as DF
from revspark.operators import enrich as EN
from revspark.operators import java_rules as JR
from revspark.operators import tokens as T
from revspark.session import cut_lineage
from revspark.streaming import throttle as WT


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


SPAN = "review_id long, file string, lo long, hi long, l0 int, l1 int, name string"


def span_rows(rng, n):
    out = []
    for k in range(n):
        l0 = rng.randint(1, 400)
        l1 = l0 + rng.choice([0, 1, 5, 62, 63, 64, 65, 127, 300])
        out.append((rng.randint(0, 1), "a", (l0 << 32) + rng.randint(0, 3), (l1 << 32) + rng.randint(0, 3), l0, l1, f"s{k}"))
    return out + [(0, "a", 5 << 32, None, 5, None, "open"), (0, None, 0, 900 << 32, 1, 800, "no file")]


@pytest.mark.parametrize("strict", [True, False])
def test_inside_blocks_is_inside(spark, strict):
    rng = random.Random(3)
    spans = span_rows(rng, 60)
    items = [(rng.randint(0, 1), "a", rng.randint(1, 700), rng.randint(0, 3)) for _ in range(300)]
    items = [(r, f, line, (line << 32) + i) for r, f, line, i in items] + [(0, None, 3, 3 << 32)]
    it = spark.createDataFrame(items, "review_id long, file string, line int, pos long")
    sp = spark.createDataFrame(spans, SPAN)
    want = sorted((r, line, pos, s[6]) for r, f, line, pos in items for s in spans
                  if f and f == s[1] and r == s[0] and s[5] is not None and s[4] <= line <= s[5]
                  and (s[2] < pos < s[3] if strict else s[2] <= pos <= s[3]))
    for fn in (T.inside, T.inside_blocks):
        got = fn(it, sp, "lo", "hi", "l0", "l1", strict=strict)
        assert sorted((x.review_id, x.line, x.pos, x.name) for x in got.collect()) == want
        assert set(got.columns) - set(sp.columns) == {"line", "pos"}


def test_exploded_spans_are_not_broadcast(spark):
    items = cut_lineage(spark.range(50000).selectExpr("id % 9 review_id", "'a' file", "int(id) line", "id << 32 pos", "sha2(string(id), 256) x"))
    spans = cut_lineage(spark.range(9).selectExpr("id review_id", "'a' file", "0L lo", "1L << 60 hi", "0 l0", "49999 l1", "'n' name"))
    for fn in (T.inside, T.inside_blocks):
        assert "Broadcast" not in plan(fn(items, spans, "lo", "hi", "l0", "l1"))
    # a long span is a row for each block of lines
    j = T.inside_blocks(items, spans, "lo", "hi", "l0", "l1").groupBy("review_id").count()
    assert sum(r["count"] for r in j.collect()) == 50000 - 1


def test_written_tables_of_many_rows_are_not_broadcast(spark):
    code = "class A {\n  private int a;\n  void f() { g(a); }\n}\n"
    files = spark.range(JR.BROADCAST_ROWS).selectExpr("id review_id", "'A.java' file", f"'{code}' content")
    jt = JR.JavaTables(files)
    assert jt.fields.count() == jt.methods.count() == JR.BROADCAST_ROWS
    big = jt.parens.join(jt.braces.select(*T.KEY, F.col("o_pos").alias("c_n1_pos")), [*T.KEY, "c_n1_pos"])
    assert "Broadcast" not in plan(big)


def test_partitions_of_tokens_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "PARTITION_BYTES", 1000)
    files = spark.range(400).selectExpr("id review_id", "'A.java' file", "repeat('int a;', 50) content")
    used = T.tokens(files).select(F.spark_partition_id().alias("p"), "review_id")
    assert used.select("p").distinct().count() > 80
    assert used.groupBy("review_id").agg(F.count_distinct("p").alias("n")).filter("n > 1").isEmpty()


def test_documents_scopes_and_pointers_are_not_broadcast(spark):
    found = cut_lineage(spark.range(20).selectExpr(
        "id % 3 review_id", "'R' rule_id", "'ERROR' severity", "'f' file", "int(id) line", "'c' code_snippet", "'m' message",
        "'r' rationale", "'x' fix_suggestion", "5 priority_score", "cast(null as array<struct<file:string,line:int,description:string>>) dataflow_path"))
    reviews = spark.range(3).selectExpr("id review_id", "'s' source", "'c' commit_sha", "timestamp'2024-01-01' analyzed_at")
    assert "Broadcast" not in plan(EN.result_document(reviews, found))
    assert "Broadcast" not in plan(EN.review_request(reviews, EN.review_summary(reviews, found), found))
    changed = cut_lineage(spark.range(20).selectExpr("id % 3 review_id", "'f' file", "int(id) line"))
    assert "Broadcast" not in plan(DF.scope_to_diff(found, changed))
    events = cut_lineage(spark.range(50).selectExpr("id % 4 k", "id", "timestamp_seconds(id * 700) ts"))
    assert "Broadcast" not in plan(WT.next_pointers(events, "k", "ts", "id", 3600))
    assert "Broadcast" not in plan(WT.first_version(events, "k", "ts", "id", 3600))
    assert "Broadcast" not in plan(WT.throttle(events, "k", "ts", "id", 3600))


def test_line_tables_and_request_tables_are_not_broadcast(spark, monkeypatch):
    from revspark.plans import review as RV

    monkeypatch.setattr(JR, "BROADCAST_ROWS", 10)
    files = spark.range(40).selectExpr("id review_id", "'a.js' file", "'let x = null;\nx.y();\n' content")
    assert "Broadcast" not in plan(RV.run_rules(files, with_java=False))
    assert RV.run_rules(files, with_java=False).count() == 40


RULE_CODE = """@Service
public class A {
  private List<String> items = new ArrayList<>();
  private int hits;
  private UserRepository repository;
  public List<String> items() { return items; }
  public void add(String s) { this.items.add(s); hits = hits + 1; }
  public void load(List<Long> ids) {
    FileInputStream in = new FileInputStream("f");
    for (Long id : ids) { repository.findById(id); }
    ids.forEach(id -> repository.findById(id));
    statement.executeQuery("select " + ids);
    for (int i = 0; i <= ids.size(); i++) { add("x"); }
    if (items == null) { items.add("y"); }
  }
}
"""


def test_no_join_of_a_rule_run_is_broadcast_at_run_time(spark, monkeypatch):
    """Whatever sizes the shuffles show, tables that grow with the files are not sent through the driver."""
    seen = {}

    def ran(name, df):
        df.collect()
        seen[name] = "BroadcastHashJoin" in plan(df)
        return df

    monkeypatch.setattr(JR, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(JR, "cut_lineage", lambda df: cut_lineage(ran(f"table {len(seen)}: {df.columns}", df)))
    monkeypatch.setattr(DF, "cut_lineage", lambda df: cut_lineage(ran(f"table {len(seen)}: {df.columns}", df)))
    files = spark.range(40).select(F.col("id").alias("review_id"), F.lit("A.java").alias("file"), F.lit(RULE_CODE).alias("content"))
    diffs = spark.range(40).selectExpr("id diff_id", "'diff --git a/A.java b/A.java\n@@ -1 +1,2 @@\n+x\n y\n+z' diff_text")
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for c in limits:
        spark.conf.set(c, "1g")
    try:
        jt = JR.JavaTables(files)
        assert jt.fields.count() == 40 * 3
        assert ran("J3a", JR.shared_field_access(jt)).count() == 40 * 4
        assert ran("J3c", JR.unsafe_publication(jt)).count() == 40
        for fn in (JR.query_in_loop, JR.loop_bound):
            assert ran(fn.__name__, fn(jt)).count() == 40
        assert ran("D1", DF.changed_lines(diffs)).count() == 80
    finally:
        for c in limits:
            spark.conf.unset(c)
    assert [name for name, broadcast in seen.items() if broadcast] == []


def test_tables_of_the_java_rules_are_dealt_out_by_file_once(spark, monkeypatch):
    """The text is moved to its file's partition for the token table; no table and no rule after that moves or broadcasts it."""
    seen, cut_by = {}, JR.cut_by

    def ran(df, keys, partitions, order=()):
        seen[f"table {len(seen)}: {df.columns}"] = plan(df)
        return cut_by(df, keys, partitions, order)

    monkeypatch.setattr(JR, "cut_by", ran)
    files = spark.range(40).select(F.col("id").alias("review_id"), F.lit("A.java").alias("file"), F.lit(RULE_CODE).alias("content"))
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for c in limits:
        spark.conf.set(c, "1g")
    try:
        jt = JR.JavaTables(files)
        rows = sorted(map(str, jt.t.collect()))
        assert rows == sorted(map(str, T.tokens(files).select(*jt.t.columns).collect()))
        for name, fn in JR.JAVA_RULES.items():
            seen[name] = plan(fn(jt))
    finally:
        for c in limits:
            spark.conf.unset(c)
    tables = list(seen.items())[1:]
    assert [name for name, p in tables if "BroadcastHashJoin" in p] == []
    # J1 and J2 deal their methods' rows out to the path walk, and what it finds back by file; the loops of J4a are two tables in one
    assert [name for name, p in tables if "Exchange" in p and "def_pos" not in name and "'at'" not in name] == ["j4a_query_in_loop"]


def test_lines_that_no_rule_looks_at_are_not_written(spark):
    """Every finding comes from a written line, at any length of comments and plain text around it."""
    from revspark.operators import line_rules as LR
    from revspark.operators.lines import lines

    code = {"a.cpp": "T* v = nullptr;\nv->run();\nchar* p = malloc(8);\nfor (;;) {\n  db.query(1);\n}\n", "a.py": "h = open(f)\nv = None\nv.x()\nfor i in x:\n  db.execute(i)\n",
            "a.js": "let v = null;\nv.run();\nfor (;;) {\n  await load();\n}\n", "a.go": "for {\n  rows := conn.query(1)\n}\nfor (;;) {\n  sql()\n}\n"}
    plain = "// plain words\n" * 50 + "plain words\n" * 50
    files = spark.createDataFrame([(1, name, text + plain) for name, text in code.items()], "review_id long, file string, content string")
    ln = lines(files)
    kept = LR.rule_lines(ln)
    assert "code" not in kept.columns and kept.count() < 20 < ln.count()
    whole = {str(r) for fn in LR.LINE_RULES.values() for r in fn(ln).collect()}
    assert whole == {str(r) for fn in LR.LINE_RULES.values() for r in fn(LR.with_code(kept)).collect()}
    assert {x for x in (LR.RULE_LEAK, LR.RULE_NULL, LR.RULE_LOOP) if any(x in w for w in whole)} == {LR.RULE_LEAK, LR.RULE_NULL, LR.RULE_LOOP}


def test_tables_written_at_a_time(spark):
    """Tables of jobs that run together do not touch each other's files, and come back whole."""
    from revspark.session import written_together

    makers = [lambda k=k: spark.range(1000 * k, 1000 * k + 1000).selectExpr("id", f"{k} k") for k in range(6)]
    for at_once in (1, 3):
        got = written_together(makers, at_once)
        assert [tuple(r) for r in got.groupBy("k").count().orderBy("k").collect()] == [(k, 1000) for k in range(6)]


def test_a_rule_run_plans_one_rule_at_a_time(spark, monkeypatch):
    """The plans and stages of all rules are not in the driver together: what a run returns only reads."""
    from revspark.operators import line_rules as LR
    from revspark.plans import review as RV

    py = "def f():\n    v = None\n    v.x()\n    h = open(p)\n"
    code = 'class A {\n  String apiKey = "a literal";\n}\n'
    files = spark.createDataFrame([(k, name, c) for k in range(2) for name, c in (("A.java", code), ("a.py", py), ("a.py", py))],
                                  "review_id long, file string, content string")
    monkeypatch.setattr(JR, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(JR, "JAVA_RULES", {"j6_hardcoded_secret": JR.hardcoded_secrets})
    monkeypatch.setattr(LR, "LINE_RULES", {k: LR.LINE_RULES[k] for k in ("l1_cpp_leak", "l4_py_leak", "l5_py_none_access")})
    got = RV.run_rules(files)
    assert not any(word in plan(got) for word in ("Join", "Window", "Exchange", "Generate"))
    rows = sorted((r.review_id, r.rule_id, r.file, r.line) for r in got.collect())
    # equal files are one file to the join of assignments with dereferences: 2 x 2 pairs
    assert rows == sorted(x for k in range(2) for x in [(k, JR.R_SECRET, "A.java", 2), (k, JR.R_LEAK, "a.py", 4)] + 4 * [(k, JR.R_NULL, "a.py", 3)])
    # findings grow with the files: a join with them is not broadcast, however small they are on disk
    assert "BroadcastHashJoin" not in plan(spark.range(3).withColumnRenamed("id", "review_id").join(got, "review_id"))


def test_texts_of_literals_are_not_repeated(spark):
    """A neighbouring literal is its quote; the secret rule still shows the whole literal."""
    code = 'class A {\n  String apiKey = "a long literal";\n  void f() { g("another", apiKey); }\n}\n'
    files = spark.createDataFrame([(1, "A.java", code)], "review_id long, file string, content string")
    rows = T.tokens(files).collect()
    near = {r[c] for r in rows for c in ("p1", "p2", "p3", "p4", "n1", "n3")}
    assert '"' in near and not any(x and len(x) > 1 and x.startswith('"') for x in near)
    assert {r.tok for r in rows if r.kind == "str"} == {'"a long literal"', '"another"'}
    assert [r.code_snippet for r in JR.hardcoded_secrets(JR.JavaTables(files)).collect()] == ['apiKey = "a long literal"']


def test_documents_of_a_review_are_made_once(spark, monkeypatch):
    """However many PRs touch a review, its findings are paged once, and every PR gets the document."""
    from revspark.streaming import review as WR

    seen = []
    pages = EN.pages
    monkeypatch.setattr(EN, "pages", lambda rows, *a, **k: seen.append(rows.count()) or pages(rows, *a, **k))
    prs = spark.range(30).selectExpr("'o/r' repo_name", "int(id) pr_number", "concat('sha', id) commit_sha", "if(id = 29, null, id % 2) review_id")
    files = spark.createDataFrame([(0, "a.py", "f = open('x')\nf.read()\n"), (1, "b.py", "x = 1\n")], "review_id long, file string, content string")
    docs = WR.review_batch(prs, files, None)["documents"].collect()
    assert seen == [1, 1]
    assert sorted(d.pr_number for d in docs) == list(range(30))
    assert all(f'"commit_id":"sha{d.pr_number}"' in d.request_json for d in docs)
    assert {d.review_id: d.request_json.count('"path"') for d in docs} == {0: 1, 1: 0, None: 0}
    assert {d.review_id for d in docs if EN.REPORT_EMPTY in d.summary} == {1, None}


def test_throttle_rounds_write_one_table_each(spark, monkeypatch):
    """A round's reached events and pointers are one join and one table; the answers are those of a walk."""
    rng, gap = random.Random(5), 100
    rows = [(i % 3, i, rng.randint(0, 4000)) for i in range(200)]
    want, last = set(), {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if k not in last or t >= last[k] + gap:
            last[k] = t
            want.add((k, i))
    events = cut_lineage(spark.createDataFrame(rows, "k long, id long, t long").selectExpr("k", "id", "timestamp_seconds(t) ts"))
    made = []
    monkeypatch.setattr(WT, "cut_lineage", lambda df: made.append(1) or cut_lineage(df))
    got = WT.accepted_ids(events, "k", "ts", "id", gap)
    assert {tuple(r) for r in got.collect()} == want
    # chains of at most 41: the pointers, the heads and up to seven rounds
    assert len(made) <= 9


def test_long_lines_are_rendered_in_one_pass(spark):
    """A line of 40,000 tokens (a pasted page without line breaks): its text is made token by token."""
    import time

    files = spark.createDataFrame([(1, "A.java", "f(a + b);" * 5000)], "review_id long, file string, content string")
    jt = JR.JavaTables(files)
    assert jt.t.count() == 35000
    start = time.time()
    assert [r.line_text for r in jt.lines_text.collect()] == [" ".join(["f(a + b);"] * 5000)]
    assert time.time() - start < 20
