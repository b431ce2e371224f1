"""Property test: the window-based diff parse equals a sequential walk."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from revspark.functions.text import SUPPORTED_EXTS
from revspark.operators import diffs as ops
from revspark.operators.diffs import changed_lines

SUP = re.compile(r"\.(" + "|".join(SUPPORTED_EXTS) + r")$")


def walk(text):
    cur, line, in_hunk, out = None, 0, False, set()
    for l in text.split("\n"):
        if l.startswith("diff --git "):
            parts = l.rstrip(" ").split(" ")
            if len(parts) >= 4:
                b = parts[3]
                f = b[2:] if b.startswith("b/") else b
                cur = f if SUP.search(f.lower()) else None
                in_hunk = False
            continue
        if cur is None:
            continue
        if l.startswith("@@ "):
            m = re.search(r"\+(\d+)", l)
            if m:
                line = int(m.group(1))
            in_hunk = True
            continue
        if l.startswith("+") and (not l.startswith("+++") or in_hunk):
            out.add((cur, line))
            line += 1
        elif l.startswith(" "):
            line += 1
    return out


headers = st.sampled_from(["diff --git a/x.py b/x.py", "diff --git a/Y.java b/Y.java", "diff --git a/n.md b/n.md",
                           "diff --git a ", "diff --git a/z.go z.go", "--- a/x.py", "+++ b/x.py", "index 1..2"])
hunks = st.builds(lambda a, b, ctx: f"@@ -{a} +{b} @@{ctx}", st.integers(1, 50), st.integers(1, 50),
                  st.sampled_from(["", " f(a,b)", " g"])) | st.just("@@ -1 @@")
bodies = st.sampled_from(["+x", "+++i;", " ctx", "-gone", "\\ No newline", "", "+", "++y"])
lines = st.lists(st.one_of(headers, hunks, bodies, bodies), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(block=st.sampled_from([1, 3, 4096]), diffs=st.lists(lines, min_size=1, max_size=3))
def test_diff_parse_matches_walk(spark, block, diffs):
    """Whatever the block length: one line, a few, all."""
    ops.BLOCK_LINES = block
    texts = ["\n".join(d) for d in diffs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "diff_id long, diff_text string")
    try:
        got = {(r.diff_id, r.file, r.line) for r in changed_lines(df).collect()}
    finally:
        ops.BLOCK_LINES = 4096
    exp = {(i, f, n) for i, t in enumerate(texts) for f, n in walk(t)}
    assert got == exp


def test_no_window_by_the_diff_alone_over_its_lines(spark):
    """A diff of a quarter million lines: its lines are in many partitions, only block summaries meet by diff."""
    n = 250_000
    text = "diff --git a/x.py b/x.py\n@@ -1 +1 @@\n" + "\n".join("+a" if k % 2 else " b" for k in range(n))
    df = spark.createDataFrame([(None, text)], "diff_id long, diff_text string")
    out = changed_lines(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan and out.count() == n // 2
    assert {r.line for r in out.collect()} == {k + 1 for k in range(n) if k % 2}
