"""Line-pattern rules L1-L9 for C/C++, Python, JS/TS and other files.

The reference walks each file once with a little state machine.  Here each
rule is a set-based job over the line table:

* leak rules (L1, L4): filter candidate lines, then a ``groupBy(file)``
  aggregate (map-side partial aggregation, so a huge file is no hot spot);
* null rules (L2, L5, L7): equi-join of null assignments with dereference
  candidates on (review_id, file, var) plus ``a.line <= d.line``.  Every
  joined pair is one finding - the reference's bag semantics (a variable
  assigned null twice reports twice);
* loop rules (L3, L6, L8, L9): keyword filter + the P5 flag of the line.

Substring tests such as ``code.contains(var + "->")`` become equi-joins by
expanding each line into the variable names it could match: for ``var->``
every suffix of the word run before an arrow, for ``*var`` every prefix of
the word run after a star.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.functions.text import strip_comments
from revspark.operators.lines import KEY, code_lines, snippet
from revspark.session import written_together

# Rule ids, severities and messages of the line rules.
RULE_LEAK = "RULE-001-RESOURCE-LEAK"
RULE_NULL = "RULE-002-NULL-SAFETY"
RULE_LOOP = "RULE-004-NPLUSONE-QUERY"
MSG_CPP_LEAK = "Resource allocated but not closed/released on all execution paths."
MSG_CPP_NULL = "Potential null pointer dereference of '{var}' without a guard check."
MSG_CPP_LOOP = "Database query executed inside a loop. Potential N+1 performance bottleneck."
MSG_PY_LEAK = "File resource opened but not closed. Use 'with' statement for safe cleanup."
MSG_PY_NULL = "Accessing member of object '{var}' that may be None."
MSG_PY_LOOP = "Database query/operation executed inside a loop. Consider batching."
MSG_JS_NULL = "Dereferencing '{var}' which is explicitly set to null/undefined without optional chaining."
MSG_JS_LOOP = "Asynchronous network/database operation executed inside a loop. Potential N+1 query issue."
MSG_GENERIC_LOOP = "Potential database call or HTTP request in loop."

# Patterns of the line rules.
CPP_ALLOC_RE = r"\b(fopen|open|malloc|new)\b"
CPP_CLOSE_RE = r"\b(fclose|close|free|delete)\b"
CPP_NULL_ASSIGN_RE = r"(\w+)\s*=\s*(nullptr|NULL|0)\s*;"
PY_WITH_OPEN_RE = r"with\s+open\("
PY_NULL_ASSIGN_RE = r"(\w+)\s*=\s*None"
JS_NULL_ASSIGN_RE = r"(const|let|var)?\s*(\w+)\s*=\s*(null|undefined)\s*;?"
# what a line must hold to assign null, and for a name on it to be dereferenced
CPP_NULL_WORDS, PY_NULL_WORDS, JS_NULL_WORDS = ["nullptr", "NULL", "0"], ["None"], ["null", "undefined"]
CPP_DEREF_RE, PY_DEREF_RE, JS_DEREF_RE = r"\w->|\*\w", r"\w[.\[]", r"\w\."
CPP_LOOP_WORDS = ["query(", "execute(", "select("]
PY_LOOP_WORDS = ["execute(", "query(", "db."]
JS_LOOP_WORDS = ["await ", "fetch(", "db.", "query("]
GENERIC_LOOP_WORDS = ["query", "sql", "fetch("]


def _contains_any(c, words):
    cond = None
    for w in words:
        x = c.contains(w)
        cond = x if cond is None else (cond | x)
    return cond


def _finding(df: DataFrame, rule_id: str, severity: str, message) -> DataFrame:
    msg = message if not isinstance(message, str) else F.lit(message)
    return df.select(
        *KEY,
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.col("line").cast("int").alias("line"),
        F.col("code_snippet"),
        F.lit(None).cast("array<struct<file:string,line:int,description:string>>").alias("dataflow_path"),
        msg.alias("message"),
    ).select("review_id", "rule_id", "severity", "file", "line", "code_snippet", "dataflow_path", "message")


def _var_message(template: str):
    before, after = template.split("{var}")
    return F.concat(F.lit(before), F.col("var"), F.lit(after))


# --------------------------------------------------------------------- leaks

def cpp_leak(ln: DataFrame) -> DataFrame:
    """L1: last allocation line after the last release line -> one finding."""
    c = code_lines(ln.filter(F.col("lang") == "cpp"))
    code = F.col("code")
    is_alloc = code.rlike(CPP_ALLOC_RE) & ~code.contains("close") & ~code.contains("free")
    is_close = code.rlike(CPP_CLOSE_RE)
    cand = c.select(*KEY, "line", "raw", is_alloc.alias("a"), is_close.alias("c")).filter("a OR c")
    agg = cand.groupBy(*KEY).agg(
        F.max(F.when(F.col("a"), F.col("line"))).alias("alloc_line"),
        F.max_by(snippet(), F.when(F.col("a"), F.col("line"))).alias("code_snippet"),
        F.max(F.when(F.col("c"), F.col("line"))).alias("close_line"),
    )
    hit = agg.filter(F.col("alloc_line") > F.coalesce(F.col("close_line"), F.lit(0)))
    return _finding(hit.withColumnRenamed("alloc_line", "line"), RULE_LEAK, "ERROR", MSG_CPP_LEAK)


def py_leak(ln: DataFrame) -> DataFrame:
    """L4: any ``with open(`` silences the file; else last open after last close."""
    c = code_lines(ln.filter(F.col("lang") == "py"))
    code = F.col("code")
    is_close = code.contains(".close()")
    is_open = code.rlike(r"open\(") & ~is_close
    is_with = code.rlike(PY_WITH_OPEN_RE)
    cand = c.select(*KEY, "line", "raw", is_open.alias("o"), is_close.alias("c"), is_with.alias("w")) \
        .filter("o OR c OR w")
    agg = cand.groupBy(*KEY).agg(
        F.max(F.when(F.col("o"), F.col("line"))).alias("open_line"),
        F.max_by(snippet(), F.when(F.col("o"), F.col("line"))).alias("code_snippet"),
        F.max(F.when(F.col("c"), F.col("line"))).alias("close_line"),
        F.bool_or(F.col("w")).alias("with_open"),
    )
    hit = agg.filter(~F.col("with_open") & (F.col("open_line") > F.coalesce(F.col("close_line"), F.lit(0))))
    return _finding(hit.withColumnRenamed("open_line", "line"), RULE_LEAK, "ERROR", MSG_PY_LEAK)


# ---------------------------------------------------------------- null rules

def _null_rule(ln: DataFrame, lang: str, assign_re: str, group: int, null_words: list[str], deref_re: str, candidates,
               line_guard, guard, message: str) -> DataFrame:
    """``line_guard`` are the tests of the line alone, ``guard`` those of the line and the name.  Only lines that can
    report go through the joins, as ``raw``; their code is made again."""
    c = code_lines(ln.filter(F.col("lang") == lang))
    assigns = (
        c.filter(_contains_any(F.col("code"), null_words))
        .select(*KEY, F.col("line").alias("a_line"), F.regexp_extract("code", assign_re, group).alias("var"))
        .filter(F.col("var") != "")
    )
    # only files with an assignment, and of each name only the pieces as long as one of the file's assigned names
    lengths = assigns.groupBy(*KEY).agg(F.collect_set(F.length("var")).alias("lengths"))
    derefs = (
        c.filter(F.col("code").rlike(deref_re) & line_guard(F.col("code"))).select(*KEY, "lang", "line", "raw")
        .join(lengths, KEY)
        .select(*KEY, "lang", "line", "raw", F.array_distinct(candidates(strip_comments(F.col("raw"), F.col("lang")))).alias("vars"))
        .filter(F.size("vars") > 0)
        .select(*KEY, "lang", "line", "raw", F.explode("vars").alias("var"))
    )
    j = with_code(derefs.join(assigns, on=[*KEY, "var"], how="inner").filter(F.col("a_line") <= F.col("line")))
    j = j.filter(guard(F.col("code"), F.col("var")))
    return _finding(j.withColumn("code_snippet", snippet()), RULE_NULL, "ERROR", _var_message(message))


def _runs_before(code, ch: str):
    return F.regexp_extract_all(code, F.lit(r"(\w+)" + ch), 1)


def _fitting(word):
    return F.filter(F.col("lengths"), lambda n: n <= F.length(word))


def _suffixes(arr):
    """The suffixes of each word that are as long as one of the file's assigned names."""
    return F.flatten(F.transform(arr, lambda w: F.transform(_fitting(w), lambda n: w.substr(F.length(w) - n + 1, n))))


def _prefixes(arr):
    return F.flatten(F.transform(arr, lambda w: F.transform(_fitting(w), lambda n: w.substr(F.lit(1), n))))


def cpp_null_deref(ln: DataFrame) -> DataFrame:
    """L2: ``var->`` or ``*var`` after ``var = nullptr|NULL|0;`` with no if/!/==."""
    def cands(code):
        return F.concat(_suffixes(_runs_before(code, "->")),
                        _prefixes(F.regexp_extract_all(code, F.lit(r"\*(\w+)"), 1)))

    def line_guard(code):
        return ~code.contains("if") & ~code.contains("!") & ~code.contains("==")

    return _null_rule(ln, "cpp", CPP_NULL_ASSIGN_RE, 1, CPP_NULL_WORDS, CPP_DEREF_RE, cands, line_guard, lambda code, var: F.lit(True), MSG_CPP_NULL)


def py_none_access(ln: DataFrame) -> DataFrame:
    """``var.`` or ``var[`` after ``var = None``; not if / is not None / not var."""
    def cands(code):
        return F.concat(_suffixes(_runs_before(code, r"\.")), _suffixes(_runs_before(code, r"\[")))

    def line_guard(code):
        return ~code.contains("if") & ~code.contains("is not None")

    def guard(code, var):
        return ~code.contains(F.concat(F.lit("not "), var))

    return _null_rule(ln, "py", PY_NULL_ASSIGN_RE, 1, PY_NULL_WORDS, PY_DEREF_RE, cands, line_guard, guard, MSG_PY_NULL)


def js_null_access(ln: DataFrame) -> DataFrame:
    """``var.`` after ``var = null|undefined``; not ?. / typeof / if / && / ?."""
    def cands(code):
        return _suffixes(_runs_before(code, r"\."))

    def line_guard(code):
        return ~code.contains("typeof") & ~code.contains("if") & ~code.contains("&&") & ~code.contains("?")

    def guard(code, var):
        return ~code.contains(F.concat(var, F.lit("?.")))

    return _null_rule(ln, "js", JS_NULL_ASSIGN_RE, 2, JS_NULL_WORDS, JS_DEREF_RE, cands, line_guard, guard, MSG_JS_NULL)


# ---------------------------------------------------------------- loop rules

def _loop_rule(ln: DataFrame, langs: list[str], words: list[str], message: str) -> DataFrame:
    c = code_lines(ln.filter(F.col("lang").isin(*langs)))
    hit = c.filter(F.col("in_loop") & _contains_any(F.col("code"), words)).select(*KEY, "line", "raw")
    return _finding(hit.withColumn("code_snippet", snippet()), RULE_LOOP, "WARNING", message)


def cpp_query_in_loop(ln: DataFrame) -> DataFrame:
    """L3."""
    return _loop_rule(ln, ["cpp"], CPP_LOOP_WORDS, MSG_CPP_LOOP)


def py_query_in_loop(ln: DataFrame) -> DataFrame:
    """L6."""
    return _loop_rule(ln, ["py"], PY_LOOP_WORDS, MSG_PY_LOOP)


def js_call_in_loop(ln: DataFrame) -> DataFrame:
    """L8."""
    return _loop_rule(ln, ["js"], JS_LOOP_WORDS, MSG_JS_LOOP)


def generic_call_in_loop(ln: DataFrame) -> DataFrame:
    """Every extension without a dedicated analyser (not ``.java``)."""
    return _loop_rule(ln, ["generic"], GENERIC_LOOP_WORDS, MSG_GENERIC_LOOP)


# Registry in the reference's per-file emission order (leak/null/loop per language).
LINE_RULES = {
    "l1_cpp_leak": cpp_leak,
    "l2_cpp_null_deref": cpp_null_deref,
    "l3_cpp_query_in_loop": cpp_query_in_loop,
    "l4_py_leak": py_leak,
    "l5_py_none_access": py_none_access,
    "l6_py_query_in_loop": py_query_in_loop,
    "l7_js_null_access": js_null_access,
    "l8_js_call_in_loop": js_call_in_loop,
    "l9_generic_call_in_loop": generic_call_in_loop,
}


#: Per language, the lines that its rules look at: a pattern, the null assignments, and words that count inside a loop.
_LOOKED_AT = {
    "cpp": (rf"{CPP_ALLOC_RE}|{CPP_CLOSE_RE}|{CPP_DEREF_RE}", (CPP_NULL_WORDS, CPP_NULL_ASSIGN_RE), CPP_LOOP_WORDS),
    "py": (rf"open\(|\.close\(\)|{PY_DEREF_RE}", (PY_NULL_WORDS, PY_NULL_ASSIGN_RE), PY_LOOP_WORDS),
    "js": (JS_DEREF_RE, (JS_NULL_WORDS, JS_NULL_ASSIGN_RE), JS_LOOP_WORDS),
    "generic": (None, None, GENERIC_LOOP_WORDS),
}


def rule_lines(ln: DataFrame) -> DataFrame:
    """The lines that some rule of their language looks at: no other line has to be written for the rules.

    ``code`` is left out, ``with_code`` makes it again."""
    code, wanted = F.col("code"), F.lit(False)
    for lang, (pattern, null, words) in _LOOKED_AT.items():
        some = F.col("in_loop") & _contains_any(code, words)
        if pattern is not None:
            some = code.rlike(pattern) | (_contains_any(code, null[0]) & code.rlike(null[1])) | some
        wanted = F.when(F.col("lang") == lang, some).otherwise(wanted)
    return code_lines(ln).filter(wanted).drop("code")


def with_code(ln: DataFrame) -> DataFrame:
    return ln.withColumn("code", strip_comments(F.col("raw"), F.col("lang")))


def run_line_rules(ln: DataFrame) -> DataFrame:
    """All line rules for non-``.java`` files, concatenated (no dedupe)."""
    # one after another: they run beside the Java rules
    return written_together([partial(fn, ln) for fn in LINE_RULES.values()], at_once=1)


__all__ = ["LINE_RULES", "run_line_rules"]
