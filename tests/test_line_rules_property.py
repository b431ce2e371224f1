"""Property test: C/C++ line rules (L1-L3) equal a sequential walk (bags)."""
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from file_tables import files_df
from revspark.operators import line_rules as LR
from revspark.operators.lines import lines

VOCAB = ['FILE* f = fopen("x", "r");', "fclose(f);", "T* p = nullptr;", "p->run();", "if (p) p->run();",
         "*p = 1;", "for (int i = 0; i < n; i++) {", "while (ok) {", "db.query(1);", "// db.query(2)", "/* c */",
         " * p-> x", "}", "", "  ", "q = NULL;", "q->go(); // x", "delete t;", "T* t = new T(); delete t;",
         "x.map(f);", "free(p);", "char* m = malloc(4);", "\tselect(q);", "xp->a(); !p"]


def jtrim(s):
    i, j = 0, len(s)
    while i < j and ord(s[i]) <= 32:
        i += 1
    while j > i and ord(s[j - 1]) <= 32:
        j -= 1
    return s[i:j]


def strip(line):
    k = line.find("//")
    if k >= 0:
        return line[:k]
    t = jtrim(line)
    return "" if t.startswith("/*") or t.startswith("*") else line


def in_loop(ls, i):
    for j in range(max(0, i - 10), i):
        t = jtrim(ls[j])
        if (t.startswith("for ") or t.startswith("for(") or t.startswith("while ") or t.startswith("while(")
                or ".forEach" in ls[j] or ".map(" in ls[j]):
            return True
    return False


def walk_cpp(name, content):
    out = []
    ls = re.split(r"\r?\n", content)
    while ls and ls[-1] == "":
        ls.pop()
    alloc, alloc_line, alloc_snip, null_vars = False, 0, "", []
    for i, raw in enumerate(ls):
        code = strip(raw)
        if not jtrim(code):
            continue
        if re.search(LR.CPP_ALLOC_RE, code, re.A) and "close" not in code and "free" not in code:
            alloc, alloc_line, alloc_snip = True, i + 1, jtrim(raw)
        if re.search(LR.CPP_CLOSE_RE, code, re.A):
            alloc = False
        m = re.search(LR.CPP_NULL_ASSIGN_RE, code, re.A)
        if m:
            null_vars.append(m.group(1))
        for v in null_vars:
            if (v + "->" in code or "*" + v in code) and not ("if" in code or "!" in code or "==" in code):
                out.append((LR.RULE_NULL, i + 1, jtrim(raw), LR.MSG_CPP_NULL.format(var=v)))
        if in_loop(ls, i) and any(w in code for w in LR.CPP_LOOP_WORDS):
            out.append((LR.RULE_LOOP, i + 1, jtrim(raw), LR.MSG_CPP_LOOP))
    if alloc:
        out.append((LR.RULE_LEAK, alloc_line, alloc_snip, LR.MSG_CPP_LEAK))
    return [(name, *x) for x in out]


files = st.lists(st.lists(st.sampled_from(VOCAB), min_size=1, max_size=25), min_size=1, max_size=4)


@settings(max_examples=12, deadline=None)
@given(fs=files)
def test_cpp_rules_match_walk(spark, fs):
    src = {f"f{i}.cpp": "\n".join(ls) + "\n" for i, ls in enumerate(fs)}
    ln = lines(files_df(spark, src))
    got = Counter()
    for fn in (LR.cpp_leak, LR.cpp_null_deref, LR.cpp_query_in_loop):
        got.update((r.file, r.rule_id, r.line, r.code_snippet, r.message) for r in fn(ln).collect())
    exp = Counter(x for name, c in src.items() for x in walk_cpp(name, c))
    assert got == exp


PY_VOCAB = ['f = open("x")', "f.close()", "with open(p) as g:", "x = None", "x.name", "x[0]", "if x.name:",
            "not x.y", "for i in xs:", "while ok:", "db.execute(q)", "cur.query(1)  # db.", "# comment", "",
            "    y = None", "y.z  # y.", "xy.attr", "print(1)"]
JS_VOCAB = ["let a = null;", "a.run();", "a?.run();", "if (a) a.run();", "var b = undefined;", "b.x && y;",
            "typeof b.x;", "c = null", "c.go()", "for (const i of xs) {", "while (ok) {", "await load(i);",
            "fetch(u);", "db.save(r);", "// fetch(1)", "}", "", "xs.forEach(f);", "q ? a.b : 1;"]


def walk_generic(name, content, lang):
    out = []
    ls = re.split(r"\r?\n", content)
    while ls and ls[-1] == "":
        ls.pop()
    in_with, has_open, open_line, open_snip, null_vars = False, False, 0, "", []
    for i, raw in enumerate(ls):
        if lang == "py":
            k = raw.find("#")
            code = raw[:k] if k >= 0 else raw
        else:
            code = strip(raw)
        if not jtrim(code):
            continue
        if lang == "py":
            if re.search(LR.PY_WITH_OPEN_RE, code):
                in_with = True
            if re.search(r"open\(", code) and not in_with and ".close()" not in code:
                has_open, open_line, open_snip = True, i + 1, jtrim(raw)
            if ".close()" in code:
                has_open = False
            m = re.search(LR.PY_NULL_ASSIGN_RE, code, re.A)
            if m:
                null_vars.append(m.group(1))
            for v in null_vars:
                if (v + "." in code or v + "[" in code) and not (
                        "if" in code or "is not None" in code or "not " + v in code):
                    out.append((LR.RULE_NULL, i + 1, jtrim(raw), LR.MSG_PY_NULL.format(var=v)))
            if in_loop(ls, i) and any(w in code for w in LR.PY_LOOP_WORDS):
                out.append((LR.RULE_LOOP, i + 1, jtrim(raw), LR.MSG_PY_LOOP))
        else:
            m = re.search(LR.JS_NULL_ASSIGN_RE, code, re.A)
            if m:
                null_vars.append(m.group(2))
            for v in null_vars:
                if v + "." in code and v + "?." not in code and "typeof" not in code:
                    if not ("if" in code or "&&" in code or "?" in code):
                        out.append((LR.RULE_NULL, i + 1, jtrim(raw), LR.MSG_JS_NULL.format(var=v)))
            if in_loop(ls, i) and any(w in code for w in LR.JS_LOOP_WORDS):
                out.append((LR.RULE_LOOP, i + 1, jtrim(raw), LR.MSG_JS_LOOP))
    if lang == "py" and has_open and not in_with:
        out.append((LR.RULE_LEAK, open_line, open_snip, LR.MSG_PY_LEAK))
    return [(name, *x) for x in out]


@settings(max_examples=10, deadline=None)
@given(py=st.lists(st.lists(st.sampled_from(PY_VOCAB), min_size=1, max_size=20), min_size=1, max_size=3),
       js=st.lists(st.lists(st.sampled_from(JS_VOCAB), min_size=1, max_size=20), min_size=1, max_size=3))
def test_py_js_rules_match_walk(spark, py, js):
    src = {f"p{i}.py": "\n".join(ls) + "\n" for i, ls in enumerate(py)}
    src.update({f"j{i}.ts": "\n".join(ls) + "\n" for i, ls in enumerate(js)})
    ln = lines(files_df(spark, src))
    got = Counter()
    for fn in (LR.py_leak, LR.py_none_access, LR.py_query_in_loop, LR.js_null_access, LR.js_call_in_loop):
        got.update((r.file, r.rule_id, r.line, r.code_snippet, r.message) for r in fn(ln).collect())
    exp = Counter(x for name, c in src.items()
                  for x in walk_generic(name, c, "py" if name.endswith(".py") else "js"))
    assert got == exp
