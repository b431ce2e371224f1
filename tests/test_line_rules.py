"""Line rules: goldens on the derived corpus and hand-made edge cases."""
from file_tables import SF01, files_df

from revspark.operators import line_rules as LR
from revspark.operators.lines import lines
from revspark.sources.code_files import code_files

# Counts of a plain sequential walk over code_files at sf0.01 (FIXTURES.md B1).
GOLDEN = {"l1_cpp_leak": 82, "l2_cpp_null_deref": 201, "l3_cpp_query_in_loop": 255, "l4_py_leak": 33,
          "l5_py_none_access": 927, "l6_py_query_in_loop": 165, "l7_js_null_access": 250,
          "l8_js_call_in_loop": 385, "l9_generic_call_in_loop": 563}


def test_goldens_sf001(spark):
    ln = lines(code_files(spark, SF01)).cache()
    for key, fn in LR.LINE_RULES.items():
        assert fn(ln).count() == GOLDEN[key], key


def run(spark, sources, fn):
    return sorted((r.file, r.line, r.message) for r in fn(lines(files_df(spark, sources))).collect())


def test_with_open_silences_python_leak(spark):
    src = {"a.py": "f = open('x')\nwith open('y') as g:\n    pass\n", "b.py": "f = open('x')\nprint(1)\n"}
    assert [r[0] for r in run(spark, src, LR.py_leak)] == ["b.py"]


def test_null_bag_semantics_duplicates(spark):
    # two null assignments of p before the dereference -> two findings (reference keeps duplicates)
    src = {"a.cpp": "T* p = nullptr;\nT* p = NULL;\np->go();\n"}
    out = run(spark, src, LR.cpp_null_deref)
    assert out == [("a.cpp", 3, out[0][2])] * 2


def test_substring_match_and_guards(spark):
    # 'xp->' contains 'p->' (substring semantics); a line with 'if' is a guard
    src = {"a.cpp": "int p = 0;\nxp->go();\nif (p) p->go();\n"}
    assert [r[1] for r in run(spark, src, LR.cpp_null_deref)] == [2]


def test_leak_same_line_alloc_and_delete_is_closed(spark):
    src = {"a.cpp": "T* t = new T(); delete t;\n", "b.cpp": "FILE* f = fopen(\"x\", \"r\");\nfclose(f);\nf = fopen(\"y\", \"r\");\n"}
    assert run(spark, src, LR.cpp_leak) == [("b.cpp", 3, LR.MSG_CPP_LEAK)]


def test_loop_window_is_ten_raw_lines(spark):
    body = "for (i = 0; i < n; i++) {\n" + "\n" * 9 + "db.query(1);\n" + "db.query(2);\n"
    src = {"a.cpp": body}
    # marker on line 1: lines 2..11 are inside, line 12 is not
    assert [r[1] for r in run(spark, src, LR.cpp_query_in_loop)] == [11]


def test_comment_strip_is_blind_to_strings(spark):
    src = {"a.js": "for (const x of xs) {\n  fetch(\"http://x\");\n  // fetch(1)\n}\n"}
    assert [r[1] for r in run(spark, src, LR.js_call_in_loop)] == [2]
