"""J1 and J2 on paths: the shapes one by one, and random programs against an explicit flow graph."""
import random

from file_tables import files_df

from revspark.operators import java_rules as J

LEAKS = """
    void bothClose(boolean c) { Reader r1 = open(); if (c) { r1.close(); } else { r1.close(); } }
    void oneCloses(boolean c) { Reader r2 = open(); if (c) { r2.close(); } else { log(); } }
    void earlyReturn(boolean bad) { Reader r3 = open(); if (bad) { return; } r3.close(); }
    void earlyThrow(boolean bad) { Reader r4 = open(); if (bad) throw new Error(); r4.close(); }
    void returnAfterClose(boolean bad) { Reader r5 = open(); if (bad) { r5.close(); return; } r5.close(); }
    void chain(int k) { Reader r6 = open(); if (k == 1) r6.close(); else if (k == 2) { r6.close(); } else r6.close(); }
    void chainGap(int k) { Reader r7 = open(); if (k == 1) r7.close(); else if (k == 2) { r7.close(); } }
    void loopClose(int k) { Reader r8 = open(); while (k > 0) { r8.close(); } }
    void doClose(int k) { Reader r9 = open(); do { r9.close(); } while (k > 0); }
    void breakBefore(int k) { Reader r10 = open(); do { if (k == 3) break; r10.close(); } while (k > 0); }
    void inFinally(boolean c) { Reader r11 = open(); try { if (c) return; use(r11); } finally { r11.close(); } }
    void insideTry(boolean c) { try { Reader r12 = open(); if (c) return; r12.close(); } finally { log(); } }
    void thrownToCatch(boolean c) { try { Reader r13 = open(); if (c) throw new Error(); r13.close(); } catch (Error e) { log(); } }
    void inSwitch(int k) { Reader r14 = open(); switch (k) { case 1: r14.close(); break; default: log(); } }
    void handedOut(boolean c) { Reader r15 = open(); if (c) { return wrap(r15); } r15.close(); }
    void deep(boolean a, boolean b) { Reader r16 = open(); if (a) { if (b) { r16.close(); } else { r16.close(); } } else { r16.close(); } }
    void deepGap(boolean a, boolean b) { Reader r17 = open(); if (a) { if (b) { r17.close(); } } else { r17.close(); } }
    void laterSame() { Reader r18 = open(); run(() -> { log(); }); r18.close(); }
    void elseOfLoop(int k) { Reader r19 = open(); for (int i = 0; i < k; i++) if (i == 2) log(); else { return; } r19.close(); }
    void synced(Object o) { Reader r20 = open(); synchronized (o) { r20.close(); } }
    void kept() { Reader r21 = open(); this.field = r21; }
"""
NULLS = """
    int bothSet(boolean c) { String s1 = null; if (c) { s1 = "a"; } else { s1 = "b"; } return s1.length(); }
    int oneSets(boolean c) { String s2 = null; if (c) { s2 = "a"; } else { log(); } return s2.length(); }
    void carried(int k) { String s3 = "a"; for (int i = 0; i < k; i++) { s3.length(); s3 = null; } }
    void notCarried(int k) { String s4 = "a"; for (int i = 0; i < k; i++) { s4.length(); s4 = null; s4 = "b"; } }
    void leftEarly(boolean c) { String s5 = null; if (c) { return; } s5 = "a"; s5.length(); }
    void guarded() { String s6 = null; if (s6 != null) { s6.length(); } }
    void guardedElse() { String s7 = null; if (s7 == null) { log(); } else { s7.length(); } }
    void afterGuard() { String s8 = null; if (s8 != null) { log(); } s8.length(); }
    void leaves() { String s9 = null; if (s9 == null) { throw new Error(); } s9.length(); }
    void inDo(int k) { String t1 = null; do { t1 = "a"; } while (k > 0); t1.length(); }
    void inWhile(int k) { String t2 = null; while (k > 0) { t2 = "a"; } t2.length(); }
    void breaks(int k) { String t3 = null; while (k > 0) { if (k == 3) break; t3 = "a"; t3.length(); } t3.length(); }
    void skips(int k) { String t4 = "a"; for (int i = 0; i < k; i++) { if (i == 3) { t4 = null; continue; } t4.length(); } }
    void caught(boolean c) { String t5 = null; try { if (c) throw new Error(); t5 = "a"; } catch (Error e) { t5.length(); } t5 = "b"; }
    void lastly(boolean c) { String t6 = null; try { if (c) return; t6 = "a"; } finally { t6.length(); } }
    void byCase(int k) { String t7 = null; switch (k) { case 1: t7 = "a"; break; } t7.length(); }
    void started(int k) { for (String t8 = null; k > 0; k--) { t8 = "a"; t8.length(); } }
    void tested(String o) { String t9 = null; if (o == null) { t9 = "a"; } else { t9 = o; } t9.length(); }
"""


def names(df):
    return {r.message.split("'")[1] for r in df.collect()}


def test_shapes(spark):
    src = {"Leaks.java": "class Leaks {" + LEAKS + "}\n", "Nulls.java": "class Nulls {" + NULLS + "}\n"}
    jt = J.JavaTables(files_df(spark, src))
    assert names(J.resource_leaks(jt)) == {"r2", "r3", "r4", "r7", "r8", "r10", "r12", "r13", "r17", "r19"}
    # s3, t4: the null goes round the loop; s8: both ways meet again; t6: the return passes the finally block
    assert names(J.null_derefs(jt)) == {"s2", "s3", "s8", "t2", "t3", "t4", "t5", "t6"}


def test_null_of_the_smallest_line_is_named(spark):
    src = {"A.java": "class A {\n void m(boolean c) {\n  String v = null;\n  if (c) {\n   v = null;\n  }\n  v.length();\n }\n}\n"}
    (r,) = J.null_derefs(J.JavaTables(files_df(spark, src))).collect()
    assert r.line == 7 and "at line 3)" in r.message and [s.line for s in r.dataflow_path] == [3, 7]


def test_unbalanced_files_end_nothing(spark):
    """A file that cannot be read gives what can be read of it; others are untouched."""
    good = "class G {\n void m() {\n  Reader r = open();\n }\n}\n"
    src = {"G.java": good, "B1.java": good.replace("}\n}\n", ""), "B2.java": "} } else { catch ( finally " + good, "B3.java": "class B { void m() { if (", "E.java": ""}
    jt = J.JavaTables(files_df(spark, src))
    assert ("G.java", 3) in {(r.file, r.line) for r in J.resource_leaks(jt).collect()}
    J.null_derefs(jt).collect()


class Program:
    """A random method: its text and, built apart from it, its flow graph."""

    def __init__(self, rng):
        self.rng, self.lines = rng, []
        self.succ, self.info = [], []

    def line(self, text):
        self.lines.append(text)
        return len(self.lines)

    def node(self, **info):
        self.succ.append([])
        self.info.append({"close": False, "defs": [], "use": None, **info})
        return len(self.succ) - 1

    def edge(self, a, b, safe=False):
        self.succ[a].append((b, safe))

    def make(self, depth, loop, size):
        return [self.one(depth, loop) for _ in range(self.rng.randint(0 if depth else 1, size))]

    def one(self, depth, loop):
        kinds = ["close", "null", "set", "use", "log"] * 2 + ["return", "throw"] + (["break", "continue"] if loop else [])
        if depth < 3:
            kinds += ["if", "if", "ne", "eq", "while", "for", "do", "try", "switch", "sync"] * 2
        k = self.rng.choice(kinds)
        if k in ("if", "ne", "eq"):
            return (k, self.make(depth + 1, loop, 3), self.make(depth + 1, loop, 3) if self.rng.random() < 0.6 else None)
        if k in ("while", "for", "do"):
            return (k, self.make(depth + 1, True, 3))
        if k == "try":
            catch = self.make(depth + 1, loop, 2) if self.rng.random() < 0.6 else None
            last = self.make(depth + 1, loop, 2) if catch is None or self.rng.random() < 0.5 else None
            return (k, self.make(depth + 1, loop, 3), catch, last)
        if k in ("switch", "sync"):
            return (k, [x for x in self.make(3, False, 3)])
        return (k,)

    def emit(self, stmts):
        """Text of the statements; every use gets its line into the tree."""
        out = []
        for s in stmts:
            k = s[0]
            if k == "use":
                out.append(("use", self.line("log(v.length());")))
                continue
            if k in ("if", "ne", "eq"):
                self.line({"if": "if (c) {", "ne": "if (v != null) {", "eq": "if (null == v) {"}[k])
                then = self.emit(s[1])
                other = None
                if s[2] is not None:
                    self.line("} else {")
                    other = self.emit(s[2])
                self.line("}")
                out.append((k, then, other))
            elif k in ("while", "for"):
                self.line({"while": "while (c) {", "for": "for (int i = 0; i < n; i++) {"}[k])
                out.append((k, self.emit(s[1])))
                self.line("}")
            elif k == "do":
                self.line("do {")
                out.append((k, self.emit(s[1])))
                self.line("} while (c);")
            elif k == "try":
                self.line("try {")
                body, catch, last = self.emit(s[1]), None, None
                if s[2] is not None:
                    self.line("} catch (Error e) {")
                    catch = self.emit(s[2])
                if s[3] is not None:
                    self.line("} finally {")
                    last = self.emit(s[3])
                self.line("}")
                out.append((k, body, catch, last))
            elif k in ("switch", "sync"):
                self.line("switch (n) { case 1:" if k == "switch" else "synchronized (this) {")
                out.append((k, self.emit(s[1])))
                self.line("}")
            else:
                self.line({"close": "r.close();", "null": "v = null;", "set": 'v = "x";', "log": "log();", "return": "return;", "throw": "throw new Error();",
                           "break": "break;", "continue": "continue;"}[k])
                out.append((k,))
        return out

    def flat(self, stmts):
        for s in stmts:
            yield s
            for x in s[1:]:
                if isinstance(x, list):
                    yield from self.flat(x)

    def closes(self, *parts):
        return any(x[0] == "close" for p in parts if p for x in self.flat(p))

    def build(self, stmts, nxt, ctx):
        """Entry node of the statements, whose end goes to ``nxt``."""
        for s in reversed(stmts):
            nxt = self.build_one(s, nxt, ctx)
        return nxt

    def build_one(self, s, nxt, ctx):
        k = s[0]
        if k in ("if", "ne", "eq"):
            n = self.node()
            self.edge(n, self.build(s[1], nxt, ctx), safe=k == "ne")
            self.edge(n, self.build(s[2] or [], nxt, ctx), safe=k == "eq")
            return n
        if k in ("while", "for"):
            n = self.node()
            self.edge(n, self.build(s[1], n, {**ctx, "break": nxt, "continue": n}))
            self.edge(n, nxt)
            return n
        if k == "do":
            n = self.node()
            top = self.build(s[1], n, {**ctx, "break": nxt, "continue": n})
            self.edge(n, top)
            self.edge(n, nxt)
            return top
        if k == "try":
            _, body, catch, last = s
            after = nxt
            own = dict(ctx, catch=None, last=None)
            if last is not None:
                after = own["last"] = self.node(close=self.closes(last))
                self.edge(after, self.build(last, nxt, ctx))
            if catch is not None:
                own["catch"] = self.node(close=self.closes(catch))
                self.edge(own["catch"], self.build(catch, after, ctx))
            start = self.node(close=self.closes(body, catch, last))
            self.edge(start, self.build(body, after, own))
            return start
        if k in ("switch", "sync"):
            parts = list(self.flat(s[1]))
            n = self.node(close=self.closes(s[1]), defs=[x[0] for x in parts if x[0] in ("null", "set")], use=[x[1] for x in parts if x[0] == "use"])
            self.edge(n, nxt)
            return n
        if k in ("return", "throw", "break", "continue"):
            n = self.node()
            to = ctx["exit"] if k in ("return", "throw") else ctx[k]
            if k == "throw" and ctx["catch"] is not None:
                to = ctx["catch"]
            elif ctx["last"] is not None:
                to = ctx["last"]
            self.edge(n, to)
            return n
        n = self.node(close=k == "close", defs=[k] if k in ("null", "set") else [], use=[s[1]] if k == "use" else None)
        self.edge(n, nxt)
        return n


def random_method(rng, number):
    p = Program(rng)
    p.line(f"void m{number}(boolean c, int n) {{")
    p.line("Reader r = open();")
    p.line("String v = null;")
    tree = p.emit(p.make(0, False, 5))
    p.line("}")
    leave = p.node()
    ctx = {"exit": leave, "catch": None, "last": None, "break": None, "continue": None}
    start = p.build(tree, leave, ctx)
    first = p.node(defs=["null"])
    p.edge(first, start)
    # The exit without a closing node
    seen, todo = set(), [first]
    while todo:
        n = todo.pop()
        if n not in seen and not p.info[n]["close"]:
            seen.add(n)
            todo += [m for m, _ in p.succ[n]]
    leak = leave in seen
    # From each null definition along edges that are not safe, past no other definition
    used = set()
    for d in range(len(p.succ)):
        if "null" in p.info[d]["defs"]:
            seen, todo = set(), [m for m, safe in p.succ[d] if not safe]
            while todo:
                n = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                used.update(p.info[n]["use"] or [])
                if not p.info[n]["defs"]:
                    todo += [m for m, safe in p.succ[n] if not safe]
    return p.lines, leak, used


def test_random_methods_equal_their_flow_graphs(spark):
    rng = random.Random(7)
    src, leaks, uses = {}, set(), set()
    for f in range(12):
        lines = ["class P {"]
        for k in range(25):
            own, leak, used = random_method(rng, k)
            base = len(lines)
            if leak:
                leaks.add((f"P{f}.java", base + 2))
            uses |= {(f"P{f}.java", base + u) for u in used}
            lines += own
        src[f"P{f}.java"] = "\n".join(lines + ["}"]) + "\n"
    jt = J.JavaTables(files_df(spark, src))
    assert {(r.file, r.line) for r in J.resource_leaks(jt).collect()} == leaks
    assert {(r.file, r.line) for r in J.null_derefs(jt).collect()} == uses
    assert len(leaks) > 60 and len(uses) > 60
