"""Java rules J1-J7 re-aimed on the token / scope tables (no AST).

Semantics follow the reference rules; accepted lexical gaps are listed per
rule.  Every rule is a composition of filters, windows (already clustered by
file) and line-keyed containment joins from ``tokens``:

* J1 resource leak: a path of the method from a resource-typed local
  declaration to its end without ``v.close()`` or an escape.
* J2 null dereference: a path from ``v = null`` to a ``v.`` dereference with no
  other definition of v and no null test of v in between.  Both walk the
  statements of the methods that have such names (``paths``).
* J3a/b/c concurrency: fields x name uses ``left_anti`` synchronized blocks,
  ``min`` per (method, field); if-conditions x then-part calls; ``return f;``
  x collection fields.
* J4a/b N+1: loop extents / lambda arguments of map, forEach, flatMap,
  filter x DB calls (range containment), one finding per enclosing loop.
* J5 SQL concatenation: top-level ``+`` argument of a query call.
* J6 hard-coded secret (our own rule, source absent in the reference).
* J7 off-by-one: classic ``for`` whose condition is ``<=`` with a
  ``size()`` / ``length()`` call on the right.

Every rule is reported once per enclosing method declaration, as the
reference walks each method (nested ones included) on its own.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.operators import paths
from revspark.session import cut_by, cut_lineage, written_together
from revspark.operators.tokens import (
    EXPR_KEYWORDS, KEY, LINE_BITS, MODIFIERS, STMT_KEYWORDS, at_token, inside, inside_blocks, nd_before, pairs, render, sized, span_text, tokens,
)

# Rule ids and messages.
R_LEAK, R_NULL, R_CONC = "RULE-001-RESOURCE-LEAK", "RULE-002-NULL-SAFETY", "RULE-003-CONCURRENCY"
R_N1, R_SQL, R_SECRET, R_LOOP = ("RULE-004-NPLUSONE-QUERY", "RULE-005-SQL-INJECTION", "RULE-006-HARDCODED-SECRET",
                                 "RULE-007-LOOP-BOUND")
MSG_LEAK = "Resource '{0}' of type '{1}' is opened but not closed on all exit paths."
MSG_NULL = "Variable '{0}' is dereferenced but it can be null (assigned null at line {1})."
MSG_SHARED = "Shared mutable field '{0}' is accessed without synchronization in concurrent context."
MSG_CTA = "Non-atomic check-then-act operation detected on collection. Use computeIfAbsent or putIfAbsent."
MSG_PUBLISH = "Unsafe publication: private mutable collection field '{0}' is returned directly."
MSG_N1_LOOP = "N+1 Query Hazard: Database query operation is executed inside a loop."
MSG_N1_STREAM = "N+1 Query Hazard: Database query operation is executed inside a stream iteration."
MSG_SQL = ("Potential SQL Injection: Database query is constructed using string concatenation. "
           "Use parameterized queries instead.")
MSG_SECRET = "Hard-coded secret: '{0}' is assigned a string literal; load it from configuration instead."
MSG_LOOP = "Potential off-by-one error: Loop condition uses '<=' with size() or length(). Consider using '<'."

# Word lists of the rules.
RESOURCE_WORDS = ["stream", "reader", "writer", "connection", "socket", "session", "resource", "closeable",
                  "autocloseable", "channel", "zipfile"]
THREAD_SAFE_WORDS = ["Atomic", "Concurrent", "Lock", "ReentrantLock", "Semaphore", "CountDownLatch"]
COLLECTION_PREFIXES = ["List", "Map", "Set", "Collection", "ArrayList", "HashMap", "HashSet"]
LOCK_CALLS = ["lock", "lockInterruptibly", "tryLock"]
CTA_CALLS = ["put", "add", "set", "remove"]
DB_SCOPE_WORDS = ["repository", "dao", "mapper", "manager", "db"]
DB_METHOD_PREFIXES = ["find", "get", "save", "delete", "update", "select", "query", "insert"]
STREAM_CALLS = ["map", "forEach", "flatMap", "filter"]
BODY_KEYWORDS = ["if", "for", "while", "switch", "catch", "synchronized"]
SQL_CALLS = ["executeQuery", "execute", "executeUpdate", "prepareStatement", "query"]
SECRET_NAME_RE = r"(?i)(password|passwd|pwd|secret|api_?key|token)"
# operators binding looser than '+' (a top-level one makes the argument something else)
LOOSER_THAN_PLUS = ["?", ":", "||", "&&", "|", "^", "&", "==", "!=", "<", ">", "<=", ">=", "instanceof", "=",
                    "+=", "-=", "*=", "/=", "->"]
LOOSER_THAN_LE = ["?", ":", "||", "&&", "|", "^", "&", "==", "!=", "=", "+=", "-=", "*=", "/=", "->"]

FINDING_COLS = ["review_id", "rule_id", "severity", "file", "line", "code_snippet", "dataflow_path", "message"]
PATH_TYPE = "array<struct<file:string,line:int,description:string>>"


def pline(c: Column) -> Column:
    return F.shiftright(c, LINE_BITS).cast("int")


def _any(c: Column, words, how="contains") -> Column:
    out = None
    for w in words:
        x = getattr(c, how)(w)
        out = x if out is None else (out | x)
    return out


def _typeish(tok: Column, before: Column, before2: Column) -> Column:
    """A token that can end a type: a word that is no modifier/expression
    keyword, the '>' of type arguments, or the ']' of '[]'.

    A '>' after a capitalised name that follows '<', ',', '.' or a bound, after
    '?', ']' or another '>', or after anything that follows '<', closes type
    arguments; any other is a comparison.  ``before`` and ``before2`` are the
    two tokens in front of ``tok``."""
    word = tok.rlike(r"^[A-Za-z_$]") & ~tok.isin(*MODIFIERS) & ~tok.isin(*EXPR_KEYWORDS)
    argument = before.rlike(r"^[A-Z]") & before2.isin(",", ".", "extends", "super", "&")
    closes = (tok == ">") & (before.isin(">", "]", "?") | argument | (before2 == "<"))
    return F.coalesce(word, F.lit(False)) | F.coalesce(closes, F.lit(False)) | F.coalesce((tok == "]") & (before == "["), F.lit(False))


def _steps(*steps: tuple[Column, str]) -> Column:
    """A dataflow path in the finding's file: (line, description) pairs."""
    return F.array(*[F.struct(F.col("file").alias("file"), line.cast("int").alias("line"), F.lit(text).alias("description"))
                     for line, text in steps])


def _finding(df: DataFrame, rule_id: str, severity: str, line: Column, snippet: Column, message: Column,
             path: Column | None = None) -> DataFrame:
    path = F.lit(None) if path is None else path
    return df.select(
        "review_id", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), "file",
        line.cast("int").alias("line"), snippet.alias("code_snippet"), path.cast(PATH_TYPE).alias("dataflow_path"),
        message.alias("message"))


def _fmt(template: str, *cols: Column) -> Column:
    parts = []
    rest = template
    for i, c in enumerate(cols):
        before, rest = rest.split("{%d}" % i, 1)
        parts += [F.lit(before), c.cast("string")]
    parts.append(F.lit(rest))
    return F.concat(*parts)


#: A written table of more rows is never broadcast.
BROADCAST_ROWS = 2000


def joinable(written: DataFrame) -> DataFrame:
    """A written table for joins.  The planner goes by its compressed size, a small part of what
    a broadcast would take in the driver, so this goes by its rows (counted from the files' footers)."""
    return written.hint("merge") if written.count() > BROADCAST_ROWS else written


class JavaTables:
    """Token-derived tables shared by the rules (built lazily, once)."""

    def __init__(self, files: DataFrame, materialize: bool = True):
        self.materialize = materialize
        self._cache: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
        files, self.partitions = sized(files)
        # in the order that containment by line asks for
        self.t = self._cut(tokens(files, self.partitions), ("line", "pos"))

    def _cut(self, df: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
        """Materialise a shared table once in the checkpoint folder, so the ten
        rules read it instead of recomputing it (and the lineage is cut).  All
        of them are dealt out by file, like the tokens: no join moves or broadcasts them."""
        return cut_by(df, KEY, self.partitions, order).hint("merge") if self.materialize else df

    def _get(self, name, fn):
        # rules are made in several threads, a table by the first that asks for it; no table is made of itself
        with self._locks[name]:
            if name not in self._cache:
                self._cache[name] = self._cut(fn())
        return self._cache[name]

    @property
    def parens(self) -> DataFrame:
        return self._get("parens", lambda: pairs(self.t, "(", ")"))

    @property
    def braces(self) -> DataFrame:
        return self._get("braces", lambda: pairs(self.t, "{", "}"))

    @property
    def lines_text(self) -> DataFrame:
        """Rendered text of each source line (``text_of`` has that of some)."""
        return self._get("lines_text", lambda: _rendered_lines(self.t))

    def text_of(self, rows: DataFrame) -> DataFrame:
        """Rendered text (line_text) of the source lines of ``rows`` (KEY, line)."""
        t = self.t.join(rows.select(*KEY, "line").distinct().hint("merge"), [*KEY, "line"], "left_semi")
        return _rendered_lines(t).hint("merge")

    @property
    def methods(self) -> DataFrame:
        """Method declarations (not constructors): name '(' params ')'
        ['throws' ...] '{' body '}'.  Columns m_open, m_close, m_open_line,
        m_close_line, m_name, m_sync, m_lvl (brace depth of the body)."""
        def build():
            pp = self.parens.filter(
                F.col("p1").rlike(r"^[A-Za-z_$]") & ~F.col("p1").isin(*STMT_KEYWORDS) & _typeish(F.col("p2"), F.col("p3"), F.col("p4"))
                & F.col("c_n1").isin("{", "throws"))
            # body '{': the token after ')' or the next '{' after a throws clause (a window pointer)
            heads = pp.select(*KEY, F.col("p1").alias("m_name"), F.col("p1_pos").alias("name_pos"),
                              F.when(F.col("c_n1") == "{", F.col("c_n1_pos")).otherwise(F.col("c_next_brace"))
                              .alias("b_pos"),
                              # a 'synchronized' modifier in the declaration, after the statement start
                              (F.col("last_sync") > F.col("stmt_start")).alias("m_sync"))
            br = self.braces.select(*KEY, F.col("o_pos").alias("b_pos"), F.col("c_pos").alias("m_close"),
                                    F.col("o_line").alias("m_open_line"), F.col("c_line").alias("m_close_line"),
                                    F.col("lvl").alias("m_lvl"))
            return heads.join(br, [*KEY, "b_pos"]).withColumnRenamed("b_pos", "m_open")
        return self._get("methods", build)

    @property
    def classes(self) -> DataFrame:
        """Class / interface bodies with their concurrency flag."""
        def build():
            # a '{' whose declaration (since the last ; { }) holds a class / interface keyword
            br = self.braces.filter(F.col("last_class_kw") > F.col("stmt_start"))
            names = self.t.select(*KEY, "line", F.col("pos").alias("last_class_kw"), F.col("n1").alias("c_name"))
            c = at_token(br, names, "last_class_kw").select(
                *KEY, "c_name", F.col("last_class_kw").alias("kw_pos"), F.col("o_pos").alias("c_open"),
                F.col("c_pos").alias("c_close"), F.col("o_line").alias("c_open_line"),
                F.col("c_line").alias("c_close_line"), F.col("lvl").alias("c_lvl"),
                F.col("stmt_start").alias("decl_start"),
                (F.col("last_conc_ann") > F.col("stmt_start")).alias("by_ann"),
                ((F.col("last_impl") > F.col("stmt_start")) & (F.col("last_iface") > F.col("last_impl")))
                .alias("by_iface"))
            return c.withColumn("concurrent", F.col("by_ann") | F.col("by_iface")).drop("by_ann", "by_iface")
        return self._get("classes", build)

    @property
    def method_class(self) -> DataFrame:
        """Direct methods of each named class (body one brace level inside)."""
        def build():
            m = self.methods
            c = self.classes.select(*KEY, "c_open", "c_close", "c_open_line", "c_close_line", "c_lvl", "concurrent")
            items = m.select(*KEY, F.col("m_open").alias("pos"), F.col("m_open_line").alias("line"), *[
                x for x in m.columns if x not in KEY])
            j = inside_blocks(items, c, "c_open", "c_close", "c_open_line", "c_close_line")
            return j.filter(F.col("m_lvl") == F.col("c_lvl") + 1).drop("pos", "line")
        return self._get("method_class", build)

    @property
    def calls(self) -> DataFrame:
        """Calls (not declarations, not ``new``): name, receiver text (the
        whole postfix chain before the name, without spaces), start
        position/line of the chain, argument parens."""
        def build():
            named = F.col("p1").rlike(r"^[A-Za-z_$]") & ~F.col("p1").isin(*STMT_KEYWORDS)
            pp = self.parens.filter(named & ((F.col("p2") == ".") | ~_typeish(F.col("p2"), F.col("p3"), F.col("p4"))))
            pp = pp.filter(F.coalesce(F.col("p2"), F.lit("")) != "new")
            t = self.t.select(*KEY, "line", F.col("pos").alias("p1_pos"), F.col("p1").alias("m1"), F.col("chain_start"))
            c = at_token(pp, t, "p1_pos")
            dotted = F.coalesce(F.col("m1") == ".", F.lit(False)) & F.col("chain_start").isNotNull()
            start = F.when(dotted, F.col("chain_start")).otherwise(F.col("p1_pos"))
            c = c.select(*KEY, F.col("p1").alias("name"), F.col("p1_pos").alias("name_pos"),
                         start.alias("call_pos"), pline(start).alias("call_line"),
                         F.col("o_pos").alias("a_open"), F.col("c_pos").alias("a_close"),
                         F.col("o_line").alias("a_open_line"), F.col("c_line").alias("a_close_line"),
                         F.col("lvl").alias("a_lvl"))
            spans = c.filter("call_pos < name_pos").select(*KEY, "call_pos", "name_pos", F.col("call_line").alias("l0"),
                                                           pline(F.col("name_pos")).alias("l1"))
            toks = inside(self.t.select(*KEY, "line", "pos", "tok"), spans.withColumn("c0", F.col("call_pos") - 1),
                          "c0", "name_pos", "l0", "l1")
            text = toks.groupBy(*KEY, "name_pos").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("_t"))
            # the last token is the dot before the name
            recv = F.array_join(F.transform(F.slice("_t", 1, F.size("_t") - 1), lambda x: x.getField("tok")), "")
            return c.join(text.select(*KEY, "name_pos", recv.alias("receiver")), [*KEY, "name_pos"], "left") \
                .withColumn("receiver", F.coalesce("receiver", F.lit("")))
        return self._get("calls", build)

    @property
    def scopes(self) -> DataFrame:
        """Every brace block with its kind (class, method, lambda, a
        statement keyword, array or block) and the name of a class or method."""
        def build():
            b = self.braces.withColumn("prev_pos", F.col("p1_pos"))
            closers = self.parens.select(*KEY, F.col("c_pos").alias("prev_pos"), F.col("p1").alias("head"))
            b = b.join(closers, [*KEY, "prev_pos"], "left")
            m = self.methods.select(*KEY, F.col("m_open").alias("o_pos"), "m_name")
            c = self.classes.select(*KEY, F.col("c_open").alias("o_pos"), "c_name")
            b = b.join(m, [*KEY, "o_pos"], "left").join(c, [*KEY, "o_pos"], "left")
            kind = (F.when(F.col("c_name").isNotNull(), F.lit("class")).when(F.col("m_name").isNotNull(), F.lit("method"))
                    .when(F.col("p1") == "->", F.lit("lambda")).when(F.col("p1").isin("else", "do", "try", "finally"), F.col("p1"))
                    .when(F.col("head").isin(*BODY_KEYWORDS, "try"), F.col("head"))
                    .when(F.col("p1").isin("=", "]"), F.lit("array")).otherwise(F.lit("block")))
            return b.select(*KEY, F.col("o_pos").alias("open_pos"), F.col("c_pos").alias("close_pos"), F.col("o_line").alias("open_line"),
                            F.col("c_line").alias("close_line"), F.col("lvl").alias("depth"), kind.alias("kind"),
                            F.coalesce("c_name", "m_name").alias("name"))
        return self._get("scopes", build)

    @property
    def heads(self) -> DataFrame:
        """Control statements with a condition: kw, kw_pos, c_pos (closing
        paren), body_end.  A body is a block, or one statement that goes on
        through directly nested control statements (``for (...) if (...) {...}``)."""
        def build():
            h = self.parens.filter(F.col("p1").isin(*BODY_KEYWORDS)).filter(
                ~((F.col("p1") == "while") & (F.col("p2") == "}") & (F.col("c_n1") == ";")))
            br = self.braces.select(*KEY, F.col("o_pos").alias("c_n1_pos"), F.col("c_pos").alias("blk_end"))
            h = h.join(br, [*KEY, "c_n1_pos"], "left").select(
                *KEY, F.col("p1").alias("kw"), F.col("p1_pos").alias("kw_pos"), "o_pos", "c_pos", "o_line", "c_line", "c_n1", "c_n1_pos",
                F.when(F.col("c_n1") == "{", F.col("blk_end")).when(~F.col("c_n1").isin(*BODY_KEYWORDS), F.col("c_next_semi")).alias("own_end"))
            onward = Window.partitionBy(*KEY).orderBy(F.col("kw_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
            return h.withColumn("body_end", F.last("own_end", ignorenulls=True).over(onward)).drop("own_end")
        return self._get("heads", build)

    @property
    def resources(self) -> DataFrame:
        """J1's resource declarations."""
        return self._get("resources", lambda: _resources(self))

    @property
    def paths(self) -> DataFrame:
        """Leaks and reached dereferences on the paths of each method (``paths.FOUND_DDL``)."""
        def build():
            events = self._cut(_resource_events(self).unionByName(_null_events(self)))
            statements = _statement_rows(self, events.select(*KEY, "m_open").distinct())
            return paths.find_paths(events.unionByName(statements))
        return self._get("paths", build)

    def call_text(self, calls: DataFrame) -> DataFrame:
        """Rendered text of each call from its start to the closing paren."""
        spans = calls.select(*KEY, "call_pos", "a_close", pline(F.col("call_pos")).alias("l0"),
                             pline(F.col("a_close")).alias("l1")).dropDuplicates()
        return span_text(self.t, spans, [*KEY, "call_pos", "a_close"], "call_pos", "a_close", "l0", "l1",
                         out="call_text")

    def in_methods(self, items: DataFrame, pos: str, line: str, direct_only: bool = False) -> DataFrame:
        """Pair items with every enclosing method declaration."""
        m = self.method_class if direct_only else self.methods
        m = m.select(*KEY, "m_open", "m_close", "m_open_line", "m_close_line", "m_name", "m_sync",
                     *(["c_open", "concurrent"] if direct_only else []))
        it = items.withColumnRenamed(pos, "pos").withColumnRenamed(line, "line")
        j = inside_blocks(it, m, "m_open", "m_close", "m_open_line", "m_close_line")
        return j.withColumnRenamed("pos", pos).withColumnRenamed("line", line)

    # ------------------------------------------------------------ fields
    @property
    def fields(self) -> DataFrame:
        """T4: field declarators of each named class: (class, name, type_text, is_final)."""
        def build():
            t = self.t
            cls = self.classes.select(*KEY, "c_open", "c_close", "c_open_line", "c_close_line", "c_lvl", "concurrent")
            # a declarator's name follows its type, or a comma outside type arguments; words of initializers do not
            named = _typeish(F.col("p1"), F.col("p2"), F.col("p3")) | F.coalesce((F.col("p1") == ",") & (F.col("angle") == 0), F.lit(False))
            cand = t.filter((F.col("kind") == "id") & F.col("n1").isin("=", ";", ",") & named & (F.col("angle") == 0)
                            & (nd_before(t) == F.col("bd")) & (F.col("nd") == F.col("bd")))
            cand = cand.select(*KEY, "pos", "line", "bd", "stmt_start")
            j = inside_blocks(cand, cls, "c_open", "c_close", "c_open_line", "c_close_line").filter(
                F.col("bd") == F.col("c_lvl"))
            spans = self._cut(j.select(*KEY, "c_open", "concurrent", F.col("pos").alias("f_pos"), F.col("line").alias("f_line"),
                                       "stmt_start"))
            # declaration tokens from the statement start to the name
            toks = t.select(*KEY, "line", "pos", "tok", "p1")
            sp = spans.select(*KEY, "f_pos", "stmt_start", pline(F.col("stmt_start")).alias("l0"),
                              F.col("f_line").alias("l1"))
            sp = sp.withColumn("l0", F.greatest(F.col("l0"), F.lit(1)))
            d = inside(toks, sp, "stmt_start", "f_pos", "l0", "l1")
            keep = ~F.col("tok").isin(*MODIFIERS) & (F.col("tok") != "@") & ~F.coalesce(F.col("p1") == "@", F.lit(False))
            g = d.groupBy(*KEY, "f_pos").agg(
                F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "tok")))).alias("_t"),
                F.max(F.col("tok") == "final").alias("is_final"))
            g = g.select(*KEY, "f_pos", F.array_join(F.transform("_t", lambda s: s.getField("tok")), "")
                         .alias("type_text"), F.coalesce("is_final", F.lit(False)).alias("is_final"))
            names = t.select(*KEY, "line", F.col("pos").alias("f_pos"), F.col("tok").alias("f_name"))
            return at_token(spans.join(g, [*KEY, "f_pos"]), names, "f_pos")
        return self._get("fields", build)

    @property
    def mutable_fields(self) -> DataFrame:
        f = self.fields
        safe = _any(F.col("type_text"), THREAD_SAFE_WORDS)
        return f.filter(~F.col("is_final") & ~safe)


def _rendered_lines(t: DataFrame) -> DataFrame:
    g = t.groupBy(*KEY, "line").agg(F.array_sort(F.collect_list(F.struct("idx", "tok"))).alias("_t"))
    return g.select(*KEY, "line", render("_t").alias("line_text"))


# ------------------------------------------------------------------ J1

def _declarators(jt: JavaTables) -> DataFrame:
    """Local variable declarators inside method bodies: name, type text,
    initializer start, in try-with-resources header or not."""
    t = jt.t
    cand = t.filter((F.col("kind") == "id") & F.col("n1").isin("=", ";", ",") & _typeish(F.col("p1"), F.col("p2"), F.col("p3"))
                    & ~F.coalesce(F.col("p1").isin("."), F.lit(False)))
    cand = cand.select(*KEY, "pos", "line", "stmt_start", "n1", "next_semi", "nd", "bd", "p1")
    return jt.in_methods(cand, "pos", "line")


def _resources(jt: JavaTables) -> DataFrame:
    """Resource-typed local declarations outside try headers: d_pos, var, type_text and the innermost method."""
    t = jt.t
    dec = _declarators(jt)
    # innermost method only (the declaration belongs to one method body)
    w = Window.partitionBy(*KEY, "pos").orderBy(F.col("m_open").desc())
    dec = jt._cut(dec.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r"))
    # type text: tokens from the statement start (or the '(' of a header) up to the name
    toks = t.select(*KEY, "line", "pos", "tok", "p1")
    sp = dec.select(*KEY, F.col("pos").alias("d_pos"), "stmt_start",
                    F.greatest(pline(F.col("stmt_start")), F.lit(1)).alias("l0"), F.col("line").alias("l1"))
    d = inside(toks, sp, "stmt_start", "d_pos", "l0", "l1")
    keep = ~F.col("tok").isin(*MODIFIERS) & (F.col("tok") != "@") & ~F.coalesce(F.col("p1") == "@", F.lit(False))
    # a try-with-resources header: the declaration follows 'try (' in the same statement
    g = d.groupBy(*KEY, "d_pos").agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "tok")))).alias("_t"),
        F.max(F.col("tok") == "try").alias("in_twr"))
    g = g.select(*KEY, "d_pos", F.transform("_t", lambda s: s.getField("tok")).alias("_toks"),
                 F.coalesce("in_twr", F.lit(False)).alias("in_twr"))
    # the type is what follows the last '(' of the header (for 'try (' / 'for (')
    g = g.withColumn("_idx", F.array_position(F.reverse("_toks"), "("))
    g = g.withColumn("type_toks", F.when(F.col("_idx") > 0, F.slice("_toks", F.size("_toks") - F.col("_idx") + 2,
                                                                     F.col("_idx"))).otherwise(F.col("_toks")))
    g = g.withColumn("type_text", F.array_join("type_toks", ""))
    res = dec.select(*KEY, F.col("pos").alias("d_pos"), "line", "m_open", "m_close", "m_close_line",
                     "next_semi").join(g.select(*KEY, "d_pos", "type_text", "in_twr"), [*KEY, "d_pos"])
    res = res.filter(_any(F.lower(F.col("type_text")), RESOURCE_WORDS) & ~F.col("in_twr"))
    names = t.select(*KEY, "line", F.col("pos").alias("d_pos"), F.col("tok").alias("var"))
    return at_token(res, names, "d_pos")


def _resource_events(jt: JavaTables) -> DataFrame:
    """Openings, and closes and escapes of the names opened in their method."""
    t = jt.t
    res = jt.resources
    names = res.select(*KEY, "m_open", "var").distinct()
    # closes: v.close() with receiver text exactly v
    closes = jt.calls.filter((F.col("name") == "close")).select(*KEY, F.col("receiver").alias("var"),
                                                                  F.col("name_pos").alias("x_pos"))
    # escapes: 'return' expression text containing v; assignment of text containing v to a field
    rets = t.filter((F.col("tok") == "return") & (F.col("n1") != ";")).select(
        *KEY, F.col("pos").alias("x_pos"), "next_semi", F.col("line").alias("l0"), pline(F.col("next_semi")).alias("l1"))
    assign = t.filter(F.col("tok").isin("=", "+=", "-=", "*=", "/=") & (F.col("p1").rlike(r"^[A-Za-z_$]")) & (
        (F.col("p2") == ".") | ((F.col("p2") != ".") & (F.col("p1").startswith("field") | F.col("p1").rlike(r"^[A-Z]")))))
    asg = assign.select(*KEY, F.col("pos").alias("x_pos"), "next_semi", F.col("line").alias("l0"),
                        pline(F.col("next_semi")).alias("l1"))
    # the expression starts after the keyword or operator, which is where the escape counts: inside its statement
    spans = rets.unionByName(asg).withColumn("v0", F.col("x_pos") + 1)
    escapes = span_text(t, spans, [*KEY, "x_pos"], "v0", "next_semi", "l0", "l1", out="x_text").withColumn("x_pos", F.col("x_pos") + 1)
    # closes and escapes are keyed by every method enclosing them: the tests below stay inside one method
    cm = jt.in_methods(closes.withColumn("c_line", pline(F.col("x_pos"))), "x_pos", "c_line").select(*KEY, "m_open", "var", "x_pos")
    em = jt.in_methods(escapes.withColumn("e_line", pline(F.col("x_pos"))), "x_pos", "e_line").select(*KEY, "m_open", "x_pos", "x_text")
    ended = cm.join(names, [*KEY, "m_open", "var"], "left_semi").unionByName(
        em.join(names, [*KEY, "m_open"]).filter(F.col("x_text").contains(F.col("var"))).drop("x_text"))
    return _event(res.withColumnRenamed("d_pos", "pos"), "open").unionByName(_event(ended.withColumnRenamed("x_pos", "pos"), "close"))


def _event(df: DataFrame, kind: Column | str) -> DataFrame:
    """A row of ``paths.ROWS_DDL``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(*KEY, "m_open", "pos", kind.alias("kind"), "var", F.lit(-1).cast("long").alias("at"))


def _null_events(jt: JavaTables) -> DataFrame:
    """Definitions, dereferences and null tests of the names that a method sets to null."""
    t = jt.t
    defs = t.filter((F.col("kind") == "id") & (F.col("n1") == "=") & ~F.coalesce(F.col("p1") == ".", F.lit(False))) \
        .select(*KEY, F.col("tok").alias("var"), "pos", "line",
                ((F.col("n2") == "null") & F.col("n3").isin(";", ",", ")")).alias("is_null"))
    uses = t.filter((F.col("kind") == "id") & (F.col("n1") == ".") & F.col("n2").rlike(r"^[A-Za-z_$]")
                    & ~F.coalesce(F.col("p1") == ".", F.lit(False))) \
        .select(*KEY, F.col("tok").alias("var"), "pos", "line")
    # innermost method of each event
    w = Window.partitionBy(*KEY, "pos").orderBy(F.col("m_open").desc())
    own = lambda df: jt.in_methods(df, "pos", "line").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    dm = jt._cut(own(defs).select(*KEY, "m_open", "var", "pos", "is_null"))
    names = dm.filter("is_null").select(*KEY, "m_open", "var").distinct()
    at = [*KEY, "m_open", "var"]
    # conditions that are exactly  v op null  (3 tokens between the parens)
    nullness = F.when(F.col("n3") == "null", F.col("n1")).when(F.col("n1") == "null", F.col("n3"))
    cond = t.filter((F.col("tok") == "(") & (F.col("p1") == "if") & F.col("n2").isin("==", "!=")).select(
        *KEY, F.col("pos").alias("o_pos"), nullness.alias("var"), F.col("n2").alias("op"))
    tests = jt.heads.filter(F.col("kw") == "if").join(cond, [*KEY, "o_pos"]).filter(F.col("var").isNotNull())
    fourth = t.select(*KEY, "line", F.col("pos").alias("o_pos"), F.lead("pos", 4).over(Window.partitionBy(*KEY).orderBy("line", "pos")).alias("_c4"))
    tests = at_token(tests, fourth, "o_pos").filter(F.col("_c4") == F.col("c_pos")).select(*KEY, "var", "op", F.col("c_pos").alias("pos"), F.col("c_line").alias("line"))
    tests = jt.in_methods(tests, "pos", "line")
    return (_event(dm.join(names, at, "left_semi"), F.when(F.col("is_null"), "null").otherwise("set"))
            .unionByName(_event(own(uses).join(names, at, "left_semi"), "use"))
            .unionByName(_event(tests.join(names, at, "left_semi"), F.when(F.col("op") == "!=", "ne").otherwise("eq"))))


def _statement_rows(jt: JavaTables, methods: DataFrame) -> DataFrame:
    """Keywords, brackets and statement ends inside ``methods`` (KEY, m_open)."""
    t = jt.t.filter(F.col("tok").isin(*paths.WORDS, "{", "}", ";")).select(*KEY, "pos", "line", "tok", "p1", "p1_pos")
    heads = jt.parens.filter(F.col("p1").isin(*BODY_KEYWORDS, "try")).select(*KEY, F.col("p1_pos").alias("pos"), "c_pos")
    bare = F.coalesce(F.col("p1").isin("{", "}", ";", ":"), F.lit(True))
    at = F.when((F.col("tok") == "{") & ~bare, F.col("p1_pos")).otherwise(F.coalesce("c_pos", F.lit(-1)))
    spans = jt.methods.join(methods, [*KEY, "m_open"], "left_semi").select(*KEY, "m_open", "m_close", "m_open_line", "m_close_line")
    rows = t.join(heads, [*KEY, "pos"], "left").select(
        *KEY, "pos", "line", F.col("tok").alias("kind"), F.when((F.col("tok") == "if") & (F.col("p1") == "else"), "else").alias("var"), at.cast("long").alias("at"))
    return inside(rows, spans, "m_open", "m_close", "m_open_line", "m_close_line").select(*KEY, "m_open", "pos", "kind", "var", "at")


def resource_leaks(jt: JavaTables) -> DataFrame:
    """A path from the declaration to the method's end without a close or an escape."""
    found = jt.paths.filter(F.col("what") == "leak").select(*KEY, "m_open", F.col("pos").alias("d_pos"))
    leak = jt.resources.join(found, [*KEY, "m_open", "d_pos"], "left_semi")
    # snippet: declarator text from the name to the end of the initializer
    ends = leak.select(*KEY, "d_pos", "next_semi", F.col("line").alias("l0"), pline(F.col("next_semi")).alias("l1"))
    decl_text = span_text(jt.t, ends.withColumn("e", F.col("next_semi") - 1), [*KEY, "d_pos"], "d_pos", "e", "l0", "l1",
                          out="snip")
    out = leak.join(decl_text, [*KEY, "d_pos"], "left")
    return _finding(out, R_LEAK, "ERROR", F.col("line"), F.col("snip"),
                    _fmt(MSG_LEAK, F.col("var"), F.col("type_text")),
                    _steps((F.col("line"), "resource opened"), (F.col("m_close_line"), "method ends with the resource open")))


# ------------------------------------------------------------------ J2

def null_derefs(jt: JavaTables) -> DataFrame:
    """A null definition that reaches a dereference on a path past no guard; one finding per (line, name) of a method."""
    hit = jt.paths.filter(F.col("what") == "null").withColumns({"line": pline(F.col("pos")), "def_line": pline(F.col("def_pos"))})
    keep = hit.groupBy(*KEY, "m_open", "line", "var").agg(F.min("def_line").alias("def_line"))
    out = keep.join(jt.text_of(keep), [*KEY, "line"], "left")
    return _finding(out, R_NULL, "ERROR", F.col("line"), F.col("line_text"),
                    _fmt(MSG_NULL, F.col("var"), F.col("def_line")),
                    _steps((F.col("def_line"), "null assigned"), (F.col("line"), "dereferenced")))


# ------------------------------------------------------------------ J3

def shared_field_access(jt: JavaTables) -> DataFrame:
    """First unsynchronised use per (method, field) in concurrent classes."""
    t = jt.t
    uses = t.filter((F.col("kind") == "id") & ~F.coalesce(F.col("p1").isin(".", "@"), F.lit(False))
                    & ~F.coalesce(F.col("n1").isin("(", "->"), F.lit(False))
                    & ~(_typeish(F.col("p1"), F.col("p2"), F.col("p3")) & F.col("n1").isin("=", ";", ",", ")", ":"))) \
        .select(*KEY, F.col("tok").alias("f_name"), "pos", "line")
    um = jt.in_methods(uses, "pos", "line", direct_only=True).filter(F.col("concurrent") & ~F.col("m_sync"))
    locks = jt.calls.filter(F.col("name").isin(*LOCK_CALLS)).select(*KEY, F.col("name_pos").alias("pos"),
                                                                     F.col("call_line").alias("line"))
    lm = jt.in_methods(locks, "pos", "line").select(*KEY, "m_open").distinct()
    um = um.join(lm, [*KEY, "m_open"], "left_anti")
    fields = jt.mutable_fields.select(*KEY, "c_open", "f_name")
    um = jt._cut(um.join(fields, [*KEY, "c_open", "f_name"], "left_semi"))
    # not inside a synchronized (...) { } block
    sync = jt.parens.filter(F.col("p1") == "synchronized").select(*KEY, F.col("c_n1_pos").alias("b_pos"))
    blocks = jt.braces.select(*KEY, F.col("o_pos").alias("b_pos"), "c_pos", "o_line", "c_line").join(
        sync, [*KEY, "b_pos"])
    in_sync = inside_blocks(um.select(*KEY, "pos", "line"), blocks, "b_pos", "c_pos", "o_line", "c_line") \
        .select(*KEY, "pos").distinct()
    um = um.join(in_sync, [*KEY, "pos"], "left_anti")
    first = um.groupBy(*KEY, "m_open", "f_name").agg(F.min(F.struct("pos", "line")).alias("u"))
    first = first.select(*KEY, "f_name", F.col("u.line").alias("line"))
    out = first.join(jt.text_of(first), [*KEY, "line"], "left")
    return _finding(out, R_CONC, "WARNING", F.col("line"), F.col("line_text"), _fmt(MSG_SHARED, F.col("f_name")))


def check_then_act(jt: JavaTables) -> DataFrame:
    """If whose condition mentions containsKey / get / == null and whose
    then-part calls put / add / set / remove."""
    ifs = jt.heads.filter(F.col("kw") == "if").select(
        *KEY, F.col("kw_pos").alias("if_pos"), "o_pos", "c_pos", "o_line", "c_line", F.col("body_end").alias("then_end"))
    cond = span_text(jt.t, ifs.withColumn("a", F.col("o_pos") + 1).withColumn("b", F.col("c_pos") - 1),
                     [*KEY, "if_pos"], "a", "b", "o_line", "c_line", out="cond")
    ifs = ifs.join(cond, [*KEY, "if_pos"]).filter(
        F.col("cond").contains("containsKey") | F.col("cond").contains("get") | F.col("cond").contains("== null"))
    acts = jt.calls.filter(F.col("name").isin(*CTA_CALLS)).select(*KEY, F.col("name_pos").alias("pos"),
                                                                   F.col("call_line").alias("line"))
    spans = ifs.select(*KEY, "if_pos", "cond", "c_pos", "then_end", F.col("c_line").alias("l0"),
                       pline(F.col("then_end")).alias("l1"))
    hit = inside_blocks(acts, spans, "c_pos", "then_end", "l0", "l1").select(*KEY, "if_pos", "cond").distinct()
    hm = jt.in_methods(hit.withColumn("line", pline(F.col("if_pos"))), "if_pos", "line", direct_only=True)
    return _finding(hm, R_CONC, "WARNING", F.col("line"), F.col("cond"), F.lit(MSG_CTA))


def unsafe_publication(jt: JavaTables) -> DataFrame:
    """``return f;`` of a mutable collection field of the class."""
    t = jt.t
    rets = t.filter((F.col("tok") == "return") & (F.col("n2") == ";") & F.col("n1").rlike(r"^[A-Za-z_$]")) \
        .select(*KEY, F.col("n1").alias("f_name"), "pos", "line")
    rm = jt.in_methods(rets, "pos", "line", direct_only=True)
    f = jt.mutable_fields.filter(_any(F.col("type_text"), COLLECTION_PREFIXES, "startswith")) \
        .select(*KEY, "c_open", "f_name")
    hit = rm.join(f, [*KEY, "c_open", "f_name"])
    snip = F.concat(F.lit("return "), F.col("f_name"), F.lit(";"))
    return _finding(hit, R_CONC, "WARNING", F.col("line"), snip, _fmt(MSG_PUBLISH, F.col("f_name")))


# ------------------------------------------------------------------ J4

def _db_calls(jt: JavaTables) -> DataFrame:
    c = jt.calls
    scope = F.lower(F.col("receiver"))
    is_db = (_any(scope, DB_SCOPE_WORDS) | (scope == "em")) & _any(F.lower(F.col("name")), DB_METHOD_PREFIXES,
                                                                     "startswith")
    return c.filter(is_db)


def query_in_loop(jt: JavaTables) -> DataFrame:
    """DB call inside for / while / do (header included), per enclosing loop."""
    t = jt.t
    loops = jt.heads.filter(F.col("kw").isin("for", "while")).select(
        *KEY, F.col("kw_pos").alias("l_pos"), F.col("body_end").alias("l_end"))
    dos = t.filter((F.col("tok") == "do") & (F.col("n1") == "{")).select(*KEY, F.col("pos").alias("l_pos"),
                                                                         F.col("n1_pos").alias("b_pos"))
    dbr = jt.braces.select(*KEY, F.col("o_pos").alias("b_pos"), F.col("c_next_semi").alias("l_end"))
    loops = loops.unionByName(dos.join(dbr, [*KEY, "b_pos"]).select(*KEY, "l_pos", "l_end"))
    loops = loops.filter(F.col("l_end").isNotNull()).withColumn("l0", pline(F.col("l_pos"))) \
        .withColumn("l1", pline(F.col("l_end")))
    calls = _db_calls(jt)
    items = calls.select(*KEY, F.col("name_pos").alias("pos"), F.col("name_pos").alias("n_pos"),
                         F.col("call_line").alias("line"), "call_pos", "a_close")
    hit = inside_blocks(items, loops, "l_pos", "l_end", "l0", "l1")
    hm = jt.in_methods(hit.select(*KEY, "l_pos", "n_pos", "call_pos", "a_close", "line")
                       .withColumnRenamed("line", "c_line"), "l_pos", "c_line")
    hm = hm.withColumn("line", pline(F.col("call_pos")))
    txt = jt.call_text(hm.select(*KEY, "call_pos", "a_close"))
    out = hm.join(txt, [*KEY, "call_pos", "a_close"], "left")
    return _finding(out, R_N1, "WARNING", F.col("line"), F.col("call_text"), F.lit(MSG_N1_LOOP))


def _top_level(jt: JavaTables, calls: DataFrame) -> DataFrame:
    """Tokens directly inside each call's argument list (not nested deeper),
    with the argument number."""
    t = jt.t.select(*KEY, "line", "pos", "tok", "kind", "p1", F.least(nd_before(jt.t), F.col("nd")).alias("ndb"))
    spans = calls.select(*KEY, "name_pos", "a_open", "a_close", "a_open_line", "a_close_line", "a_lvl")
    j = inside(t, spans, "a_open", "a_close", "a_open_line", "a_close_line").filter(F.col("ndb") == F.col("a_lvl"))
    w = Window.partitionBy(*KEY, "name_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return jt._cut(j.withColumn("arg_no", F.coalesce(F.sum(F.when(F.col("tok") == ",", 1)).over(w), F.lit(0))))


def query_in_stream(jt: JavaTables) -> DataFrame:
    """DB call in a lambda argument of map / forEach / flatMap / filter."""
    streams = jt.calls.filter(F.col("name").isin(*STREAM_CALLS))
    top = _top_level(jt, streams)
    arrows = top.filter(F.col("tok") == "->").select(*KEY, "name_pos", "arg_no", F.col("pos").alias("arrow"))
    ends = top.filter(F.col("tok") == ",").select(*KEY, "name_pos", "arg_no", F.col("pos").alias("comma"))
    lam = arrows.join(ends, [*KEY, "name_pos", "arg_no"], "left").join(
        streams.select(*KEY, "name_pos", "a_close"), [*KEY, "name_pos"])
    lam = lam.select(*KEY, "name_pos", "arrow", F.coalesce("comma", "a_close").alias("arg_end")) \
        .withColumn("l0", pline(F.col("arrow"))).withColumn("l1", pline(F.col("arg_end")))
    calls = _db_calls(jt).select(*KEY, F.col("name_pos").alias("pos"), F.col("name_pos").alias("n_pos"),
                                 F.col("call_line").alias("line"), "call_pos", "a_close")
    hit = inside_blocks(calls, lam.withColumnRenamed("name_pos", "s_pos"), "arrow", "arg_end", "l0", "l1")
    hm = jt.in_methods(hit.select(*KEY, "s_pos", "n_pos", "call_pos", "a_close", "line")
                       .withColumnRenamed("line", "c_line"), "s_pos", "c_line")
    hm = hm.withColumn("line", pline(F.col("call_pos")))
    txt = jt.call_text(hm.select(*KEY, "call_pos", "a_close"))
    out = hm.join(txt, [*KEY, "call_pos", "a_close"], "left")
    return _finding(out, R_N1, "WARNING", F.col("line"), F.col("call_text"), F.lit(MSG_N1_STREAM))


# ------------------------------------------------------------------ J5

def sql_concatenation(jt: JavaTables) -> DataFrame:
    """An argument whose top-level operator is a binary '+'."""
    calls = jt.calls.filter(F.col("name").isin(*SQL_CALLS))
    top = _top_level(jt, calls)
    prev_end = F.col("p1").rlike(r"^[\w$\"']") | F.col("p1").isin(")", "]", "++", "--")
    top = top.withColumn("binary_add", F.col("tok").isin("+", "-") & F.coalesce(prev_end, F.lit(False)))
    g = top.groupBy(*KEY, "name_pos", "arg_no").agg(
        F.max(F.col("tok").isin(*LOOSER_THAN_PLUS)).alias("looser"),
        F.max_by("tok", F.when(F.col("binary_add"), F.col("pos"))).alias("last_add"))
    args = g.filter(~F.col("looser") & (F.col("last_add") == "+"))
    hit = args.join(calls, [*KEY, "name_pos"])
    hm = jt.in_methods(hit.withColumn("c_line", F.col("call_line")), "name_pos", "c_line")
    txt = jt.call_text(hm.select(*KEY, "call_pos", "a_close"))
    out = hm.join(txt, [*KEY, "call_pos", "a_close"], "left")
    return _finding(out, R_SQL, "ERROR", F.col("call_line"), F.col("call_text"), F.lit(MSG_SQL))


# ------------------------------------------------------------------ J6

def hardcoded_secrets(jt: JavaTables) -> DataFrame:
    """J6 (our rule): ``name = "literal"`` with a secret-like name, one per
    assignment or declarator, anywhere in the file (fields included)."""
    t = jt.t
    hit = t.filter((F.col("kind") == "id") & (F.col("n1") == "=") & F.col("n2").startswith('"')
                   & F.coalesce(F.col("n3").isin(";", ",", ")"), F.lit(False)) & F.col("tok").rlike(SECRET_NAME_RE))
    snip = F.concat(F.col("tok"), F.lit(" = "), F.col("n2"))
    return _finding(hit, R_SECRET, "ERROR", F.col("line"), snip, _fmt(MSG_SECRET, F.col("tok")))


# ------------------------------------------------------------------ J7

def loop_bound(jt: JavaTables) -> DataFrame:
    """Classic for whose condition is ``x <= y.size()`` / ``.length()``."""
    t = jt.t.select(*KEY, "line", "pos", "tok", F.least(nd_before(jt.t), F.col("nd")).alias("ndb"))
    heads = jt.parens.filter(F.col("p1") == "for").select(*KEY, F.col("p1_pos").alias("f_pos"), "o_pos", "c_pos",
                                                          "o_line", "c_line", "lvl")
    top = inside(t, heads, "o_pos", "c_pos", "o_line", "c_line").filter(F.col("ndb") == F.col("lvl"))
    w = Window.partitionBy(*KEY, "f_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    top = jt._cut(top.withColumn("sec", F.coalesce(F.sum(F.when(F.col("tok") == ";", 1)).over(w), F.lit(0))))
    n_semi = top.groupBy(*KEY, "f_pos").agg(F.sum(F.when(F.col("tok") == ";", 1).otherwise(0)).alias("n_semi"))
    cond = top.filter((F.col("sec") == 1) & (F.col("tok") != ";"))
    g = cond.groupBy(*KEY, "f_pos").agg(
        F.min(F.when(F.col("tok") == "<=", F.col("pos"))).alias("le_pos"),
        F.max(F.col("tok").isin(*LOOSER_THAN_LE)).alias("looser"),
        F.max_by("tok", "pos").alias("last_tok"),
        F.max("pos").alias("last_pos"),
        F.min("pos").alias("first_pos"))
    after = cond.join(g.select(*KEY, "f_pos", "le_pos"), [*KEY, "f_pos"]).filter(F.col("pos") > F.col("le_pos")) \
        .groupBy(*KEY, "f_pos").agg(F.max(~F.col("tok").isin(".", ")", "(") & ~F.col("tok").rlike(r"^[\w$]"))
                                    .alias("other_ops"))
    # the last ')' closes a call named size / length
    pp = jt.parens.select(*KEY, F.col("c_pos").alias("last_pos"), F.col("p1").alias("callee"))
    g = g.join(n_semi, [*KEY, "f_pos"]).join(after.hint("merge"), [*KEY, "f_pos"]).join(pp, [*KEY, "last_pos"], "left")
    hit = g.filter((F.col("n_semi") == 2) & F.col("le_pos").isNotNull() & ~F.col("looser") & ~F.col("other_ops")
                   & (F.col("last_tok") == ")") & F.col("callee").isin("size", "length"))
    spans = hit.select(*KEY, "f_pos", "first_pos", "last_pos", pline(F.col("first_pos")).alias("l0"),
                       pline(F.col("last_pos")).alias("l1"))
    txt = span_text(jt.t, spans, [*KEY, "f_pos"], "first_pos", "last_pos", "l0", "l1", out="cond")
    hm = jt.in_methods(hit.select(*KEY, "f_pos").withColumn("line", pline(F.col("f_pos"))), "f_pos", "line")
    out = hm.join(txt, [*KEY, "f_pos"])
    return _finding(out, R_LOOP, "WARNING", F.col("line"), F.col("cond"), F.lit(MSG_LOOP))


JAVA_RULES = {
    "j1_resource_leak": resource_leaks,
    "j2_null_deref": null_derefs,
    "j3a_shared_field": shared_field_access,
    "j3b_check_then_act": check_then_act,
    "j3c_unsafe_publication": unsafe_publication,
    "j4a_query_in_loop": query_in_loop,
    "j4b_query_in_stream": query_in_stream,
    "j5_sql_concat": sql_concatenation,
    "j6_hardcoded_secret": hardcoded_secrets,
    "j7_loop_bound": loop_bound,
}


def run_java_rules(files: DataFrame) -> DataFrame:
    """All Java rules over ``.java`` files, concatenated (no dedupe)."""
    jt = JavaTables(files)
    return written_together([lambda fn=fn: fn(jt).select(*FINDING_COLS) for fn in JAVA_RULES.values()])
