"""Token and scope tables T1-T4 for the Java rules (no parser).

* T1 ``tokens(review_id, file, line, idx, pos, tok, kind, nd, bd)``:
  comments are blanked per file row (newlines kept, so line numbers hold),
  lines are exploded, and each line is tokenised with one regex.  ``pos`` is
  a file-wide order key (line << 32 | index in line; a string has fewer than
  2 ** 31 lines and tokens, so lines never run into each other).  ``nd`` is the nesting
  depth after the token over ( [ { and ``bd`` the brace depth after it.
* T2 bracket pairs and scopes (method, class, loops, if, synchronized,
  try-with-resources header, lambda);
* T3 calls (name, receiver text, argument parens);
* T4 fields of each class.

Partitioning: the compact file rows are hash-partitioned by (review_id,
file) once, in as many partitions as their size asks for; every window below is partitioned by (review_id, file[, ...]),
so none of them adds an exchange.  Containment tests ("token inside scope")
are equi-joins on (review_id, file, line) after exploding each scope into
the lines it spans (scopes of many lines, for items that few lines have, into
blocks of lines): linear in (tokens x nesting depth) for code of usual line
lengths, quadratic in a line that holds very many scopes.  These joins are
sort-merge joins: the planner knows neither the exploded rows nor the
uncompressed size, and would send them through the driver.  What they give
keeps that hint for the joins after (receivers, type texts, snippets): the sums
of a rule run's broadcasts, each below the planner's limit, fill a driver too.

Regexes avoid nested alternation under ``*`` (java.util.regex recursion) and
look-around, so DuckDB (RE2) runs the same patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.session import cut_lineage

KEY = ["review_id", "file"]
LINE_BITS = 32
#: Bytes of text whose tokens are one partition (a task sorts about 80 bytes for each).
PARTITION_BYTES = 4 << 20
#: Lines of a block: ``inside_blocks`` finds longer spans by block.
BLOCK_LINES = 64

# Lexical patterns.
SPECIAL_RE = (r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|"
              r"\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'")
TOKEN_RE = (r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*'|[A-Za-z_$][\w$]*|\d[\w.]*|"
            r"<=|>=|==|!=|->|&&|\|\||\+\+|--|\+=|-=|\*=|/=|::|[^\s\w]")
# Java words that matter to the rules.
MODIFIERS = ["public", "private", "protected", "static", "final", "abstract", "synchronized", "native",
             "default", "strictfp", "transient", "volatile"]
EXPR_KEYWORDS = ["return", "throw", "else", "case", "do", "assert", "yield", "new", "instanceof"]
STMT_KEYWORDS = ["if", "for", "while", "switch", "catch", "synchronized", "try", "do", "else", "return", "new",
                 "throw", "assert", "super", "this", "finally"]
SPACE_AFTER = ["if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "else", "try", "do", ";"]
# Class markers of the concurrency rule.
CONCURRENT_ANNOTATIONS = ["RestController", "Controller", "Service", "Component", "Repository"]
CONCURRENT_INTERFACES = ["Runnable", "Callable"]
BINOPS = ["<=", ">=", "==", "!=", "&&", "||", "+", "-", "*", "/", "%", "<", ">", "=", "+=", "-=", "*=", "/=",
          "?", ":", "->"]


def blank_comments(content: Column) -> Column:
    """Replace every comment by one space and its newlines; strings stay."""
    pieces = F.split(content, SPECIAL_RE)
    specials = F.concat(F.regexp_extract_all(content, F.lit(SPECIAL_RE), 0), F.array(F.lit("")))
    kept = F.zip_with(pieces, specials, lambda p, s: F.concat(
        p, F.when(s.startswith("/"), F.concat(F.lit(" "), F.regexp_replace(s, r"[^\n]+", ""))).otherwise(s)))
    return F.array_join(kept, "")


def _partitions(files: DataFrame) -> int:
    """Partitions of the token table of ``files`` (..., size): one for each core, more where the texts are longer
    than PARTITION_BYTES each, so that the memory of one task does not grow with the input.  All tables of the Java
    rules are dealt out like that, so it is the number of their files and tasks too."""
    size = files.agg(F.sum("size")).first()[0] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))


def sized(files: DataFrame) -> tuple[DataFrame, int]:
    """The files, written: their texts are made once, their sizes read from the written table; and ``_partitions``."""
    f = cut_lineage(files.select(*KEY, "content").withColumn("size", F.octet_length("content").cast("long")))
    return f, _partitions(f)


def _kind(tok: Column) -> Column:
    return (F.when(tok.startswith('"'), F.lit("str")).when(tok.startswith("'"), F.lit("chr"))
            .when(tok.rlike(r"^[A-Za-z_$]"), F.lit("id")).when(tok.rlike(r"^\d"), F.lit("num"))
            .otherwise(F.lit("op")))


def tokens(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """T1 over files(review_id, file, content)."""
    if not partitions:
        files, partitions = sized(files)
    # the few rows of the files are sorted before they are exploded: the tokens' sort finds one run
    f = files.select(*KEY, "content").repartition(partitions, *KEY).sortWithinPartitions(*KEY)
    f = f.select(*KEY, blank_comments(F.col("content")).alias("clean"))
    ln = f.select(*KEY, F.posexplode(F.split(F.col("clean"), "\n")).alias("l0", "text"))
    t = ln.select(*KEY, (F.col("l0") + 1).cast("int").alias("line"),
                  F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(TOKEN_RE), 0)).alias("idx", "tok"))
    t = t.withColumn("pos", F.shiftleft(F.col("line").cast("long"), LINE_BITS) + F.col("idx")) \
         .withColumn("kind", _kind(F.col("tok")))
    # a neighbouring string literal is its quote only (n2: whole): texts are not carried along nine times
    t = t.withColumn("short", F.when(F.col("kind") == "str", F.lit('"')).otherwise(F.col("tok")))
    # columns of one order are made together: each withColumns is one pass of a window over the rows
    w = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nd_delta = F.when(F.col("tok").isin("(", "[", "{"), 1).when(F.col("tok").isin(")", "]", "}"), -1).otherwise(0)
    bd_delta = F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)
    angle = F.when(F.col("tok") == "<", 1).when(F.col("tok") == ">", -1).otherwise(0)
    wo = Window.partitionBy(*KEY).orderBy("pos")
    t = t.withColumns({
        **{name: F.sum(delta).over(w).cast("int") for name, delta in (("nd", nd_delta), ("bd", bd_delta), ("angle", angle))},
        **{f"p{i}": F.lag("short", i).over(wo) for i in range(1, 6)}, "p1_pos": F.lag("pos", 1).over(wo), "p1_kind": F.lag("kind", 1).over(wo),
        "n1": F.lead("short", 1).over(wo), "n2": F.lead("tok", 2).over(wo), "n3": F.lead("short", 3).over(wo), "n1_pos": F.lead("pos", 1).over(wo)}) \
        .drop("short")
    # statement start: last ; { } before the token (a declaration's first token follows it), and the
    # last position of a few markers before it -- all one growing-frame window pass, linear per file
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tok = F.col("tok")
    ann_name = (F.col("kind") == "id") & (F.col("n1") != ".") & (
        (F.col("p1") == "@") | ((F.col("p1") == ".") & (F.col("p3") == "@"))
        | ((F.col("p1") == ".") & (F.col("p3") == ".") & (F.col("p5") == "@")))
    marks = {
        "stmt_start": tok.isin(";", "{", "}"),
        "last_sync": (tok == "synchronized") & F.coalesce(F.col("n1") != "(", F.lit(True)),
        "last_class_kw": tok.isin("class", "interface") & F.coalesce(F.col("p1") != ".", F.lit(True)),
        "last_conc_ann": F.coalesce(ann_name & tok.isin(*CONCURRENT_ANNOTATIONS), F.lit(False)),
        "last_impl": tok == "implements",
        "last_iface": tok.isin(*CONCURRENT_INTERFACES) & F.coalesce(F.col("p1") != "@", F.lit(True)),
    }
    # angle brackets open since the statement's start: 0 outside a type's arguments
    angle0 = F.last(F.when(tok.isin(";", "{", "}"), F.col("angle")), ignorenulls=True).over(before)
    t = t.withColumns({name: F.coalesce(F.last(F.when(cond, F.col("pos")), ignorenulls=True).over(before), F.lit(-1).cast("long"))
                       for name, cond in marks.items()} | {"angle": F.col("angle") - F.coalesce(angle0, F.lit(0))})
    # next ';' and next '{' after the token: a growing frame over the reversed order stays linear
    after = Window.partitionBy(*KEY).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"next_semi": F.last(F.when(tok == ";", F.col("pos")), ignorenulls=True).over(after),
                       "next_brace": F.last(F.when(tok == "{", F.col("pos")), ignorenulls=True).over(after)})
    # start of the postfix chain (a.b(c).d) that the token belongs to: a token that does not carry one on
    word = (F.col("kind") == "id") & ~tok.isin(*STMT_KEYWORDS, *EXPR_KEYWORDS)
    p1 = F.coalesce(F.col("p1"), F.lit(""))
    after_word = F.coalesce(F.col("p1_kind") == "id", F.lit(False)) & ~p1.isin(*[k for k in STMT_KEYWORDS if k not in ("this", "super")], *EXPR_KEYWORDS)
    carries = (tok.isin(".", ")", "]") | (p1 == ".") | ((tok == "(") & after_word) | ((tok == "[") & (after_word | p1.isin(")", "]")))
               | (word & (p1 == "new")))
    level = Window.partitionBy(*KEY, "lvl").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("lvl", F.least(F.col("nd"), F.col("nd") - nd_delta)) \
         .withColumn("chain_start", F.last(F.when(~carries, F.col("pos")), ignorenulls=True).over(level)) \
         .drop("lvl", "p1_kind", "p5")
    return t


def at_token(rows: DataFrame, t: DataFrame, pos: str) -> DataFrame:
    """``rows`` with the columns of the token at their position ``pos`` (t: KEY, line, ``pos``, ...).

    A position names its line, so this is the join on (KEY, ``pos``); with the line it is in the order that the
    token table is written in, and its rows are not sorted again."""
    line = F.shiftright(F.col(pos), LINE_BITS).cast("int")
    return rows.withColumn("_at_line", line).join(t.withColumnRenamed("line", "_at_line"), [*KEY, "_at_line", pos]).drop("_at_line")


def nd_before(t: DataFrame) -> Column:
    delta = F.when(F.col("tok").isin("(", "[", "{"), 1).when(F.col("tok").isin(")", "]", "}"), -1).otherwise(0)
    return F.col("nd") - delta


def pairs(t: DataFrame, open_tok: str, close_tok: str) -> DataFrame:
    """T2 bracket pairs: (o_pos, o_line, c_pos, c_line) plus the open
    bracket's neighbours.  Opens and closes at the same depth alternate, so
    the next bracket in (file, depth) order after an open is its close."""
    b = t.filter(F.col("tok").isin(open_tok, close_tok)).select(
        *KEY, "pos", "line", "tok", "p1", "p2", "p3", "p4", "p1_pos", "n1", "n1_pos", "next_semi", "next_brace",
        "stmt_start", "last_sync", "last_class_kw", "last_conc_ann", "last_impl", "last_iface",
        F.when(F.col("tok") == open_tok, F.col("nd")).otherwise(F.col("nd") + 1).alias("lvl"))
    w = Window.partitionBy(*KEY, "lvl").orderBy("pos")
    b = b.withColumn("c_tok", F.lead("tok").over(w)).withColumn("c_pos", F.lead("pos").over(w)) \
         .withColumn("c_line", F.lead("line").over(w)).withColumn("c_n1", F.lead("n1").over(w)) \
         .withColumn("c_n1_pos", F.lead("n1_pos").over(w)).withColumn("c_next_semi", F.lead("next_semi").over(w)) \
         .withColumn("c_next_brace", F.lead("next_brace").over(w))
    return b.filter((F.col("tok") == open_tok) & (F.col("c_tok") == close_tok)).select(
        *KEY, F.col("pos").alias("o_pos"), F.col("line").alias("o_line"), "c_pos", "c_line", "lvl",
        "p1", "p2", "p3", "p4", "p1_pos", "n1", "n1_pos", "c_n1", "c_n1_pos", "c_next_semi", "c_next_brace", "stmt_start",
        "last_sync", "last_class_kw", "last_conc_ann", "last_impl", "last_iface")


def by_line(spans: DataFrame, start_line: str, end_line: str) -> DataFrame:
    """Explode each span into the lines it covers (join key for containment)."""
    return spans.withColumn("line", F.explode(F.sequence(F.col(start_line), F.col(end_line))))


def inside(items: DataFrame, spans: DataFrame, lo: str, hi: str, lo_line: str, hi_line: str,
           strict: bool = True) -> DataFrame:
    """Pairs (item, span) with the item's pos inside the span's [lo, hi]; for items
    that every line has, like tokens.

    The exploded spans are never broadcast: their estimated size is that of the
    spans before the explode, as compressed on disk."""
    s = by_line(spans, lo_line, hi_line)
    return _held(items.join(s.hint("merge"), [*KEY, "line"]), lo, hi, strict)


def inside_blocks(items: DataFrame, spans: DataFrame, lo: str, hi: str, lo_line: str, hi_line: str,
                  strict: bool = True) -> DataFrame:
    """``inside`` for items fewer than lines: a span of more than BLOCK_LINES lines
    meets the items of its blocks of lines, not one row per line."""
    is_long = (F.col(hi_line) - F.col(lo_line)) >= BLOCK_LINES
    first, last = (F.when(is_long, F.floor(F.col(c) / BLOCK_LINES)).otherwise(F.col(c)).cast("long") for c in (lo_line, hi_line))
    s = spans.withColumns({"_l0": F.col(lo_line), "_l1": F.col(hi_line), "_long": is_long, "_at": F.explode(F.sequence(first, last))})
    places = F.array(F.struct(F.lit(False).alias("_long"), F.col("line").cast("long").alias("_at")),
                     F.struct(F.lit(True).alias("_long"), F.floor(F.col("line") / BLOCK_LINES).cast("long").alias("_at")))
    i = items.select("*", F.inline(places))
    j = i.join(s.hint("merge"), [*KEY, "_long", "_at"]).filter(F.col("line").between(F.col("_l0"), F.col("_l1")))
    return _held(j, lo, hi, strict).drop("_long", "_at", "_l0", "_l1")


def _held(j: DataFrame, lo: str, hi: str, strict: bool) -> DataFrame:
    cond = (F.col("pos") > F.col(lo)) & (F.col("pos") < F.col(hi)) if strict else \
        (F.col("pos") >= F.col(lo)) & (F.col("pos") <= F.col(hi))
    # held items grow with the text: what is made of them is joined without the driver too
    return j.filter(cond).hint("merge")


def render(toks: str) -> Column:
    """Join the tokens of the array column ``toks`` (structs with ``tok``) as source text: spaces
    around binary operators, after commas and between adjacent words.

    The array is a column of its input, so that looking at the token before is one access: an
    expression would be worked out anew for every token of a line."""
    def piece(x, i):
        tk = x.getField("tok")
        prev = F.element_at(F.col(toks), F.greatest(i, F.lit(1))).getField("tok")
        wordy = prev.rlike(r"^[\w$\"']") & tk.rlike(r"^[\w$\"']")
        spaced = wordy | prev.isin(*SPACE_AFTER) | (tk == "{") | ((prev == ")") & tk.rlike(r"^[\w$]"))
        sep = F.when((i > 0) & spaced, F.lit(" ")).otherwise(F.lit(""))
        body = F.when(tk.isin(*BINOPS), F.concat(F.lit(" "), tk, F.lit(" "))) \
            .when(tk == ",", F.lit(", ")).otherwise(tk)
        return F.concat(sep, body)
    s = F.array_join(F.transform(F.col(toks), piece), "")
    return F.trim(F.regexp_replace(s, " {2,}", " "))


def span_text(t: DataFrame, spans: DataFrame, span_key: list[str], lo: str, hi: str, lo_line: str, hi_line: str,
              out: str = "text") -> DataFrame:
    """Rendered text of the tokens in [lo, hi] for each span (key ``span_key``)."""
    items = t.select(*KEY, "line", "pos", "tok")
    j = inside(items, spans.select(*KEY, *[c for c in span_key if c not in KEY], lo, hi, lo_line, hi_line)
               .withColumnRenamed("line", "_line_"), lo, hi, lo_line, hi_line, strict=False)
    g = j.groupBy(*span_key).agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("_t"))
    return g.select(*span_key, render("_t").alias(out))
