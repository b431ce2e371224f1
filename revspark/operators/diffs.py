"""Unified-diff parse (S6/D1) and diff scoping.

D1 turns each diff text into ``changed_lines(diff_id, file, line)`` with
two-level scans over the exploded diff lines (blocks of lines, then one summary
row per block):

1. current file = last ``diff --git`` header at or before the row (a header
   naming an unsupported file switches tracking off);
2. hunk rows and counted rows (``+`` not ``+++``, or a leading space) while
   a file is tracked;
3. new-file line = start of the last hunk + counted rows since that hunk.

Intended fixes (differ from the reference on purpose): the hunk start is
the first ``+<digits>`` of the ``@@`` line, and inside a hunk a line
starting ``+++`` is added text (``++i;`` added), not a file header.  The reference cuts at the first
comma after the plus sign, which fails when the hunk's context text holds a
comma (``@@ -1 +1 @@ f(a,b)``) and then keeps the old counter.  As in the
reference, the counter is not reset by a new file header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.functions.text import is_supported
from revspark.session import cut_lineage


#: Lines of a diff in one block of the scans.
BLOCK_LINES = 4096


def _carried(rows: DataFrame, keys: list[str], carry: dict[str, Column], lasts: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with what the blocks before hand over.

    Each block gives one summary row: the latest non-null value of every name in
    ``lasts`` and the total of every name in ``sums``.  ``carry`` names expressions
    over a window of the blocks before (``"before"``) in terms of these.  The
    summaries are joined back on the blocks' keys, null keys included."""
    block = [*keys, "block"]
    summary = rows.groupBy(*block).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("pos"))).alias(n) for n in lasts], *[F.sum(n).alias(n) for n in sums])
    for name, value in carry.items():
        summary = summary.withColumn(name, value)
    names = {c: f"_k{k}" for k, c in enumerate(block)}
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    # a summary row per block of every diff grows with the diffs: not broadcast
    return rows.join(summary.select(*block, *carry).withColumnsRenamed(names).hint("merge"), on).drop(*names.values())


def changed_lines(diffs: DataFrame, keys: tuple[str, ...] = ("diff_id",)) -> DataFrame:
    """diffs(*keys, diff_text) -> changed_lines(*keys, file, line), a set.

    ``keys`` must identify one diff text (e.g. diff_id, or review_id).  The
    lines are reduced to what the parse needs, written once, and scanned twice
    in two levels: inside blocks of BLOCK_LINES lines, and over one summary row
    per block.  So one huge diff is many blocks and many tasks."""
    keys = list(keys)
    lines = diffs.select(*keys, F.posexplode(F.split(F.col("diff_text"), "\n")).alias("pos", "l"))
    l = F.col("l")
    parts = F.split(F.regexp_replace(l, " +$", ""), " ")  # like Java split: no trailing empties
    b_path = F.element_at(parts, 4)
    header_file = F.when(b_path.startswith("b/"), F.substring(b_path, 3, 1 << 30)).otherwise(b_path)
    is_git, is_hunk = l.startswith("diff --git "), l.startswith("@@ ")
    header = F.struct(F.when(is_supported(header_file), header_file).alias("f"), F.col("pos").alias("at"))
    rows = cut_lineage(lines.select(
        *keys, "pos", F.floor(F.col("pos") / BLOCK_LINES).cast("int").alias("block"), is_git.alias("is_git"),
        F.when(is_git & (F.size(parts) >= 4), header).alias("header"), F.when(is_hunk, F.col("pos")).alias("hunk"),
        # a number outside int keeps the old counter
        F.when(is_hunk, F.regexp_extract(l, r"\+(\d+)", 1).try_cast("int").cast("long")).alias("start"),
        l.startswith("+").alias("added"), l.startswith("+++").alias("three"), l.startswith(" ").alias("context")))
    here = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    # the file that a line belongs to, and the latest hunk head
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    rows = _carried(rows, keys, {"c_header": last("header", before), "c_hunk": last("hunk", before)}, ["header", "hunk"], [])
    rows = rows.withColumns({"file": F.coalesce(last("header", here), "c_header"), "in_hunk": F.coalesce(last("hunk", here), "c_hunk")})
    tracked = F.col("file.f").isNotNull() & ~F.col("is_git")
    # '+++' is a file header only before the first hunk of the file; inside a hunk it is added text
    text = ~F.col("three") | F.coalesce(F.col("in_hunk") > F.col("file.at"), F.lit(False))
    plus = tracked & F.col("hunk").isNull() & F.col("added") & text
    counted = F.when(plus | (tracked & F.col("hunk").isNull() & F.col("context")), 1).otherwise(0)
    rows = rows.select(*keys, "block", "pos", F.col("file.f").alias("file"), plus.alias("plus"), counted.alias("inc"), F.when(tracked, F.col("start")).alias("start"))

    # the new file's line: the latest hunk's start and what is counted since
    rows = rows.withColumn("cum", F.sum("inc").over(here)).withColumn("base", F.col("start") - F.col("cum"))
    offset = F.coalesce(F.sum("inc").over(before), F.lit(0))
    rows = _carried(rows, keys, {"offset": offset, "c_base": last(F.col("base") - F.col("offset"), before)}, ["base"], ["inc"])
    line = F.col("cum") - 1 + F.coalesce(last("base", here), F.coalesce("c_base", F.lit(0)) + F.col("offset"))
    # counting on past the largest int goes on at the smallest, as int arithmetic does
    line = F.pmod(line + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return rows.withColumn("line", line).filter("plus").select(*keys, "file", F.col("line").cast("int").alias("line")).dropDuplicates()


def changed_files(diffs: DataFrame) -> DataFrame:
    """Supported files named by ``diff --git`` headers, in a set."""
    rows = diffs.select("diff_id", F.explode(F.split(F.col("diff_text"), "\n")).alias("l"))
    parts = F.split(F.regexp_replace(F.col("l"), " +$", ""), " ")
    b_path = F.element_at(parts, 4)
    f = F.when(b_path.startswith("b/"), F.substring(b_path, 3, 1 << 30)).otherwise(b_path)
    return rows.filter(F.col("l").startswith("diff --git ") & (F.size(parts) >= 4)) \
        .select("diff_id", f.alias("file")).filter(is_supported(F.col("file"))).dropDuplicates()


def scope_to_diff(findings: DataFrame, changed: DataFrame | None, key: str = "review_id") -> DataFrame:
    """Keep a finding when its own line, or any step of its dataflow path,
    is a changed line of its review.  ``changed=None`` keeps everything.

    Findings are written once with a row number; one row per (row number,
    place) of its own line and its steps meets the changed lines, and the row
    numbers that do bring their findings back, copies included.  Texts and
    paths are never keys.
    """
    if changed is None:
        return findings
    findings = cut_lineage(findings.withColumn("_row", F.monotonically_increasing_id()))
    own = F.array(F.struct(F.col("file").alias("f"), F.col("line").alias("l")))
    steps = F.transform(F.col("dataflow_path"), lambda s: F.struct(s["file"].alias("f"), s["line"].alias("l")))
    places = findings.select("_row", key, F.explode(F.array_distinct(F.concat(own, F.coalesce(steps, F.array().cast("array<struct<f:string,l:int>>"))))).alias("p"))
    places = places.select("_row", key, F.col("p.f").alias("file"), F.col("p.l").alias("line"))
    # both sides grow with the input, and compressed sizes say little: neither is broadcast
    hit = places.join(changed.select(key, "file", "line").hint("merge"), [key, "file", "line"], "left_semi").select("_row").distinct()
    return findings.join(hit.hint("merge"), "_row", "left_semi").drop("_row")
