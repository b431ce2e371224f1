"""Line table (P3), comment strip (P4), inside-loop flag (P5), blank filter.

``lines(files)`` is a narrow transform: the inside-loop flag is computed on the
array of a file's lines, inside its row, and one ``posexplode`` makes the line
rows.  No window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.functions.text import is_loop_marker, jtrim, not_blank, rule_lang, strip_comments

KEY = ["review_id", "file"]
LOOP_LOOKBACK = 10  # fixed value: previous 10 raw lines


def lines(files: DataFrame) -> DataFrame:
    """files(review_id, file, content) -> lines(review_id, file, lang, line, raw, code, in_loop).

    ``code`` is the comment-stripped text used by the rules; ``raw`` is kept for
    snippets.  ``in_loop`` (P5): one of the ``LOOP_LOOKBACK`` raw lines before
    has a loop marker.  A file is one row, so all of this is local to the row:
    one read, one explode, no exchange.  Lines of blank/null content never appear.
    """
    f = files.filter(not_blank(F.col("content"))).withColumn("lang", rule_lang(F.col("file")))
    f = f.select(*KEY, "lang", _once(F.split(F.col("content"), r"\r?\n")).alias("raws"))
    f = f.select(*KEY, "lang", "raws", _once(F.transform("raws", is_loop_marker)).alias("marks"))

    def line(raw, i):
        before = F.slice(F.col("marks"), F.greatest(i - LOOP_LOOKBACK, F.lit(0)) + 1, F.least(i, F.lit(LOOP_LOOKBACK)))
        return F.struct(raw.alias("raw"), F.exists(before, lambda m: m).alias("in_loop"))

    exploded = f.select(*KEY, "lang", F.posexplode(F.transform("raws", line)).alias("pos", "l"))
    return exploded.select(
        *KEY,
        "lang",
        (F.col("pos") + 1).cast("int").alias("line"),
        F.col("l.raw").alias("raw"),
        strip_comments(F.col("l.raw"), F.col("lang")).alias("code"),
        F.col("l.in_loop").alias("in_loop"),
    )


def _once(value):
    """A generator of one row: its value is computed once and not copied into the lambdas that use it."""
    return F.explode(F.array(value))


def code_lines(ln: DataFrame) -> DataFrame:
    """Only lines whose stripped code is non-blank can report."""
    return ln.filter(not_blank(F.col("code")))


def snippet(raw_col: str = "raw"):
    return jtrim(F.col(raw_col))
