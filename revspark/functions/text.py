"""Column-expression helpers for source text (all JVM-side, codegen-friendly).

Java's ``String.trim()`` strips every char <= U+0020 while Spark's ``trim``
strips spaces only, so the reference's trim is rebuilt with a regex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x00-\x20]"
NON_WS = r"[^\x00-\x20]"

# Supported source suffixes (S2), lower-cased match.
SUPPORTED_EXTS = [
    "java", "cpp", "h", "hpp", "cc", "c", "py", "js", "ts", "jsx", "tsx",
    "go", "rs", "php", "cs", "rb", "swift", "kt", "sh", "sql",
]
SUPPORTED_RE = r"\.(" + "|".join(SUPPORTED_EXTS) + r")$"

# Rule-language dispatch by extension.
CPP_EXTS = ["cpp", "h", "hpp", "cc", "c"]
JS_EXTS = ["js", "ts", "jsx", "tsx"]


def jtrim(c: Column) -> Column:
    """Java ``String.trim()``."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def not_blank(c: Column) -> Column:
    """True when ``c.trim()`` is non-empty (Java semantics); null -> False."""
    return F.coalesce(c.rlike(NON_WS), F.lit(False))


def extension(path: Column) -> Column:
    """Text after the last dot when the dot is not the first char, else ''."""
    return F.regexp_extract(path, r"^.+\.([^.]*)$", 1)


def is_supported(path: Column) -> Column:
    """Lower-cased path ends with one of the supported suffixes; null -> False."""
    return F.coalesce(F.lower(path).rlike(SUPPORTED_RE), F.lit(False))


def rule_lang(path: Column) -> Column:
    """P1: 'java' (exact ``.java`` suffix), 'cpp', 'py', 'js' or 'generic'."""
    ext = F.lower(extension(path))
    return (
        F.when(path.endswith(".java"), F.lit("java"))
        .when(ext.isin(*CPP_EXTS), F.lit("cpp"))
        .when(ext == "py", F.lit("py"))
        .when(ext.isin(*JS_EXTS), F.lit("js"))
        .otherwise(F.lit("generic"))
    )


def prompt_lang(path: Column) -> Column:
    """Language name used in prompts and enrichment lookup."""
    p = F.lower(path)

    def ends(*exts):
        cond = None
        for e in exts:
            c = p.endswith("." + e)
            cond = c if cond is None else (cond | c)
        return F.coalesce(cond, F.lit(False))

    return (
        F.when(ends("cpp", "h", "hpp", "cc", "c"), F.lit("C++"))
        .when(ends("py"), F.lit("Python"))
        .when(ends("js", "jsx"), F.lit("JavaScript"))
        .when(ends("ts", "tsx"), F.lit("TypeScript"))
        .when(ends("go"), F.lit("Go"))
        .when(ends("rs"), F.lit("Rust"))
        .otherwise(F.lit("Java"))
    )


def strip_comments(raw: Column, lang: Column) -> Column:
    """Python cuts at the first '#'; every other language cuts at the
    first '//' or, when there is none, blanks a line whose trimmed text
    starts with '/*' or '*'.  Blind to string literals, as the reference."""
    other = (
        F.when(raw.contains("//"), F.substring_index(raw, "//", 1))
        .when(raw.rlike(r"^[\x00-\x20]*(/\*|\*)"), F.lit(""))
        .otherwise(raw)
    )
    return F.when(lang == "py", F.substring_index(raw, "#", 1)).otherwise(other)


def is_loop_marker(raw: Column) -> Column:
    """P5 marker: trimmed raw line starts with 'for ', 'for(', 'while ',
    'while(' or contains '.forEach' / '.map('."""
    starts = raw.rlike(r"^[\x00-\x20]*(for|while)(\(| [\x00-\x20]*[^\x00-\x20])")
    return starts | raw.contains(".forEach") | raw.contains(".map(")
