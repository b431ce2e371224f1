"""Scans and request intake: S1 source-file scan, S2 supported-file filter,
S3 PR-files payload explode, S4 PR metadata extract, S5 review-request routing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.functions.text import is_supported, jtrim, not_blank

# Request routing.
GITHUB_PR_RE = r"https://github\.com/([^/]+)/([^/]+)/pull/(\d+)"
DEFAULT_FILE_NAME = "PastedCode.java"
ERR_URL_REQUIRED = "GitHub PR URL is required."
ERR_URL_INVALID = "Invalid URL. Expected: https://github.com/owner/repo/pull/123"
ERR_CODE_REQUIRED = "Code is required."
ERR_TYPE = "type must be 'github' or 'code'."
UNKNOWN = "unknown"


def scan_source_dir(spark: SparkSession, path: str, review_id: int = 0) -> DataFrame:
    """S1 on a folder of source files: one row per file with its whole text."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return source_files(df.select(F.lit(review_id).cast("long").alias("review_id"),
                                  F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def source_files(files: DataFrame) -> DataFrame:
    """S1 + S2: keep supported files with non-blank content."""
    return files.filter(is_supported(F.col("file")) & not_blank(F.col("content")))


def explode_pr_files(payloads: DataFrame, key: str = "review_id") -> DataFrame:
    """S3: PR 'files' JSON list -> supported file names (no paging)."""
    arr = F.from_json(F.col("payload"), "array<struct<filename:string>>")
    return payloads.select(key, F.explode(arr).alias("f")).select(key, F.col("f.filename").alias("file")) \
        .filter(is_supported(F.col("file")))


def extract_json_field(body: Column, name: str) -> Column:
    """The first ``"name"`` anywhere in the text; the value is the text
    between the next two double quotes after the key and one more char;
    ``unknown`` when the key is absent or the value is empty."""
    key = f'"{name}"'
    def locate(sub: str, pos: Column) -> Column:
        return F.call_function("locate", F.lit(sub), body, pos.cast("int"))

    idx = locate(key, F.lit(1))                                 # 1-based, 0 = absent
    start0 = locate('"', idx + len(key) + 1)                    # 0-based start of the value
    end1 = locate('"', start0 + 1)                              # 1-based closing quote
    end0 = end1 - 1
    ok = (idx > 0) & (start0 > 0) & (end1 > 0) & (end0 > start0)
    return F.when(ok, body.substr(start0 + 1, end0 - start0)).otherwise(F.lit(UNKNOWN))


def pr_metadata(payloads: DataFrame, key: str = "review_id") -> DataFrame:
    """Head sha and branch from a PR API answer."""
    b = F.col("body")
    return payloads.select(key, extract_json_field(b, "sha").alias("head_sha"),
                           extract_json_field(b, "ref").alias("head_branch"))


def route_requests(requests: DataFrame) -> DataFrame:
    """Github -> (owner, repo, pr_number) from the trimmed URL; code ->
    file name with default; else an error.  One row per request."""
    t = F.col("type")
    url = jtrim(F.col("github_url"))
    owner = F.regexp_extract(url, GITHUB_PR_RE, 1)
    matched = F.coalesce(url.rlike(GITHUB_PR_RE), F.lit(False))
    blank_url = ~not_blank(F.col("github_url"))
    blank_code = ~not_blank(F.col("code"))
    is_gh, is_code = F.coalesce(t == "github", F.lit(False)), F.coalesce(t == "code", F.lit(False))
    # a number that is no int names no pull request
    number = F.regexp_extract(url, GITHUB_PR_RE, 3).try_cast("int")
    matched = matched & number.isNotNull()
    gh_ok = is_gh & ~blank_url & matched
    code_ok = is_code & ~blank_code
    error = (F.when(is_gh & blank_url, F.lit(ERR_URL_REQUIRED))
             .when(is_gh & ~matched, F.lit(ERR_URL_INVALID))
             .when(is_code & blank_code, F.lit(ERR_CODE_REQUIRED))
             .when(~is_gh & ~is_code, F.lit(ERR_TYPE)))
    fname = F.when(not_blank(F.col("file_name")), F.col("file_name")).otherwise(F.lit(DEFAULT_FILE_NAME))
    return requests.select(
        "request_id",
        F.when(gh_ok, F.lit("github")).when(code_ok, F.lit("code")).otherwise(F.lit("error")).alias("route"),
        F.when(gh_ok, owner).alias("owner"),
        F.when(gh_ok, F.regexp_extract(url, GITHUB_PR_RE, 2)).alias("repo"),
        F.when(gh_ok, number).alias("pr_number"),
        F.when(code_ok, fname).alias("file_name"),
        error.alias("error"),
    )
